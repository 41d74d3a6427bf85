import os

import pytest

from kgloom.llm.queries import QUERIES, SQL
from tests.compare import FOLDER, both

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        mine, told = both(spark, QUERIES[name], SQL[name])
        assert mine == told
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0  # what they hold: test_expectations.py


def test_terms_match_a_plain_count(spark):
    """Over the whole table, against a count without n-grams."""
    from collections import Counter

    from kgloom.llm.terms import plain_term

    last: dict = {}
    for r in spark.read.parquet(f"{FOLDER}/graph_nodes.parquet").collect():
        if r.id is not None and (r.id not in last or (r.updated_at is not None and (last[r.id].updated_at is None or r.updated_at > last[r.id].updated_at))):
            last[r.id] = r
    seen = Counter(t for r in last.values() for t in {plain_term(k.term) for k in r.keywords or ()} | {plain_term(t) for t in r.top_keywords or ()} if t)
    want = {(t, "common" if n > 0.1 * len(last) else "rare") for t, n in seen.items() if n == 1 or n > 0.1 * len(last)}
    assert {tuple(r) for r in QUERIES["p5_found"](spark, FOLDER).select("term", "mark").collect()} == want
