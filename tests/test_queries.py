import importlib
import os

import pytest

import __spark_entry__
from tests.compare import FOLDER, both

MODULES = [importlib.import_module(m) for m in __spark_entry__._MODULES]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        mine, told = both(spark, QUERIES[name], SQL[name])
        assert mine == told
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0  # what they hold: test_expectations.py


def test_entry(spark):
    assert set(SQL) <= set(QUERIES)
    if os.path.isdir(FOLDER):
        assert __spark_entry__.entry(spark).count() > 0
