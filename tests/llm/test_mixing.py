import os
import random
from collections import Counter

import numpy as np
import pytest

from kgloom.llm.mixing import TOKENIZER, mix, plan, slots_of, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")


def test_slots_are_spread_evenly():
    weights = [0.5, 0.3, 0.15, 0.05]
    source = slots_of(weights, 0, 10_000)
    for start in (0, 137, 5000):
        share = np.bincount(source[start : start + 1000], minlength=4) / 1000
        assert np.abs(share - weights).max() < 0.006
    assert (slots_of(weights, 400, 50) == source[400:450]).all()


def test_plan():
    there, size = plan({"a": 100, "b": 1000, "z": 5}, {"a": (0.4, 2), "b": (0.4, 1), "gone": (0.2, 3)})
    assert there == [("a", 0.5, 200), ("b", 0.5, 1000)] and size == 400 and plan({}, {"a": (1.0, 1)})[1] == 0


def test_mix(spark):
    rng = random.Random(6)
    names = ["big", " BIG ", "small", "Other", None, "middle"]
    documents = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 60))) if rng.random() < 0.97 else None, rng.choices(names, [9, 9, 2, 3, 1, 5])[0], 1) for i in range(600)]
    documents += [(1000, "x " * 30_000, "other", 1), (1001, "", "big", 1)]
    df = spark.createDataFrame(documents, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small ", 0.3, 3), ("middle", 0.1, 2), ("absent", 0.1, 2), ("none", None, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(df, targets, block=64)
    rows, told = mixed.collect(), {r.source: r for r in report.collect()}
    assert set(told) == {"big", "small", "middle", "absent", "other"}
    for source, share in (("big", 5 / 9), ("small", 3 / 9), ("middle", 1 / 9)):
        assert abs(told[source].actual_share - share) < 0.02 and told[source].repeats <= told[source].max_repeats
    assert told["absent"].actual_share == 0 and told["other"].mix_tokens == 0 and told["other"].target_share is None
    uses = Counter(r.doc_id for r in rows)
    assert max(uses.values()) == 3 and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    assert told["small"].mix_tokens == sum(r.n_tokens for r in rows if r.source == "small")
    assert mix(df.limit(0), targets)[0].count() == 0 and mix(df, targets.limit(0))[0].count() == 0


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "hello world" * 20_000), (4, "语" * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] >= 40_000 and got[4] >= 30_000


def test_a_small_repeated_source_meets_its_target(spark):
    rng = random.Random(8)
    documents = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=100)), "small") for i in range(24)] + [(100 + i, "one two three four " * rng.randrange(50, 150), "big") for i in range(400)]
    counts = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(documents, "doc_id long, text string, source string")).collect()}
    spare = 4897 - sum(counts[i] for i in range(24))
    documents.append((99, "one" + " one" * (spare - 1), "small"))
    df = spark.createDataFrame(documents, "doc_id long, text string, source string")
    for share in (0.02, 0.04):  # the second asks for all there is, three times
        mixed, report = mix(df, spark.createDataFrame([("small", share, 3), ("big", 1 - share, 3)], "source string, target_share double, max_repeats int"), block=2048)
        told = {r.source: r for r in report.collect()}
        assert told["small"].available_tokens == 4897
        whole = sum(r.mix_tokens for r in told.values())
        for source, want in (("small", share), ("big", 1 - share)):
            average = told[source].available_tokens / sum(s == source for _, _, s in documents)
            assert abs(told[source].mix_tokens - want * whole) <= average and told[source].repeats <= 3
        sizes = Counter()
        for r in mixed.collect():
            sizes[r.slot] += r.n_tokens
        assert max(sizes.values()) < 2 * 2048 and abs(np.mean(list(sizes.values())) - 2048) < 200
