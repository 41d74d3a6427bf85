import random

from kgloom.operators.ranking import numbered
from kgloom.operators.sequence import chunked, packed_batches, question_answer_pairs, recursive_chunks, sentence_chunks, with_previous, within_budget, wrapped_chunks
from pyspark.sql import functions as F


def test_numbered_over_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.random(), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, v double, i int").repartition(7), ["g"], ["v", "i"], "at").collect()
    for g in ("hot", "a", None):
        part = sorted((r.v, r.i) for r in got if r.g == g)
        assert [(r.v, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r["at"])] == part and sorted(r["at"] for r in got if r.g == g) == list(range(len(part)))


def test_previous_and_pairs(spark):
    roles = ["user", "assistant", "user", "user", "system", "assistant"]
    df = spark.createDataFrame([("c", i, r, "x" * (10 + 10 * i)) for i, r in enumerate(roles)], "c string, t int, role string, content string")
    assert [(r.t, r.prev_t) for r in with_previous(df, ["c"], ["t"], ["t"]).orderBy("t").collect()] == [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert [(r.qa_index, len(r.question), len(r.answer)) for r in question_answer_pairs(df, ["c"], ["t"]).orderBy("qa_index").collect()] == [(0, 10, 20), (1, 40, 60)]
    assert [(r.qa_index) for r in question_answer_pairs(df, ["c"], ["t"], least_answer=30).collect()] == [1]


def test_budget_and_batches(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([4, 0, 6, 1])], "g int, i int, c int")
    assert [r.running for r in within_budget(df, ["g"], ["i"], F.col("c"), 10).orderBy("i").collect()] == [4, 10]
    for costs, cap, base, want in (([300] * 5, 1000, 100, [0, 0, 1, 1, 2]), ([100] * 7, 500, 50, [0, 0, 0, 1, 1, 1, 2]), ([5000], 100, 0, [0])):
        rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(costs)], "g int, i int, c int")
        assert [r.batch for r in packed_batches(rows, ["g"], "i", "c", cap, base).orderBy("i").collect()] == want


def test_chunkers(spark):
    assert sentence_chunks("One two. Three four! Five six?", 20) == ["One two. Three four!", "Five six?"] and sentence_chunks("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and sentence_chunks(None) == []
    assert wrapped_chunks("aa bb cc dddddddd", 5) == ["aa bb", "cc", "dddddddd"] and wrapped_chunks("", 5) == []
    text = "para one is here.\n\npara two is a bit longer than that.\n\n" + "word " * 60 + "y" * 130
    got = recursive_chunks(text, 50, 10)
    assert max(map(len, got)) <= 50 and got[0] == "para one is here." and "y" * 50 in got
    assert [(r.id, r.pos) for r in chunked(spark.createDataFrame([(1, "a. b. c."), (2, None)], "id int, t string"), "id", "t", most=5).collect()] == [(1, 0), (1, 1)]


def test_running_sums_over_tasks(spark):
    from kgloom.operators.ranking import running_sum

    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.choice([1, 2, 5, None])) for i in range(300)]
    got = {(r.g, r.i): r.s for r in running_sum(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), ["g"], ["i"], F.col("v"), "s").collect()}
    sums: dict = {}
    for g, i, v in rows:
        assert got[g, i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
