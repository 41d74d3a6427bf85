import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import parsing as P


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_cleaning(spark):
    raw = "Ｆｕｌｌ <b>Tag</b> ```code\nblock``` see https://a.b/c  cite turn0search3 excited【x】 end  "
    assert one(spark, T.cleaned("x", html=True, citations=True), raw) == "full tag see ex d end"
    assert one(spark, T.cleaned("x"), None) == ""
    assert one(spark, T.preprocessed("x", punctuation=True), "~~~t~~~ a `b` — c! 😀 d") == "a — c d"
    assert one(spark, T.preprocessed("x", cjk=True), "知识图谱分析") == "知识 图谱 分析"
    assert one(spark, T.without_markdown("x"), "> [!note] hint\n![i](u) **bold** [[a|b]] [[c]] [t](u) `x`\n---\n> quote _it_") == "bold b c t quote it"


def test_tokens_and_grams(spark):
    got = one(spark, T.topic_tokens("x"), "The (Graph) of a x k9s /usr/bin/env {a} 图谱 , spark!")
    assert got == ["graph", "x", "k9s", "图谱", "spark"]
    assert one(spark, T.grams(F.split("x", " "), 3), "a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, T.grams(F.split("x", " "), 3), "a") == ["a"]


@pytest.mark.parametrize("value, want", [("12.9", 12), ("x", None), (None, None), (" 7 ", 7), ("1e3", 1000)])
def test_epochs(spark, value, want):
    assert one(spark, T.epoch_seconds("x"), value) == want


def test_other_scalars(spark):
    assert one(spark, T.epoch_of_any_unit("x", 5), "1700000000000") == 1_700_000_000 and one(spark, T.epoch_of_any_unit("x", 5), "no") == 5
    assert one(spark, T.epoch_of_date("x"), "2024-01-02") == one(spark, T.epoch_of_date("x"), "2024/01/02") == 1704153600 and one(spark, T.epoch_of_date("x"), "soon") is None
    assert one(spark, T.json_is_whole("x"), '{"a": [1]}') and not one(spark, T.json_is_whole("x"), '{"a": [1}') and not one(spark, T.json_is_whole("x"), None)
    assert one(spark, T.cluster_number("x"), "cluster_12") == 12 and one(spark, T.token_estimate("x"), "12345") == 2
    assert one(spark, T.jaccard(F.split("x", " "), F.array(F.lit("a"))), "a b") == 0.5 and one(spark, T.jaccard(F.array(), F.array(), 1.0), "a") == 1.0
    a, b = one(spark, T.seeded_vector(8)("x"), "t"), one(spark, T.seeded_vector(8)("x"), "t")
    assert a == b and abs(sum(v * v for v in a) - 1) < 1e-5 and one(spark, T.seeded_vector(4)("x"), None) == [0, 0, 0, 0]


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro text here\n# One\nbody of part one\n### Deep\nshort\n## Two\nbody of part two"), (2, None), (3, "")], "id long, t string")
    assert [(r.id, r.pos, r.heading) for r in P.heading_sections(df, "id", "t").orderBy("pos").collect()] == [(1, 0, None), (1, 1, "One"), (1, 3, "Two")]
    got = P.first_level_sections(df.withColumn("title", F.lit("T")), "id", "t", "title", 5).collect()
    assert [(r.qa_id, r.heading) for r in got] == [("1_0", "One")]
    plain = P.first_level_sections(spark.createDataFrame([(7, "no heading at all, just text", "T")], "id long, t string, title string"), "id", "t", "title").first()
    assert (plain.qa_id, plain.heading) == ("7_0", "T")


def test_front_matter(spark):
    df = spark.createDataFrame([("---\ntitle: \"Hello\"\ndate: 2024-01-02\ntags: [a, 'b']\n---\nBody",), ("no matter",)], "t string")
    a, b = P.front_matter(df, "t").collect()
    assert (a.fm_title, a.fm_created, a.body) == ("Hello", 1704153600, "Body") and b.front == {} and b.body == "no matter"
    assert one(spark, P.bracket_list(F.col("x")), "[a, 'b']") == ["a", "b"]


def test_answers_of_models(spark):
    df = spark.createDataFrame([("- conversation_id=7 | cluster_id=3 | confidence=85%\nconversation_id: 8 | cluster_id: cluster_2\nconversation_id=7 | cluster_id=9\nnoise",)], "t string")
    assert sorted(tuple(r) for r in P.assignment_lines(df, "t").collect()) == [(7, "cluster_3", 0.85), (8, "cluster_2", 1.0)]
    lines = spark.createDataFrame([("PROGRESS:edges:45.5:3:10:12.5",), ("STEP_START:merge",), ("other",)], "t string")
    assert [tuple(r) for r in P.progress_lines(lines, "t").collect()] == [("progress", "edges", 45.5, 3, 10, 12.5), ("start", "merge", None, None, None, None)]
    assert P.extract_json('Sure:\n```json\n{"a": [1, {"b": "}"}]}\n```') == '{"a": [1, {"b": "}"}]}' and P.extract_json("none") is None and P.extract_json(None) is None
    assert [r.json for r in P.extracted(spark.createDataFrame([("x [1] y",), (None,)], "t string"), "t").collect()] == ["[1]", None]
    assert P.resolve_anchor("alpha  beta gamma delta", "beta gamma", "delta") == (7, 23) and P.resolve_anchor("alpha  beta", "alpha beta", "zzz") == (0, 11)
