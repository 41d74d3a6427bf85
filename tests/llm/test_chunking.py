import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm.chunking import block_texts, cut_texts, longest_stretch, pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!\n\t語。", max_size=200), st.integers(7, 40), st.integers(0, 3))
def test_pieces_cover_the_text(text, limit, overlap):
    found = pieces(text, limit, overlap)
    assert bool(found) == bool(text)
    if not text:
        return
    assert found[0][0] == 0 and found[-1][1] == len(text) and found[-1][2] == "end"
    for (a, b, _), (c, d, _) in zip(found, found[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b, _ in found)
    rebuilt = text[: found[0][1]] + "".join(text[b:d] for (_, b, _), (_, d, _) in zip(found, found[1:]))
    assert rebuilt == text
    assert any(c == "forced" for *_, c in found) == (len(text) > limit and longest_stretch(text) > limit)


def test_strongest_boundary_and_overlap():
    rng = random.Random(3)
    text = "\n\n".join(" ".join("".join(rng.choices("abcdef", k=6)) + rng.choice([".", "", "", ""]) for _ in range(90)) for _ in range(12))
    found = pieces(text)
    assert {c for *_, c in found} == {"paragraph", "end"}
    assert {a[1] - b[0] for a, b in zip(found, found[1:])} == {150}


def test_frames(spark):
    rows = [("a", None), ("b", ""), ("c", " \n\t"), ("d", "x" * 1500 + "  "), ("e", "x" * 1501), ("f", ("word " * 200_000))]
    df = cut_texts(spark.createDataFrame([(k, t, 1) for k, t in rows], "id string, body string, n_chars int"), "body")
    got = {r.id: r for r in df.collect()}
    assert [got[k].n_chars for k in "abcde"] == [0, 0, 0, 1500, 1501]
    assert [[p.cut for p in got[k].pieces] for k in "abcde"] == [[], [], [], ["end"], ["forced", "end"]]
    assert max(len(p.content) for p in got["f"].pieces) <= 1500
    assert cut_texts(df.select("id", "n_chars").limit(0).selectExpr("id", "id as body"), "body").count() == 0


def test_blocks(spark):
    df = spark.createDataFrame([(1, None, '{"blocks": {"block_id": " q ", "raw_text": "hi"}}'), (2, None, None), (3, None, "[1"), (4, None, '{"block_graph": "{\\"blocks\\": [null, {\\"raw_text\\": 3}, {\\"raw_text\\": \\"x\\"}]}"}')], "graph_id long, loaded_at timestamp, block_graph string")
    assert sorted((r.graph_id, r.block_id, r.raw_text) for r in block_texts(df).collect()) == [(1, "q", "hi"), (4, "2", "x")]
