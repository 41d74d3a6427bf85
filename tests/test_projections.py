from pyspark.sql import functions as F

from kgloom.functions.text import seeded_vector
from kgloom.operators import projections as P


def test_sources(spark):
    schema = "source_id string, title string, pos int, heading string, role string, content string"
    a = spark.createDataFrame([("x y", "t", 0, None, "User", "hi"), ("n/1", "t", 0, "H", None, "text"), ("n/1", None, 1, None, None, None)], schema)
    messages, notes = P.insertion_batch(a)
    assert [tuple(r) for r in messages.collect()] == [("x_y", "t", 0, "user", "hi")] and [r.content for r in notes.orderBy("pos").collect()] == ["# H\n\ntext", "# Untitled\n\n"]
    assert {r.source_id for r in P.merged_sources([a, a]).collect()} == {"src0_x y", "src1_x y", "src0_n/1", "src1_n/1"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.id for r in P.appended(ids("a", "b"), ids("b", "c", "c"), "id").collect()) == ["a", "b", "c"]
    assert {r.k: r.fits for r in P.fits_one_run(spark.createDataFrame([("a",)] * 749 + [("b",)] * 750, "k string"), "k").collect()} == {"a": True, "b": False}
    nodes = spark.createDataFrame([("conv_1",), ("note_1",)], "orig_id string")
    assert {r.orig_id: r.uuid for r in P.filled_ids(nodes, spark.createDataFrame([(0, "u0"), (1, "u1")], "pos int, uuid string")).collect()} == {"conv_1": "u1", "note_1": None}


def test_lookups(spark):
    nodes = spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2")], "id long, orig_id string, cluster string")
    hits = spark.createDataFrame([("a", 9), ("zz", 2), ("zz", 9)], "key string, no long")
    assert [(r.key, r.no, r.cluster) for r in P.looked_up(hits, nodes, "key", "no", ["cluster"]).orderBy("key", "no").collect()] == [("a", 9, "k1"), ("zz", 2, "k2"), ("zz", 9, None)]
    clusters = spark.createDataFrame([("c1", [1, 2])], "cluster string, members array<long>")
    assert {tuple(r) for r in P.read_assignments(spark.createDataFrame([(1, "d")], "node long, cluster string"), clusters).collect()} == {(1, "d"), (2, "c1")}
    assert {(r.id, r.v) for r in P.first_by_id([spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id int, v string")]).collect()} == {(1, "x"), (2, "z")}
    assert [r.name for r in P.names_containing(spark.createDataFrame([("Beta",), ("ALBETA",), ("c",), (None,)], "name string"), "bet", 5).collect()] == ["ALBETA", "Beta"]
    row = spark.createDataFrame([(["Graph index", "x", None, "index"],)], "k array<string>").select(P.matched_keywords(F.col("k"), F.lit("INDEX")).alias("m")).first()
    assert row.m == ["Graph index", "x", "index"]  # x is part of index


def test_types_and_images(spark):
    df = spark.createDataFrame([(1, ["Person", "Zed"], 'see <image page="2" index="1"> and <image page=3 index=0>!')], "id int, types array<string>, t string")
    assert P.localised(df, "types", spark.createDataFrame([("Person", "P")], "name string, local string")).first().types == ["P", "Zed"]
    assert [tuple(r) for r in P.image_tags(df, "id", "t").collect()] == [(1, 0, 2, 1), (1, 1, 3, 0)]
    assert P.with_captions(df, "id", "t", spark.createDataFrame([(2, 1, "A CAT")], "page int, index int, caption string")).first().t == "see A CAT and !"


def test_groups(spark):
    nodes = spark.createDataFrame([(1, "k", ["a", "b"]), (2, "k", ["b"]), (3, "l", None)], "node long, cluster string, terms array<string>")
    edges = spark.createDataFrame([(1, 2, 0.9, True), (2, 3, 0.85, False), (1, 3, 0.1, False)], "source long, target long, weight double, is_intra boolean")
    assert {r.cluster: r.density for r in P.stored_density(nodes, edges).collect()} == {"k": 1.0, "l": 0.0}
    assert {(r.source, r.target): r.shared for r in P.close_pairs_with_words(edges, nodes).collect()} == {(1, 2): ["b"], (2, 3): []}
    rows = [("i", g, t, s) for g, t, s in [(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7), (2, "d", 0.1), (2, "a", 0.2)]]
    picked = P.spread_selection(spark.createDataFrame(rows, "i string, g int, t string, s double"), "i", "g", "t", "s", 3).orderBy("rank").collect()
    assert [r.t for r in picked] == ["a", "b", "d"]
    assert [r.term for r in P.unique_terms(spark.createDataFrame([(1, ["A", "a ", "b", None, " "])], "i int, t array<string>"), "i", "t").orderBy("pos").collect()] == ["A", "b"]
    late = spark.createDataFrame([(1, ["a"] * 700 + ["b"])], "i int, t array<string>")  # repeats take no place of what comes after them
    assert [r.term for r in P.unique_terms(late, "i", "t").orderBy("pos").collect()] == ["a", "b"]
    assert [r.title for r in P.most_significant(spark.createDataFrame([("low", "x"), ("high", "y"), (None, "z"), ("medium", "w")], "level string, title string"), "level").collect()] == ["y", "w", "x"]
    got = P.labelled_groups(spark.createDataFrame([("g", ["a"]), ("h", ["b"]), ("i", None)], "k string, top_keywords array<string>"), spark.createDataFrame([("g", "Z")], "k string, label string"), "k")
    assert {r.k: r.top_keywords for r in got.collect()} == {"g": ["Z", "a"], "h": ["b"], "i": None}
    blocks = spark.createDataFrame([(1, "b1"), (1, "b2"), (1, "b3")], "graph_id long, block_id string")
    assert {r.block_id: r.order_index for r in P.ordered_blocks(blocks, spark.createDataFrame([(1, [["b2", "b1"]])], "graph_id long, paths array<array<string>>")).collect()} == {"b1": 1, "b2": 0, "b3": None}
    text = spark.createDataFrame([("n", " ", ["t"] * 12)], "n string, d string, t array<string>").select(P.profile_text(F.col("n"), F.col("d"), F.col("t")).alias("p")).first().p
    assert text == "n " + " ".join(["t"] * 10)


def test_vector_table(spark, tmp_path):
    table = P.VectorTable(spark, str(tmp_path / "vectors"))
    assert table.count() == 0
    schema = "id string, cluster_id string, vector array<double>, version bigint"
    table.upsert(spark.createDataFrame([("a", "k", [1.0, 0.0], 1), ("b", "k", [0.0, 1.0], 1)], schema))
    table.upsert(spark.createDataFrame([("a", "l", [1.0, 0.1], 2), ("b", "x", [9.0, 9.0], 0)], schema))
    assert {r.id: r.cluster_id for r in table.read().collect()} == {"a": "l", "b": "k"}
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, vector array<double>")
    assert [r.item for r in table.search(queries, 2).orderBy("rank").collect()] == ["a", "b"] and [r.item for r in table.search(queries, 2, F.col("cluster_id") == "k").collect()] == ["b"]
    table.delete(spark.createDataFrame([("a",)], "id string"))
    assert table.count() == 1 and table.fetch(spark.createDataFrame([("b",), ("a",)], "id string")).count() == 1
    table.clear()
    assert table.count() == 0


def test_section_vectors(spark):
    df = spark.createDataFrame([(1, "word " * 1000), (2, ""), (3, None)], "id int, t string")
    rows = P.section_vectors(df, "id", "t", seeded_vector(8)).collect()
    assert [r.id for r in rows] == [1] and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6
