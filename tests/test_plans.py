from kgloom.functions.text import seeded_vector
from kgloom.operators.keywords import embedded_keywords, formulas, gram_counts, identifiers, is_noise, kept_keywords, selected
from kgloom.operators.trees import raised_vectors, tree_edges
from kgloom.plans.insert import inserted


def test_keywords(spark):
    assert [t for t, _ in selected([("graph index", 0.5), ("index graph", 0.4), ("12345", 0.9), ("graphIndex", 0.3), ("", 1.0)], 5)] == ["graph index", "graphIndex"]
    assert is_noise("return null") and not is_noise("return policy") and identifiers("my_var myVar my_var")[0] == ("my_var", 0.6) and formulas("x = y and matrix")[0][0] == "x = y"
    df = spark.createDataFrame([(1, "graph index graph index myVar", [1.0, 0.0, 0.0, 0.0]), (2, None, [0.0] * 4)], "id int, t string, v array<double>")
    assert [(r.term, r.n) for r in gram_counts(df, "id", "t", 1).orderBy("rank").collect()] == [("graph", 2), ("index", 2), ("myvar", 1)]
    ranked = embedded_keywords(df, "id", "t", "v", seeded_vector(4), most=2)
    assert {r.id for r in ranked.collect()} == {1} and ranked.count() <= 8
    got = {r.id: [k.term for k in r.keywords] for r in kept_keywords(ranked, df, "id", "t", 3).collect()}
    assert len(got[1]) == 3 and got[2] == []


def test_trees(spark):
    rows = [("r", None, None), ("a", "r", None), ("b", "r", [0.0, 2.0]), ("c", "a", [1.0, 0.0]), ("d", "a", [3.0, 0.0]), ("e", "b", None), ("x", "y", None), ("y", "x", [1.0, 1.0])]
    got = {r.node: None if r.vector is None else [round(v, 4) for v in r.vector] for r in raised_vectors(spark.createDataFrame(rows, "node string, parent string, vector array<double>")).collect()}
    assert got["a"] == [1.0, 0.0] and got["r"] == [0.7071, 0.7071] and got["e"] is None and got["x"] is None
    nodes = spark.createDataFrame([(1, "notion_r", "k"), (2, "notion_a", "k"), (3, "notion_b", None)], "id long, orig_id string, cluster_id string")
    edges = spark.createDataFrame([(3, 1)], "source long, target long")
    tree = spark.createDataFrame([(n, p) for n, p, _ in rows], "id string, parent_id string")
    assert [(r.source, r.target, r.is_intra) for r in tree_edges(tree, nodes, edges).collect()] == [(1, 2, True)]


def test_insert(spark):
    items = spark.createDataFrame([(10, 0, ["spark join"], [1.0, 0.0]), (11, 1, ["unheard"], [0.9, 0.1]), (12, 2, ["unheard"], [0.0, 1.0])], "item long, pos int, keywords array<string>, vector array<double>")
    vectors = spark.createDataFrame([(1, "k1", [1.0, 0.05], 1), (2, "k2", [0.0, 1.0], 1), (10, "old", [5.0, 5.0], 1)], "item long, cluster_id string, vector array<double>, version int")
    clusters = spark.createDataFrame([("k1", "spark", "join", None), ("k2", "garden", "", None)], "cluster_id string, name string, description string, themes array<string>")
    got = inserted(items, vectors, clusters)
    assert {r.item: r.cluster_id for r in got["nodes"].collect()} == {10: "k1", 11: "cluster_misc", 12: "cluster_misc"}
    assert {(r.source, r.target) for r in got["edges"].collect()} == {(10, 1), (11, 1), (11, 10), (12, 2)}
    assert {r.item: r.cluster_id for r in got["vectors"].collect()} == {1: "k1", 2: "k2", 10: "k1", 11: "cluster_misc", 12: "cluster_misc"}
