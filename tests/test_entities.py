import numpy as np

from kgloom.operators import assignment as A
from kgloom.operators import entities as E
from kgloom.operators import retrieval as R


def test_validation_of_relations(spark):
    nodes = spark.createDataFrame([(1, "X", ["Person"]), (1, "Y", ["Person", "Place"]), (1, "Z", None), (2, "X", ["Event"])], "batch int, name string, types array<string>")
    edges = spark.createDataFrame([(1, "X", "Y", "causes"), (1, "Z", "Y", "causes"), (2, "X", "W", "causes"), (1, "X", "X", "knows"), (1, "X", "Y", "knows")], "batch int, start string, target string, type string")
    forbidden = spark.createDataFrame([("causes", "any", "Person"), ("causes", "Event", "unknown")], "type string, start_type string, target_type string")
    left = E.forbidden_edges_out(edges, nodes, forbidden)
    assert {tuple(r) for r in left.collect()} == {(1, "Z", "Y", "causes"), (1, "X", "X", "knows"), (1, "X", "Y", "knows")}
    assert {tuple(r) for r in E.dangling_edges_out(edges, nodes).collect()} == {(1, "X", "Y", "causes"), (1, "Z", "Y", "causes"), (1, "X", "Y", "knows")}
    assert E.known_edge_types(edges, spark.createDataFrame([("knows",)], "name string")).count() == 2


def test_names_and_folding(spark):
    variants = spark.createDataFrame([("A", "colour", "Colour"), ("B", " COLOUR ", "Color")], "type string, variant string, standard string")
    df = spark.createDataFrame([("Colour", "x"), ("other", "colour")], "start string, target string")
    assert {tuple(r) for r in E.standard_names(df, ["start", "target"], variants).collect()} == {("Color", "x"), ("other", "Color")}
    nodes = spark.createDataFrame([(2, "n", "T2", "b", "c2"), (1, "n", "T1", "a", "c1"), (3, "n", "T1", "a", "c1"), (4, "m", None, None, None)], "pos int, name string, type string, description string, chunk_id string")
    got = {r.name: r for r in E.folded_entities(nodes).collect()}
    assert (got["n"].types, got["n"].description, got["n"].chunk_ids) == (["T1", "T2"], "a | b", ["c1", "c2"])
    names = spark.createDataFrame([(1, "T", "Alpha"), (0, "T", "ALPHA "), (2, "T", "b")], "pos int, type string, name string")
    assert {r.name for r in E.names_by_type(names, spark.createDataFrame([("T", "alpha"), ("T", "c")], "type string, name string")).collect()} == {"ALPHA ", "b", "c"}


def test_merging(spark):
    old = spark.createDataFrame([("a", ["x"], 1), ("b", None, 2)], "name string, types array<string>, created int")
    new = spark.createDataFrame([("a", ["y", "x"], 9), ("c", ["z"], 9)], "name string, types array<string>, created int")
    assert {(r.name, tuple(r.types), r.created) for r in E.merged_entities(old, new, ["name"], ["types"]).collect()} == {("a", ("x", "y"), 1), ("b", (), 2), ("c", ("z",), 9)}
    rows = E.upserted(spark.createDataFrame([("k", 1, "old"), ("l", 5, "old")], "id string, v int, t string"), spark.createDataFrame([("k", 1, "new"), ("l", 4, "new")], "id string, v int, t string"), ["id"], "v")
    assert {r.id: r.t for r in rows.collect()} == {"k": "new", "l": "old"}
    relations = E.merged_relations(spark.createDataFrame([("a", "t", "b", 0.5, ["1"])], "start string, type string, target string, weight double, source_ids array<string>"), spark.createDataFrame([("a", "t", "b", 1.0, ["2"])], "start string, type string, target string, weight double, source_ids array<string>"))
    assert [(r.weight, r.source_ids) for r in relations.collect()] == [(0.5, ["1", "2"])]
    tables = E.ingested(spark.createDataFrame([(0, "a", "T", "d", "c1")], "pos int, name string, type string, description string, chunk_id string"), spark.createDataFrame([("a", "rel", "b", "c1")], "start string, type string, target string, chunk_id string"), spark.createDataFrame([("c1", "t" * 600)], "chunk_id string, text string"))
    assert {r.name for r in tables["entities"].collect()} == {"a", "b"} and len(tables["chunks"].first().text) == 500


def test_retrieval(spark):
    chunks = spark.createDataFrame([("c1", "first text", [1.0, 0.0]), ("c2", "second text", [0.8, 0.6]), ("c3", "third text", [0.0, 1.0]), ("c4", " ", [-1.0, 0.0])], "chunk_id string, text string, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.1], "what?"), ("z", [0.0, 0.0], "none?")], "query string, vector array<double>, question string")
    links = spark.createDataFrame([("E1", "c1"), ("E2", "c3"), ("E2", "c1")], "name string, chunk_id string")
    relations = spark.createDataFrame([("E1", "E2")], "start string, target string")
    got = R.hybrid(queries.where("query = 'q'"), chunks, links, relations, k=2)
    assert [(r.chunk_id, r.way) for r in got.orderBy("position").collect()] == [("c1", "vector"), ("c2", "vector"), ("c3", "graph")]
    assert [r.item for r in R.vector_search(queries.where("query = 'q'"), chunks.withColumnRenamed("chunk_id", "item"), 4).orderBy("rank").collect()] == ["c1", "c2", "c3", "c4"]
    context = R.contexts(got, chunks, 22)
    assert context.first().context == "first text\n\nsecond text"[:10] + "\n\n" + "second text"
    told = {r.query: r.prompt for r in R.prompts(context, queries, "likes brevity").collect()}
    assert "No passage" in told["z"] and "first text" in told["q"] and "likes brevity" in told["q"]


def test_assignment(spark):
    items = spark.createDataFrame([("a", ["spark join", "shuffle", "python"]), ("b", ["gardening"]), ("c", []), ("d", None)], "item string, keywords array<string>")
    clusters = spark.createDataFrame([("k1", "Spark engine", "join shuffle", ["data"]), ("k2", "", None, None)], "cluster_id string, name string, description string, themes array<string>")
    got = {r.item: r for r in A.by_words(items, clusters).collect()}
    assert got["a"].cluster_id == "k1" and abs(got["a"].score - 0.580556) < 1e-6 and got["a"].confidence == 0.581
    assert got["b"].is_new and got["c"].is_new and got["d"].is_new and got["b"].confidence == 1.0
    scores = spark.createDataFrame([("a", "k1", 0.5, 0.2), ("a", "k2", 0.1, 0.9), ("b", "k1", 0.5, 0.0), ("c", "k1", 0.1, -0.5)], "item string, cluster_id string, word_score double, vector_score double")
    assert {r.item: r.cluster_id for r in A.guarded(scores).collect()} == {"a": "k2", "b": "k1", "c": "cluster_misc"}


def test_assignment_joins_no_item_with_every_cluster(spark, monkeypatch):
    import random

    r = random.Random(1)
    phrase = lambda: " ".join(r.choices("ash beech cedar fir elm oak pine yew".split(), k=r.randint(1, 3)))
    said = {k: [phrase() for _ in range(r.randint(1, 6))] for k in range(60)} | {60: ["nothing known"], 61: []}
    known = {f"c{k:02}": [phrase() for _ in range(r.randint(1, 5))] for k in range(29)} | {"c29": ["willow"]}
    share = lambda a, b: len(a & b) / len(a | b)

    def score(item, cluster):
        a, b = [set(p.split()) for p in item], [set(p.split()) for p in cluster]
        x, y, best = set().union(*a), set().union(*b), sorted((max(share(p, q) for q in b) for p in a), reverse=True)[:3]
        return 0.5 * len(x & y) / len(x) + 0.3 * share(x, y) + 0.2 * (sum(best) / len(best))

    items = spark.createDataFrame(list(said.items()), "item long, keywords array<string>")
    clusters = spark.createDataFrame([(c, None, "", t) for c, t in known.items()], "cluster_id string, name string, description string, themes array<string>")
    got = A.by_words(items, clusters, 0.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {k: max((score(p, t), c) for c, t in known.items()) if p else (0.0, None) for k, p in said.items()}
    assert want[60] == (0.0, "c29")
    assert {r.item: (r.score, r.cluster_id) for r in got.collect()} == want
    monkeypatch.setattr(A, "AT_ONCE", 100)  # of 30 clusters: items three by three, and rows for three keys
    monkeypatch.setattr(A, "KEPT", 100)
    index, every = A._Known(list(known.values())), [p for ps in said.values() for p in ps]
    kept = [A._Kept(make, len(known)) for make in (index.having, index.closest)]
    at, scores = index.best(len(said), np.repeat(np.arange(len(said)), [len(p) for p in said.values()]), np.arange(len(every)), every, *kept)
    assert {k: (float(s), f"c{c:02}" if c >= 0 else None) for k, c, s in zip(said, at, scores)} == want
