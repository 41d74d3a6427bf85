import io
import json
import zipfile

from pyspark.sql import functions as F

from kgloom.plans.macro import Settings, graph
from kgloom.plans.provider import RuleProvider, completed, costs, usage
from kgloom.sources.files import read_ontology, read_sources
from kgloom.sources.graph_files import read_graph, shown_edges, shown_nodes, stored_metadata, write_graph
from kgloom.streaming.tasks import dispatch, once, read_requests, running_assignment, sessions, windowed


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_read_sources(spark, tmp_path):
    w, a = "http://w", "http://a"
    para = lambda t, s="": f'<w:p xmlns:w="{w}">' + (f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else "") + f"<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f'<w:tbl xmlns:w="{w}"><w:tr><w:tc>{para("c1")}</w:tc><w:tc>{para("c2")}</w:tc></w:tr></w:tbl>'
    (tmp_path / "a.docx").write_bytes(packed(word__document_xml=f'<w:document xmlns:w="{w}"><w:body>{para("Head", "Heading1")}{para("text one")}{table}</w:body></w:document>'))
    slide = f'<s xmlns:a="{a}"><a:p><a:r><a:t>hello slide</a:t></a:r></a:p></s>'
    (tmp_path / "b.pptx").write_bytes(packed(ppt__slides__slide1_xml=slide, ppt__notesSlides__notesSlide1_xml=slide.replace("hello slide", "a note")))
    (tmp_path / "c.md").write_text("---\ntitle: x\n---\nintro that is long\n# H\nbody that is long")
    (tmp_path / "d.txt").write_bytes("안녕하세요".encode("cp949"))
    export = [{"conversation_id": "k", "title": "t", "create_time": "5.7", "mapping": {"r": {"parent": None}, "a": {"parent": "r", "message": {"id": "1", "author": {"role": "user"}, "content": {"parts": ["q"]}}}, "b": {"parent": "a", "message": {"id": "2", "author": {"role": "assistant"}, "content": "r"}}}}]
    (tmp_path / "e.json").write_text(json.dumps(export))
    (tmp_path / "f.json").write_text(json.dumps([{"id": "conv_3_1", "role": "user", "content": "x"}, {"id": "conv_3_2", "role": "user", "content": "y"}]))
    (tmp_path / "g.json").write_text("{broken")
    (tmp_path / "h.json").write_text(json.dumps({"source_nodes": [{"id": 1, "title": "only", "sections": [{"content": " "}]}]}))
    rows = read_sources(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [(r.heading, r.content) for r in by["a.docx"]] == [("Head", "text one\nc1 | c2")] and by["b.pptx"][0].content == "hello slide\na note"
    assert [r.heading for r in by["c.md"]] == [None, "H"] and by["d.txt"][0].content == "안녕하세요"
    assert [(r.source_id, r.role, r.content, r.created) for r in by["e.json"]] == [("k", "user", "q", 5), ("k", "assistant", "r", 5)]
    assert {r.source_id for r in by["f.json"]} == {"conv_3"} and by["g.json"][0].error and by["h.json"][0].content == "only"


def test_graph_files(spark, tmp_path):
    body = {"nodes": [{"id": 1, "title": "t", "keywords": [{"term": "a", "score": 1}]}], "edges": [{"source": 1, "target": 2, "weight": 0.5, "confidence": "high"}], "metadata": {"clusters": {"c1": {"name": "n", "themes": ["x"]}}}}
    (tmp_path / "g.json").write_text(json.dumps(body))
    (tmp_path / "h.json").write_text("nonsense")
    tables = read_graph(spark, str(tmp_path))
    assert [(r.cluster_id, r.name, r.themes) for r in tables["clusters"].collect()] == [("c1", "n", ["x"])]
    assert shown_nodes(tables["nodes"]).first().keywords == ["a"] and shown_edges(tables["edges"]).first().type == "hard"
    assert stored_metadata(tables["nodes"]).first().cluster_id == ""
    write_graph(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 1
    (tmp_path / "o.json").write_text(json.dumps({"node_types": [{"name": "P", "description": "d"}], "edge_types": [{"name": "e", "description": "d", "forbidden_pairs": [["any", "P"]]}]}))
    kinds, edges, pairs = read_ontology(spark, str(tmp_path / "o.json"))
    assert kinds.first().name == "P" and edges.first().name == "e" and tuple(pairs.first()) == ("e", "any", "P")


def test_stream_of_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    task = lambda i, kind: json.dumps({"taskId": i, "taskType": kind, "payload": "{}", "timestamp": "2024-01-01T00:00:00Z"})
    (tmp_path / "in/1.json").write_text("\n".join([task("a", "good"), task("b", "bad"), task("c", "unknown"), task("a", "good")]))

    def bad(df):
        raise RuntimeError("no")

    handlers = {"good": lambda df: df.withColumn("result", F.lit("ok")), "bad": bad}
    dispatch(once(read_requests(spark, str(tmp_path / "in"))), handlers, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.task_id, r.task_type, r.status) for r in got) == [("a", "good", "done"), ("b", "bad", "failed")]


def test_windows_over_a_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00", 1.0), ("u", "2024-01-01 00:10:00", 2.0), ("u", "2024-01-01 02:00:00", 4.0)]
    df = spark.createDataFrame(rows, "user_id string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("w", windowed(stream, "1 hour")), ("s", sessions(stream)), ("v", windowed(stream, "1 hour", "30 minutes", by=("user_id",)))):
        out.writeStream.format("memory").queryName(name).outputMode("append" if name == "s" else "complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2] and sum(r.n for r in spark.table("v").collect()) == 6
    assert [r.n for r in spark.table("s").collect()] == [2]


def test_running_assignment(spark, tmp_path):
    df = spark.createDataFrame([("u", "a", [1.0, 0.0]), ("u", "b", [0.9, 0.1]), ("u", "c", [0.0, 1.0]), ("w", "d", [0.0, 1.0])], "user_id string, item string, vector array<double>").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    running_assignment(stream).writeStream.format("memory").queryName("r").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.user_id, r.item): r.cluster for r in spark.table("r").collect()} == {("u", "a"): 0, ("u", "b"): 0, ("u", "c"): 1, ("w", "d"): 0}


def test_provider_and_costs(spark):
    df = spark.createDataFrame([(1, "12345678"), (2, None)], "id int, prompt string")
    calls = completed(df, "id", "prompt", RuleProvider(lambda p: p[:4]), "extract")
    assert {r.id: r.answer for r in calls.collect()} == {1: "1234", 2: ""} and usage(calls).first().input_tokens == 2

    class Failing:
        name = "failing"

        def complete(self, prompts):
            raise OSError("down")

    assert [(r.answer, r.attempts, r.error) for r in completed(df, "id", "prompt", Failing(), "x").where("id = 1").collect()] == [(None, 3, "down")]
    rows = spark.createDataFrame([("s", "P ", "alias", 1000, 500), ("s", "q", "none", 1, 1)], "stage string, provider string, model string, input_tokens int, output_tokens int")
    prices = spark.createDataFrame([("p", "M", 0.15, 0.6)], "provider string, model string, input_per_million double, output_per_million double")
    got = costs(rows, prices, spark.createDataFrame([("alias", "m")], "model string, known_as string")).first()
    assert (got.calls, round(got.cost, 8), got.missing) == (2, 0.00045, 1)


def test_macro_plan(spark):
    rows = [(f"s{i}", f"title {i}", p, "user", f"graph index topic{i % 3} and section {p} of topic{i % 3}") for i in range(12) for p in range(2)]
    tables = graph(spark.createDataFrame(rows, "source_id string, title string, pos int, role string, content string"), Settings(clusters=3, high=0.2, medium=0.1))
    nodes = tables["nodes"].collect()
    assert sorted(r.id for r in nodes) == list(range(12)) and all(r.cluster.startswith("cluster_") and r.num_sections == 2 for r in nodes)
    assert sum(r["size"] for r in tables["clusters"].collect()) == 12 and {"is_intra", "is_intra_initial"} <= set(tables["edges"].columns)
    assert tables["subclusters"].columns and tables["candidates"].columns


def test_cuts_are_deleted_and_a_cluster_must_name_its_folder(spark):
    import types

    import pytest

    from kgloom.session import clear_cuts, cut, shared_dir

    df = cut(spark.range(3))
    assert df.count() == 3 and clear_cuts(spark) and not clear_cuts(spark)
    away = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(away)
