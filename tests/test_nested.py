import json

import pytest

from kgloom.operators.nested import block_kinds, contained, deep_json, entry_kinds, entry_parents, labelled, nodes_of, read_json


def test_interval_labels_nest():
    root = {"blocks": [{"block_id": "a", "micro_graph": {"nodes": [{"name": " x "}, "y", None], "edges": [{"source": "x", "target": "y", "type": [["uses"]]}]}}, {"block_id": "b"}]}
    nodes = labelled(root, block_kinds(root))
    a, x, y, edge, b = nodes
    assert [n[3:5] for n in nodes] == [("block", "a"), ("micro_node", "x"), ("micro_node", "y"), ("micro_edge", "x|uses|y"), ("block", "b")]
    for inner in (x, y, edge):
        assert a[0] < inner[0] and inner[1] < a[1] and not (b[0] < inner[0] and inner[1] < b[1])


def test_deep_nesting_needs_no_recursion():
    root: object = "x"
    for _ in range(5000):
        root = [root]
    assert labelled(root, lambda path, value: ("leaf", None, {}) if value == "x" else None)[0][0] == 5000


def test_parents_as_written_else_as_listed():
    root = {"a": {"children": ["b", "c"]}, "b": {"parent": None}, "c": {"parent": "zz"}, "d": None, "e": {"parent": " "}}
    assert [(k, p) for _, k, p, _ in entry_parents(root)] == [("a", ""), ("b", "a"), ("c", "zz"), ("d", ""), ("e", "")]
    assert [(k, p) for _, k, p, _ in entry_parents([{"id": "a"}, {"parent": "a"}, 3, {"id": "b", "parent": "a"}])] == [("a", ""), ("b", "a")]


def test_flat_tables(spark):
    graph = {"blocks": {"m1": {"raw_text": "t"}, "m2": json.dumps({"block_id": "q", "micro_graph": json.dumps({"nodes": ["n"]})})}}
    rows = [(1, json.dumps(json.dumps({"block_graph": graph})), "k"), (2, None, "k"), (3, "{broken", "k"), (4, "", "k"), (5, "null", None), (6, "[]", "k")]
    df = spark.createDataFrame(rows, "id long, j string, kind string")
    nodes = nodes_of(df, "id", "j", block_kinds)
    got = sorted((r.rec_id, r.kind, r.parent_key, r.key) for r in contained(nodes, "block").collect())
    assert got == sorted([(1, "block", None, "m1"), (1, "block", None, "q"), (1, "micro_node", "q", "n")])
    entries = nodes_of(spark.createDataFrame([(1, json.dumps({"a": {"message": {"content": {"parts": ["x", None, {}]}, "author": {"role": "User"}}}}))], "id long, j string"), "id", "j", entry_kinds)
    message = contained(entries, "entry").where("kind = 'message'").collect()[0]
    assert message.parent_key == "a" and json.loads(message.body)["text"] == "x"


def test_read_json_gives_up_on_text():
    assert read_json('"plain"') is None and read_json("nonsense") is None and read_json('"{\\"a\\": 1}"') == {"a": 1}


def test_texts_nested_deeper_than_the_stack_are_read():
    deep = 200_000
    value = read_json('{"a": {"parent": null, "x": ' + "[" * deep + "]" * deep + '}, "b": {"parent": "a"}}')
    assert [(k, p) for _, k, p, _ in entry_parents(value)] == [("a", ""), ("b", "a")]
    value = read_json('{"k":' * deep + "1" + "}" * deep)
    for _ in range(deep):
        value = value["k"]
    assert value == 1 and read_json("[" * deep + "]" * (deep - 1)) is None


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, {"b": "x\\u00e9\\"]"}, [], {}], "a ": null, "c":true}', " [ ] ", '"x"', "3", '{"a":1,"a":2}', "[1,]", '{"a":1,}', "{1:2}", '{"a" 1}', "[1 2]", "", "[", '{"a":', "[]]", "[1}", "nul"])
def test_deep_json_reads_what_json_reads(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            deep_json(text)
    else:
        assert deep_json(text) == want


def test_json_encoded_many_times():
    text: object = {"a": [1]}
    for _ in range(7):
        text = json.dumps(text)
    assert read_json(text) == {"a": [1]} and read_json('"plain"') is None and read_json("") is None
