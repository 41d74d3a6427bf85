"""Deeply nested JSON records as flat tables, linked by interval labels.

A depth-first walk numbers every value of a record on the way down (``pre``) and on the way up (``post``). A value lies
inside another exactly if its ``pre`` is larger and its ``post`` smaller, so one table of labelled nodes per record
type keeps the whole hierarchy: a child's parent of some type is the last such node before it, in ``pre`` order, that
contains it. Records are walked where they are read; nothing larger than a record is ever held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Matches any key or position in a path.
ANY = "*"
NODE_SCHEMA = "rec_id bigint, pre int, post int, level int, kind string, key string, body string"


def deep_json(text: str) -> Any:
    """``json.loads`` without recursion, for texts nested deeper than the interpreter's stack; ValueError if not valid JSON."""
    scalar = json.JSONDecoder().raw_decode
    space = json.decoder.WHITESPACE.match
    stack: list[tuple[Any, str | None]] = []  # open containers, each with the key it gets in the one around it
    at, key = space(text, 0).end(), None
    while True:
        # a value begins here
        mark = text[at : at + 1]
        if mark and mark in "[{":
            inside = space(text, at + 1).end()
            value: Any = [] if mark == "[" else {}
            if text[inside : inside + 1] != ("]" if mark == "[" else "}"):
                stack.append((value, key))
                at, key = inside, None
                if mark == "{":
                    key, at = _key(text, at)
                continue
            at = inside + 1
        else:
            value, at = scalar(text, at)
        # a value has ended
        while True:
            at = space(text, at).end()
            if not stack:
                if at != len(text):
                    raise json.JSONDecodeError("Extra data", text, at)
                return value
            around, outer = stack[-1]
            if isinstance(around, list):
                around.append(value)
            else:
                around[key] = value
            mark = text[at : at + 1]
            if mark == ",":
                at, key = space(text, at + 1).end(), None
                if isinstance(around, dict):
                    key, at = _key(text, at)
                break
            if mark != ("]" if isinstance(around, list) else "}"):
                raise json.JSONDecodeError("Expecting ',' or end", text, at)
            stack.pop()
            value, key, at = around, outer, at + 1


def _key(text: str, at: int) -> tuple[str, int]:
    """The key at ``at`` and where its value begins."""
    if text[at : at + 1] != '"':
        raise json.JSONDecodeError("Expecting a key", text, at)
    key, at = json.decoder.scanstring(text, at + 1)
    at = json.decoder.WHITESPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise json.JSONDecodeError("Expecting ':'", text, at)
    return key, json.decoder.WHITESPACE.match(text, at + 1).end()


def read_json(text: Any) -> Any:
    """The value of a JSON text that may have been encoded any number of times; None if it is not valid JSON."""
    while isinstance(text, str):
        text = text.lstrip("\ufeff")
        try:
            try:
                text = json.loads(text)
            except RecursionError:
                text = deep_json(text)
        except ValueError:
            return None
    return text


def opened(value: Any) -> Any:
    """A container that was stored as a JSON string; other values as they are."""
    if isinstance(value, str) and value[:1] in "[{":
        inner = read_json(value)
        return value if inner is None else inner
    return value


def as_items(value: Any, own_keys: Sequence[str] = ()) -> list[tuple[str, Any]]:
    """The members of a list, of a map, or of one object (known by ``own_keys``) standing where a list belongs."""
    value = opened(value)
    if isinstance(value, dict):
        return [("0", value)] if any(k in value for k in own_keys) else list(value.items())
    return [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else []


def text_of(value: Any) -> str | None:
    """A scalar as trimmed text; None for null, blank and containers."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return (value if isinstance(value, str) else json.dumps(value)).strip() or None


def first_text(value: Any) -> str | None:
    """The first scalar of a value that may be wrapped in lists."""
    while isinstance(value, list):
        value = value[0] if value else None
    return text_of(value)


def labelled(root: Any, kind_of: Callable[[tuple, Any], tuple[str, str | None, dict] | None]) -> list[tuple]:
    """(pre, post, level, kind, key, body) of each node for which ``kind_of(path, value)`` gives (kind, key, body).

    All values are numbered, in one iterative walk, so that depth is not limited by the interpreter's stack.
    """
    out: list[list] = []
    clock_pre = clock_post = 0
    stack: list[tuple] = [((), opened(root), None, None)]
    while stack:
        path, value, slot, children = stack.pop()
        if children is None:
            pre, clock_pre = clock_pre, clock_pre + 1
            if (found := kind_of(path, value)) is not None:
                slot = len(out)
                out.append([pre, -1, len(path), found[0], found[1], found[2]])
            else:
                slot = None
            stack.append(((), None, slot, True))  # without its path, or a deep text holds the square of its depth
            inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
            stack.extend(((*path, k), opened(v), None, None) for k, v in reversed(list(inner)))
        else:
            if slot is not None:
                out[slot][1] = clock_post
            clock_post += 1
    return [tuple(x) for x in out]


def nodes_of(df: DataFrame, rec_id: str, text: str, kinds: Callable[[Any], Callable], carry: Sequence[str] = ()) -> DataFrame:
    """The labelled nodes of the JSON column ``text``; ``kinds(root)`` gives the ``kind_of`` of a record.

    ``body`` is a JSON object with what the kind keeps. A null or unreadable text has no nodes. Columns of ``carry``
    are repeated on each node; others are dropped, whatever their names.
    """
    carried = [df.schema[c] for c in carry]
    schema = NODE_SCHEMA + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)

    def shred(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns: list[list] = [[] for _ in range(7)]
            origin: list[int] = []
            for i, (rec, raw) in enumerate(zip(ids, texts)):
                root = read_json(raw)
                if root is None:
                    continue
                for pre, post, level, kind, key, body in labelled(root, kinds(root)):
                    for column, x in zip(columns, (rec, pre, post, level, kind, key, json.dumps(body, ensure_ascii=False) if body else None)):
                        column.append(x)
                    origin.append(i)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays += [batch.column(2 + j).take(pa.array(origin, pa.int32())) for j in range(len(carried))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*NODE_NAMES, *[f.name for f in carried]])

    return df.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(text).alias("text"), *carry).mapInArrow(shred, schema)


NODE_NAMES = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def contained(nodes: DataFrame, parent_kind: str, within: Sequence[str] = ("rec_id",)) -> DataFrame:
    """``nodes`` with parent_key and parent_pre of the innermost ``parent_kind`` node around each; null if there is none.

    Nodes of ``parent_kind`` must not lie in each other. One sort within a record finds all links.
    """
    order = Window.partitionBy(*within).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == parent_kind, F.struct("key", "pre", "post")), ignorenulls=True).over(order)
    inside = F.col("_around.post") > F.col("post")
    return nodes.withColumn("_around", last).withColumns({"parent_key": F.when(inside, F.col("_around.key")), "parent_pre": F.when(inside, F.col("_around.pre"))}).drop("_around")


# The records of this project


BLOCK_KEYS = ("block_id", "raw_text", "micro_graph")


def block_kinds(root: Any) -> Callable:
    """Blocks, micro nodes and micro edges of a block graph, bare or under ``block_graph``."""
    top = ("block_graph",) if isinstance(root, dict) and "block_graph" in root else ()
    place = (*top, "blocks")
    deep = len(place)

    def kind_of(path: tuple, value: Any) -> tuple | None:
        if path[:deep] != place or len(path) < deep:
            return None
        rest = path[deep:]
        if isinstance(value, dict) and ((rest == () and any(k in value for k in BLOCK_KEYS)) or (len(rest) == 1 and "micro_graph" not in rest and any(k in value for k in BLOCK_KEYS))):
            raw = value.get("raw_text")
            return "block", text_of(value.get("block_id")) or (rest[0] if rest and isinstance(rest[0], str) else None), {"raw_text": raw} if isinstance(raw, str) else {}
        if "micro_graph" not in rest[:2] or len(rest) < 2:
            return None
        after = rest[rest.index("micro_graph") + 1:]
        single = isinstance(value, dict) and len(after) == 1 and (after[0] == "nodes" and "name" in value or after[0] == "edges" and "target" in value)
        if len(after) != 2 and not single or len(after) == 2 and isinstance(after[1], str) and not isinstance(value, dict):
            return None
        if after[0] == "nodes":
            name = text_of(value.get("name")) if isinstance(value, dict) else text_of(value)
            return ("micro_node", name, {"type": value.get("type")} if isinstance(value, dict) and value.get("type") else {}) if name else None
        if after[0] == "edges" and isinstance(value, dict):
            ends = [first_text(value.get("start", value.get("source"))), first_text(value.get("type")), first_text(value.get("target"))]
            return "micro_edge", "|".join(x or "" for x in ends), {"start": ends[0], "type": ends[1], "target": ends[2]}
        return None

    return kind_of


def entry_parents(root: Any) -> list[tuple[Any, str, str, Any]]:
    """(step, key, parent, entry) of each entry of an export's mapping: its own parent, else the entry that lists it, else ''.

    ``step`` is where the mapping holds it: its key, or its position in a list.
    """
    items = root.items() if isinstance(root, dict) else enumerate(root) if isinstance(root, list) else ()
    entries = []
    for step, value in items:
        value = opened(value)
        key = str(step) if isinstance(root, dict) else text_of(value.get("id")) if isinstance(value, dict) else None
        if key is not None:
            entries.append((step, key, value))
    listed: dict[str, str] = {}
    for _, key, value in entries:
        children = value.get("children") if isinstance(value, dict) else None
        for child in children if isinstance(children, list) else ():
            if isinstance(child, (str, int)):
                listed.setdefault(str(child), key)
    out = []
    for step, key, value in entries:
        own = value.get("parent") if isinstance(value, dict) else None
        own = own if isinstance(own, str) and own.strip() else text_of(own)
        out.append((step, key, own if own is not None else listed.get(key, ""), value))
    return out


def message_text(content: Any) -> str | None:
    """The strings of ``parts`` joined by line breaks, else ``text``, else the plain string."""
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        if isinstance(content.get("parts"), list):
            return "\n".join(p for p in content["parts"] if isinstance(p, str))
        return content["text"] if isinstance(content.get("text"), str) else None
    return "\n".join(p for p in content if isinstance(p, str)) if isinstance(content, list) else None


def entry_kinds(root: Any) -> Callable:
    """Entries and messages of an export's mapping."""
    known = {step: (key, parent) for step, key, parent, _ in entry_parents(root)}

    def kind_of(path: tuple, value: Any) -> tuple | None:
        if len(path) == 1 and path[0] in known:
            key, parent = known[path[0]]
            return "entry", key, {"parent": parent}
        if len(path) == 2 and path[1] == "message" and isinstance(value, dict):
            author = value.get("author")
            role = author.get("role") if isinstance(author, dict) else author
            return "message", text_of(value.get("id")), {"role": role if isinstance(role, str) else None, "text": message_text(value.get("content")), "create_time": first_text(value.get("create_time"))}
        return None

    return kind_of
