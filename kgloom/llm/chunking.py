"""Cutting oversized texts at natural boundaries.

A text is split into tokens (words, sentence marks, white space). The running sums of their lengths are the sorted
array of all places where a cut may fall, each with the strength of the boundary there. A piece ends at the last strong
boundary under the limit, found by binary search; the next one starts ``overlap`` characters before that end. Only where
no token ends under the limit is a piece cut hard.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: What is trimmed at both ends of an item.
BLANK = " \t\r\n"
#: Words, and runs of sentence marks or of white space, which may be cut anywhere.
_TOKEN = re.compile(r"[^\s.!?。！？]+|[.!?。！？]+|\s+")
PIECE = "struct<piece: int, start: int, end: int, cut: string>"


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, cut) of each piece; cut is paragraph, sentence, word, mark, forced, or end for the last.

    No piece is longer than ``limit``. Each starts ``overlap`` characters before the last one's end, or as much closer
    to it as it takes to reach the next boundary. An empty text has no piece, one within the limit has one.
    """
    if overlap < 0 or limit <= 2 * overlap:
        raise ValueError("overlap must be less than half of limit")
    size = len(text)
    if size <= limit:
        return [(0, size, "end")] if size else []
    tokens = _TOKEN.findall(text)
    token_ends = list(accumulate(map(len, tokens)))
    ends: list[int] = []  # wherever no word is cut
    for token, end in zip(tokens, token_ends):
        ends.extend(range(end - len(token) + 1, end + 1) if token[0] in ".!?。！？" or token.isspace() else (end,))
    by_kind: dict[str, list[int]] = {"paragraph": [], "sentence": [], "word": []}
    for token, after, end in zip(tokens, tokens[1:], token_ends):
        if token.isspace():
            continue
        if after.isspace():
            by_kind["word"].append(end)
            if after.count("\n") > 1:
                by_kind["paragraph"].append(end)
        if token[0] in ".!?。！？":
            by_kind["sentence"].append(end)
    out: list[tuple[int, int, str]] = []
    start, done = 0, 0
    while size - start > limit:
        reach = start + limit
        for cut, places, least in (*((k, v, start + limit // 2) for k, v in by_kind.items()), ("word", by_kind["word"], done), ("mark", ends, done)):
            at = bisect_right(places, reach) - 1
            if at >= 0 and places[at] > max(least, done):
                end = places[at]
                break
        else:
            end, cut = reach, "forced"
        out.append((start, end, cut))
        done = end
        following = ends[bisect_right(ends, end)]
        start = max(end - overlap, following - limit) if following - end <= limit else end - overlap
        start = max(start, out[-1][0] + 1)
    out.append((start, size, "end"))
    return out


def longest_stretch(text: str) -> int:
    """Characters of the longest stretch without white space or sentence mark."""
    return max((len(t) for t in _TOKEN.findall(text) if not t.isspace() and t[0] not in ".!?。！？"), default=0)


def cut_texts(df: DataFrame, text: str | Column, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """``df`` without the text, with n_chars and pieces of the trimmed text: an array of piece, start, end, cut and content.

    A null or blank text has 0 characters and no piece. Columns of ``df`` named n_chars or pieces are replaced.
    """
    given = df.withColumn("_text", F.col(text) if isinstance(text, str) else text)
    keep = [c for c in df.columns if c not in ("n_chars", "pieces", *([text] if isinstance(text, str) else []))]
    item = PIECE[:-1] + (", content: string>" if with_text else ">")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, lists = [], []
            for raw in batch.column(len(keep)).to_pylist():
                body = (raw or "").strip(BLANK)
                sizes.append(len(body))
                lists.append([{"piece": i, "start": a, "end": b, "cut": c} | ({"content": body[a:b]} if with_text else {}) for i, (a, b, c) in enumerate(pieces(body, limit, overlap))])
            kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cut", pa.string()), *([("content", pa.string())] if with_text else [])]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int32()), pa.array(lists, kind)], names=[*keep, "n_chars", "pieces"])

    return given.select(*keep, "_text").mapInArrow(run, f"{schema}, n_chars int, pieces array<{item}>")


def block_texts(df: DataFrame) -> DataFrame:
    """graph_id, loaded_at, block_id and raw_text of each block of a table of block graphs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from kgloom.operators.nested import BLOCK_KEYS, as_items, opened, read_json, text_of

        for batch in batches:
            rows: list[list] = [[], [], []]
            for i, raw in enumerate(batch.column(2).to_pylist()):
                root = read_json(raw)
                graph = opened(root.get("block_graph", root)) if isinstance(root, dict) else None
                for key, block in as_items(graph.get("blocks"), BLOCK_KEYS) if isinstance(graph, dict) else ():
                    block = opened(block)
                    if isinstance(block, dict) and isinstance(block.get("raw_text"), str):
                        for column, x in zip(rows, (i, text_of(block.get("block_id")) or key, block["raw_text"])):
                            column.append(x)
            origin = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(origin), batch.column(1).take(origin), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["graph_id", "loaded_at", "block_id", "raw_text"])

    given = df.select("graph_id", "loaded_at", "block_graph")
    stamp = given.schema["loaded_at"].dataType.simpleString()
    return given.mapInArrow(run, f"graph_id bigint, loaded_at {stamp}, block_id string, raw_text string")
