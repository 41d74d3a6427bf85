"""Evaluation texts leaking into training text, by greedy string tiling.

All windows of ``size`` consecutive words of a text have running Karp-Rabin hashes. Those of the test items are the seeds;
those of the documents are compared with them by a join on the hash, so neither side is ever held as a whole and the
corpus is read once. A bit filter of the seeds, of bounded size, keeps windows that can't match from travelling. Shared
windows that follow each other in document and item are one match; the longest matches are marked first, so that no
word of the item or of the document is covered twice. What is covered tells a leak even where passages were put in
another order.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut

#: The filter of seeds has at most 2 ** FILTER_BITS bits (16 MB) and goes to every task.
FILTER_BITS = 27
#: Different words whose hashes a task remembers.
HELD = 1_000_000
WORD = re.compile(r"[^\W_]+")
_BASE = 1_000_003


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


class WordHashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: str) -> int:
        from hashlib import blake2b

        value = self[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


def window_hashes(ids, size: int):
    """Karp-Rabin hashes of all windows of ``size`` ids, modulo 2**64."""
    import numpy as np

    count = len(ids) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    values, out = ids.astype(np.uint64), np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(_BASE) + values[i : i + count]
    return out


def tiles(doc, item, pairs, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in doc, place in item, length), longest first, none shorter than ``size`` or overlapping another.

    ``pairs`` are places (in doc, in item) where windows of ``size`` may agree; ``doc`` and ``item`` are sequences of words or ids.
    """
    runs: list[tuple[int, int, int]] = []
    ended: dict[int, int] = {}
    for i, j in sorted(pairs):
        if ended.get(i - j, -1) >= i + size:
            continue
        n = 0
        while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
            n += 1
        if n >= size:
            ended[i - j] = i + n
            runs.append((i, j, n))
    return marked_tiles(runs, size)


def marked_tiles(runs: Iterable[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of the longest matches ``runs`` (place in doc, place in item, length)."""
    queue = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(queue)
    if not queue:
        return []
    first_doc, first_item = min(i for _, i, _ in queue), min(j for *_, j in queue)
    free_doc = bytearray(b"\1" * (max(i - n for n, i, _ in queue) - first_doc))
    free_item = bytearray(b"\1" * (max(j - n for n, _, j in queue) - first_item))
    out = []
    while queue:
        n, i, j = heapq.heappop(queue)
        n, x, y = -n, i - first_doc, j - first_item
        if 0 not in free_doc[x : x + n] and 0 not in free_item[y : y + n]:
            out.append((i, j, n))
            free_doc[x : x + n] = free_item[y : y + n] = bytes(n)
            continue
        open_ = [free_doc[x + k] and free_item[y + k] for k in range(n)]
        k = 0
        while k < n:  # what is left between marked words goes back as shorter runs
            if not open_[k]:
                k += 1
                continue
            start = k
            while k < n and open_[k]:
                k += 1
            if k - start >= size:
                heapq.heappush(queue, (start - k, i + start, j + start))
    return out


def windows(df: DataFrame, key: str, text: str, size: int, sieve=None, bits: int = 0) -> DataFrame:
    """``key``, copy (a hash of the text), words (its number of words), hash, at and run of every window of ``size`` words.

    Windows of equal hash that follow each other are one row of ``run`` windows from ``at`` on. With ``sieve``, a
    broadcast array of 2 ** ``bits`` bits, only windows whose bit is set are listed.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            if len(known) > HELD:
                known.clear()
            rows, columns = [], []
            for n, text_ in enumerate(batch.column(2).to_pylist()):
                words = words_of(text_)
                if len(words) < size:
                    continue
                hashes = window_hashes(np.array([known[w] for w in words], np.uint64), size)
                first = np.append(True, hashes[1:] != hashes[:-1])
                at = np.flatnonzero(first)
                length = np.diff(np.append(at, len(hashes)))
                if sieve is not None:
                    place = hashes[at] >> np.uint64(64 - bits)
                    hit = (sieve.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                    at, length = at[hit], length[hit]
                if len(at):
                    rows.append(np.full(len(at), n))
                    columns.append((np.full(len(at), len(words)), hashes[at].view(np.int64), at, length))
            if rows:
                words_, hashes, at, length = (np.concatenate(c) for c in zip(*columns))
                origin = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(origin), batch.column(1).take(origin), pa.array(words_, pa.int32()), pa.array(hashes), pa.array(at, pa.int32()), pa.array(length, pa.int32())], names=[key, "copy", "words", "hash", "at", "run"]
                )

    given = df.select(key, F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"`{key}` {kind}, copy bigint, words int, hash bigint, at int, run int")


def _sieve(seeds: DataFrame, most: int):
    """A broadcast bit array of the seeds' hashes by their leading bits, and how many bits tell its places apart."""
    import numpy as np

    bits = max(6, min(most, (64 * seeds.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = seeds.select(F.shiftrightunsigned(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set")).toPandas()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
    return seeds.sparkSession.sparkContext.broadcast(held), bits


def leaks(documents: DataFrame, items: DataFrame, min_match: int = 12, min_coverage: float = 0.0, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, longest, covered and item_words of each document that holds passages of an item.

    ``longest`` is the longest tile in words, ``covered`` the item's words within tiles of at least ``min_match`` words;
    pairs with a covered share below ``min_coverage`` are left out. ``documents`` has doc_id and text, ``items`` item_id
    and text; other columns are ignored. Null and short texts match nothing. Different texts of one id give rows of
    their own, equal ones count once.
    """
    size = min_match
    seeds = cut(windows(items, "item_id", "text", size))
    sieve, bits = _sieve(seeds, filter_bits)
    here = windows(documents, "doc_id", "text", size, sieve, bits)
    there = seeds.select("item_id", F.col("copy").alias("item_copy"), F.col("words").alias("item_words"), "hash", F.col("at").alias("item_at"), F.col("run").alias("item_run"))
    # of two runs of one hash, what matches from their first and from their last window on
    both = here.join(there, "hash").withColumn("m", F.least("run", "item_run"))
    ends = F.array_distinct(F.array(F.struct(F.col("at").alias("i"), F.col("item_at").alias("j")), F.struct((F.col("at") + F.col("run") - F.col("m")).alias("i"), (F.col("item_at") + F.col("item_run") - F.col("m")).alias("j"))))
    pair = ["doc_id", "copy", "item_id", "item_copy", "item_words"]
    shared = both.select(*pair, "m", F.explode(ends).alias("e")).select(*pair, "m", "e.i", (F.col("e.i") - F.col("e.j")).alias("diagonal"))
    along = Window.partitionBy(*pair, "diagonal").orderBy("i", "m")
    reached = F.max(F.col("i") + F.col("m")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = shared.withColumn("fresh", F.coalesce(F.col("i") > reached, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    matches = islands.groupBy(*pair, "diagonal", "island").agg(F.min("i").alias("i"), (F.max(F.col("i") + F.col("m")) - F.min("i") + size - 1).alias("n"))
    listed = matches.groupBy(*pair).agg(F.collect_list(F.struct("i", (F.col("i") - F.col("diagonal")).alias("j"), "n")).alias("runs"))

    def tile(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [marked_tiles([(r["i"], r["j"], r["n"]) for r in runs], size) for runs in batch.column(3).to_pylist()]
            longest, covered = [t[0][2] for t in got], [sum(n for *_, n in t) for t in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(longest, pa.int32()), pa.array(covered, pa.int32()), batch.column(2)], names=["doc_id", "item_id", "longest", "covered", "item_words"])

    kinds = [documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    found = listed.select("doc_id", "item_id", "item_words", "runs").mapInArrow(tile, f"doc_id {kinds[0]}, item_id {kinds[1]}, longest int, covered int, item_words int")
    return found.where(F.col("covered") >= min_coverage * F.col("item_words"))
