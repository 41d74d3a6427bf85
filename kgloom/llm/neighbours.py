"""The most similar vectors of every vector, by a hash-prefix forest.

A tree hashes every vector to a string of bits, one for the side of each of some random planes, and keeps the vectors in
the order of these strings, in which those with the longest common prefixes are next to each other. A forest stands on
one short stem: the first bits of its strings, by which the vectors of a stem (at most ``leaf``, where bits tell them
apart) come together in one task. There the rest of the strings is grown, ``LOCAL`` trees of it, as sorted arrays. A
query descends to its longest match and ascends in all trees of its stem in step, a bit at a time, until the nodes above
it hold ``budget`` candidates, and these are compared exactly. A query whose candidates would be more than its stem
holds takes the whole stem instead.

Each vector thus travels once for each stem, not for each tree. Stems of 0.6 ``leaf`` vectors at 0.85: 3 for 20,000
vectors, 9 for 150,000, 23 for 10 million, 102 for a billion.

Strings are only as long as evenly spread vectors need: a plane separates a pair with chance angle / pi whatever the
data are like, so that a pair at the wanted similarity meets with the wanted probability in dense groups too. Vectors
that agree in all bits are compared however many they are, so a dense group costs the square of its size.

Equal vectors are one entry, so that a vector repeated in a third of all rows costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.vectors import best_columns, distinct_vectors, unpacked
from kgloom.session import cut

BITS = 64
#: Vectors of a stem.
LEAF = 32_768
#: Vectors that agree in all bits of a stem and that one task compares; more are spread over tasks in pairs of parts.
HELD = 32_768
#: Trees that are grown on a stem, and candidates at which a query stops to ascend in them.
LOCAL, BUDGET = 12, 768
#: Close pairs for each vector of a node beyond which they are not listed but the best of each vector taken.
DENSE = 64


def bits_for(count: int, leaf: int = LEAF) -> int:
    """Halvings after which nodes of evenly spread vectors are well below ``leaf``."""
    return min(BITS, math.ceil(max(0.0, math.log2(max(1, count) / (0.6 * leaf)))))


def local_bits(count: int, budget: int = BUDGET) -> int:
    """Bits of the strings within a stem of ``count`` vectors: those after which its trees together offer about ``budget`` candidates."""
    return min(20, max(0, int(math.log2(max(1.0, LOCAL * count / budget)))))


def trees_for(count: int, similarity: float, recall: float, leaf: int = LEAF, budget: int = BUDGET) -> int:
    """Stems after which a pair of ``similarity`` has met with probability ``recall``.

    Each bit keeps it together with chance 1 - angle / pi: all bits of the stem must, then those of one of its trees.
    """
    side = 1 - math.acos(similarity) / math.pi
    bits = bits_for(count, leaf)
    inside = 1 - (1 - side ** local_bits(min(leaf, math.ceil(count / 2**bits)), budget)) ** LOCAL
    together = side**bits * inside
    return 1 if together > 1 - 1e-9 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def leaves(codes, start: int, end: int, leaf: int, bit: int = 0, bits: int = BITS):
    """(start, end) of the highest prefix-tree nodes of at most ``leaf`` of the sorted codes[start:end].

    Codes that agree in the first ``bits`` stay together, however many they are.
    """
    import numpy as np

    todo = [(start, end, bit)]
    while todo:
        low, high, at = todo.pop()
        if high - low <= leaf:
            if high > low:
                yield low, high
        elif at == bits:
            yield low, high
        else:
            flag = np.uint64(1 << (BITS - 1 - at))
            middle = low + int(np.searchsorted((codes[low:high] & flag) != 0, True))
            todo += [(middle, high, at + 1), (low, middle, at + 1)]


def best_of_each(i, j, cosine, k: int):
    """The ``k`` largest cosines of each i, ties by smaller j, of triples that may repeat."""
    import numpy as np

    order = np.lexsort((j, -cosine, i))
    i, j, cosine = i[order], j[order], cosine[order]
    fresh = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)]
    i, j, cosine = i[fresh], j[fresh], cosine[fresh]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], cosine[keep]


def ascended(values, queries, k: int, least: float, budget: int = BUDGET, seed: int = 17):
    """(i, j, cosine) of the ``k`` nearest of at least ``least`` among the candidates of each of ``queries``, ascending rows of a stem's matrix."""
    import numpy as np

    exact = values.astype(np.float64)
    exact /= np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]
    quick = exact.astype(np.float32)
    n, bits = len(values), local_bits(len(values), budget)
    sides = quick @ np.random.default_rng(seed).standard_normal((values.shape[1], LOCAL * bits)).astype(np.float32) > 0
    codes = (sides.reshape(n, LOCAL, bits) @ (1 << np.arange(bits)[::-1])).T if bits else np.zeros((LOCAL, n), np.int64)
    # in step over all trees, from the longest prefix upwards, until there are enough candidates; 0 is the whole stem
    level = np.full(n, -1)
    for at in range(bits, -1, -1):
        total = np.zeros(n, np.int64)
        for code in codes:
            prefix = code >> (bits - at)
            total += np.bincount(prefix, minlength=1 << at)[prefix]
        level[(level < 0) & (total >= min(budget, n))] = at
        level[(level == at) & (total >= n)] = 0
    asked = np.zeros(n, bool)
    asked[queries] = True
    kth = np.full(n, max(least, -1.5))
    parts: list[tuple] = []

    def compare(rows, columns):
        strip = max(1, (1 << 22) // len(columns))
        for start in range(0, len(rows), strip):
            some = rows[start : start + strip]
            products = quick[some] @ quick[columns].T
            place = np.searchsorted(columns, some)
            products[np.arange(len(some)), place] = -2  # every query is its own candidate
            hits = np.flatnonzero(products >= (kth[some] - 1e-5).astype(np.float32)[:, None])
            if len(hits) > DENSE * len(some) and len(columns) > k:
                top = np.partition(products, len(columns) - k, axis=1)[:, len(columns) - k]
                hits = np.flatnonzero(products >= np.maximum(kth[some] - 1e-5, top - 2e-5).astype(np.float32)[:, None])
            if len(hits) > DENSE * len(some):  # more alike than float32 can tell
                parts.extend(best_columns(exact, some, columns, k, least))
            else:
                i, j = np.divmod(hits, len(columns))
                i, j = some[i], columns[j]
                cosine = np.round(np.einsum("ij,ij->i", exact[i], exact[j]), 12)
                sure = cosine >= least
                parts.append((i[sure], j[sure], cosine[sure]))

    def settle():
        if parts:
            found = best_of_each(*(np.concatenate(x) for x in zip(*parts)), k)
            parts[:] = [found]
            full = np.bincount(found[0], minlength=n)[found[0]] == k
            last = np.flatnonzero(full & np.append(found[0][1:] != found[0][:-1], True)[: len(full)])
            kth[found[0][last]] = np.maximum(kth[found[0][last]], found[2][last])

    for at in np.unique(level[asked]):
        wanted = asked & (level == at)
        if at == 0:
            compare(np.flatnonzero(wanted), np.arange(n))
            settle()
            continue
        for code in codes:
            prefix = code >> (bits - at)
            order = np.argsort(prefix, kind="stable")
            for node in np.split(order, np.flatnonzero(np.diff(prefix[order])) + 1):
                rows = node[wanted[node]]
                if len(rows):
                    compare(rows, node)
            settle()
    return parts[0] if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def forest_pairs(entries: DataFrame, least: float, k: int, trees: int, dim: int = 64, leaf: int = LEAF, seed: int = 17, held: int = HELD, bits: int = BITS, budget: int = BUDGET, tasks: int | None = None) -> DataFrame:
    """a, b and cosine, a < b, of the pairs of entries (no bigint, vec) of at least ``least`` of which one is among the other's ``k`` nearest that it meets in one of ``trees`` stems.

    Entries that agree in all ``bits`` of a stem are never parted: up to ``held`` of them are compared in one task, more
    in all pairs of their parts. Rows are spread over ``tasks`` ranges of strings, which cut no string's entries.
    """

    def coded(batches: Iterator) -> Iterator:
        import numpy as np

        planes = np.random.default_rng(seed).standard_normal((dim, trees * bits)).astype(np.float32)
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                piece = batch.slice(part, 2048)
                sides = np.zeros((len(piece), trees, BITS), bool)
                sides[:, :, :bits] = (unpacked(piece.column(1), dim) @ planes > 0).reshape(len(piece), trees, bits)
                codes = np.packbits(sides, axis=2).view(">u8").reshape(len(piece), trees)
                yield piece, (codes ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)  # keeps the order of unsigned codes

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for piece, signed in coded(batches):
            for tree in range(trees):
                code, n = np.unique(signed[:, tree], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), tree, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["tree", "code", "n"])

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for piece, signed in coded(batches):
            row = pa.array(np.repeat(np.arange(len(piece)), trees))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(piece))), pa.array(signed.reshape(-1)), piece.column(0).take(row), piece.column(1).take(row)], names=["tree", "code", "no", "vec"])

    def compared(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def best(nos, values, tree, low, high):
            # a node with next to no others looks at its neighbours in the order of strings, too
            first, last = (low, high) if high - low > 4 * k else (max(0, low - budget // 2), min(len(nos), high + budget // 2))
            order = np.argsort(nos[first:last])  # the smaller no first, which decides ties
            nos, values = nos[first:last][order], values[first:last][order]
            i, j, cosine = ascended(values, np.flatnonzero((order >= low - first) & (order < high - first)), k, least, budget, seed + 1 + int(tree))
            if len(i):
                low, high = np.minimum(i, j), np.maximum(i, j)
                _, once = np.unique(low * np.int64(len(nos)) + high, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(nos[low[once]]), pa.array(nos[high[once]]), pa.array(cosine[once])], names=["a", "b", "cosine"])

        def nodes(tree, codes, blocks, nos, values, last):
            """Compares all nodes but the last one, which may go on; returns where that begins."""
            other = (np.diff(tree) != 0) | (np.diff(blocks) != 0) | ((blocks[1:] > 0) & (np.diff(codes) != 0))
            for part in np.split(np.arange(len(tree)), np.flatnonzero(other) + 1):
                whole = len(part) and blocks[part[0]] > 0
                found = [(int(part[0]), int(part[-1]) + 1)] if whole else list(leaves(codes, int(part[0]), int(part[-1]) + 1, leaf, bits=bits)) if len(part) else []
                ends = not last and len(part) and part[-1] == len(tree) - 1
                start, end = (int(part[0]), int(part[-1]) + 1) if len(part) else (0, 0)
                for low, high in found[:-1] if ends else found:
                    yield from best(nos[start:end], values[start:end], tree[low], low - start, high - start)
                if ends:
                    yield found[-1][0]

        held = None
        for batch in batches:
            fresh = (batch.column(0).to_numpy(), (batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), unpacked(batch.column(4), dim))
            held = fresh if held is None else tuple(np.concatenate(x) for x in zip(held, fresh))
            if len(held[0]) >= 2 * leaf:
                for out in nodes(*held, last=False):
                    if isinstance(out, int):
                        held = tuple(x[out:] for x in held)
                    else:
                        yield out
        if held is not None and len(held[0]):
            yield from nodes(*held, last=True)

    rows = entries.select("no", "vec").mapInArrow(hashed, "tree int, code bigint, no bigint, vec binary")
    alike = cut(entries.select("no", "vec").mapInArrow(counted, "tree int, code bigint, n bigint").groupBy("tree", "code").agg(F.sum("n").alias("n")).where(F.col("n") > held))
    if alike.isEmpty():
        spread = rows.withColumn("block", F.lit(0))
    else:
        parts = alike.select("tree", "code", F.ceil(F.col("n") / F.lit(max(1, held // 2))).cast("int").alias("parts"))
        pairs = "if(parts is null, array(0), transform(filter(sequence(0, parts - 1), p -> p <> own), p -> 1 + least(p, own) * parts + greatest(p, own)))"
        spread = rows.join(parts, ["tree", "code"], "left").withColumn("own", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.expr(pairs)))
    ordered = spread.select("tree", "code", "block", "no", "vec").repartitionByRange(*([tasks] if tasks else []), "tree", "code", "block").sortWithinPartitions("tree", "code", "block", "no")
    return ordered.mapInArrow(compared, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def nearest(vectors: DataFrame, k: int = 10, similarity: float = 0.85, recall: float = 0.998, dim: int = 64, leaf: int = LEAF, beyond: bool = False, budget: int = BUDGET) -> DataFrame:
    """id, near_id, cosine and rank: for each vector its ``k`` most similar others with a cosine of at least ``similarity``, or with ``beyond`` of any.

    ``vectors`` has id (unique) and vec; see :func:`kgloom.functions.vectors.usable_vectors`. Equal cosines go by id. A
    pair of at least ``similarity`` is met with probability ``recall``; those below it less often, in tables of up to
    ``budget`` vectors always. Without ``beyond`` a vector without a close one has no row; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    named = cut(distinct_vectors(vectors, dim))
    by_id = Window.partitionBy("same").orderBy("id")
    few = cut(named.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1))
    firsts = few.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("vec", "id").alias("vec"))
    entries = cut(firsts.orderBy(F.col("ids")[0]).withColumn("no", F.monotonically_increasing_id()))  # in the order of ids, which decides ties
    within = named.join(entries.select("same", "ids"), "same").where("size(ids) > 1").select("id", F.explode("ids").alias("near_id"), F.lit(1.0).alias("cosine")).where("id <> near_id")
    count = entries.count()
    trees = trees_for(count, similarity, recall, leaf, budget)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, math.ceil(2 * trees * count / leaf)))
    pairs = cut(forest_pairs(entries, -1.0 if beyond else similarity, k, trees, dim, leaf, bits=bits_for(count, leaf), budget=budget, tasks=tasks))
    both = pairs.select("a", "b", "cosine").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    queries = entries.where(F.size("ids") <= k).select(F.col("no").alias("a"), F.col("ids").alias("own"))
    others = entries.select(F.col("no").alias("b"), F.col("ids").alias("near"))
    met = both.join(others, "b").select("a", "cosine", F.explode("near").alias("near_id"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "near_id")
    met = met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
    across = met.join(queries, "a").select(F.explode("own").alias("id"), "near_id", "cosine")
    ranked = within.unionByName(across).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near_id")))
    return ranked.where(F.col("rank") <= k)
