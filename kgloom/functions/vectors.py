"""Vectors: the usable ones of a table, and their similarity in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.current import current_rows, trimmed


def usable_vectors(df: DataFrame, dim: int = 64, key: str = "id", vector: str = "embedding", order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """id (trimmed) and vec, the raw little-endian float32 bytes, of the current rows with ``dim`` finite numbers that are not all zero.

    Rows with a null id are left out; other columns are ignored.
    """
    rows = current_rows(df.select(trimmed(key).alias("id"), *order, F.col(vector).cast("array<float>").alias("v")).where("id is not null"), ["id"], order, ["v"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
            batch = batch.filter(fits)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), packed(values[good])], names=["id", "vec"])

    return rows.mapInArrow(run, "id string, vec binary")


def packed(values):
    """The rows of a float32 matrix as a binary array."""
    import numpy as np
    import pyarrow as pa

    values = np.ascontiguousarray(values, "<f4")
    width = values.shape[1] * 4 if values.ndim == 2 else 0
    offsets = np.arange(len(values) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def unpacked(column, dim: int):
    """The float32 matrix of a binary array."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def canonical(values):
    """Float32 rows scaled by powers of two only, so that exact multiples by these become equal; -0 becomes 0."""
    import numpy as np

    _, exponent = np.frexp(np.abs(values).max(axis=1))
    return np.ldexp(values, -exponent[:, None]) + np.float32(0)


def distinct_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``vectors`` with same, 16 bytes that are equal exactly for vectors equal up to a power of two."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            plain = canonical(unpacked(batch.column(1), dim))
            same = pa.array([hashlib.md5(row.tobytes()).digest() for row in plain], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(plain), same], names=["id", "vec", "same"])

    return vectors.select("id", "vec").mapInArrow(run, "id string, vec binary, same binary")


def close_pairs(values, threshold: float, strip: int = 512):
    """(i, j, cosine) of all pairs i < j of a matrix with a cosine of at least ``threshold``, in strips of rows.

    Float32 products choose, float64 ones decide.
    """
    import numpy as np

    exact = values.astype(np.float64)
    exact /= np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]
    quick = exact.astype(np.float32)
    for start in range(0, len(values), strip):
        found = quick[start : start + strip] @ quick[start:].T >= np.float32(threshold - 1e-5)
        i, j = np.nonzero(found)
        keep = j > i
        i, j = i[keep] + start, j[keep] + start
        for part in range(0, len(i), 1 << 18):
            a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            cosine = np.round(np.einsum("ij,ij->i", exact[a], exact[b]), 12)
            sure = cosine >= threshold
            yield a[sure], b[sure], cosine[sure]


def close_rows(values, threshold: float, k: int, strip: int = 512, tile: int = 2048):
    """(i, j, cosine) of each row's ``k`` nearest others of at least ``threshold``, of equal ones those that come first; i < j, pairs may repeat.

    For matrices in which most pairs are close: memory stays at a strip's products with a tile of rows, which are float64
    and rounded like the cosines of :func:`close_pairs`, so that both choose the same.
    """
    import numpy as np

    exact = values.astype(np.float64)
    exact /= np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]
    every = np.arange(len(values))
    for i, j, cosine in best_columns(exact, every, every, k, threshold, strip, tile):
        yield np.minimum(i, j), np.maximum(i, j), cosine


def best_columns(exact, rows, columns, k: int, threshold: float, strip: int = 512, tile: int = 2048):
    """(row, column, cosine) of the ``k`` nearest ``columns`` of each of ``rows``, both ascending places in a matrix of unit float64 rows.

    A row is no neighbour of its own. Of equal cosines, rounded to 12 digits, those of smaller columns come first.
    """
    import numpy as np

    for start in range(0, len(rows), strip):
        own = rows[start : start + strip]
        some = exact[own]
        nearest, cosine = np.full((len(own), k), -1), np.full((len(own), k), -2.0)
        for low in range(0, len(columns), tile):
            part = columns[low : low + tile]
            products = some @ exact[part].T
            at = np.searchsorted(part, own)
            itself = np.flatnonzero((at < len(part)) & (part[np.minimum(at, len(part) - 1)] == own))
            products[itself, at[itself]] = -2
            # only what is greater than the k-th so far can still count: what is equal comes later
            least = np.maximum(cosine[:, -1] + 4e-13, threshold - 1e-12)
            i, j = np.divmod(np.flatnonzero(products > least[:, None]), products.shape[1])
            if len(i) > 4 * k * len(own):
                products = np.round(products, 12)
                place = max(0, products.shape[1] - k)
                kth = np.maximum(np.partition(products, place, axis=1)[:, place], least)[:, None]
                above, equal = products > kth, products == kth
                above |= equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
                i, j = np.divmod(np.flatnonzero(above), products.shape[1])
            if not len(i):
                continue
            a, fresh = np.unique(i, return_inverse=True)
            c = np.round(np.einsum("ij,ij->i", some[i], exact[part[j]]), 12)
            row = np.concatenate([np.repeat(np.arange(len(a)), k), fresh])
            near, close = np.concatenate([nearest[a].ravel(), part[j]]), np.concatenate([cosine[a].ravel(), c])
            order = np.lexsort((near, -close, row))
            first = np.searchsorted(row[order], np.arange(len(a)))
            best = order[first[:, None] + np.arange(k)]
            nearest[a], cosine[a] = near[best], close[best]
        i, at = np.nonzero((nearest >= 0) & (cosine >= threshold))
        yield own[i], nearest[i, at], cosine[i, at]
