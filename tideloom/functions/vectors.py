"""Vector functions as column expressions over `array<float>`; sums run in double."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is null, empty, all zero, or the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.try_divide(dot(a, b), norm(a) * norm(b)))


def normalize(a: Column | str, epsilon: float = 1e-9) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    lengths = F.array_repeat(norm(a) + epsilon, F.size(a))  # once a row: an outer expression in a lambda runs per element
    return F.zip_with(_d(a), lengths, lambda x, n: x / n)


def blend(anchor: Column | str, rolling: Column | str, weight: float = 0.35) -> Column:
    """Weighted sum of an anchor and a rolling centroid, to unit length."""
    return normalize(F.zip_with(_d(anchor), _d(rolling), lambda a, r: F.lit(weight) * a + F.lit(1 - weight) * r))


def rolling(old: Column | str, count: Column | str, added_sum: Column | str, added: Column | str, most: int = 150) -> Column:
    """Centroid after `added` vectors of sum `added_sum`; the old one weighs at most `most` members."""
    old, count, added_sum, added = (F.col(x) if isinstance(x, str) else x for x in (old, count, added_sum, added))
    weight = F.least(F.when(F.coalesce(count, F.lit(0)) == 0, 1).otherwise(count), F.lit(most))
    moved = F.zip_with(_d(old), _d(added_sum), lambda o, s: (o * weight + s) / (weight + added))
    return F.when(old.isNull(), F.transform(_d(added_sum), lambda s: s / added)).otherwise(moved)


def merged(a: Column | str, n_a: Column | str, b: Column | str, n_b: Column | str, most: int = 150) -> Column:
    """Centroid of two hubs, each weighing at most `most` members, to unit length."""
    n_a, n_b = (F.least(F.col(x) if isinstance(x, str) else x, F.lit(most)) for x in (n_a, n_b))
    return normalize(F.zip_with(_d(a), _d(b), lambda x, y: (x * n_a + y * n_b) / F.greatest(n_a + n_b, F.lit(1))))


def vector_sums(rows: DataFrame, by: str, vector: str, dim: int, unit: bool = False) -> DataFrame:
    """`(by, n, sums)`: element sums of the vectors (or of their unit vectors) of `dim` entries for each integer key.

    Each task adds up its batches before the shuffle, so a key may hold any share of the rows. Null keys, vectors of
    another length and, with `unit`, vectors that are all zero or not finite are left out.
    """

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            flat = b.column(1).flatten()
            x = (flat.fill_null(float("nan")) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            keys = b.column(0).to_numpy()
            if unit and len(x):
                size = np.linalg.norm(x, axis=1)
                ok = np.isfinite(size) & (size > 0)
                x, keys = x[ok] / size[ok, None], keys[ok]
            names, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            if not len(names):
                continue
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(names))), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), dim).cast(pa.list_(pa.float64()))], names=["k", "n", "sums"])

    def add(t: pa.Table) -> pa.Table:
        sums = t.column("sums").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(axis=0)
        return pa.table({"k": t.column("k")[:1], "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    ok = rows.where((F.size(vector) == dim) & F.col(by).isNotNull()).select(F.col(by).cast("long"), vector)
    parts = ok.mapInArrow(partial, "k long, n long, sums array<double>")
    return parts.groupBy("k").applyInArrow(add, "k long, n long, sums array<double>").withColumnRenamed("k", by)


def to_text(v: Column | str) -> Column:
    """`[a,b]`, the text form of a vector; null and empty vectors give `[]`."""
    v = F.col(v) if isinstance(v, str) else v
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(v, F.array().cast("array<float>")), lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(text: Column | str) -> Column:
    return F.from_json(F.when(F.length(F.trim(text)) > 0, text).otherwise("[]"), "array<double>")


def to_binary(v: Column | str) -> Column:
    """Big-endian 16-bit length, 16 zero bits, then 32-bit floats; null for null and empty vectors."""

    @F.pandas_udf("binary")
    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None or not len(x) else struct.pack(">HH", len(x), 0) + np.asarray(x, dtype=">f4").tobytes() for x in s], dtype=object)

    return pack(F.col(v) if isinstance(v, str) else v)


def from_binary(b: Column | str) -> Column:
    """The vector of `to_binary`; a wrong header or length is an error, null and empty give null."""

    @F.pandas_udf("array<float>")
    def unpack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = [None] * len(s)
            for i, x in enumerate(s):
                if x is None or not len(x):
                    continue
                n, zero = struct.unpack(">HH", bytes(x[:4])) if len(x) >= 4 else (0, 1)
                if zero or not n or len(x) != 4 + 4 * n:
                    raise ValueError("not a packed vector")
                out[i] = np.frombuffer(bytes(x[4:]), dtype=">f4").astype(np.float32)
            yield pd.Series(out, dtype=object)

    return unpack(F.col(b) if isinstance(b, str) else b)
