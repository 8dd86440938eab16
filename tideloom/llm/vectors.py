"""Vectors as Arrow batches and as compressed blocks for shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.runtime import cut, maybe_broadcast


def first_vectors(rows: DataFrame, key: str, vector: str, dim: int, order: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`(key, vector, *keep)` of the rows with a vector of `dim` entries; of a repeated key the row first in `order`.

    The keys that occur more than once are found in a narrow pass, so vectors are not shuffled to tell deliveries apart.
    A row delivered twice with equal `order` may stay twice; callers treat equal rows as one. Vectors that are all zero
    or hold nulls or non-finite numbers are dropped later, by `usable`.
    """
    rows = rows.where(F.col(key).isNotNull())
    columns = [key, vector, *(keep or [])]
    if order is not None:
        when = F.coalesce(F.col(order).cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
        again = cut(rows.groupBy(key).agg(F.count("*").alias("n"), F.min(when).alias("__first")).where("n > 1").select(key, "__first"))
        n = again.count()
        if n:
            rows = rows.withColumn("__when", when).join(maybe_broadcast(again, n), key, "left").where("__first is null or __when = __first")
    return rows.where(F.size(vector) == dim).select(*columns)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have `dim` entries, as float32 rows; nulls become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def usable(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are finite and not all zero, their unit vectors)."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return ok, (x[ok] / norm[ok, None]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.maximum(norm, 1e-30)[:, None]).astype(np.float32)


#: Most distinct numbers of a batch that are replaced by codes.
DICTIONARY = 4096


class Coded:
    """Float32 rows as codes into the sorted distinct numbers of a batch, where these are few; else the rows themselves.

    Lossless either way: embeddings stored with limited precision shrink to their entropy, others travel as they are.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.values, self.codes = x, None, None
        probe = x.ravel()[: 1 << 16]
        if len(np.unique(probe)) <= DICTIONARY:
            codes, values = pd.factorize(np.ascontiguousarray(x).ravel())
            if len(values) <= DICTIONARY:
                order = np.argsort(values, kind="stable")
                place = np.empty(len(values), np.uint16)
                place[order] = np.arange(len(values), dtype=np.uint16)
                self.values, self.codes = np.asarray(values)[order], place[codes].reshape(x.shape)

    def rows(self, at: np.ndarray | list[int]) -> tuple[np.ndarray, ...]:
        """Arrays that stand for the rows `at` in a packed block."""
        if self.codes is None:
            return (self.x[at],)
        planes = np.ascontiguousarray(self.codes[at]).view(np.uint8).reshape(len(at), self.codes.shape[1], 2)
        return self.values, np.ascontiguousarray(planes[..., 0]), np.ascontiguousarray(planes[..., 1])


def decoded(arrays: list[np.ndarray]) -> np.ndarray:
    """The rows of a block from the arrays of `Coded.rows`."""
    if len(arrays) == 1:
        return arrays[0]
    values, low, high = arrays
    return values[low.astype(np.uint16) | (high.astype(np.uint16) << 8)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one block in a row: shapes and types in front, compressed without loss."""
    # A byte type is written "|u1", so the separator is another character.
    body = ";".join(f"{a.dtype.str}:{','.join(map(str, a.shape))}" for a in arrays).encode() + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpack(block: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(block)
    at = body.index(b"\n") + 1
    out = []
    for head in body[: at - 1].decode().split(";"):
        kind, shape = head.rsplit(":", 1)
        dims = tuple(map(int, shape.split(",")))
        n = int(np.prod(dims))
        out.append(np.frombuffer(body, dtype=np.dtype(kind), count=n, offset=at).reshape(dims))
        at += n * np.dtype(kind).itemsize
    return out


def blocks(keys: list[int], parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], names=["block_key", "block"])


def batches_of(stream: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Regroup a stream into batches of about `rows` rows: larger blocks compress better."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in stream:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
