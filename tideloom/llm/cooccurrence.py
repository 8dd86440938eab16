"""Items that appear together: exact pair counts over sorted runs of packed 64-bit pair codes.

Items get dense 32-bit numbers; each task packs the pairs of its records into 64-bit codes, sorts them and writes
run-length counted runs; Spark's external sort merges the runs of each code range (spilling as needed), and one streaming
pass adds up the runs. Only (code, count) crosses the shuffle, so a pair in a third of all records costs one row a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.runtime import cut, maybe_broadcast

#: Longest run buffered in a task before it is sorted and written, in pairs (8 bytes each).
RUN_PAIRS = 2_000_000
#: Items of one record that are paired at once.
TILE = 1_024
#: A vocabulary up to this size is sent to the tasks; a larger one is joined.
IN_PLACE = 500_000


def spelled(item: Column) -> Column:
    """Lower case, no blanks at the ends and around the first colon, inner blanks single."""
    flat = F.regexp_replace(F.lower(item), r"(?U)[\s\p{Cf}]+", " ")
    return F.trim(F.regexp_replace(flat, r"^([^:]*?) ?: ?", "$1:"))


def numbered(items: DataFrame, column: str) -> DataFrame:
    """Add `code`, a dense number from 0, to distinct `items` without gathering them: sorted ranges plus their offsets."""
    ranged = cut(items.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("__part", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("__part").count().collect())  # one row a partition
    total = 0
    offsets = []
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    if total >= 1 << 31:
        raise ValueError(f"{total} distinct items do not fit 31-bit codes")
    spark = items.sparkSession
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "__part int, __from long"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return ranged.join(table, "__part").withColumn("code", (F.col("__from") + place).cast("long")).drop("__part", "__from")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of sorted distinct codes -> sorted runs (code, n)."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["code", "n"])

    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)
        for length in np.unique(lengths):  # all records of one length at once
            if length < 2:
                continue
            at = starts[lengths == length]
            if length > TILE:  # a long record is paired tile by tile, so no more than a run is held at once
                for start in at.tolist():
                    codes = np.sort(flat[start : start + length])
                    for a in range(0, length, TILE):
                        for b in range(a, length, TILE):
                            grid = (codes[a : a + TILE, None] << 32) | codes[None, b : b + TILE]
                            held.append(grid[np.triu_indices(len(grid), 1)] if a == b else grid.ravel())
                            size += held[-1].size
                            if size >= RUN_PAIRS:
                                yield flush()
                                held, size = [], 0
                continue
            left, right = np.triu_indices(length, 1)
            step = max(1, RUN_PAIRS // len(left))
            for i in range(0, len(at), step):
                rows = flat[at[i : i + step, None] + np.arange(length)]
                rows.sort(axis=1)
                held.append(((rows[:, left] << 32) | rows[:, right]).ravel())
                size += held[-1].size
                if size >= RUN_PAIRS:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by code -> run-length sums, one row a code."""
    code, total = None, 0
    for batch in batches:
        codes, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        heads = np.concatenate([[0], np.nonzero(np.diff(codes))[0] + 1])
        sums, keys = np.add.reduceat(counts, heads), codes[heads]
        if code is not None and keys[0] == code:
            sums[0] += total
        elif code is not None:
            yield pa.RecordBatch.from_arrays([pa.array([code]), pa.array([total])], names=["code", "n"])
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["code", "n"])
        code, total = int(keys[-1]), int(sums[-1])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code]), pa.array([total])], names=["code", "n"])


def cooccurrence(records: DataFrame, key: str, items: str, min_pairs: int = 1) -> DataFrame:
    """`(item_a, item_b, n_ab, n_a, n_b, n, lift, log_odds)` for pairs named together in at least `min_pairs` records.

    `n` counts the records that name any item; `lift` is n_ab * n / (n_a * n_b); `log_odds` is the logarithm of the odds
    ratio of the 2 x 2 table with 0.5 added to each cell. An item counts once a record (spelled alike); null and blank
    items, and null or empty arrays, name nothing. `item_a` sorts before `item_b`. Items named by fewer than `min_pairs`
    records cannot reach it and are left out of the pairing, which loses nothing. Keys are expected once. An empty table
    gives an empty result; other columns are ignored.
    """
    lists = records.select(F.col(key).alias("k"), F.array_distinct(F.filter(F.transform(items, spelled), lambda x: x.isNotNull() & (F.length(x) > 0))).alias("its")).where("size(its) > 0")
    named = lists.select(F.posexplode("its").alias("pos", "item"))
    counts = cut(named.groupBy("item").agg(F.count("*").alias("m"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("heads")))
    n = counts.agg(F.sum("heads")).first()[0] or 0  # each record has one first item
    coded = cut(numbered(counts.where(F.col("m") >= max(1, min_pairs)).select("item", "m"), "item"))
    vocabulary = coded.count()
    side = maybe_broadcast(coded.select("item", "code"), vocabulary)
    baskets = (
        lists.withColumn("r", F.xxhash64("k", "its")).select("k", "r", F.explode("its").alias("item")).join(side, "item").groupBy("k", "r").agg(F.collect_list("code").alias("codes")).where("size(codes) > 1").select("codes")
        if vocabulary > IN_PLACE
        else _coded_in_place(lists, coded)
    )
    runs = baskets.mapInArrow(_runs, "code long, n long")
    pairs = runs.repartition(F.col("code")).sortWithinPartitions("code").mapInArrow(_merge, "code long, n long").where(F.col("n") >= min_pairs)
    a, b = coded.select(F.col("code").alias("ca"), F.col("item").alias("item_a"), F.col("m").alias("n_a")), coded.select(F.col("code").alias("cb"), F.col("item").alias("item_b"), F.col("m").alias("n_b"))
    both = pairs.select(F.shiftright("code", 32).alias("ca"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("cb"), F.col("n").alias("n_ab"))
    both = both.join(maybe_broadcast(a, vocabulary), "ca").join(maybe_broadcast(b, vocabulary), "cb").withColumn("n", F.lit(n).cast("long"))
    half = F.lit(0.5)
    odds = F.log((F.col("n_ab") + half) * (F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + half) / ((F.col("n_a") - F.col("n_ab") + half) * (F.col("n_b") - F.col("n_ab") + half)))
    return both.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), odds.alias("log_odds"))


def _coded_in_place(lists: DataFrame, coded: DataFrame) -> DataFrame:
    """A vocabulary of bounded size is sent to the tasks, which number the items of each record without a shuffle."""
    words = coded.select("item", "code").collect()  # at most IN_PLACE rows, checked by the caller
    index = lists.sparkSession.sparkContext.broadcast({w: c for w, c in words})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.value.get
        for batch in batches:
            column = batch.column(0)
            unique = column.flatten().dictionary_encode()
            table = np.array([get(w, -1) for w in unique.dictionary.to_pylist()] or [-1], dtype=np.int64)
            codes = table[unique.indices.to_numpy(zero_copy_only=False)] if len(unique) else np.zeros(0, np.int64)
            keep = codes >= 0
            ends = np.concatenate([[0], np.cumsum(keep)])[column.offsets.to_numpy() - column.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes[keep]))], names=["codes"])

    return lists.select("its").mapInArrow(number, "codes array<long>")
