"""Session helpers shared by every operator: table reading, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side with at most this many narrow rows may be broadcast (tens of MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: And at most this many bytes by the plan's statistics (compressed files: some three times as much in memory).
BROADCAST_BYTES = 64 << 20


def local_session(app: str = "tideloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share: `spark.checkpoint.dir`.

    Only a local session, where executors and driver are one process, gets a temporary folder if it is unset.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder for intermediate tables")
        got = "file://" + tempfile.mkdtemp(prefix="tideloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a `cut` that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows and estimated bytes are within bounds; else leave the join to AQE."""
    if rows > bound:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # plans without statistics give the product of their sides
    return F.broadcast(df) if not known or size <= BROADCAST_BYTES else df


def one_row_per_key(df: DataFrame, key: str, order: list[Column], bound: int = BROADCAST_ROWS) -> DataFrame:
    """The first row of each `key` under `order`, with all columns, without shuffling rows whose key is unique.

    A narrow count finds the keys that occur more than once; only their rows pass through a window. Rows with a null
    key are dropped. Ties under `order` keep one row (which one is decided by a hash of the row).
    """
    df = df.where(F.col(key).isNotNull())
    again = cut(df.groupBy(key).count().where("count > 1").select(key))
    n = again.count()
    if n == 0:
        return df
    side = maybe_broadcast(again, n, bound)
    rank = Window.partitionBy(key).orderBy(*order, F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    repeated = df.join(side, key, "left_semi").withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")
    return df.join(side, key, "left_anti").unionByName(repeated)


def first_delivery(posts: DataFrame) -> DataFrame:
    """One row per post: the delivery with the earliest `received_at` (rows without one come last)."""
    return one_row_per_key(posts, "id", [F.col("received_at").asc_nulls_last()])


def latest_hub(hubs: DataFrame) -> DataFrame:
    """One row per hub: the row with the latest `last_updated_at`; exact double rows count once."""
    return one_row_per_key(hubs, "id", [F.col("last_updated_at").desc_nulls_last()])


@contextmanager
def single_runner(spark: SparkSession, job: str) -> Iterator[bool]:
    """Whether this driver is the only one to run `job` now: a lock file in the shared folder, removed at the end.

    It does not wait; a driver that died leaves its lock, which names its application and is removed by hand.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lock-{job}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, False)
    except Exception:  # noqa: BLE001  the file is there: another driver holds the lock
        yield False
        return
    out.write(bytearray(spark.sparkContext.applicationId.encode()))
    out.close()
    try:
        yield True
    finally:
        fs.delete(path, False)
