"""Explicit schemas of the tables, read with a fail-closed check, and versioned snapshots as the write side."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

_L, _S, _B, _I, _D, _TS, _V = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType(), T.TimestampType(), T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "posts": _struct(id=_L, user_id=_L, content=_S, has_media=_B, engagement_score=_I, ground_truth=_I, platform=_S, source_id=_S, external_post_id=_S, external_author_id=_S, published_at=_TS, received_at=_TS, deleted_at=_TS, assignment_status=_S, assignment_confidence=T.DecimalType(5, 4), assignment_updated_at=_TS, post_seq=_L, event_id=_L, embedding=_V, created_at=_TS, entities=T.ArrayType(_S), content_sig=_L, repost_of_id=_L),
    "event_hubs": _struct(id=_L, created_at=_TS, last_updated_at=_TS, member_count=_I, repost_count=_I, is_active=_B, status=_S, discourse_type=_S, seed_post_id=_L, merged_into_id=_L, title=_S, handle=_S, summary=_S, centroid=_V),
    "hub_merges": _struct(id=_L, source_event_id=_L, target_event_id=_L, initiated_by=_S, status=_S, snapshot_post_ids=_S, snapshot_member_count=_I, snapshot_centroid_source=_S, opened_note=_S, reopened_note=_S, created_at=_TS, reopened_at=_TS),
    "assignment_decision_log": _struct(id=_L, post_id=_L, event_id=_L, similarity=_D, runner_similarity=_D, threshold_used=_D, margin_budget=_D, status=_S, confidence=_D, policy_version=_S, model_version=_S, reason=_S, created_at=_TS),
    "clustering_feedback_log": _struct(id=_L, post_id=_L, event_id=_L, initial_similarity_score=T.DecimalType(4, 3), feedback_type=_S, actor=_S, model_version=_S, policy_version=_S, created_at=_TS),
}

#: Longest values accepted from outside, by column.
LENGTHS = {"content": 100_000, "platform": 50, "source_id": 200, "external_post_id": 300, "external_author_id": 300}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read one table with its schema; a missing or differently typed column is an error, never a silent null."""
    want = {f.name: f.dataType for f in SCHEMAS[name].fields}
    got = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    drift = [f"{c}: {got.get(c)} instead of {t}" for c, t in want.items() if got.get(c) != t]
    if drift:
        raise ValueError(f"{name} differs from schema version {SCHEMA_VERSION}: {'; '.join(drift)}")
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def validated(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with defaults filled, rejected rows with a reason) by the length caps."""
    reason = F.when(F.col("user_id").isNull(), "user_id missing").when(F.col("content").isNull(), "content missing")
    for c, n in LENGTHS.items():
        if c in posts.columns:
            reason = reason.when(F.length(c) > n, f"{c} longer than {n}")
    marked = posts.withColumn("reject_reason", reason)
    good = marked.where("reject_reason is null").drop("reject_reason")
    defaults = {k: v for k, v in {"has_media": False, "platform": "unknown", "source_id": "legacy"}.items() if k in posts.columns}
    return (good.fillna(defaults) if defaults else good), marked.where("reject_reason is not null")


class SnapshotStore:
    """Whole-table snapshots under one folder. Version n is the folder `vn`, valid once its marker `vn.json` is there.

    A marker is written under another name and renamed, which no reader sees half done; readers take the highest one, so
    a writer that dies leaves the version before in place, and its folder is overwritten by the next.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, text: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):  # noqa: ANN202
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Valid versions, oldest first."""
        home = self._path(f"{self.folder}/{name}")
        if not self._fs().exists(home):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(home)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def version(self, name: str) -> int:
        return max(self.versions(name), default=0)

    def write(self, name: str, df: DataFrame, keep: int = 3) -> int:
        """Write the next version and delete those older than the last `keep`."""
        new = self.version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{new}")
        fs = self._fs()
        part = self._path(f"{self.folder}/{name}/.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps({"version": new, "schema": SCHEMA_VERSION}).encode()))
        out.close()
        if not fs.rename(part, self._path(f"{self.folder}/{name}/v{new}.json")):
            raise RuntimeError(f"version {new} of {name} was written by someone else")
        for old in [v for v in self.versions(name) if v <= new - keep]:
            fs.delete(self._path(f"{self.folder}/{name}/v{old}.json"), False)
            fs.delete(self._path(f"{self.folder}/{name}/v{old}"), True)
        return new

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The highest version, or an older one that is still kept: a restore is a read of it and a write."""
        at = version or self.version(name)
        if at not in self.versions(name):
            raise ValueError(f"{name} has no version {at}")
        return self.spark.read.parquet(f"{self.folder}/{name}/v{at}")

    def migrate(self, name: str, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> int:
        """Rewrite the current version by the steps from its schema version on, in order, forward only."""
        at = self.version(name)
        was = json.loads(self.spark.read.text(f"{self.folder}/{name}/v{at}.json").first()[0])["schema"]
        if was > SCHEMA_VERSION:
            raise ValueError(f"{name} has schema version {was}, newer than {SCHEMA_VERSION}")
        df = self.read(name)
        for n in range(was + 1, SCHEMA_VERSION + 1):
            if n not in steps:
                raise ValueError(f"no step to schema version {n}")
            df = steps[n](df)
        return self.write(name, df) if was < SCHEMA_VERSION else at

    def append(self, name: str, df: DataFrame, day: str = "created_at") -> None:
        """Append to a journal partitioned by day."""
        df.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(f"{self.folder}/{name}")
