"""Queries p2_ and p3_: late events and hub hierarchies, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.operators.hierarchy import ancestor_pairs, nested_sets
from tideloom.operators.late_events import event_time_counts
from tideloom.runtime import table


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "posts").where("id is not null and received_at is not null")
    return posts.groupBy("id").agg(F.min("received_at").alias("received_at"), F.min_by("published_at", "received_at").alias("published_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fates = event_time_counts(_arrivals(spark, sf_dir), "id", "published_at", "received_at", emit="records")
    return fates.where("fate <> 'on_time'").select(F.col("id").alias("post_id"), "fate")


def p2_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_time_counts(_arrivals(spark, sf_dir), "id", "published_at", "received_at")
    return rows.select("period_start", "on_time", "amended", "refused")


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = table(spark, sf_dir, "event_hubs").where("id is not null")
    latest = hubs.groupBy("id").agg(F.max(F.struct("last_updated_at", "merged_into_id")).alias("row")).select("id", F.col("row.merged_into_id").alias("merged_into_id"))
    return nested_sets(latest, "id", "merged_into_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "event_hubs").where("id is not null").groupBy("id").agg(F.max(F.struct("last_updated_at", "merged_into_id")).alias("row"))
    pointing = raw.where("row.merged_into_id is not null").select("id")
    return _hierarchy(spark, sf_dir).join(pointing, "id", "left_semi").select(F.col("id").alias("hub_id"), F.col("root").alias("root_id"), "depth")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hierarchy(spark, sf_dir)
    return rows.select(F.col("id").alias("hub_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", ">").alias("path"), F.col("size") - 1, "on_ring").toDF("hub_id", "root_id", "depth", "path", "n_below", "on_ring")


def p3_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hub with every hub merged into it, directly or through others."""
    return ancestor_pairs(_hierarchy(spark, sf_dir)).select(F.col("ancestor_id").alias("hub_id"), F.col("descendant_id").alias("below_id"), "steps")


QUERIES = {f.__name__: f for f in (p2_found, p2_hours, p3_found, p3_hierarchy, p3_below)}

_ARRIVALS = "SELECT id, received_at, published_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS rn FROM posts WHERE received_at IS NOT NULL) WHERE rn = 1 AND published_at IS NOT NULL"
_FATES = f"""SELECT id AS post_id, date_trunc('hour', published_at) AS h, CASE
  WHEN received_at <= date_trunc('hour', published_at) + INTERVAL 75 MINUTE THEN 'on_time'
  WHEN received_at <= date_trunc('hour', published_at) + INTERVAL 25 HOUR THEN 'amends' ELSE 'refused' END AS fate FROM ({_ARRIVALS})"""
_HUBS = "SELECT id, merged_into_id AS p FROM (SELECT id, merged_into_id, row_number() OVER (PARTITION BY id ORDER BY last_updated_at DESC) AS rn FROM event_hubs) WHERE rn = 1"
_WALK = f"""WITH RECURSIVE h AS ({_HUBS}), g AS (SELECT h.id, CASE WHEN k.id IS NULL THEN NULL ELSE h.p END AS p, h.p AS raw FROM h LEFT JOIN h k ON h.p = k.id),
  down AS (SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM g WHERE p IS NULL
    UNION ALL SELECT g.id, d.root, d.depth + 1, d.path || '>' || CAST(g.id AS VARCHAR) FROM g JOIN down d ON g.p = d.id),
  up AS (SELECT id AS below_id, p AS hub_id, 1 AS steps FROM g WHERE p IS NOT NULL AND id IN (SELECT id FROM down)
    UNION ALL SELECT u.below_id, g.p, u.steps + 1 FROM up u JOIN g ON u.hub_id = g.id WHERE g.p IS NOT NULL)"""

SQL = {
    "p2_found": f"SELECT post_id, fate FROM ({_FATES}) WHERE fate <> 'on_time'",
    "p2_hours": f"SELECT h AS period_start, count(*) FILTER (WHERE fate = 'on_time') AS on_time, count(*) FILTER (WHERE fate = 'amends') AS amended, count(*) FILTER (WHERE fate = 'refused') AS refused FROM ({_FATES}) GROUP BY 1",
    "p3_found": f"{_WALK} SELECT g.id AS hub_id, coalesce(d.root, -1) AS root_id, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth FROM g LEFT JOIN down d ON g.id = d.id WHERE g.raw IS NOT NULL",
    "p3_hierarchy": f"""{_WALK} SELECT g.id AS hub_id, coalesce(d.root, -1) AS root_id, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth, d.path AS path,
      CASE WHEN d.id IS NULL THEN NULL ELSE coalesce(n.n, 0) END AS n_below, d.id IS NULL AS on_ring
      FROM g LEFT JOIN down d ON g.id = d.id LEFT JOIN (SELECT hub_id, count(*) AS n FROM up GROUP BY 1) n ON g.id = n.hub_id""",
    "p3_below": f"{_WALK} SELECT hub_id, below_id, CAST(steps AS BIGINT) AS steps FROM up",
}
