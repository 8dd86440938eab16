"""Knobs, their history and the model registry: small tables kept as DataFrames, changed by whole new tables.

`config(key, value)`, `history(id, policy_version, knob, old_value, new_value, status, source, rationale, actor,
created_at)`, `registry(id, model_version, adapter_path, precision, recall, noise, status, promoted_at)`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knobs that may be changed, their range and decimals.
KNOBS = {"global_similarity_threshold": (0.500, 0.999, 3)}
BASE_POLICY, BASE_MODEL = "policy-v1", "minilm-base"


def checked(knob: str, value: float) -> float:
    """`value` at the knob's precision; an unknown knob or a value out of range is an error."""
    if knob not in KNOBS:
        raise ValueError(f"knob '{knob}' is not calibratable")
    low, high, digits = KNOBS[knob]
    out = round(float(value), digits)
    if not low <= out <= high:
        raise ValueError(f"value must be within [{low}, {high}]")
    return out


def effective_threshold(stored: Column, floor: float) -> Column:
    """The stored threshold, but never below `floor`; `floor` where none is stored."""
    return F.greatest(F.coalesce(stored.cast("double"), F.lit(floor)), F.lit(floor))


def current_versions(history: DataFrame, registry: DataFrame) -> DataFrame:
    """One row `(policy_version, model_version)`: a version more for every applied change, and the model promoted last."""
    applied = history.agg(F.count_if(F.col("status") == "applied").alias("n"))
    promoted = registry.where("status = 'promoted'").agg(F.max(F.struct(F.col("promoted_at").isNotNull().alias("known"), "promoted_at", "id", "model_version")).alias("m"))
    version = F.when(F.col("n") == 0, BASE_POLICY).otherwise(F.concat(F.lit("policy-v"), (F.col("n") + 1).cast("string")))
    return applied.crossJoin(promoted).select(version.alias("policy_version"), F.coalesce("m.model_version", F.lit(BASE_MODEL)).alias("model_version"))


def _stored(config: DataFrame, knob: str) -> float | None:
    row = config.where(F.col("key") == knob).select(F.col("value").cast("double")).first()
    return None if row is None or row[0] is None else float(row[0])


def _entry(history: DataFrame, at: datetime | str, **fields: object) -> DataFrame:
    """One more row of the history, numbered after the last."""
    last = history.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    values = {**{k: F.lit(v) for k, v in fields.items()}, "id": F.col("id"), "created_at": F.lit(at).cast("timestamp")}
    return history.unionByName(last.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in history.dtypes]))


def apply_change(config: DataFrame, history: DataFrame, knob: str, value: float, source: str, actor: str | None, at: datetime | str, rationale: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(config, history) with the knob set; a change to the value it has is an error. The row carries the version before it."""
    new, old = checked(knob, value), _stored(config, knob)
    if old is not None and round(old, KNOBS[knob][2]) == new:
        raise ValueError(f"{knob} is already {new}")
    n = history.where("status = 'applied'").count()
    version = BASE_POLICY if n == 0 else f"policy-v{n + 1}"
    spark = config.sparkSession
    types = dict(config.dtypes)
    row = spark.range(1).select(*[{"key": F.lit(knob), "value": F.lit(new)}.get(c, F.lit(None)).cast(types[c]).alias(c) for c in config.columns])
    after = config.where(F.col("key") != knob).unionByName(row)
    return after, _entry(history, at, policy_version=version, knob=knob, old_value=old, new_value=new, status="applied", source=source, rationale=rationale, actor=actor)


def propose_change(config: DataFrame, history: DataFrame, knob: str, value: float, source: str, actor: str | None, at: datetime | str, rationale: str | None = None) -> DataFrame:
    """History with one more proposal; proposing the value that holds is an error."""
    new, old = checked(knob, value), _stored(config, knob)
    if old is not None and round(old, KNOBS[knob][2]) == new:
        raise ValueError(f"{knob} is already {new}")
    return _entry(history, at, policy_version="pending", knob=knob, new_value=new, status="proposed", source=source, rationale=rationale, actor=actor)


def revert_change(config: DataFrame, history: DataFrame, change_id: int, actor: str | None, at: datetime | str) -> tuple[DataFrame, DataFrame]:
    """The applied change `change_id` taken back: its old value is applied as a change of its own."""
    row = history.where((F.col("id") == change_id) & (F.col("status") == "applied")).first()
    if row is None or row["old_value"] is None:
        raise ValueError(f"change {change_id} cannot be reverted")
    return apply_change(config, history, row["knob"], float(row["old_value"]), "panel-revert", actor, at, f"revert of {change_id}")


def promotion_verdict(registry: DataFrame, precision: float, recall: float, noise: float, least_precision: float = 0.95, least_recall: float = 0.80, most_noise: float = 0.02) -> str:
    """promoted, or why not: the gates, then the comparison with the model promoted last (zero counts as unknown)."""
    if precision < least_precision or recall < least_recall or noise > most_noise:
        return "rejected: gates"
    now = registry.where("status = 'promoted'").orderBy(F.desc("promoted_at")).first()
    if now is not None:
        if precision < (now["precision"] or 0) and recall < (now["recall"] or 0):
            return "rejected: worse"
        if noise > (now["noise"] or 1) and precision <= (now["precision"] or 0):
            return "rejected: noise"
    return "promoted"


def promote(registry: DataFrame, model: str, path: str, precision: float, recall: float, noise: float, at: datetime | str) -> DataFrame:
    """Registry with `model` promoted and the models promoted before retired; a known model keeps its id."""
    retired = registry.withColumn("status", F.when(F.col("status") == "promoted", "retired").otherwise(F.col("status")))
    fresh = registry.agg(F.coalesce(F.max(F.when(F.col("model_version") == model, F.col("id"))), F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    values = {"id": F.col("id"), "model_version": F.lit(model), "adapter_path": F.lit(path), "precision": F.lit(precision), "recall": F.lit(recall), "noise": F.lit(noise), "status": F.lit("promoted"), "promoted_at": F.lit(at).cast("timestamp")}
    row = fresh.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in registry.dtypes])
    return retired.where(F.col("model_version") != model).unionByName(row)


def upsert_rollup(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Roll-ups with `rows` written over those of the same window, versions and source."""
    keys = ["window_start", "window_end", "policy_version", "model_version", "source"]
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
