"""Keyed state as DataFrames: upserts, update joins, membership intervals, sequences, leases, state diffs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], keep_old: list[str] | None = None, tombstone: str = "deleted_at") -> DataFrame:
    """`stored` with the last incoming row of each key written over it.

    A stored row with a tombstone stays as it is. Columns in `keep_old` keep the stored value where the new one is null;
    columns that `incoming` lacks keep the stored value.
    """
    new = latest(incoming, keys, order).withColumn("__new", F.lit(True))
    both = stored.withColumn("__old", F.lit(True)).alias("o").join(new.alias("n"), keys, "full_outer")
    shut = F.col(f"o.{tombstone}").isNotNull() if tombstone in stored.columns else F.lit(False)
    out: list[Column] = []
    for c in stored.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in incoming.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in (keep_old or []) else F.col(f"n.{c}")
            out.append(F.when(F.col("__new").isNotNull() & ~F.coalesce(shut, F.lit(False)), value).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`stored` with the non-null values of `changes(key, ...)` written over it; keys of `changes` are unique."""
    cols = [c for c in changes.columns if c != key]
    named = changes.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return stored.join(named, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in stored.columns])


def insert_missing(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`stored` and the incoming rows whose key it lacks."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def membership_intervals(admissions: DataFrame) -> DataFrame:
    """`admissions(post_id, hub_id, role, admitted_at)` -> intervals `(…, departed_at)`; null is the live one.

    An admission to the hub and role that the post already has changes nothing; an admission without hub ends the
    membership.
    """
    w = Window.partitionBy("post_id").orderBy("admitted_at", F.col("hub_id").asc_nulls_first(), "role")
    changed = ~(F.lag("hub_id").over(w).eqNullSafe(F.col("hub_id")) & F.lag("role").over(w).eqNullSafe(F.col("role"))) | F.lag("admitted_at").over(w).isNull()
    kept = admissions.where("post_id is not null and admitted_at is not null").withColumn("__c", changed).where("__c").drop("__c")
    w2 = Window.partitionBy("post_id").orderBy("admitted_at", F.col("hub_id").asc_nulls_first(), "role")
    return kept.withColumn("departed_at", F.lead("admitted_at").over(w2)).where("hub_id is not null").select("post_id", "hub_id", "role", "admitted_at", "departed_at")


def members_at(intervals: DataFrame, at: datetime | str) -> DataFrame:
    t = F.lit(at).cast("timestamp")
    return intervals.where((F.col("admitted_at") <= t) & (F.col("departed_at").isNull() | (F.col("departed_at") > t)))


def sequenced(events: DataFrame, key: str, order: list[Column], last: DataFrame | None = None) -> DataFrame:
    """Add `seq`: 1, 2, … per key in order, after the stored `last(key, seq)` if given."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    if last is None:
        return events.withColumn("seq", n)
    return events.join(last.select(key, F.col("seq").alias("__last")), key, "left").withColumn("seq", n + F.coalesce("__last", F.lit(0))).drop("__last")


def lease(outbox: DataFrame, as_of: datetime | str, consumer: str, token: str, limit: int, after: int = 0, lease_minutes: float = 2.0, max_attempts: int = 5) -> DataFrame:
    """The outbox after a claim: the next `limit` available rows are leased, rows out of attempts have failed."""
    t = F.lit(as_of).cast("timestamp")
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= t)
    spent = F.col("delivery_status").isin("pending", "leased") & (F.col("attempts") >= max_attempts) & free
    state = outbox.withColumn("delivery_status", F.when(spent, "failed").otherwise(F.col("delivery_status")))
    open_rows = (F.col("delivery_status") == "pending") | ((F.col("delivery_status") == "leased") & (F.col("lease_until") <= t))
    ready = state.where(open_rows & (F.col("id") > after) & (F.coalesce("available_at", t) <= t)).orderBy("id").limit(limit).select("id", F.lit(True).alias("__mine"))
    joined = state.join(ready, "id", "left")
    mine = F.col("__mine").isNotNull()
    return joined.select(
        *[c for c in outbox.columns if c not in ("delivery_status", "attempts", "consumer", "lease_token", "lease_until")],
        F.when(mine, "leased").otherwise(F.col("delivery_status")).alias("delivery_status"), (F.col("attempts") + mine.cast("int")).alias("attempts"),
        F.when(mine, consumer).otherwise(F.col("consumer")).alias("consumer"), F.when(mine, token).otherwise(F.col("lease_token")).alias("lease_token"),
        F.when(mine, t + F.make_dt_interval(secs=F.lit(lease_minutes * 60))).otherwise(F.col("lease_until")).alias("lease_until"))


def numbered_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Add `handle`: the name for the first row of a name, then `-2`, `-3` and on, leaving out numbers with which another
    name is spelled; handles are distinct."""
    first = rows.select(F.col(name).alias("__other")).distinct()
    # Names that end in a number reserve it for the name before.
    split = first.select(F.regexp_extract("__other", r"^(.*)-(\d{1,9})$", 1).alias(name), F.regexp_extract("__other", r"^(.*)-(\d{1,9})$", 2).alias("k")).where(F.length("k") > 0).where(~F.col("k").startswith("0"))
    taken = split.groupBy(name).agg(F.sort_array(F.collect_set(F.col("k").cast("long"))).alias("__taken"))
    n = F.row_number().over(Window.partitionBy(name).orderBy(key)).cast("long")
    placed = rows.withColumn("__n", n).join(taken, name, "left")
    number = F.aggregate(F.filter(F.coalesce("__taken", F.array().cast("array<long>")), lambda x: x > 1), F.col("__n"), lambda v, r: F.when(r <= v, v + 1).otherwise(v))
    return placed.withColumn("handle", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), number.cast("string")))).drop("__n", "__taken")


def state_diff(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """`(key, field, change, old, new)` between two JSON objects: added, removed or changed top-level fields."""
    maps = rows.select(key, *[F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")).alias(n) for c, n in ((before, "b"), (after, "a"))])
    fields = maps.select(key, "a", "b", F.explode(F.array_union(F.map_keys("b"), F.map_keys("a"))).alias("field"))
    old, new = F.col("b")[F.col("field")], F.col("a")[F.col("field")]
    change = F.when(~F.map_contains_key("b", F.col("field")), "added").when(~F.map_contains_key("a", F.col("field")), "removed").when(~old.eqNullSafe(new), "changed")
    return fields.select(key, "field", change.alias("change"), old.alias("old"), new.alias("new")).where("change is not null")
