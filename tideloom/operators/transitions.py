"""Status changes of posts: claims, noise, guarded assignment, the sweep of old candidates, stuck posts, the buffer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.config import DEFAULT, Config
from tideloom.functions.text import entities_conflict, identity_tokens
from tideloom.operators import matching

def _at(as_of: datetime | str) -> Column:
    return F.lit(as_of).cast("timestamp")


def before(as_of: datetime | str, seconds: float) -> Column:
    return _at(as_of) - F.make_dt_interval(secs=F.lit(float(seconds)))


def pending(posts: DataFrame, limit: int = 500, hints: DataFrame | None = None, chunk: int = 128) -> DataFrame:
    """`(id, chunk)` of the next `limit` pending posts, lowest id first, in chunks; `hints(id)` narrows to those ids.

    A chunk size of 0 or less is one chunk.
    """
    rows = posts.where("assignment_status = 'pending'").select("id")
    if hints is not None:
        rows = rows.join(hints.select("id").distinct(), "id", "left_semi")
    taken = rows.orderBy("id").limit(limit)
    place = F.row_number().over(Window.orderBy("id")) - 1  # at most `limit` rows
    return taken.select("id", (F.floor(place / chunk) if chunk > 0 else F.lit(0)).cast("long").alias("chunk"))


def newest_hints(hints: DataFrame, cap: int = 100_000) -> DataFrame:
    """The `cap` newest rows of `hints(id, at)`: older hints fall out, as the pending scan finds their posts anyway."""
    return hints.orderBy(F.desc("at"), F.desc("id")).limit(cap)


def with_status(posts: DataFrame, changes: DataFrame, allowed: tuple[str, ...], as_of: datetime | str) -> DataFrame:
    """Posts after `changes(id, status, event_id, confidence)`, which apply only where the status is among `allowed`."""
    marks = changes.select("id", F.col("status").alias("__status"), F.col("event_id").alias("__event"), F.col("confidence").alias("__conf")).dropDuplicates(["id"])
    rows = posts.join(marks, "id", "left")
    hit = F.col("__status").isNotNull() & F.col("assignment_status").isin(*allowed) & F.col("deleted_at").isNull()
    value = {"assignment_status": F.when(hit, F.col("__status")).otherwise(F.col("assignment_status")), "event_id": F.when(hit, F.col("__event")).otherwise(F.col("event_id")),
        "assignment_confidence": F.when(hit, F.col("__conf").cast("decimal(5,4)")).otherwise(F.col("assignment_confidence")), "assignment_updated_at": F.when(hit, _at(as_of)).otherwise(F.col("assignment_updated_at"))}
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in posts.columns])


def noise(gated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, outbox events, journal rows) of `gated(id, reason)`, posts that the gate turned away."""
    changes = gated.select("id", F.lit("noise").alias("status"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("confidence"))
    events = gated.select(F.lit("post.noise").alias("event_type"), F.col("id").alias("post_id"), F.lit(None).cast("long").alias("event_id"), F.to_json(F.struct(F.col("id").alias("post_id"), F.lit("noise").alias("status"), "reason")).alias("payload"))
    journal = gated.select(F.col("id").alias("post_id"), F.lit("noise").alias("status"), F.lit("discourse_gate_noise").alias("reason"))
    return changes, events, journal


def released(posts: DataFrame, as_of: datetime | str, seconds: float = 300) -> DataFrame:
    """Posts stuck in processing for longer than `seconds` are pending again."""
    stuck = (F.col("assignment_status") == "processing") & (F.col("assignment_updated_at") < before(as_of, seconds))
    value = {"assignment_status": F.when(stuck, "pending").otherwise(F.col("assignment_status")), "assignment_updated_at": F.when(stuck, _at(as_of)).otherwise(F.col("assignment_updated_at"))}
    return posts.select(*[value.get(c, F.col(c)).alias(c) for c in posts.columns])


def sweep(posts: DataFrame, hubs: DataFrame, identity: DataFrame, as_of: datetime | str, dim: int, limit: int = 200, minutes: float = 10, threshold: float = DEFAULT.assign_threshold, cfg: Config = DEFAULT) -> DataFrame:
    """`(post_id, status, event_id, confidence, sim, runner_sim, reason)` for the `limit` longest waiting candidates.

    Each is matched once more. The veto comes before the tie-break here, the tie-break may not pick a hub that conflicts
    with the post, and what is still not assigned becomes unassigned.
    """
    waiting = posts.where((F.col("assignment_status") == "candidate") & F.col("event_id").isNull() & (F.col("assignment_updated_at") < before(as_of, minutes * 60)))
    taken = waiting.orderBy("assignment_updated_at", "id").limit(limit)
    none = F.array().cast("array<string>")
    tokens = lambda name, key: identity.select(F.col("event_id").alias(key), F.col("tokens").alias(name))
    rows = (
        matching.match_top2(taken, hubs, dim).join(taken.select(F.col("id").alias("post_id"), identity_tokens(F.col("entities")).alias("mine")), "post_id")
        .join(tokens("best", "event_id"), "event_id", "left").join(tokens("second", "runner_id"), "runner_id", "left").withColumns({c: F.coalesce(c, none) for c in ("mine", "best", "second")})
    )
    sim, runner = F.col("sim"), F.col("runner_sim")
    first = matching.decision(sim, runner, threshold, cfg)
    clear = (first == "assigned") & ~entities_conflict(F.col("mine"), F.col("best"))
    open_case = (first == "candidate") | ((first == "assigned") & ~clear)
    with_best, with_second = F.arrays_overlap("mine", "best"), F.arrays_overlap("mine", "second")
    tie = open_case & (sim >= cfg.tiebreak_sim) & (with_best != with_second)
    theirs = F.when(with_best, F.col("best")).otherwise(F.col("second"))
    broken = tie & ~entities_conflict(F.col("mine"), theirs)
    to_second = broken & ~with_best
    event = F.when(clear | (broken & with_best), F.col("event_id")).when(to_second, F.col("runner_id"))
    status = F.when(clear | broken, "assigned").otherwise("unassigned")
    reason = F.when(clear, "auto_resolve_candidate").when(broken, "entity_tiebreak").otherwise("auto_resolve_unassigned")
    return rows.select("post_id", status.alias("status"), event.alias("event_id"), F.when(tie & ~with_best, runner).otherwise(sim).alias("confidence"), "sim", "runner_sim", reason.alias("reason"))


def buffer_rows(buffer: DataFrame, posts: DataFrame, since: Column | None = None) -> DataFrame:
    """The buffer's rows of live posts (others are purged), from `since` on, with the post's columns; oldest first."""
    rows = buffer.where(F.col("created_at") >= since) if since is not None else buffer
    live = posts.where("deleted_at is null").select(F.col("id").alias("post_id"), "user_id", "entities")
    return rows.join(live, "post_id").orderBy("created_at", "post_id")


def to_buffer(buffer: DataFrame, posts: DataFrame, ids: DataFrame, as_of: datetime | str) -> DataFrame:
    """The buffer with the posts of `ids(id)` that it lacks."""
    new = posts.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("post_id"), "embedding", _at(as_of).alias("created_at"))
    return buffer.unionByName(new.join(buffer.select("post_id"), "post_id", "left_anti"))


def aged(posts: DataFrame, as_of: datetime | str, hours: float = 24) -> DataFrame:
    """Changes (see `with_status`) of posts without hub that have waited longer than `hours` since they were created."""
    old = posts.where(F.col("event_id").isNull() & F.col("deleted_at").isNull() & F.col("assignment_status").isin("pending", "candidate", "unassigned") & (F.col("created_at") < before(as_of, hours * 3600)))
    return old.select("id", F.lit("noise").alias("status"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("confidence"))
