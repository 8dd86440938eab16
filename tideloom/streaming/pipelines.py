"""Structured Streaming: ingestion by micro-batch, late events with a cut-off, sequences per key, windowed roll-ups."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideloom.functions.text import content_signature
from tideloom.operators import matching, transitions
from tideloom.operators.ledger import latest, upsert
from tideloom.operators.late_events import AMENDS, ON_TIME, REFUSED, FingerBTree
from tideloom.sources.tables import SnapshotStore, validated


def ingest(batch: DataFrame, hubs: DataFrame, identity: DataFrame, dim: int, threshold: float) -> DataFrame:
    """One micro-batch of posts (with vectors and entities) to decisions, against the hubs as they stood at its start."""
    accepted, _ = validated(batch)
    newest = [F.desc_nulls_last(c) for c in ("received_at", "published_at") if c in accepted.columns]
    once = latest(accepted, ["id"], [*newest, F.xxhash64(*accepted.columns)]).withColumn("content_sig", content_signature(F.col("content")))
    matches = matching.match_top2(once, hubs, dim)
    decided = matching.assign(matches, once.select(F.col("id").alias("post_id"), "entities"), identity, threshold)
    return decided.join(once.select(F.col("id").alias("post_id"), "content_sig"), "post_id")


def ingest_stream(posts: DataFrame, store: SnapshotStore, hubs: Callable[[], DataFrame], identity: Callable[[], DataFrame], dim: int, threshold: float, checkpoint: str) -> StreamingQuery:
    """Decide every micro-batch and write it under its own number: a replayed batch overwrites itself.

    If the store holds `posts`, the batch is upserted into them (tombstones stay, the last delivery wins) and the
    decisions change the status of those that wait; the snapshot names the batch, so a replay changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        rows = ingest(batch, hubs(), identity(), dim, threshold).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{store.folder}/decisions/batch={number}")
        if store.version("posts"):
            done = store.spark.read.parquet(f"{store.folder}/decisions/batch={number}")
            newest = [F.desc_nulls_last("received_at")] if "received_at" in batch.columns else [F.desc("id")]
            accepted, _ = validated(batch)
            stored = upsert(store.read("posts"), accepted, ["id"], newest, [c for c in ("published_at",) if c in batch.columns]).fillna({"assignment_status": "pending"})
            changes = done.select(F.col("post_id").alias("id"), "status", "event_id", "confidence")
            store.write("posts", transitions.with_status(stored, changes, ("pending", "processing"), datetime.now(timezone.utc)))
        batch.unpersist()

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_event_stream(events: DataFrame, key: str, event_at: str, received_at: str, period_s: int = 3600, grace_s: int = 900, cutoff_s: int = 86400, shards: int = 64) -> DataFrame:
    """`(key, period_start, fate)` of a stream of records, by the finger B-tree kept as state.

    Periods are spread over `shards` by period and key, each with its own tree of partial aggregates; the trees' counts
    add up. Within a trigger records go in order of receipt; a record is judged by its own time of receipt, so it has the
    same fate in whatever trigger it comes.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.select(F.col(key).cast("long").alias("k"), micros(event_at).alias("e"), micros(received_at).alias("r")).where("k is not null and e is not null and r is not null")
    rows = rows.withColumn("p", F.floor(F.col("e") / (period_s * 1_000_000)).cast("long")).withColumn("shard", F.pmod(F.xxhash64("p", F.pmod("k", F.lit(4))), F.lit(shards)))
    span, grace, cutoff = period_s * 1_000_000, grace_s * 1_000_000, cutoff_s * 1_000_000

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tree: FingerBTree = pickle.loads(state.get[0]) if state.exists else FingerBTree()
        pdf = pd.concat(list(frames)).sort_values(["r", "k"], kind="stable")  # one trigger's records of one shard
        fates = []
        for p, r in zip(pdf.p.tolist(), pdf.r.tolist()):
            for _ in tree.evict(-(-(r - cutoff) // span) - 2):
                pass
            late = r > (p + 1) * span + grace
            kept = tree.add(p, int(late))  # false too for a period that a later receipt, seen before, has closed
            fates.append(REFUSED if not kept and r > (p + 1) * span + cutoff else AMENDS if late else ON_TIME)
        state.update((pickle.dumps(tree),))
        yield pd.DataFrame({"k": pdf.k, "p": pdf.p, "fate": fates})

    out = rows.groupBy("shard").applyInPandasWithState(step, "k long, p long, fate string", "tree binary", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("k").alias(key), F.timestamp_micros(F.col("p") * F.lit(span)).alias("period_start"), "fate")


def period_stream(events: DataFrame, event_at: str, received_at: str, period: str = "1 hour", cutoff: str = "24 hours") -> DataFrame:
    """`(period_start, n, late)`: running counts by event time, amended while a period is open and final after the cut-off.

    In `update` mode every trigger gives the periods it changed, in `append` mode each period once, when it closes.
    """
    rows = events.where(F.col(event_at).isNotNull()).withWatermark(event_at, cutoff)
    late = F.col(received_at) > F.window(event_at, period).getField("end") + F.expr("INTERVAL 15 MINUTES")
    return rows.withColumn("__late", late).groupBy(F.window(event_at, period).alias("w")).agg(F.count("*").alias("n"), F.count_if("__late").alias("late")).select(F.col("w.start").alias("period_start"), "n", "late")


def rollup_stream(decisions: DataFrame, every: str = "1 hour", lateness: str = "24 hours") -> DataFrame:
    """Windowed totals and assigned decisions; `append` mode gives closed windows, `update` mode the running ones."""
    rows = decisions.withWatermark("created_at", lateness)
    return rows.groupBy(F.window("created_at", every).alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "assigned").alias("assigned")).select(F.col("w.start").alias("window_start"), "total", "assigned")


def sequence_stream(events: DataFrame, key: str, at: str) -> DataFrame:
    """Add `seq`, 1, 2, … per key over the whole stream, in order of `at` within a trigger."""
    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values(at, kind="stable")
        pdf["seq"] = range(last + 1, last + 1 + len(pdf))
        state.update((last + len(pdf),))
        yield pdf

    return events.groupBy(key).applyInPandasWithState(step, f"{fields}, seq long", "seq long", "append", GroupStateTimeout.NoTimeout)


def aged_out(buffer: DataFrame, as_of: datetime, hours: float = 24.0) -> DataFrame:
    """Buffered posts older than `hours`: they become noise at the next trigger."""
    return buffer.where(F.col("created_at") < F.lit(as_of) - F.make_dt_interval(secs=F.lit(hours * 3600)))
