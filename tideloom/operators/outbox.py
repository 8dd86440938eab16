"""The outbox as a table: payloads, keyed upserts with sequences, acknowledgement, pruning, retries and delivery.

Rows are `(id, event_type, post_id, event_id, payload, delivery_status, attempts, consumer, lease_token, lease_until,
available_at, delivered_at, last_error, created_at)`; every function takes the table and the time and gives the new table.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.operators.ledger import latest

MAX_ATTEMPTS = 5


def _at(as_of: datetime | str) -> Column:
    return F.lit(as_of).cast("timestamp")


def payload(event_type: Column, post_id: Column, event_id: Column, confidence: Column, seq: Column | None = None) -> Column:
    """JSON of an assignment event; the status is the suffix of the event type, nulls are kept, `post_seq` comes last."""
    fields = [post_id.alias("post_id"), event_id.alias("event_id"), F.split_part(event_type, F.lit("."), F.lit(2)).alias("status"), confidence.alias("confidence")]
    kept = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return kept if seq is None else F.when(seq.isNull(), kept).otherwise(F.concat(F.substring_index(kept, "}", 1), F.lit(',"post_seq":'), seq.cast("string"), F.lit("}")))


def bumped(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """`(post_id, post_seq)`: the next sequence number of every distinct post of `ids(post_id)`, one a call."""
    return ids.where("post_id is not null").select("post_id").distinct().join(posts.select(F.col("id").alias("post_id"), (F.coalesce("post_seq", F.lit(0)) + 1).alias("post_seq")), "post_id")


def write(box: DataFrame, events: DataFrame, as_of: datetime | str, order: list[Column]) -> DataFrame:
    """`box` with `events(event_type, post_id, event_id, payload)` upserted by post and type, the last under `order` winning.

    A rewritten row is pending again with no attempts, and keeps its lease and time of delivery. Events without a post
    are always new rows. New ids follow the highest one, numbered per post type and post from ranges, not in one task.
    """
    keyed = latest(events.where("post_id is not null"), ["post_id", "event_type"], order).select("event_type", "post_id", F.col("event_id").alias("__event"), F.col("payload").alias("__payload"), F.lit(True).alias("__new"))
    both = box.where("post_id is not null").join(keyed, ["post_id", "event_type"], "left")
    new = F.coalesce("__new", F.lit(False))
    value = {"event_id": F.when(new, F.col("__event")).otherwise(F.col("event_id")), "payload": F.when(new, F.col("__payload")).otherwise(F.col("payload")), "delivery_status": F.when(new, "pending").otherwise(F.col("delivery_status")),
        "attempts": F.when(new, 0).otherwise(F.col("attempts")).cast("int"), "available_at": F.when(new, _at(as_of)).otherwise(F.col("available_at"))}
    rewritten = both.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])
    fresh = keyed.join(box.select("post_id", "event_type"), ["post_id", "event_type"], "left_anti").unionByName(
        events.where("post_id is null").select("event_type", "post_id", F.col("event_id").alias("__event"), F.col("payload").alias("__payload"), F.lit(True).alias("__new")))
    top = box.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    # A number in each of 1,024 hashed shards, shards after each other: no task numbers all rows.
    shard = fresh.withColumn("__s", F.pmod(F.xxhash64("event_type", "post_id", "__event"), F.lit(1024)))
    sizes = shard.groupBy("__s").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("__from", F.coalesce(F.sum("n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 1,024 rows
    place = F.row_number().over(Window.partitionBy("__s").orderBy("event_type", "post_id", "__event", "__payload"))
    numbered = shard.withColumn("__n", place).join(F.broadcast(starts), "__s").crossJoin(F.broadcast(top))
    given = {"id": F.col("__top") + F.col("__from") + F.col("__n"), "event_type": F.col("event_type"), "post_id": F.col("post_id"), "event_id": F.col("__event"), "payload": F.col("__payload"), "delivery_status": F.lit("pending"), "attempts": F.lit(0), "available_at": _at(as_of), "created_at": _at(as_of)}
    inserted = numbered.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in box.dtypes])
    return rewritten.unionByName(inserted).unionByName(box.where("post_id is null"))


def ack(box: DataFrame, acks: DataFrame, as_of: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(box, `(id, outcome)`) after `acks(id, token)`: acked, conflict (an active lease of another token), closed or missing.

    An active lease is acknowledged with its own token only; a row without one by anyone.
    """
    t = _at(as_of)
    asked = acks.select("id", F.col("token").alias("__token"), F.lit(True).alias("__asked")).dropDuplicates(["id"])
    rows = box.join(asked, "id", "left")
    open_row = F.col("delivery_status").isin("pending", "leased")
    mine = F.col("lease_until").isNull() | (F.col("lease_until") <= t) | F.coalesce(F.col("lease_token") == F.col("__token"), F.lit(False))
    hit = F.coalesce("__asked", F.lit(False)) & open_row & mine
    value = {"delivery_status": F.when(hit, "delivered").otherwise(F.col("delivery_status")), "delivered_at": F.when(hit, t).otherwise(F.col("delivered_at")), "lease_until": F.when(~hit, F.col("lease_until"))}
    after = rows.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])
    outcome = F.when(hit, "acked").when(open_row, "conflict").otherwise("closed")
    told = rows.where("__asked").select("id", outcome.alias("outcome"))
    missing = asked.join(box.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("outcome"))
    return after, told.unionByName(missing)


def prune(box: DataFrame, as_of: datetime | str, unconsumed_days: float = 7, failed_days: float = 30, delivered_days: float = 7) -> DataFrame:
    """Pending rows nobody took within `unconsumed_days` fail as `unconsumed_event`; those are deleted after
    `failed_days`, delivered rows after `delivered_days`. Other failures stay."""
    ago = lambda days: _at(as_of) - F.make_dt_interval(secs=F.lit(days * 86_400.0))
    held = F.col("consumer").isNotNull() & F.coalesce(F.col("lease_until") > _at(as_of), F.lit(False))
    aged = (F.col("delivery_status") == "pending") & (F.col("available_at") < ago(unconsumed_days)) & ~held
    value = {"delivery_status": F.when(aged, "failed").otherwise(F.col("delivery_status")), "last_error": F.when(aged, "unconsumed_event").otherwise(F.col("last_error")),
        "attempts": (F.col("attempts") + aged.cast("int")).cast("int"), "lease_until": F.when(~aged, F.col("lease_until"))}
    state = box.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])
    gone = ((F.col("delivery_status") == "failed") & F.coalesce(F.col("last_error") == "unconsumed_event", F.lit(False)) & (F.col("created_at") < ago(failed_days))) | ((F.col("delivery_status") == "delivered") & F.coalesce(F.col("delivered_at") < ago(delivered_days), F.lit(False)))
    return state.where(~gone)


def supersede(box: DataFrame, folded: DataFrame) -> DataFrame:
    """Assignment events of `folded(post_id)`, posts that another one stands for, are superseded."""
    marks = folded.select("post_id").distinct().withColumn("__f", F.lit(True))
    rows = box.join(marks, "post_id", "left")
    hit = F.coalesce("__f", F.lit(False)) & (F.col("event_type") == "post.assigned") & (F.col("delivery_status") != "superseded")
    value = {"delivery_status": F.when(hit, "superseded").otherwise(F.col("delivery_status")), "last_error": F.when(hit, "folded_repost").otherwise(F.col("last_error")), "attempts": (F.col("attempts") + hit.cast("int")).cast("int")}
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])


def retry_failed(box: DataFrame, as_of: datetime | str) -> DataFrame:
    """Failed rows are pending again, without attempts and error."""
    dead = F.col("delivery_status") == "failed"
    value = {"delivery_status": F.when(dead, "pending").otherwise(F.col("delivery_status")), "attempts": F.when(dead, 0).otherwise(F.col("attempts")).cast("int"), "available_at": F.when(dead, _at(as_of)).otherwise(F.col("available_at")), "last_error": F.when(~dead, F.col("last_error"))}
    return box.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])


def claim(box: DataFrame, as_of: datetime | str, limit: int) -> DataFrame:
    """The next `limit` rows for delivery, leased for two minutes: `(box)` with their attempts raised."""
    t = _at(as_of)
    ready = (F.col("available_at") <= t) & ((F.col("delivery_status") == "pending") | ((F.col("delivery_status") == "leased") & (F.col("lease_until") < t)))
    mine = box.where(ready).orderBy("id").limit(limit).select("id", F.lit(True).alias("__mine"))
    rows = box.join(mine, "id", "left")
    hit = F.col("__mine").isNotNull()
    value = {"delivery_status": F.when(hit, "leased").otherwise(F.col("delivery_status")), "attempts": (F.col("attempts") + hit.cast("int")).cast("int"), "lease_until": F.when(hit, t + F.expr("INTERVAL 2 MINUTES")).otherwise(F.col("lease_until"))}
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])


def settle(box: DataFrame, outcomes: DataFrame, as_of: datetime | str) -> DataFrame:
    """The claimed rows after `outcomes(id, ok, error)`: delivered, pending again in a minute, or failed at the fifth try.

    An outcome whose `ok` is null was not tried: the row is pending and gets its attempt back.
    """
    t = _at(as_of)
    rows = box.join(outcomes.select("id", F.col("ok").alias("__ok"), F.col("error").alias("__error"), F.lit(True).alias("__told")), "id", "left")
    told, tried = F.coalesce("__told", F.lit(False)), F.col("__ok").isNotNull()
    spent = F.col("attempts") >= MAX_ATTEMPTS
    status = F.when(~tried, "pending").when(F.col("__ok"), "delivered").when(spent, "failed").otherwise("pending")
    again = told & tried & ~F.col("__ok") & ~spent
    value = {
        "delivery_status": F.when(told, status).otherwise(F.col("delivery_status")), "lease_until": F.when(~told, F.col("lease_until")),
        "attempts": F.when(told & ~tried, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")).cast("int"), "last_error": F.when(told & tried & ~F.col("__ok"), F.col("__error")).otherwise(F.col("last_error")),
        "delivered_at": F.when(told & F.coalesce("__ok", F.lit(False)), t).otherwise(F.col("delivered_at")), "available_at": F.when(again, t + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("available_at"))}
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in box.columns])


def signature(body: bytes, secret: str) -> str:
    """Hexadecimal HMAC-SHA256 of the exact bytes that are sent."""
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


class Breaker:
    """Opens after `limit` failures in a row and lets one try pass after `rest` seconds; the caller gives the time."""

    def __init__(self, limit: int = 5, rest: float = 300.0) -> None:
        self.limit, self.rest, self.failures, self.opened = limit, rest, 0, None

    def shut(self, now: float) -> bool:
        return self.opened is not None and now - self.opened < self.rest

    def note(self, ok: bool, now: float) -> None:
        self.failures = 0 if ok else self.failures + 1
        self.opened = None if ok else now if self.failures >= self.limit else self.opened


def deliver(rows: Iterable, send: Callable[[bytes, dict[str, str]], int], breaker: Breaker, now: Callable[[], float], secret: str | None = None) -> list[tuple[int, bool | None, str | None]]:
    """Send one claimed batch (bounded by `claim`'s limit): `(id, ok, error)`; rows after the breaker opens are not tried.

    `send(body, headers)` gives an HTTP status. The body is compact JSON of the row, signed if there is a secret.
    """
    out: list[tuple[int, bool | None, str | None]] = []
    for r in rows:
        if breaker.shut(now()):
            out.append((r["id"], None, None))
            continue
        body = json.dumps({c: r[c] for c in ("id", "event_type", "post_id", "event_id", "payload")} | {"dispatched_at": now()}, separators=(",", ":"), ensure_ascii=False, default=str).encode()
        headers = {"Content-Type": "application/json"} | ({"X-Signature": f"sha256={signature(body, secret)}"} if secret else {})
        try:
            code = send(body, headers)
            ok, error = code in (200, 201, 202, 204), f"HTTP {code}"
        except Exception as e:  # noqa: BLE001  any failure of the transport is a failed delivery
            ok, error = False, str(e)[:400]
        breaker.note(ok, now())
        out.append((r["id"], ok, None if ok else error))
    return out
