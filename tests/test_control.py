"""The outbox, status changes and pages on planted rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideloom.functions import text as tx
from tideloom.functions import vectors as vx
from tideloom.operators import outbox, transitions
from tideloom.plans import pages

T0 = datetime(2026, 3, 1)
BOX = "id long, event_type string, post_id long, event_id long, payload string, delivery_status string, attempts int, consumer string, lease_token string, lease_until timestamp, available_at timestamp, delivered_at timestamp, last_error string, created_at timestamp"


def box(spark, rows):
    full = [{"id": i, "event_type": "post.assigned", "post_id": i, "event_id": 1, "payload": "{}", "delivery_status": "pending", "attempts": 0, "available_at": T0, "created_at": T0, **more} for i, more in rows]
    names = [f.split()[0] for f in BOX.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], BOX)


def test_payloads(spark):
    df = spark.createDataFrame([("post.assigned", 1, 42, 0.91, 7), ("post.candidate", 2, None, None, None)], "t string, p long, e long, c double, s long")
    got = [r.x for r in df.select(outbox.payload(F.col("t"), F.col("p"), F.col("e"), F.col("c"), F.col("s")).alias("x")).collect()]
    assert [json.loads(x) for x in got] == [{"post_id": 1, "event_id": 42, "status": "assigned", "confidence": 0.91, "post_seq": 7}, {"post_id": 2, "event_id": None, "status": "candidate", "confidence": None}]


def test_written_events(spark):
    b = box(spark, [(1, {"delivery_status": "delivered", "attempts": 3, "lease_token": "t", "delivered_at": T0}), (2, {"post_id": None, "event_type": "event.created"})])
    events = spark.createDataFrame([("post.assigned", 1, 5, "a", 1), ("post.assigned", 1, 6, "b", 2), ("post.noise", 1, None, "c", 1), ("event.merged", None, 9, "d", 1), ("event.merged", None, 9, "d", 2)], "event_type string, post_id long, event_id long, payload string, n int")
    after = outbox.write(b, events, T0 + timedelta(hours=1), [F.desc("n")]).collect()
    assert len(after) == 5 and len({r.id for r in after}) == 5 and {r.id for r in after} == {1, 2, 3, 4, 5}
    one = next(r for r in after if r.id == 1)
    assert (one.event_id, one.payload, one.delivery_status, one.attempts, one.lease_token, one.delivered_at) == (6, "b", "pending", 0, "t", T0)


def test_acknowledgement_needs_the_lease(spark):
    h = timedelta(hours=1)
    rows = [(1, {}), (2, {"delivery_status": "leased", "lease_token": "t", "lease_until": T0 + h}), (3, {"delivery_status": "leased", "lease_token": "t", "lease_until": T0 + h}), (4, {"delivery_status": "leased", "lease_token": "t", "lease_until": T0 - h}), (5, {"delivery_status": "failed"}), (6, {"delivery_status": "leased", "lease_token": "t", "lease_until": T0 + h})]
    acks = spark.createDataFrame([(1, None), (2, "t"), (3, "other"), (4, None), (5, None), (6, None), (77, "t")], "id long, token string")
    after, told = outbox.ack(box(spark, rows), acks, T0)
    assert {r.id: r.outcome for r in told.collect()} == {1: "acked", 2: "acked", 3: "conflict", 4: "acked", 5: "closed", 6: "conflict", 77: "missing"}
    assert {r.id for r in after.where("delivery_status = 'delivered'").collect()} == {1, 2, 4}


def test_delivery_and_breaker(spark):
    rows = [{"id": i, "event_type": "x", "post_id": i, "event_id": None, "payload": "é"} for i in range(1, 10)]
    seen = []

    def send(body, headers):
        seen.append((body, headers))
        return 200 if len(seen) == 1 else 500

    told = outbox.deliver(rows, send, outbox.Breaker(), lambda: 0.0, "key")
    assert [ok for _, ok, _ in told] == [True] + [False] * 5 + [None] * 3 and told[1][2] == "HTTP 500"
    body, headers = seen[0]
    assert headers["X-Signature"] == "sha256=" + outbox.signature(body, "key") and "é".encode() in body
    breaker = outbox.Breaker(limit=1, rest=300)
    breaker.note(False, 0.0)
    assert breaker.shut(299) and not breaker.shut(300)
    breaker.note(True, 301)
    assert not breaker.shut(301)
    claimed = outbox.claim(box(spark, [(1, {}), (2, {"attempts": 4}), (3, {}), (4, {"available_at": T0 + timedelta(hours=1)}), (5, {})]), T0, 3)
    assert {r.id: r.attempts for r in claimed.where("delivery_status = 'leased'").collect()} == {1: 1, 2: 5, 3: 1}
    after = outbox.settle(claimed, spark.createDataFrame([(1, True, None), (2, False, "HTTP 500"), (3, None, None)], "id long, ok boolean, error string"), T0)
    assert {r.id: (r.delivery_status, r.attempts, r.last_error) for r in after.collect()} == {1: ("delivered", 1, None), 2: ("failed", 5, "HTTP 500"), 3: ("pending", 0, None), 4: ("pending", 0, None), 5: ("pending", 0, None)}


def test_guarded_changes_and_empty_tables(spark):
    schema = "id long, assignment_status string, event_id long, assignment_confidence decimal(5,4), assignment_updated_at timestamp, deleted_at timestamp, note string"
    posts = spark.createDataFrame([(1, "pending", None, None, T0, None, "x"), (2, "assigned", 4, None, T0, None, "x"), (3, "pending", None, None, T0, T0, "x")], schema)
    changes = spark.createDataFrame([(i, "assigned", 9, 0.7) for i in (1, 2, 3, 99)], "id long, status string, event_id long, confidence double")
    got = {r.id: (r.assignment_status, r.event_id) for r in transitions.with_status(posts, changes, ("pending",), T0).collect()}
    assert got == {1: ("assigned", 9), 2: ("assigned", 4), 3: ("pending", None)}
    assert transitions.with_status(posts.where("id < 0"), changes, ("pending",), T0).count() == 0
    assert [r.chunk for r in transitions.pending(posts, 10, chunk=0).collect()] == [0, 0]
    empty = box(spark, [(1, {})]).where("id < 0")
    assert outbox.write(empty, changes.select(F.lit("a").alias("event_type"), F.col("id").alias("post_id"), "event_id", F.lit("{}").alias("payload")), T0, [F.col("payload")]).count() == 4
    assert outbox.prune(empty, T0).count() == 0 and outbox.retry_failed(empty, T0).count() == 0


def test_gate_words(spark):
    words = set(tx.signal_lexicon())
    assert {"drives", "vetoes", "banned", "planned", "denied", "studies", "rallied", "hikes", "dropped", "opened", "signed", "crashes", "plunged", "soar"} <= words and not {"announce", "openned", "run"} & words
    rows = [("nothing here but seven plain little words", None), ("the two rivals met and rates plunged today", None), ("nothing here but seven plain little Words", True)]
    df = spark.createDataFrame(rows, "t string, p boolean")
    assert [r.g for r in df.select(tx.gate(F.col("t"), F.lit(False), F.coalesce("p", F.lit(False))).alias("g")).collect()] == ["lacks_substance", "valid_discourse", "valid_discourse"]


def test_binary_vectors(spark):
    df = spark.createDataFrame([([0.123456789, -0.000123456],), ([],), (None,)], "v array<float>")
    got = [r.b for r in df.select(vx.to_binary("v").alias("b")).select(vx.from_binary("b").alias("b")).collect()]
    assert got == [df.first().v, None, None]
    with pytest.raises(Exception, match="packed"):
        spark.createDataFrame([(bytearray(b"\x00\x02\x00\x00\x00"),)], "b binary").select(vx.from_binary("b")).collect()


def test_orders_windows_and_settings(spark):
    df = spark.createDataFrame([(1, 0.5, T0), (2, None, T0 - timedelta(days=2)), (3, 0.9, T0 - timedelta(days=9))], "id long, similarity double, created_at timestamp")
    ids = lambda rows: [r.id for r in rows.collect()]
    assert ids(df.orderBy(pages.ordered("sim_asc", pages.DECISION_ORDERS, "time"))) == [1, 3, 2] and ids(df.orderBy(pages.ordered("bad", pages.DECISION_ORDERS, "time"))) == [1, 2, 3]
    assert ids(pages.since(df, "24h", pages.DECISION_WINDOWS, T0, None)) == [1] and ids(pages.since(df, "odd", pages.DECISION_WINDOWS, T0, None)) == [1, 2, 3] and ids(pages.since(df, "odd", pages.AUDIT_WINDOWS, T0, "7d")) == [1, 2]
    assert pages.redacted_settings({"API_TOKEN": "x", "DB_PASSWORD": "", "SIZE": 3}) == {"API_TOKEN": "***", "DB_PASSWORD": "", "SIZE": 3}
