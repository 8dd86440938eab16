"""The whole way from posts to hubs on a corpus with known truth, and the invariants that must hold after it."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideloom.functions.text import content_signature
from tideloom.operators import birth, corrections, folding
from tideloom.plans import pages
from tideloom.runtime import cut, single_runner
from tideloom.sources import synthetic


def test_corpus_is_reproducible(spark):
    a, b = (synthetic.corpus(spark, seed=7).collect() for _ in range(2))
    assert a == b and a != synthetic.corpus(spark, seed=8).collect()
    assert Counter(r.kind for r in a) == {"signal": 48, "flood": 12, "near": 4, "spam": 6, "weak": 3, "noise": 10}


def test_posts_to_hubs(spark):
    rows = cut(synthetic.corpus(spark))
    none = spark.createDataFrame([], "id long, centroid array<float>, member_count int, seed_post_id long")
    found, hubs = birth.birth(rows.withColumn("author", F.col("user_id").cast("string")), none, 32)
    posts = rows.join(found.select("id", "event_id"), "id", "left").select(
        "id", "event_id", F.when(F.col("event_id").isNotNull(), "assigned").otherwise("unassigned").alias("assignment_status"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("long").alias("repost_of_id"),
        content_signature(F.col("content")).alias("content_sig"), F.transform("embedding", lambda x: x.cast("float")).alias("embedding"), "kind", "ground_truth")
    after = cut(folding.fold_hubs(cut(posts), 32))
    got = after.collect()
    assert not [r for r in got if r.kind in ("spam", "weak", "noise") and r.event_id is not None]
    topics = {}
    for r in got:
        if r.event_id is not None:
            topics.setdefault(r.event_id, set()).add(r.ground_truth)
    assert all(len(t) == 1 for t in topics.values()) and Counter(t for s in topics.values() for t in s) == {0: 1, 1: 1, 2: 1, 3: 1}  # one hub a topic
    assert sum(r.event_id is not None for r in got if r.kind == "signal") >= 46
    assert {r.assignment_status for r in got if r.kind == "flood"} == {"repost"}
    assert corrections.broken_invariants(after).count() == 0
    counts = {r.event_id: r.member_count + r.repost_count for r in folding.hub_counts(after).collect()}
    assert counts == Counter(r.event_id for r in got if r.event_id is not None)


def test_one_runner_at_a_time(spark):
    with single_runner(spark, "births") as first:
        assert first
        with single_runner(spark, "births") as second:
            assert not second
    with single_runner(spark, "births") as third:
        assert third


def test_consumers(spark):
    one = spark.createDataFrame([(4, "a", "A", "x", True, 5, None)], "id long, consumer_id string, name string, token_hash string, is_active boolean, rate_limit_per_minute int, last_used_at timestamp")
    two = pages.with_consumer(one, "b", "B", "secret", None, "2026-03-01")
    with pytest.raises(ValueError):
        pages.with_consumer(two, "b", "C", "t", None, "2026-03-01")
    calls = spark.createDataFrame([("secret",), ("other",), ("",)], "token string")
    found, seen = pages.authenticated(two, calls, "2026-03-01")
    assert [(r.consumer_id, r.rate_limit_per_minute) for r in found.collect()] == [("b", 60)] and seen.where("last_used_at is not null").count() == 1
    off = pages.toggled(two, "b")
    assert pages.authenticated(off, calls, "2026-03-01")[0].count() == 0 and pages.without_consumer(off, "b").count() == 1
