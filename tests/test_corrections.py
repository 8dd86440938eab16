from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom.operators import corrections

T0 = datetime(2026, 3, 1)
POSTS = "id long, event_id long, assignment_status string, deleted_at timestamp, repost_of_id long, content_sig long"
HUBS = "id long, is_active boolean, status string, merged_into_id long, member_count int, repost_count int, centroid array<float>, last_updated_at timestamp"


def tables(spark):
    posts = spark.createDataFrame([(1, 10, "assigned", None, None, 5), (2, 10, "repost", None, 1, 5), (3, 11, "assigned", None, None, 6), (4, 10, "assigned", T0, None, 7), (5, 12, "assigned", None, None, 8)], POSTS)
    hubs = spark.createDataFrame([(10, True, "active", None, 1, 1, [1.0, 0.0], T0), (11, True, "active", None, 200, 0, [0.0, 1.0], T0), (12, True, "active", None, 1, 0, None, T0)], HUBS)
    return posts, hubs, spark.createDataFrame([(10, 11), (12, 11)], "source_id long, target_id long")


def test_merge_and_reopen(spark):
    posts, hubs, pairs = tables(spark)
    moved, after, log = corrections.apply_merges(posts, hubs, pairs, T0)
    assert {r.id: r.event_id for r in moved.collect()} == {1: 11, 2: 11, 3: 11, 4: 11, 5: 11}
    got = {r.id: r for r in after.collect()}
    assert (got[10].is_active, got[10].merged_into_id, got[11].member_count, got[11].repost_count) == (False, 11, 202, 1)
    assert np.linalg.norm(got[11].centroid) == pytest.approx(1) and got[11].centroid[1] > 0.99
    assert {(r.source_event_id, r.post_id) for r in log.collect()} == {(10, 1), (10, 2), (12, 5)}
    unlinked = corrections.unlink(moved, spark.createDataFrame([(1, 11)], "post_id long, event_id long"))
    back, again = corrections.reopen_merges(unlinked, after, log.where("source_event_id = 10"), T0)
    assert {r.id: r.event_id for r in back.collect()} == {1: None, 2: 11, 3: 11, 4: 11, 5: 11}  # the copy stays, as its original did not go back
    both, counts = corrections.reopen_merges(moved, after, log.where("source_event_id = 10"), T0)
    assert {r.id: r.event_id for r in both.collect()} == {1: 10, 2: 10, 3: 11, 4: 11, 5: 11}
    assert {r.id: (r.member_count, r.repost_count) for r in counts.collect()} == {10: (1, 1), 11: (2, 0), 12: (1, 0)}
    onward = after.withColumn("merged_into_id", F.when(F.col("id") == 10, 99).otherwise(F.col("merged_into_id")))
    assert {r.id: r.event_id for r in corrections.reopen_merges(moved, onward, log.where("source_event_id = 10"), T0)[0].collect()}[1] == 11
    assert {r.id: (r.is_active, r.merged_into_id) for r in again.collect()} == {10: (True, None), 11: (True, None), 12: (False, 11)}


def test_unlink_confirm_and_delete_move_counts(spark):
    posts = spark.createDataFrame([(1, 10, "assigned", None, None, 5, 0.9, [1.0, 0.0]), (2, 10, "repost", None, 1, 5, None, None), (3, 11, "assigned", None, None, 6, None, [0.0, 1.0]), (4, None, "candidate", None, None, 7, 0.5, None)], POSTS + ", assignment_confidence double, embedding array<float>")
    hubs = spark.createDataFrame([(10, True, "active", None, 1, 1, [1.0, 0.0], T0), (11, True, "active", None, 3, 0, [0.0, 1.0], T0), (12, False, "merged", 10, 1, 0, None, T0)], HUBS)
    removals = spark.createDataFrame([(1, 12), (2, 10), (3, 10), (99, 10)], "post_id long, event_id long")
    after, counted, buffer, told = corrections.unlinked(posts, hubs, removals, T0)
    assert {r.id: (r.event_id, r.assignment_status) for r in after.collect()}[1] == (None, "candidate") and [r.post_id for r in buffer.collect()] == [1]
    assert {r.id: r.member_count for r in counted.collect()} == {10: 0, 11: 3, 12: 1} and [(r.post_id, r.event_id, r.similarity) for r in told.collect()] == [(1, 10, 1.0)]
    after, counted, told = corrections.confirmed(posts, hubs, spark.createDataFrame([(3, 12), (4, 11), (1, 10), (2, 11)], "post_id long, event_id long"), T0)
    assert {r.id: r.event_id for r in after.collect()} == {1: 10, 2: 10, 3: 10, 4: 11} and {r.id: r.member_count for r in counted.collect()} == {10: 2, 11: 3, 12: 1}
    assert {(r.post_id, r.similarity) for r in told.collect()} == {(1, 0.9), (3, 0.0), (4, 0.5)}
    after, counted = corrections.deleted(posts, hubs, spark.createDataFrame([(1,), (3,)], "id long"), T0)
    assert {r.id: (r.event_id, r.repost_of_id) for r in after.collect()}[2] == (10, None)
    assert {r.id: (r.member_count, r.repost_count) for r in counted.collect()} == {10: (1, 0), 11: (2, 0), 12: (1, 0)}


def test_delete_promotes_the_earliest_copy(spark):
    posts = spark.createDataFrame([(1, 10, "assigned", None, None, 5), (2, 10, "repost", None, 1, 5), (3, 10, "repost", None, 1, 5), (4, 10, "repost", T0, 1, 5)], POSTS)
    got = {r.id: r for r in corrections.delete(posts, spark.createDataFrame([(1,), (99,)], "id long"), T0).collect()}
    assert (got[1].deleted_at, got[1].event_id, got[1].assignment_status) == (T0, None, "noise")
    assert (got[2].repost_of_id, got[2].assignment_status, got[3].repost_of_id, got[2].event_id) == (None, "assigned", 2, 10)


def test_invariants_and_recomputed_centroid(spark):
    bad = spark.createDataFrame([(1, 10, "assigned", None, None, 5), (2, 11, "repost", None, 1, 5), (3, 10, "repost", None, 2, 6), (4, 10, "repost", None, None, 7), (5, 10, "assigned", None, None, 5)], POSTS)
    assert {r.rule: r.n for r in corrections.broken_invariants(bad).collect()} == {"status_and_lineage": 1, "repost_chain": 1, "copy_in_another_hub": 2, "double_signature": 1}
    rows = spark.createDataFrame([(i, 7, "assigned", None, [float(i), 1.0]) for i in range(1, 5)], "id long, event_id long, assignment_status string, deleted_at timestamp, embedding array<float>")
    got = {r.id: r.centroid for r in corrections.recomputed_centroids(rows, spark.createDataFrame([(7,), (8,)], "id long"), 2, most=2).collect()}
    assert got == {7: [1.5, 1.0], 8: None}


def test_embed(spark):
    def load():
        from types import SimpleNamespace

        return SimpleNamespace(encode=lambda texts: [[float(len(t)), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, content string")
    assert {r.id: r.embedding for r in corrections.embed(df, load).collect()} == {1: [3.0, 1.0], 2: None}
