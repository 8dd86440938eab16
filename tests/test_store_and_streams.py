from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideloom.sources.tables import SnapshotStore, read_table, validated
from tideloom.streaming import pipelines

T0 = datetime(2026, 3, 1)


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    for n in range(1, 4):
        assert store.write("hubs", spark.range(n)) == n
        assert store.read("hubs").count() == n
    spark.range(7).write.parquet(f"{store.folder}/hubs/v4")  # a writer that died before its marker
    assert store.read("hubs").count() == 3 and store.write("hubs", spark.range(9)) == 4 and store.read("hubs").count() == 9
    assert store.versions("hubs") == [2, 3, 4] and store.read("hubs", 2).count() == 2
    with pytest.raises(ValueError, match="no version"):
        store.read("hubs", 1)


def test_ingest_updates_stored_posts(spark, tmp_path):
    schema = "id long, user_id long, content string, embedding array<float>, entities array<string>, received_at timestamp"
    kept = spark.createDataFrame([(1, 7, "old", None, None, T0, "pending", None, None, None, None), (3, 7, "gone", None, None, T0, "noise", None, None, None, T0)], schema + ", assignment_status string, event_id long, assignment_confidence decimal(5,4), assignment_updated_at timestamp, deleted_at timestamp")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write("posts", kept)
    rows = [(1, 7, "first delivery", [1.0, 0.0], None, T0), (1, 7, "second delivery", [1.0, 0.0], None, T0 + timedelta(hours=1)), (2, 7, "a new post", [0.0, 1.0], None, T0), (3, 7, "again", [1.0, 0.0], None, T0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    hubs = spark.createDataFrame([(4, [1.0, 0.0])], "id long, centroid array<float>")
    names = spark.createDataFrame([], "event_id long, tokens array<string>")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    pipelines.ingest_stream(stream, store, lambda: hubs, lambda: names, 2, 0.62, str(tmp_path / "c")).awaitTermination(120)
    got = {r.id: (r.content, r.assignment_status, r.event_id) for r in store.read("posts").collect()}
    assert got == {1: ("second delivery", "assigned", 4), 2: ("a new post", "unassigned", None), 3: ("gone", "noise", None)}


def test_schema_drift_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "posts.parquet"))
    with pytest.raises(ValueError, match="differs"):
        read_table(spark, str(tmp_path / "posts.parquet"), "posts")
    assert read_table(spark, "/root/testdata/sf0.001/posts.parquet", "posts").count() > 0


def test_validation(spark):
    df = spark.createDataFrame([(1, "x" * 5, None), (2, None, "s"), (3, "y" * 100_001, "s")], "user_id long, content string, source_id string")
    good, bad = validated(df)
    assert [r.source_id for r in good.collect()] == ["legacy"]
    assert {r.user_id for r in bad.collect()} == {2, 3}


def test_late_event_stream_equals_batch(spark, tmp_path):
    from tideloom.operators.late_events import event_time_counts

    rows = [(i, T0 + timedelta(hours=i % 7), T0 + timedelta(hours=(i * 5) % 60, minutes=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at timestamp, got timestamp")
    want = {(r.id, r.fate) for r in event_time_counts(df, "id", "at", "got", emit="records").collect()}
    df.orderBy("got").repartitionByRange(3, "got").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pipelines.late_event_stream(stream, "id", "at", "got", shards=4).writeStream.format("memory").queryName("fates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.fate) for r in spark.table("fates").collect()} == want


def test_ingest_stream(spark, tmp_path):
    posts = spark.createDataFrame([(1, 7, "the ferry stalled", [1.0, 0.0], None), (2, 7, None, [1.0, 0.0], None)], "id long, user_id long, content string, embedding array<float>, entities array<string>")
    posts.write.parquet(str(tmp_path / "in"))
    hubs = spark.createDataFrame([(4, [1.0, 0.0])], "id long, centroid array<float>")
    names = spark.createDataFrame([], "event_id long, tokens array<string>")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in"))
    pipelines.ingest_stream(stream, store, lambda: hubs, lambda: names, 2, 0.62, str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(f"{store.folder}/decisions").collect()
    assert [(r.post_id, r.status, r.event_id) for r in got] == [(1, "assigned", 4)]


def test_periods_close_with_their_late_records(spark, tmp_path):
    m = lambda n: T0 + timedelta(minutes=n)
    batches = [[(1, m(5), m(6)), (2, m(50), m(80))], [(3, m(20), m(95)), (4, m(70), m(71))], [(5, m(3000), m(3001))], [(7, m(3010), m(3011))], [(6, m(30), m(3012))], [(8, m(3011), m(3013))]]  # a cut-off takes hold a trigger after it is known
    schema = "id long, at timestamp, got timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = pipelines.period_stream(stream, "at", "got").writeStream.format("memory").queryName("periods").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {r.period_start: (r.n, r.late) for r in spark.table("periods").collect()}
    assert closed == {T0: (3, 2), T0 + timedelta(hours=1): (1, 0)}  # the sixth record came after its hour was closed


def test_rollup_stream_plan(spark):
    rate = spark.readStream.format("rate").load().select(F.col("timestamp").alias("created_at"), F.lit("assigned").alias("status"))
    assert pipelines.rollup_stream(rate).columns == ["window_start", "total", "assigned"]
