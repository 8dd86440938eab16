"""Rewriting hubs and posts as whole tables: merges, reopened merges, unlinking, deletion with promotion of copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions import vectors as vx
from tideloom.operators.folding import canonical, hub_counts
from tideloom.operators.merging import canonical_hub
from tideloom.runtime import cut


def apply_merges(posts: DataFrame, hubs: DataFrame, pairs: DataFrame, at: datetime | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`pairs(source_id, target_id)`, each source once and no target a source -> (posts, hubs, log).

    Posts move to the target, reposts included; the source becomes inactive and points to the target; the target's
    centroid is the weighted one of both sides (several sources are added in order of their ids); the log keeps what
    `reopen_merges` needs: the live posts that moved.
    """
    t = F.lit(at).cast("timestamp")
    move = pairs.select(F.col("source_id").alias("event_id"), F.col("target_id").alias("__to")).dropDuplicates(["event_id"])
    moved = posts.join(move, "event_id", "left").withColumn("event_id", F.coalesce("__to", "event_id")).select(*posts.columns)
    source = hubs.select(F.col("id").alias("source_id"), F.coalesce("member_count", F.lit(0)).alias("n"), "repost_count", "centroid")
    sides = pairs.dropDuplicates(["source_id"]).join(source, "source_id")
    lists = sides.groupBy(F.col("target_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("source_id", "n", "centroid"))).alias("parts"), F.sum("n").alias("more"), F.sum(F.coalesce("repost_count", F.lit(0))).alias("more_reposts"))  # the sources of one target
    gone = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("__into")).dropDuplicates(["id"])
    joined = hubs.join(lists, "id", "left").join(gone, "id", "left")
    start = F.struct(F.transform("centroid", lambda x: x.cast("double")).alias("v"), F.coalesce("member_count", F.lit(0)).cast("long").alias("n"))

    def add(state, part):  # noqa: ANN001, ANN202
        both = vx.merged(state["v"], state["n"], part["centroid"], part["n"])
        return F.struct(F.when(state["v"].isNull(), F.transform(part["centroid"], lambda x: x.cast("double"))).when(part["centroid"].isNull(), state["v"]).otherwise(both).alias("v"), (state["n"] + part["n"]).alias("n"))

    centre = F.transform(F.aggregate("parts", start, add, lambda s: s["v"]), lambda x: x.cast("float"))
    into, grown = F.col("__into"), F.col("parts").isNotNull()
    new = {
        "merged_into_id": F.coalesce(into, F.col("merged_into_id")), "is_active": F.when(into.isNotNull(), False).otherwise(F.col("is_active")), "status": F.when(into.isNotNull(), "merged").otherwise(F.col("status")),
        "member_count": F.when(grown, F.coalesce("member_count", F.lit(0)) + F.col("more")).otherwise(F.col("member_count")).cast("int"),
        "repost_count": F.when(grown, F.coalesce("repost_count", F.lit(0)) + F.col("more_reposts")).otherwise(F.col("repost_count")).cast("int"),
        "centroid": F.when(grown, centre).otherwise(F.col("centroid")), "last_updated_at": F.when(grown | into.isNotNull(), t).otherwise(F.col("last_updated_at")),
    }
    after = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in hubs.columns])
    live = posts.where("deleted_at is null").join(move, "event_id").select("id", F.col("event_id").alias("source_event_id"), F.col("__to").alias("target_event_id"))
    log = pairs.dropDuplicates(["source_id"]).select(F.col("source_id").alias("source_event_id"), F.col("target_id").alias("target_event_id"))
    return moved, after, log.join(live.select("source_event_id", F.col("id").alias("post_id")), "source_event_id", "left").withColumn("merged_at", t)


def synced_counts(hubs: DataFrame, posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Hubs with the counts of `ids(id)` taken from their live posts; a hub without any keeps its counts."""
    now = hub_counts(posts).select(F.col("event_id").alias("id"), F.col("member_count").alias("__m"), F.col("repost_count").alias("__r")).join(ids.select("id").distinct(), "id", "left_semi")
    value = {"member_count": F.coalesce(F.col("__m").cast("int"), F.col("member_count")), "repost_count": F.coalesce(F.col("__r").cast("int"), F.col("repost_count"))}
    return hubs.join(now, "id", "left").select(*[value.get(c, F.col(c)).alias(c) for c in hubs.columns])


def reopen_merges(posts: DataFrame, hubs: DataFrame, log: DataFrame, at: datetime | str, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Undo the merges of `log(source_event_id, target_event_id, post_id)` whose target is still active and whose source
    was not merged onward.

    The logged posts that are still in the target and assigned go back, and with each the live reposts of it. The source
    is active again with as many members as went back, the target has as many fewer, both then counted anew from their
    live posts; with `dim` (posts with `embedding`) both centroids are computed anew from the members.
    """
    t = F.lit(at).cast("timestamp")
    active = hubs.where("is_active").select(F.col("id").alias("target_event_id"))
    onward = hubs.where("merged_into_id is not null").select(F.col("id").alias("source_event_id"), F.col("merged_into_id").alias("__now"))
    valid = log.join(active, "target_event_id", "left_semi").join(onward, "source_event_id", "left").where("__now is null or __now = target_event_id").drop("__now")
    logged = valid.where("post_id is not null").select(F.col("post_id").alias("id"), F.col("target_event_id").alias("event_id"), F.col("source_event_id").alias("__back")).dropDuplicates(["id"])
    back = cut(logged.join(posts.where("assignment_status = 'assigned'").select("id", "event_id"), ["id", "event_id"], "left_semi"))
    copies = posts.where("assignment_status = 'repost' and deleted_at is null").select("id", "event_id", "repost_of_id").join(back.select(F.col("id").alias("repost_of_id"), "event_id", "__back"), ["repost_of_id", "event_id"]).select("id", "__back")
    home = back.select("id", "__back").unionByName(copies).dropDuplicates(["id"])
    restored = cut(posts.join(home, "id", "left").withColumn("event_id", F.coalesce("__back", "event_id")).select(*posts.columns))
    again = valid.select(F.col("source_event_id").alias("id")).distinct().join(back.groupBy(F.col("__back").alias("id")).agg(F.count("*").alias("__gained")), "id", "left").select("id", F.coalesce("__gained", F.lit(0)).alias("__gained"))
    shrunk = valid.select(F.col("target_event_id").alias("id")).distinct().join(back.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("__lost")), "id", "left").select("id", F.coalesce("__lost", F.lit(0)).alias("__lost"))
    rows = hubs.join(again, "id", "left").join(shrunk, "id", "left")
    up, down = F.col("__gained").isNotNull(), F.col("__lost").isNotNull()
    value = {
        "is_active": F.when(up, True).otherwise(F.col("is_active")), "status": F.when(up, "active").otherwise(F.col("status")), "merged_into_id": F.when(~up, F.col("merged_into_id")), "last_updated_at": F.when(up | down, t).otherwise(F.col("last_updated_at")),
        "member_count": F.when(up, F.col("__gained")).when(down, F.greatest(F.coalesce("member_count", F.lit(0)) - F.col("__lost"), F.lit(0))).otherwise(F.col("member_count")).cast("int")}
    touched = cut(again.select("id").union(shrunk.select("id")).distinct())
    counted = synced_counts(rows.select(*[value.get(c, F.col(c)).alias(c) for c in hubs.columns]), restored, touched)
    if dim is None:
        return restored, counted
    fresh = recomputed_centroids(restored, touched, dim).select("id", F.transform("centroid", lambda x: x.cast("float")).alias("__c"), F.lit(True).alias("__fresh"))
    joined = counted.join(fresh, "id", "left")
    return restored, joined.select(*[F.when(F.col("__fresh"), F.col("__c")).otherwise(F.col(c)).alias(c) if c == "centroid" else F.col(c) for c in hubs.columns])


def recomputed_centroids(posts: DataFrame, hub_ids: DataFrame, dim: int, most: int = 150) -> DataFrame:
    """`(id, centroid)`: the plain mean of a hub's first `most` assigned members by id; null without any."""
    rows = posts.where("assignment_status = 'assigned' and deleted_at is null").join(hub_ids.select(F.col("id").alias("event_id")), "event_id", "left_semi").where(F.size("embedding") == dim)
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("event_id").orderBy("id"))).where(F.col("__r") <= most)
    sums = vx.vector_sums(first, "event_id", "embedding", dim)
    means = sums.select(F.col("event_id").alias("id"), F.transform("sums", lambda x: x / F.col("n")).alias("centroid"))
    return hub_ids.select("id").join(means, "id", "left")


def _moved_counts(hubs: DataFrame, changes: DataFrame, at: datetime | str) -> DataFrame:
    """Hubs after `changes(id, by)`, sums of members gained or lost; counts do not fall below zero."""
    sums = changes.groupBy("id").agg(F.sum("by").alias("__by"))
    hit = F.col("__by").isNotNull()
    value = {"member_count": F.when(hit, F.greatest(F.coalesce("member_count", F.lit(0)) + F.col("__by"), F.lit(0))).otherwise(F.col("member_count")).cast("int"), "last_updated_at": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("last_updated_at"))}
    return hubs.join(sums, "id", "left").select(*[value.get(c, F.col(c)).alias(c) for c in hubs.columns])


def _cosines(pairs: DataFrame, posts: DataFrame, hubs: DataFrame) -> DataFrame:
    """`pairs(id, hub)` with `similarity` of post and centroid, 0 where one is missing."""
    rows = pairs.join(posts.select("id", "embedding"), "id").join(hubs.select(F.col("id").alias("hub"), "centroid"), "hub")
    return rows.select("id", "hub", F.coalesce(vx.cosine(F.col("embedding"), F.col("centroid")), F.lit(0.0)).alias("similarity"))


def unlink(posts: DataFrame, removals: DataFrame) -> DataFrame:
    """Posts after `removals(post_id, event_id)`: a live post that is no repost and still in that hub becomes a candidate
    without hub."""
    marks = removals.select(F.col("post_id").alias("id"), "event_id", F.lit(True).alias("__out")).dropDuplicates(["id", "event_id"])
    rows = posts.join(marks, ["id", "event_id"], "left")
    out = F.coalesce("__out", F.lit(False)) & F.col("deleted_at").isNull() & F.col("repost_of_id").isNull()
    new = {"event_id": F.when(~out, F.col("event_id")), "assignment_status": F.when(out, "candidate").otherwise(F.col("assignment_status"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in posts.columns])


def unlinked(posts: DataFrame, hubs: DataFrame, removals: DataFrame, at: datetime | str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(posts, hubs, buffer rows, feedback) after `removals(post_id, event_id)`, hub ids resolved through merges.

    Each post taken out lowers its hub's count, returns to the buffer with its vector, and is told as feedback with its
    similarity to the hub's centroid.
    """
    to = canonical_hub(hubs).select(F.col("id").alias("event_id"), F.col("canonical_id").alias("hub"))
    asked = removals.select(F.col("post_id").alias("id"), "event_id").join(to, "event_id").select("id", "hub").distinct()
    there = posts.where("deleted_at is null and repost_of_id is null").select("id", F.col("event_id").alias("hub"))
    hit = cut(asked.join(there, ["id", "hub"], "left_semi"))
    after = unlink(posts, hit.select(F.col("id").alias("post_id"), F.col("hub").alias("event_id")))
    buffer = posts.join(hit.select("id"), "id", "left_semi").select(F.col("id").alias("post_id"), "embedding", F.lit(at).cast("timestamp").alias("created_at"))
    told = _cosines(hit, posts, hubs).select(F.col("id").alias("post_id"), F.col("hub").alias("event_id"), "similarity", F.lit("user_removed").alias("feedback_type"))
    return after, _moved_counts(hubs, hit.select(F.col("hub").alias("id"), F.lit(-1).alias("by")), at), buffer, told


def confirmed(posts: DataFrame, hubs: DataFrame, pins: DataFrame, at: datetime | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, hubs, feedback) after `pins(post_id, event_id)`: live posts that are no reposts are assigned to the active
    hub that the id resolves to; one pin a post. A post that changes hubs leaves one count and joins the other."""
    to = canonical_hub(hubs).select(F.col("id").alias("event_id"), F.col("canonical_id").alias("hub")).join(hubs.where("is_active").select(F.col("id").alias("hub")), "hub", "left_semi")
    asked = pins.select(F.col("post_id").alias("id"), "event_id").join(to, "event_id").groupBy("id").agg(F.min("hub").alias("hub"))
    live = posts.where("deleted_at is null and repost_of_id is null").select("id", F.col("event_id").alias("old"), F.coalesce(F.col("assignment_confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    hit = cut(asked.join(live, "id"))
    rows = posts.join(hit.select("id", F.col("hub").alias("__hub")), "id", "left")
    pin = F.col("__hub").isNotNull()
    value = {"event_id": F.coalesce("__hub", "event_id"), "assignment_status": F.when(pin, "assigned").otherwise(F.col("assignment_status"))}
    moved = hit.where("not (old <=> hub)")
    changes = moved.select(F.col("hub").alias("id"), F.lit(1).alias("by")).union(moved.where("old is not null").select(F.col("old").alias("id"), F.lit(-1).alias("by")))
    told = hit.select(F.col("id").alias("post_id"), F.col("hub").alias("event_id"), F.col("confidence").alias("similarity"), F.lit("user_confirmed").alias("feedback_type"))
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in posts.columns]), _moved_counts(hubs, changes, at), told


def delete(posts: DataFrame, ids: DataFrame, at: datetime | str) -> DataFrame:
    """Posts after the deletion of `ids(id)`: tombstones without hub; the smallest live copy of a deleted original takes
    its place, the other copies point to it."""
    t = F.lit(at).cast("timestamp")
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    rows = posts.join(gone, "id", "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)) & F.col("deleted_at").isNull())
    copies = rows.where("not __gone and deleted_at is null and repost_of_id is not null").select("id", "repost_of_id")
    heirs = copies.join(gone.select(F.col("id").alias("repost_of_id")), "repost_of_id", "left_semi").groupBy("repost_of_id").agg(F.min("id").alias("__heir"))
    joined = rows.join(heirs, "repost_of_id", "left")
    lead = F.col("__heir") == F.col("id")
    new = {
        "deleted_at": F.when(F.col("__gone"), t).otherwise(F.col("deleted_at")), "event_id": F.when(~F.col("__gone"), F.col("event_id")),
        "assignment_status": F.when(F.col("__gone"), "noise").when(lead, "assigned").otherwise(F.col("assignment_status")),
        "repost_of_id": F.when(F.col("__heir").isNotNull() & ~F.col("__gone"), F.when(~lead, F.col("__heir"))).otherwise(F.col("repost_of_id")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in posts.columns])


def deleted(posts: DataFrame, hubs: DataFrame, ids: DataFrame, at: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(posts, hubs) after `delete`: each deleted post lowers its hub's count; hubs in which a copy took a post's place
    are counted anew."""
    gone = cut(posts.where("deleted_at is null").join(ids.select("id").distinct(), "id", "left_semi").select("id", "event_id"))
    after = cut(delete(posts, ids, at))
    lowered = _moved_counts(hubs, gone.where("event_id is not null").select(F.col("event_id").alias("id"), F.lit(-1).alias("by")), at)
    copied = posts.where("deleted_at is null and repost_of_id is not null").select(F.col("repost_of_id").alias("id"), F.col("id").alias("copy")).join(gone.select(F.col("id").alias("copy")), "copy", "left_anti").select("id").distinct()
    heirs = gone.join(copied, "id", "left_semi").where("event_id is not null").select(F.col("event_id").alias("id"))
    return after, synced_counts(lowered, after, heirs)


def broken_invariants(posts: DataFrame) -> DataFrame:
    """`(rule, n)`: status repost without or lineage with another status, chains of reposts, copies outside the hub of
    their original, and doubles of one hub and signature among canonicals; only rules that are broken."""
    live = posts.where("deleted_at is null")
    original = live.select(F.col("id").alias("repost_of_id"), F.col("event_id").alias("__hub"), F.col("repost_of_id").alias("__on"))
    pairs = live.where("repost_of_id is not null").join(original, "repost_of_id")
    count = lambda rows, rule: rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    doubles = canonical(posts).where("event_id is not null and content_sig <> 0").groupBy("event_id", "content_sig").count().where("count > 1")
    out = count(live.where((F.col("assignment_status") == "repost") != F.col("repost_of_id").isNotNull()), "status_and_lineage")
    for rows, rule in ((pairs.where("__on is not null"), "repost_chain"), (pairs.where("not (event_id <=> __hub)"), "copy_in_another_hub"), (doubles, "double_signature")):
        out = out.union(count(rows, rule))
    return out.where("n > 0")


def embed(posts: DataFrame, load: Callable[[], object], text: str = "content", vector: str = "embedding", rows: int = 256) -> DataFrame:
    """Add vectors from the model that `load` returns, once a task; it has `encode(list[str])`. Null texts get nulls."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            out: list = [None] * len(s)
            at = [i for i, ok in enumerate(s.notna()) if ok]
            for lo in range(0, len(at), rows):
                for i, v in zip(at[lo : lo + rows], model.encode([s.iloc[i] for i in at[lo : lo + rows]])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return posts.withColumn(vector, F.pandas_udf(run, "array<float>")(F.col(text)))
