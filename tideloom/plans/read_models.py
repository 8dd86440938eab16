"""Read models composed of the operators: hub pages, search, logs, training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.text import like_literal, preview
from tideloom.operators.folding import canonical
from tideloom.operators.ledger import latest

CHRONO = ["created_at", "id"]


def hub_timeline(posts: DataFrame, hub_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a hub's canonical posts, oldest first, with `has_more`; `limit` is held within 1 to 200."""
    limit = max(1, min(200, limit))
    rows = canonical(posts).where(F.col("event_id") == hub_id).orderBy(*CHRONO).offset(offset).limit(limit + 1)
    page = rows.withColumn("at", F.row_number().over(Window.orderBy(*CHRONO)))  # at most 201 rows
    return page.withColumn("has_more", F.max("at").over(Window.partitionBy()) > limit).where(F.col("at") <= limit)


def hub_catalysts(posts: DataFrame, hubs: DataFrame) -> DataFrame:
    """`(hub_id, catalyst_id)`: the seed post if it is live, else the hub's earliest canonical post."""
    seeds = hubs.select(F.col("id").alias("hub_id"), F.col("seed_post_id").alias("id")).join(posts.where("deleted_at is null").select("id"), "id", "left_semi").select("hub_id", F.col("id").alias("seed"))
    first = canonical(posts).where("event_id is not null").groupBy(F.col("event_id").alias("hub_id")).agg(F.min(F.struct(*CHRONO)).alias("f")).select("hub_id", F.col("f.id").alias("first"))
    return hubs.select(F.col("id").alias("hub_id")).join(seeds, "hub_id", "left").join(first, "hub_id", "left").select("hub_id", F.coalesce("seed", "first").alias("catalyst_id"))


def hub_top_posts(posts: DataFrame, n: int = 3) -> DataFrame:
    """`(hub_id, rank, post_id, engagement_score)`: each hub's `n` most engaging canonical posts, then the earliest."""
    w = Window.partitionBy("event_id").orderBy(F.desc_nulls_last("engagement_score"), *CHRONO)
    rows = canonical(posts).where("event_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return rows.select(F.col("event_id").alias("hub_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("post_id"), "engagement_score")


def hub_summary(posts: DataFrame, hubs: DataFrame) -> DataFrame:
    """Per hub: live posts, canonicals, media, distinct voices, first and last post."""
    live = posts.where("deleted_at is null and event_id is not null")
    own = F.col("repost_of_id").isNull()
    agg = live.groupBy("event_id").agg(
        F.count("*").alias("live"), F.count_if(own).alias("canonicals"), F.count_if(own & F.col("has_media")).alias("media"), F.count_distinct("user_id").alias("voices"),
        F.count_distinct(F.coalesce("external_author_id", F.col("user_id").cast("string"))).alias("authors"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    zero = {c: 0 for c in ("live", "canonicals", "media", "voices", "authors")}
    return hubs.select(F.col("id").alias("event_id"), "title").join(agg, "event_id", "left").fillna(zero).withColumnRenamed("event_id", "hub_id")


def search_posts(posts: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Live posts that hold the literal text (a number finds that id only), newest first, with a preview."""
    hit = F.col("id") == int(query) if query.isdigit() else like_literal(F.col("content"), query)
    rows = posts.where(hit & F.col("deleted_at").isNull()).select("id", "event_id", preview(F.col("content")).alias("preview"))
    return rows.orderBy(F.desc("id")).limit(limit) if limit else rows


def search_hubs(hubs: DataFrame, posts: DataFrame, query: str) -> DataFrame:
    """Hubs whose title, handle or any live member post holds the literal text."""
    members = posts.where(like_literal(F.col("content"), query) & F.col("deleted_at").isNull() & F.col("event_id").isNotNull()).select(F.col("event_id").alias("id")).distinct().withColumn("__m", F.lit(True))
    hit = like_literal(F.col("title"), query) | like_literal(F.col("handle"), query) | F.col("__m").isNotNull()
    return hubs.join(members, "id", "left").where(hit).select("id", "title", "handle")


def merge_log(merges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Merges with the titles of both hubs."""
    side = lambda n: hubs.select(F.col("id").alias(f"{n}_event_id"), F.col("title").alias(f"{n}_title"))
    rows = merges.join(side("source"), "source_event_id", "left").join(side("target"), "target_event_id", "left")
    return rows.select("id", "source_event_id", "source_title", "target_event_id", "target_title", "status", "initiated_by", F.col("snapshot_member_count").cast("long").alias("snapshot_member_count"))


def last_decisions(decisions: DataFrame) -> DataFrame:
    """Each post's last decision other than noise."""
    return latest(decisions.where("status <> 'noise' and post_id is not null"), ["post_id"], [F.desc("created_at"), F.desc("id")])


def training_pairs(feedback: DataFrame, posts: DataFrame) -> DataFrame:
    """`(post_id, event_id, anchor, positive_id, positive, negative_id, negative, holdout)`: confirmed posts with text, a
    sibling of the same hub and a negative, by the smallest id, and a split by the post.

    The sibling is another post of the hub with text, or the anchor itself where there is none. The negative is a post
    that was removed from the same hub, else a removed post that sits in another hub. A post is on one side of the split
    whatever its judgements.
    """
    texts = posts.where("content is not null").select("id", "event_id", "content")
    judged = feedback.where("event_id is not null and post_id is not null").select("post_id", "event_id", "feedback_type")
    anchors = judged.where("feedback_type = 'user_confirmed'").select("post_id", "event_id").distinct().join(texts.select(F.col("id").alias("post_id"), F.col("content").alias("anchor")), "post_id")
    # Two candidates a hub are enough: one of them is not the anchor.
    few = texts.where("event_id is not null").withColumn("r", F.row_number().over(Window.partitionBy("event_id").orderBy("id"))).where("r <= 2")
    pair = few.groupBy("event_id").agg(F.min_by(F.struct("id", "content"), "r").alias("one"), F.max_by(F.struct("id", "content"), "r").alias("two"))
    removed = judged.where("feedback_type = 'user_removed'").select(F.col("post_id").alias("id"), "event_id").distinct().join(texts.select("id", "content", F.col("event_id").alias("now")), "id")
    own = removed.groupBy("event_id").agg(F.min(F.struct("id", "content")).alias("hard"))
    # Of the removed posts that sit in a hub, the two of smallest id in different hubs serve every hub.
    seated = removed.where("now is not null").groupBy("now").agg(F.min(F.struct("id", "content")).alias("p")).select("now", "p")
    two = seated.orderBy("p.id").limit(2).agg(F.sort_array(F.collect_list(F.struct("p", "now"))).alias("far"))  # two rows
    rows = anchors.join(pair, "event_id", "left").join(own, "event_id", "left").crossJoin(F.broadcast(two))
    same = F.col("one.id") == F.col("post_id")
    other = F.when(~same, F.col("one")).when(F.col("two.id") != F.col("post_id"), F.col("two"))
    far = F.get(F.filter("far", lambda x: x["now"] != F.col("event_id")), F.lit(0))["p"]
    negative = F.coalesce("hard", far)
    return rows.select(
        "post_id", "event_id", "anchor", F.coalesce(other["id"], F.col("post_id")).alias("positive_id"), F.coalesce(other["content"], F.col("anchor")).alias("positive"), negative["id"].alias("negative_id"), negative["content"].alias("negative"),
        (F.pmod(F.crc32(F.col("post_id").cast("string")), F.lit(5)) == 0).alias("holdout"))
