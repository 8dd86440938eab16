"""Pages over the tables: hub views, references, quality, decisions, operations, audit, consumers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.text import like_literal, preview
from tideloom.operators.folding import canonical
from tideloom.operators.merging import canonical_hub

#: Window presets in hours (null is all time), the orders a page may be asked for, and their defaults.
DECISION_WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720, "all": None}
AUDIT_WINDOWS = {"24h": 24, "7d": 168, "30d": 720, "all": None}
QUALITY_ORDERS = {"window": "window_end", "total": "total", "precision": "precision", "coverage": "coverage", "unlink": "unlink_rate", "drift": "drift"}
DECISION_ORDERS = {"time": "created_at", "sim": "similarity", "threshold": "threshold_used"}


def clamped(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def ordered(sort: str, orders: dict[str, str], default: str) -> Column:
    """`name_desc` or `name_asc` as an order with nulls last; anything else is the default, descending."""
    name, _, way = sort.rpartition("_")
    if name not in orders or way not in ("asc", "desc"):
        name, way = default, "desc"
    return F.asc_nulls_last(orders[name]) if way == "asc" else F.desc_nulls_last(orders[name])


def since(rows: DataFrame, window: str, presets: dict[str, int | None], as_of: datetime | str, default: str | None, at: str = "created_at") -> DataFrame:
    """Rows of a window preset; an unknown one is `default`, or no limit where that is None."""
    hours = presets.get(window, presets.get(default) if default else None)
    return rows if hours is None else rows.where(F.col(at) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600.0)))


# References


def post_references(ids: DataFrame, posts: DataFrame) -> DataFrame:
    """`ids(post_id)` with the post's preview, author, platform, status and hub; `not_found` where there is none."""
    known = posts.select(F.col("id").alias("post_id"), preview(F.col("content")).alias("content_preview"), F.col("user_id").alias("author_id"), "platform", F.col("assignment_status").alias("status"), "event_id", F.lit(True).alias("__there"))
    return ids.select("post_id").distinct().join(known, "post_id", "left").withColumn("status", F.when(F.col("__there"), F.col("status")).otherwise("not_found")).drop("__there")


def label(title: Column, fallback: Column, chars: int = 84) -> Column:
    whole = F.when(F.length(title) > 0, title).otherwise(fallback)
    return F.when(F.length(whole) <= chars, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, chars - 1)), F.lit("…")))


def hub_references(ids: DataFrame, hubs: DataFrame) -> DataFrame:
    """`ids(event_id)` with label, handle, type, counts and status of the hub; `not_found` where there is none."""
    known = hubs.select(F.col("id").alias("event_id"), "title", "handle", "discourse_type", "member_count", "repost_count", "status", F.lit(True).alias("__there"))
    rows = ids.select("event_id").distinct().join(known, "event_id", "left")
    there = F.coalesce("__there", F.lit(False))
    return rows.select(
        "event_id", label(F.col("title"), F.concat(F.lit("hub-"), F.col("event_id").cast("string"))).alias("label"), "handle", F.when(there, F.coalesce("discourse_type", F.lit("event"))).alias("discourse_type"),
        F.when(there, F.coalesce("member_count", F.lit(0))).alias("member_count"), F.when(there, F.coalesce("repost_count", F.lit(0))).alias("repost_count"), F.when(there, F.coalesce("status", F.lit("active"))).otherwise("not_found").alias("status"))


def member_previews(posts: DataFrame, n: int) -> DataFrame:
    """`(event_id, previews)`: the first `n` non-empty previews of each hub's earliest canonical posts."""
    w = Window.partitionBy("event_id").orderBy("created_at", "id")
    rows = canonical(posts).where("event_id is not null").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n + 1).select("event_id", "__r", preview(F.col("content")).alias("p")).where("p is not null")
    lists = rows.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("__r", "p"))).alias("l"))  # at most n + 1
    return lists.select("event_id", F.slice(F.transform("l", lambda x: x["p"]), 1, n).alias("previews"))


def search_hub_cards(hubs: DataFrame, posts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Active hubs whose title, handle, seed post or any post holds the literal text, largest first; digits find an id."""
    limit = clamped(limit, 1, 100)
    if query.strip().isdigit():
        return hubs.where(F.col("id") == int(query)).select("id", "title", "member_count")
    hit = posts.where(like_literal(F.col("content"), query.strip())).select("id", "event_id")
    seeds = hit.select(F.col("id").alias("seed_post_id"), F.lit(True).alias("__seed"))
    members = hit.where("event_id is not null").select(F.col("event_id").alias("id"), F.lit(True).alias("__member")).distinct()
    rows = hubs.where("is_active").join(seeds, "seed_post_id", "left").join(members, "id", "left")
    found = rows.where(like_literal(F.col("title"), query.strip()) | like_literal(F.col("handle"), query.strip()) | F.col("__seed").isNotNull() | F.col("__member").isNotNull())
    return found.orderBy(F.desc_nulls_last("member_count"), "id").limit(limit).select("id", "title", "member_count")


# Hub views


def hub_media(posts: DataFrame, n: int = 100) -> DataFrame:
    """`(hub_id, place, post_id)`: each hub's first `n` canonical posts with media, oldest first."""
    w = Window.partitionBy("event_id").orderBy("created_at", "id")
    rows = canonical(posts).where("event_id is not null and has_media").withColumn("place", F.row_number().over(w).cast("long"))
    return rows.where(F.col("place") <= clamped(n, 1, 100)).select(F.col("event_id").alias("hub_id"), "place", F.col("id").alias("post_id"))


def hub_anchor(posts: DataFrame) -> DataFrame:
    """`(hub_id, post_id)`: the earliest canonical post of each hub."""
    first = canonical(posts).where("event_id is not null").groupBy("event_id").agg(F.min(F.struct("created_at", "id")).alias("f"))
    return first.select(F.col("event_id").alias("hub_id"), F.col("f.id").alias("post_id"))


def hub_perspectives(posts: DataFrame, catalysts: DataFrame, n: int = 20) -> DataFrame:
    """`(hub_id, rank, post_id)`: the most engaging canonical posts of each hub besides its catalyst, then the earliest."""
    w = Window.partitionBy("event_id").orderBy(F.desc_nulls_last("engagement_score"), "created_at", "id")
    others = canonical(posts).where("event_id is not null").join(catalysts.select(F.col("hub_id").alias("event_id"), F.col("catalyst_id").alias("id")), ["event_id", "id"], "left_anti")
    rows = others.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= clamped(n, 1, 20))
    return rows.select(F.col("event_id").alias("hub_id"), "rank", F.col("id").alias("post_id"))


def hub_views(requested: DataFrame, posts: DataFrame, hubs: DataFrame, catalysts: DataFrame) -> DataFrame:
    """`requested(hub_id)` resolved through merges, with the counts, catalyst and label of the hub that answers.

    A hub without voices counts the posts of its first page (50 at most). Hubs that do not exist have no row.
    """
    resolved = requested.select(F.col("hub_id").alias("id")).distinct().join(canonical_hub(hubs), "id")
    live = posts.where("deleted_at is null and event_id is not null").groupBy("event_id").agg(
        F.count_if(F.col("repost_of_id").isNull()).alias("total_posts"), F.count_if(F.col("repost_of_id").isNotNull()).alias("reposts"), F.count_distinct("user_id").alias("voices"))
    named = hubs.select(F.col("id").alias("canonical_id"), label(F.col("title"), F.concat(F.lit("hub-"), F.col("id").cast("string"))).alias("label"), F.coalesce("status", F.lit("active")).alias("status"), "member_count")
    rows = resolved.join(named, "canonical_id").join(live.withColumnRenamed("event_id", "canonical_id"), "canonical_id", "left").join(catalysts.withColumnRenamed("hub_id", "canonical_id"), "canonical_id", "left").fillna(0, ["total_posts", "reposts", "voices"])
    voices = F.when(F.col("voices") == 0, F.least(F.col("total_posts"), F.lit(50))).otherwise(F.col("voices"))
    return rows.select(F.col("id").alias("requested_id"), F.col("canonical_id").alias("hub_id"), "redirected", "label", "status", "member_count", "total_posts", "reposts", voices.alias("voices"), "catalyst_id", (F.col("total_posts") > 50).alias("has_more"))


# Quality, decisions, operations


def latest_windows(rollups: DataFrame, n: int, source: str | None = None) -> DataFrame:
    """The roll-ups of the `n` latest window ends (one window start each, the earliest), of one source if given."""
    rows = rollups.where(F.col("source") == source) if source else rollups
    ends = rows.groupBy("window_end").agg(F.min("window_start").alias("window_start")).orderBy(F.desc("window_end")).limit(n)
    return rows.join(ends, ["window_start", "window_end"])


def quality_page(rollups: DataFrame, n: int = 14, source: str | None = None) -> DataFrame:
    """One row: totals, and averages over the windows in which a rate is known."""
    rows = latest_windows(rollups, n, source)
    return rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "confirmed", "removed", "dismissed")], *[F.avg(c).alias(c) for c in ("precision", "coverage", "unlink_rate", "drift")])


def decision_filter(decisions: DataFrame, as_of: datetime | str, window: str = "24h", post_id: int | None = None, hub_id: int | None = None, status: str = "") -> DataFrame:
    """Decisions of a window (an unknown preset has no cut-off), post, hub and status; an unknown status filters nothing."""
    rows = since(decisions, window, DECISION_WINDOWS, as_of, None)
    for column, value in (("post_id", post_id), ("event_id", hub_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.where(F.col("status") == status) if status in ("assigned", "candidate", "unassigned", "noise", "repost") else rows


def decision_page(decisions: DataFrame, posts: DataFrame, hubs: DataFrame, limit: int = 100, offset: int = 0, sort: str = "time_desc") -> DataFrame:
    """A page of decisions with references to post and hub, in order, with `has_more` (the page is full)."""
    limit = min(limit, 100)
    by = [ordered(sort, DECISION_ORDERS, "time"), F.desc("id")]
    page = decisions.orderBy(*by).offset(max(offset, 0)).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("long"))  # at most 100 rows
    page = page.withColumn("has_more", F.count("*").over(Window.partitionBy()) == limit)
    refs = post_references(page.select("post_id"), posts).select("post_id", "content_preview")
    cards = hub_references(page.where("event_id is not null").select("event_id"), hubs).select("event_id", "label")
    return page.join(refs, "post_id", "left").join(cards, "event_id", "left")


def operations_page(box: DataFrame, posts: DataFrame, rollups: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: failed and leased events, stuck and stalled posts, the last human roll-up and whether it is fresh."""
    t = F.lit(as_of).cast("timestamp")
    old = lambda status, minutes: F.count_if((F.col("assignment_status") == status) & (F.col("assignment_updated_at") < t - F.make_dt_interval(secs=F.lit(minutes * 60.0))))
    a = box.agg(F.count_if(F.col("delivery_status") == "failed").alias("failed"), F.count_if((F.col("delivery_status") == "leased") & (F.col("lease_until") >= t)).alias("leased"))
    b = posts.agg(old("processing", 5).alias("stuck"), old("pending", 15).alias("stalled"))
    c = rollups.where("source = 'human'").agg(F.max("window_end").alias("last_rollup"))
    return a.crossJoin(b).crossJoin(c).withColumn("fresh", F.coalesce(F.col("last_rollup") >= t - F.expr("INTERVAL 2 HOURS"), F.lit(False)))  # one row each


# Audit


def audit_filter(log: DataFrame, as_of: datetime | str, actor: str = "", domain: str = "", entity: str = "", window: str = "7d", query: str = "") -> DataFrame:
    """Entries of a window (an unknown preset is seven days), actor, domain, entity type; `query` is a pattern in which
    `%` and `_` are wildcards, looked for in five columns."""
    rows = since(log, window, AUDIT_WINDOWS, as_of, "7d")
    for column, value in ((F.col("actor"), actor), (F.split_part("action", F.lit("."), F.lit(1)), domain), (F.col("entity_type"), entity)):
        if value:
            rows = rows.where(column == value)
    if query.strip():
        like = f"%{query.strip()}%"
        hit = F.lit(False)
        for c in ("action", "actor", "entity_id", "before_state", "after_state"):
            hit = hit | F.coalesce(F.ilike(F.col(c).cast("string"), F.lit(like)), F.lit(False))
        rows = rows.where(hit)
    return rows


def audit_page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, newest first, with the number of all entries."""
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(clamped(limit or 50, 1, 200))
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("matches"))))


def audit_stats(log: DataFrame, as_of: datetime | str) -> DataFrame:
    recent = F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return log.agg(F.count("*").alias("total"), F.count_distinct("actor").alias("actors"), F.count_distinct("entity_type").alias("entities"), F.count_if(recent).alias("recent"))


def audit_options(log: DataFrame) -> DataFrame:
    """`(kind, value)`: the distinct actors, domains and entity types."""
    kinds = {"actor": F.col("actor"), "domain": F.split_part("action", F.lit("."), F.lit(1)), "entity": F.col("entity_type")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()]))
    return log.select(pairs.alias("o")).select("o.kind", "o.value").where("value is not null").distinct()


# Consumers and admins


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def authenticated(consumers: DataFrame, calls: DataFrame, as_of: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(answers, consumers) of `calls(token)`: the active consumer of each token, and the consumers with `last_used_at`
    moved where it is older than a minute."""
    asked = calls.where("length(token) > 0").select(token_hash(F.col("token")).alias("token_hash")).distinct()
    found = consumers.where("is_active").join(asked, "token_hash", "left_semi").select("consumer_id", "name", F.coalesce("rate_limit_per_minute", F.lit(60)).alias("rate_limit_per_minute"))
    t = F.lit(as_of).cast("timestamp")
    seen = consumers.join(found.select("consumer_id", F.lit(True).alias("__seen")), "consumer_id", "left")
    move = F.col("__seen").isNotNull() & (F.col("last_used_at").isNull() | (F.col("last_used_at") <= t - F.expr("INTERVAL 60 SECONDS")))
    return found, seen.select(*[F.when(move, t).otherwise(F.col(c)).alias(c) if c == "last_used_at" else F.col(c) for c in consumers.columns])


def with_consumer(consumers: DataFrame, consumer_id: str, name: str, token: str, limit: int | None, at: datetime | str) -> DataFrame:
    """Consumers with one more, whose token is kept as its hash only; a known id or name is an error."""
    if not consumers.where((F.col("consumer_id") == consumer_id) | (F.col("name") == name)).isEmpty():
        raise ValueError(f"consumer {consumer_id} exists")
    value = {"id": F.col("id"), "consumer_id": F.lit(consumer_id), "name": F.lit(name), "token_hash": token_hash(F.lit(token)), "is_active": F.lit(True), "rate_limit_per_minute": F.lit(limit), "created_at": F.lit(at).cast("timestamp")}
    last = consumers.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return consumers.unionByName(last.select(*[value.get(c, F.lit(None)).cast(t).alias(c) for c, t in consumers.dtypes]))


def toggled(consumers: DataFrame, consumer_id: str) -> DataFrame:
    return consumers.withColumn("is_active", F.when(F.col("consumer_id") == consumer_id, ~F.col("is_active")).otherwise(F.col("is_active")))


def without_consumer(consumers: DataFrame, consumer_id: str) -> DataFrame:
    return consumers.where(F.col("consumer_id") != consumer_id)


def rate_limited(calls: DataFrame, consumer: str, at: str, limit: Column) -> DataFrame:
    """Add `allowed`: at most `limit` calls of a consumer in each clock minute, in order of time."""
    w = Window.partitionBy(consumer, F.date_trunc("minute", F.col(at))).orderBy(at, *[c for c in ("id",) if c in calls.columns])
    return calls.withColumn("allowed", F.row_number().over(w) <= limit)


def listed(admins: DataFrame, query: str, columns: list[str], order: str) -> DataFrame:
    """Rows in which any of the columns matches the pattern `query` (wildcards count); all rows if it is empty."""
    if not query.strip():
        return admins.orderBy(order)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.ilike(F.col(c), F.lit(f"%{query.strip()}%")), F.lit(False))
    return admins.where(hit).orderBy(order)


def redacted_settings(settings: dict[str, object], secret: tuple[str, ...] = ("SECRET", "PASSWORD", "TOKEN", "KEY", "DSN")) -> dict[str, object]:
    """Settings for display: values of secret names are replaced, empty ones stay visible as empty."""
    return {k: ("***" if v else "") if any(s in k.upper() for s in secret) else v for k, v in settings.items()}
