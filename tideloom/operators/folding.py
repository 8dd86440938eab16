"""Copies within a hub: exact folds by signature, near duplicates by cosine, chains, counts."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.operators.graph import connected_components
from tideloom.runtime import cut


def canonical(posts: DataFrame) -> DataFrame:
    """Live posts that are no repost."""
    return posts.where("deleted_at is null and repost_of_id is null")


def exact_fold(posts: DataFrame, key: str = "id", hub: str = "event_id", sig: str = "content_sig") -> DataFrame:
    """`(key, keep_id)` for each live canonical post that another one of its hub and signature stands for.

    The keeper is the smallest id among the hub's canonicals of that signature and the originals that its reposts of that
    signature point to. Signature 0 means not computed and folds nothing; posts without hub fold nothing.
    """
    live = posts.where("deleted_at is null").where(F.col(hub).isNotNull() & (F.col(sig) != 0))
    own = live.where("repost_of_id is null").select(F.col(hub).alias("h"), F.col(sig).alias("s"), F.col(key).alias("k"))
    targets = live.where("repost_of_id is not null").select(F.col(hub).alias("h"), F.col(sig).alias("s"), F.col("repost_of_id").alias("k"))
    alive = canonical(posts).select(F.col(key).alias("k"), F.col(hub).alias("h"))
    keepers = own.union(targets.join(alive, ["k", "h"], "left_semi").select("h", "s", "k")).groupBy("h", "s").agg(F.min("k").alias("keep_id"))
    return own.join(keepers, ["h", "s"]).where("k <> keep_id").select(F.col("k").alias(key), "keep_id")


def near_duplicate_links(posts: DataFrame, dim: int, floor: float = 0.98, key: str = "id", hub: str = "event_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """`(src, dst, sim)` between posts of one hub with cosine at least `floor`, `src < dst`.

    A hub's posts are cut into hashed blocks, and each pair of blocks is one task, so a hub of any size is never gathered.
    """
    lean = posts.where(F.col(hub).isNotNull() & (F.size(vector) == dim)).select(F.col(hub).cast("long").alias("h"), F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    sizes = lean.groupBy("h").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    spread = lean.join(sizes, "h").withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("h", F.least("b", "o").alias("left"), F.greatest("b", "o").alias("right"), "b", "k", "v")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.to_numpy()).astype(np.float64)
        size = np.linalg.norm(x, axis=1)
        ok = np.isfinite(size) & (size > 0)
        u, k, b = x[ok] / size[ok, None], pdf.k.to_numpy()[ok], pdf.b.to_numpy()[ok]
        low, high = int(pdf.left.iloc[0]), int(pdf.right.iloc[0])
        rows, cols = np.nonzero(b == low)[0], np.nonzero(b == high)[0]
        s = u[rows] @ u[cols].T
        i, j = np.nonzero(s >= floor)
        a, c, sim = k[rows[i]], k[cols[j]], s[i, j]
        keep = a < c if low == high else a != c
        return pd.DataFrame({"src": np.minimum(a, c)[keep], "dst": np.maximum(a, c)[keep], "sim": sim[keep]})

    return spread.groupBy("h", "left", "right").applyInPandas(pairs, "src long, dst long, sim double").distinct()


def near_duplicate_fold(links: DataFrame) -> DataFrame:
    """`(id, keep_id)`: every linked post but the smallest of its component, which stands for it."""
    return connected_components(links).where("id <> component").select("id", F.col("component").alias("keep_id"))


def flatten_reposts(posts: DataFrame, key: str = "id") -> DataFrame:
    """`(key, repost_of_id)` with chains of reposts replaced by their last original; rings are left as they stand.

    Steps double until no link changes, or until only links that lead into rings still do: a link that has not ended
    after as many steps as there are links can only be one of those.
    """
    links = cut(posts.where("repost_of_id is not null").select(F.col(key).alias("k"), F.col("repost_of_id").alias("to")))
    first, n, steps = links, links.count(), 1
    while steps <= n:
        onward = links.select(F.col("k").alias("to"), F.col("to").alias("next"))
        step = cut(links.join(onward, "to", "left").select("k", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")))
        links, steps = step.select("k", "to"), steps * 2
        if step.where("more").isEmpty():
            return links.select(F.col("k").alias(key), F.col("to").alias("repost_of_id"))
    ended = links.join(first.select(F.col("k").alias("to")), "to", "left_anti").select("k", F.col("to").alias("__end"))
    return first.join(ended, "k", "left").select(F.col("k").alias(key), F.coalesce("__end", "to").alias("repost_of_id"))


def fold_hubs(posts: DataFrame, dim: int | None = None, most: int = 400) -> DataFrame:
    """Posts after folding: exact copies, then, with `dim`, near copies in hubs of 2 to `most` canonicals, then chains
    to their last original. A post that another one stands for is a repost of it and keeps its hub."""
    def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
        keep = found.select("id", F.col("keep_id").alias("__keep"))
        hit = F.col("__keep").isNotNull()
        value = {"repost_of_id": F.coalesce("__keep", "repost_of_id"), "assignment_status": F.when(hit, "repost").otherwise(F.col("assignment_status"))}
        return cut(rows.join(keep, "id", "left").select(*[value.get(c, F.col(c)).alias(c) for c in rows.columns]))

    out = marked(posts, exact_fold(posts))
    if dim is not None:
        few = near_duplicate_hubs(out, 2, most).select("event_id")
        out = marked(out, near_duplicate_fold(near_duplicate_links(canonical(out).join(few, "event_id", "left_semi"), dim)))
    flat = flatten_reposts(out).select("id", F.col("repost_of_id").alias("__last"))
    return out.join(flat, "id", "left").select(*[F.coalesce("__last", "repost_of_id").alias(c) if c == "repost_of_id" else F.col(c) for c in out.columns])


def hub_counts(posts: DataFrame) -> DataFrame:
    """`(event_id, member_count, repost_count)` over live posts; a hub without any has no row."""
    live = posts.where("deleted_at is null and event_id is not null")
    return live.groupBy("event_id").agg(F.count_if(F.col("repost_of_id").isNull()).alias("member_count"), F.count_if(F.col("repost_of_id").isNotNull()).alias("repost_count"))


def drifted_counts(posts: DataFrame, hubs: DataFrame) -> DataFrame:
    """Hubs whose stored counts differ from `hub_counts`."""
    now = hub_counts(posts)
    joined = hubs.select(F.col("id").alias("event_id"), F.col("member_count").alias("old_members"), F.col("repost_count").alias("old_reposts")).join(now, "event_id")
    return joined.where("not (old_members <=> member_count) or not (old_reposts <=> repost_count)")


def foldable_hubs(posts: DataFrame) -> DataFrame:
    """`(event_id)` of hubs with two canonicals of one signature."""
    rows = canonical(posts).where("event_id is not null and content_sig <> 0")
    return rows.groupBy("event_id", "content_sig").count().where("count > 1").select("event_id").distinct()


def near_duplicate_hubs(posts: DataFrame, low: int = 2, high: int = 400) -> DataFrame:
    """`(event_id, n)` of hubs with between `low` and `high` canonicals that have a vector."""
    rows = canonical(posts).where("event_id is not null and embedding is not null")
    return rows.groupBy("event_id").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))

