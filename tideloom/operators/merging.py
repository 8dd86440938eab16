"""Hubs against hubs: redirects, candidate pairs, the judge, the greedy pass, the hub network."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.config import DEFAULT, Config
from tideloom.functions.text import identity_tokens
from tideloom.operators.graph import connected_components
from tideloom.runtime import cut

#: Hubs whose vectors a task holds at once.
BLOCK = 4_096
#: Hubs of one user that are paired with another block of them in one group.
VOICE_BLOCK = 512


def canonical_hub(hubs: DataFrame, max_hops: int = 5) -> DataFrame:
    """`(id, canonical_id, redirected)`: follow `merged_into_id` up to `max_hops` times, stopping at the first active hub,
    at a hub without a target, and at a target that does not exist (which is then the result)."""
    step = hubs.select(F.col("id").alias("to"), F.col("merged_into_id").alias("next"), F.coalesce("is_active", F.lit(False)).alias("live"))
    at = hubs.select("id", F.col("id").alias("to"))
    for _ in range(max_hops):
        at = at.join(step, "to", "left").select("id", F.when(F.coalesce("live", F.lit(True)) | F.col("next").isNull(), F.col("to")).otherwise(F.col("next")).alias("to"))
    return at.select("id", F.col("to").alias("canonical_id"), (F.col("to") != F.col("id")).alias("redirected"))


def dominant_tokens(posts: DataFrame, fraction: float = DEFAULT.merge_identity_fraction, support: int = DEFAULT.merge_identity_support) -> DataFrame:
    """`(event_id, orgs, identity)`: tokens in at least `support` and `fraction` of a hub's live posts."""
    live = posts.where("deleted_at is null and event_id is not null").select("id", "event_id", "entities")
    totals = live.groupBy("event_id").agg(F.count("*").alias("total"))
    counts = live.select("id", "event_id", F.explode("entities").alias("e")).distinct().groupBy("event_id", "e").agg(F.count("*").alias("n"))
    strong = counts.join(totals, "event_id").where((F.col("n") >= support) & (F.col("n") / F.col("total") >= fraction))
    lists = strong.groupBy("event_id").agg(F.collect_set("e").alias("es"))  # at most 1 / fraction tokens a post list
    return lists.select("event_id", F.sort_array(identity_tokens(F.col("es"), org_only=True)).alias("orgs"), F.sort_array(identity_tokens(F.col("es"))).alias("identity"))


def merge_candidates(hubs: DataFrame, dim: int, floor: float = DEFAULT.merge_entity_floor, gap_hours: float | None = DEFAULT.merge_gap_hours) -> DataFrame:
    """`(a, b, sim)` of active hubs with cosine at least `floor`, updated within `gap_hours` of each other; without
    `gap_hours` all active hubs are compared, also those never updated.

    Pairs meet in windows of time of that length (each hub in its own and, as the later one, in the window before), and
    each window is cut into block pairs, so no task holds more than two blocks. `a` is the hub with more members (then
    the smaller id).
    """
    span = None if gap_hours is None else int(gap_hours * 3_600_000_000)
    lean = hubs.where(F.col("is_active") & (F.size("centroid") == dim)).select(F.col("id").cast("long").alias("k"), F.coalesce("member_count", F.lit(0)).cast("long").alias("m"), F.unix_micros("last_updated_at").alias("t"), F.col("centroid").alias("v"))
    if span is None:
        spread = lean.withColumns({"t": F.lit(0).cast("long"), "w": F.lit(0).cast("long"), "win": F.lit(0).cast("long")})
    else:
        lean = lean.where("t is not null").withColumn("w", F.floor(F.col("t") / span))
        spread = lean.select("*", F.explode(F.array(F.col("w"), F.col("w") - 1)).alias("win"))
    sizes = spread.groupBy("win").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    blocks = spread.join(sizes, "win").withColumn("b", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("win", F.least("b", "o").alias("left"), F.greatest("b", "o").alias("right"), "b", "k", "m", "t", "w", "v")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.to_numpy()).astype(np.float64)
        size = np.linalg.norm(x, axis=1)
        ok = np.isfinite(size) & (size > 0)
        pdf, u = pdf[ok], x[ok] / size[ok, None]
        b, k, m, t, w, win = (pdf[c].to_numpy() for c in ("b", "k", "m", "t", "w", "win"))
        rows, cols = np.nonzero(b == pdf.left.iloc[0])[0] if len(b) else [], np.nonzero(b == pdf.right.iloc[0])[0] if len(b) else []
        if not len(rows) or not len(cols):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": int, "b": int, "sim": float})
        s = u[rows] @ u[cols].T
        i, j = np.nonzero(s >= floor)
        p, q, sim = rows[i], cols[j], s[i, j]
        keep = (k[p] != k[q]) & (span is None or np.abs(t[p] - t[q]) <= span) & ((w[p] == win[p]) | (w[q] == win[q]))
        p, q, sim = p[keep], q[keep], sim[keep]
        first = (m[p] > m[q]) | ((m[p] == m[q]) & (k[p] < k[q]))
        return pd.DataFrame({"a": np.where(first, k[p], k[q]), "b": np.where(first, k[q], k[p]), "sim": sim})

    return blocks.groupBy("win", "left", "right").applyInPandas(pairs, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def judge(sim: Column, orgs_a: Column, identity_a: Column, orgs_b: Column, identity_b: Column, cfg: Config = DEFAULT) -> Column:
    """dominant_org_conflict, shared_identity, identity_divergent, high_similarity or no_identity_evidence."""
    both_orgs = (F.size(orgs_a) > 0) & (F.size(orgs_b) > 0)
    both = (F.size(identity_a) > 0) & (F.size(identity_b) > 0)
    return (
        F.when(both_orgs & ~F.arrays_overlap(orgs_a, orgs_b), "dominant_org_conflict")
        .when(both & F.arrays_overlap(identity_a, identity_b), "shared_identity").when(both, "identity_divergent")
        .when(sim >= cfg.merge_no_identity_sim, "high_similarity").otherwise("no_identity_evidence")
    )


def judged_pairs(pairs: DataFrame, tokens: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """`(a, b, sim, verdict, merge)`."""
    none = F.array().cast("array<string>")
    rows = pairs.join(tokens.select(F.col("event_id").alias("a"), F.col("orgs").alias("oa"), F.col("identity").alias("ia")), "a", "left").join(tokens.select(F.col("event_id").alias("b"), F.col("orgs").alias("ob"), F.col("identity").alias("ib")), "b", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("oa", "ia", "ob", "ib")})
    verdict = judge(F.col("sim"), F.col("oa"), F.col("ia"), F.col("ob"), F.col("ib"), cfg)
    return rows.select("a", "b", "sim", verdict.alias("verdict")).withColumn("merge", F.col("verdict").isin("shared_identity", "high_similarity"))


def greedy_merges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """`(source_id, target_id, step)` of one pass over the approved pairs in rank order (members descending, then id).

    The larger hub of a pair survives, of equals the later in rank, by the counts at the start of the pass. A hub that
    was merged away opens no further pairs and is no second side; one that is merged away while it stands first goes on
    through the hub it became part of. Pairs that share no hub, even through others, cannot affect each other, so each
    component of pairs is one task; steps count within a component.
    """
    size = members.select(F.col("id").alias("h"), F.coalesce("member_count", F.lit(0)).cast("long").alias("m"))
    rows = pairs.select("a", "b").join(size.select(F.col("h").alias("a"), F.col("m").alias("ma")), "a").join(size.select(F.col("h").alias("b"), F.col("m").alias("mb")), "b")
    part = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"id": "a"})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        count = dict(zip(pdf.a, pdf.ma)) | dict(zip(pdf.b, pdf.mb))
        rank = {h: i for i, h in enumerate(sorted(count, key=lambda h: (-count[h], h)))}
        partners: dict[int, list[int]] = {}
        for a, b in zip(pdf.a, pdf.b):
            first, second = (a, b) if rank[a] < rank[b] else (b, a)
            partners.setdefault(first, []).append(second)
        into: dict[int, int] = {}
        away: set[int] = set()
        out = []
        for first in sorted(partners, key=rank.get):
            if first in away:
                continue
            for second in sorted(partners[first], key=rank.get):
                if second in away:
                    continue
                loser, winner = (second, first) if count[first] > count[second] else (first, second)
                ends = []
                for h in (loser, winner):
                    while h in into:
                        h = into[h]
                    ends.append(h)
                if ends[0] != ends[1]:
                    into[ends[0]] = ends[1]
                    away.add(loser)
                    out.append((*ends, len(out)))
        return pd.DataFrame(out, columns=["source_id", "target_id", "step"])

    return rows.join(part, "a").groupBy("component").applyInPandas(run, "source_id long, target_id long, step long")


def merge_to_fixpoint(posts: DataFrame, hubs: DataFrame, dim: int, at: datetime | str, fresh_hours: float = DEFAULT.hub_freshness_hours, gap_hours: float | None = DEFAULT.merge_gap_hours, max_rounds: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, hubs, merges `(round, source_id, target_id)`) of passes repeated until one merges nothing.

    A pass moves centroids, so the next may find pairs that it could not see. Each pass takes active hubs updated within
    `fresh_hours` before `at`; a chain of merges within a pass is applied to its last hub.
    """
    from tideloom.operators.corrections import apply_merges

    done = posts.sparkSession.createDataFrame([], "round int, source_id long, target_id long")
    for n in range(max_rounds):
        near = hubs.where(F.col("last_updated_at") >= F.lit(at).cast("timestamp") - F.make_dt_interval(secs=F.lit(fresh_hours * 3600.0)))
        found = cut(greedy_merges(cut(judged_pairs(merge_candidates(near, dim, gap_hours=gap_hours), dominant_tokens(posts))).where("merge"), hubs))
        if found.isEmpty():
            break
        last = found.select("source_id", "target_id")
        while True:  # follow chains to their last hub
            onward = last.join(found.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("__next")), "target_id", "left")
            moved = cut(onward.select("source_id", F.coalesce("__next", "target_id").alias("target_id"), F.col("__next").isNotNull().alias("more")))
            last = moved.select("source_id", "target_id")
            if moved.where("more").isEmpty():
                break
        after = apply_merges(posts, hubs, last, at)
        posts, hubs = cut(after[0]), cut(after[1])
        done = done.union(last.select(F.lit(n).alias("round"), "source_id", "target_id"))
    return posts, hubs, done


# Tickers by the first word of a name, and words without meaning for a codename.
TICKERS = {
    "aws": "AWS", "amazon": "AWS", "fed": "FED", "federal": "FED", "microsoft": "MSFT", "apple": "AAPL", "google": "GOOG", "meta": "META", "openai": "OPENAI", "nvidia": "NVDA", "tesla": "TSLA", "spacex": "SPACEX",
    "barcelona": "BAR", "fc": "BAR", "nasa": "NASA", "nato": "NATO", "opec": "OPEC", "un": "UN", "eu": "EU", "who": "WHO", "fedex": "FDX", "barclays": "BARC", "musk": "MUSK", "trump": "TRUMP", "putin": "PUTIN", "zelensky": "ZEL", "netflix": "NFLX", "spotify": "SPOT", "uber": "UBER",
}
CODENAME_STOP = """a an the in on at by of to for and or not its it is are was were be been being that this these those with over under as from into upon amid
after before has have had can could will would shall should may might us new major minor report reports reported say says said seeing today yesterday early
late expected continues continued start starts began begin plans plan sees watch aftermath weeks month year another first second third one two three every
any all due ahead again enough more among against during set warns warn jumps jump soars soar rises rise falls fall fell drops drop double triple back stage
while via using used use make makes made take takes took secured dramatic victory completes"""


def codename(handle: Column, title: Column, hub_id: Column) -> Column:
    """A short name of a hub: the ticker or first six letters of its first telling word, and a second word if there is
    room; 17 characters at most."""
    text = F.regexp_replace(F.lower(F.when(F.length(handle) > 0, handle).otherwise(F.coalesce(title, F.lit("")))), "_", "-")
    words = F.filter(F.split(text, "-"), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in CODENAME_STOP.split()])
    telling = F.filter(words, lambda w: ~F.array_contains(stop, w))
    kept = F.when(F.size(telling) > 0, telling).otherwise(words)
    head = F.get(kept, F.lit(0))
    tickers = F.create_map(*[F.lit(x) for pair in TICKERS.items() for x in pair])
    root = F.coalesce(F.element_at(tickers, head), F.upper(F.substring(head, 1, 6)), F.concat(F.lit("HUB"), hub_id.cast("string")))
    suffix = F.get(F.filter(F.slice(kept, 2, 1_000), lambda w: (F.length(w) <= 7) & ~w.rlike(r"^[0-9_.-]+$")), F.lit(0))
    return F.substring(F.when((F.length(root) < 6) & suffix.isNotNull(), F.concat(root, F.lit("-"), F.upper(suffix))).otherwise(root), 1, 17)


def codenames(hubs: DataFrame) -> DataFrame:
    """`(id, codename)`: codenames by order of creation, later ones of the same name with their id appended."""
    rows = hubs.select("id", "created_at", codename(F.col("handle"), F.col("title"), F.col("id")).alias("__code"))
    again = F.row_number().over(Window.partitionBy("__code").orderBy("created_at", "id")) > 1
    return rows.select("id", F.when(again, F.concat("__code", F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("__code")).alias("codename"))


def birth_edges(hubs: DataFrame) -> DataFrame:
    """`(src, dst)` of hubs that follow each other in order of creation; ranges are chained across their borders.

    The order is taken per day of creation and the days are linked by their first and last hubs, so no task sorts all.
    """
    day = hubs.where("id is not null and created_at is not null").select("id", "created_at", F.to_date("created_at").alias("day"))
    inside = day.withColumn("dst", F.lead("id").over(Window.partitionBy("day").orderBy("created_at", "id")))
    ends = day.groupBy("day").agg(F.min(F.struct("created_at", "id")).alias("first"), F.max(F.struct("created_at", "id")).alias("last"))
    across = ends.withColumn("dst", F.lead("first.id").over(Window.orderBy("day")))  # one row a day
    return inside.where("dst is not null").select(F.col("id").alias("src"), "dst").union(across.where("dst is not null").select("last.id", "dst"))


def voice_edges(posts: DataFrame, most_hubs: int | None = None) -> DataFrame:
    """`(src, dst, users)`: users with live posts in both hubs, `src < dst`.

    `most_hubs` optionally leaves out users in more hubs than that (off by default).
    """
    own = cut(posts.where("deleted_at is null and event_id is not null and user_id is not null").select("user_id", "event_id").distinct())
    if most_hubs:
        own = own.join(own.groupBy("user_id").count().where(F.col("count") <= most_hubs).select("user_id"), "user_id", "left_semi")
    # Each user's hubs are cut into blocks; a pair of blocks is one group, so no user is gathered into one row.
    sizes = own.groupBy("user_id").agg(F.ceil(F.count("*") / F.lit(VOICE_BLOCK)).cast("int").alias("parts"))
    placed = own.join(sizes, "user_id").withColumn("b", F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int"))
    left = placed.select("user_id", F.col("b").alias("b1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b2"), F.col("event_id").alias("src"))
    right = placed.select("user_id", F.col("b").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b1"), F.col("event_id").alias("dst"))
    pairs = left.join(right, ["user_id", "b1", "b2"]).where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("users"))


def hub_graph(birth: DataFrame, similar: DataFrame, voice: DataFrame) -> DataFrame:
    """`(src, dst, kind, weight)`: one edge a pair, birth before similar before voice; weights within [0.05, 1]."""
    both = (
        birth.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(0).alias("p"), F.lit("birth").alias("kind"), F.lit(1.0).alias("w"))
        .union(similar.select(F.least("a", "b"), F.greatest("a", "b"), F.lit(1), F.lit("similar"), F.col("sim")))
        .union(voice.select("src", "dst", F.lit(2), F.lit("voice"), F.least(F.col("users"), F.lit(8)).cast("double")))
    )
    best = both.groupBy("src", "dst").agg(F.min(F.struct("p", "kind", "w")).alias("b"))
    return best.select("src", "dst", "b.kind", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("b.w"))), 3).alias("weight"))
