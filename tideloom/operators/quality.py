"""Quality from journals: windowed roll-ups, drift, threshold curves, clustering scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def between(rows: DataFrame, start: datetime | str, end: datetime | str, at: str = "created_at") -> DataFrame:
    return rows.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))


def versions() -> list[Column]:
    return [F.coalesce("policy_version", F.lit(UNKNOWN)).alias("policy_version"), F.coalesce("model_version", F.lit(UNKNOWN)).alias("model_version")]


def human_rollup(feedback: DataFrame, every: str = "1 hour") -> DataFrame:
    """Confirmed, removed and dismissed per window and versions, precision and unlink rate (null without judgements)."""
    rows = feedback.select(F.window("created_at", every).alias("w"), *versions(), "feedback_type")
    kinds = {"confirmed": "user_confirmed", "removed": "user_removed", "dismissed": "user_dismissed"}
    got = rows.groupBy("w", "policy_version", "model_version").agg(F.count("*").alias("total"), *[F.count_if(F.col("feedback_type") == k).alias(n) for n, k in kinds.items()])
    judged = F.col("confirmed") + F.col("removed")
    return got.select(F.col("w.start").alias("window_start"), "policy_version", "model_version", "total", *kinds, F.try_divide(F.col("confirmed"), judged).alias("precision"), F.try_divide(F.col("removed"), judged).alias("unlink_rate"))


def system_rollup(decisions: DataFrame, every: str = "1 hour") -> DataFrame:
    """Decisions per window and versions and the share assigned."""
    rows = decisions.select(F.window("created_at", every).alias("w"), *versions(), "status")
    got = rows.groupBy("w", "policy_version", "model_version").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "assigned").alias("assigned"))
    return got.select(F.col("w.start").alias("window_start"), "policy_version", "model_version", "total", "assigned", F.try_divide(F.col("assigned"), F.col("total")).alias("coverage"))


def latest_labels(feedback: DataFrame) -> DataFrame:
    """`(post_id, label, policy_version, model_version)`: the last good or bad judgement of each post."""
    label = F.when(F.col("feedback_type").isin("user_confirmed", "auto_confirmed"), "good").when(F.col("feedback_type") == "user_removed", "bad")
    rows = feedback.where("post_id is not null").withColumn("label", label).where("label is not null")
    last = Window.partitionBy("post_id").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("post_id", "label", *versions())


def labels_of(feedback: DataFrame, policy: str, model: str) -> DataFrame:
    """`(post_id, label)` of one policy and model: the post's last judgement is taken first, its versions are asked after."""
    return latest_labels(feedback).where((F.col("policy_version") == policy) & (F.col("model_version") == model)).select("post_id", "label")


def pairwise_accuracy(rows: DataFrame, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """`(precision, recall)`: the share of rows whose positive similarity exceeds, or reaches, the negative; 1 without rows."""
    share = lambda ok: F.coalesce(F.avg(ok.cast("double")), F.lit(1.0))
    return rows.agg(share(F.col(positive) > F.col(negative)).alias("precision"), share(F.col(positive) >= F.col(negative)).alias("recall"))


def labelled(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest labels with the similarity of every assigned decision of the post (a post decided twice counts twice)."""
    sims = decisions.where("status = 'assigned' and similarity is not null").select("post_id", "similarity")
    return latest_labels(feedback).join(sims, "post_id")


def drift(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """`(versions, good, bad, drift)`: mean similarity of good less that of bad, null unless both exist."""
    means = labelled(feedback, decisions).groupBy("policy_version", "model_version").agg(F.avg(F.when(F.col("label") == "good", F.col("similarity"))).alias("good"), F.avg(F.when(F.col("label") == "bad", F.col("similarity"))).alias("bad"))
    return means.withColumn("drift", F.col("good") - F.col("bad"))


def threshold_curve(rows: DataFrame, sim: str = "similarity", label: str = "label") -> DataFrame:
    """`(threshold, tp, fp, precision, coverage)` at every distinct similarity rounded to 4 decimals.

    Counts compare the unrounded similarities with the threshold. Similarities are first counted per (rounded value,
    on or above it), of which there are at most some ten thousand, so the cumulative window stays small at any size.
    """
    t = F.round(F.col(sim), 4)
    bins = rows.where(F.col(sim).isNotNull() & F.col(label).isin("good", "bad")).groupBy(t.alias("threshold")).agg(
        *[F.count_if((F.col(label) == k) & on).alias(f"{k}_{n}") for k in ("good", "bad") for n, on in (("on", F.col(sim) >= t), ("below", F.col(sim) < t))])
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, -1)
    cum = bins.select("threshold", *[(F.coalesce(F.sum(F.col(f"{k}_on") + F.col(f"{k}_below")).over(above), F.lit(0)) + F.col(f"{k}_on")).cast("long").alias(n) for k, n in (("good", "tp"), ("bad", "fp"))])
    total = rows.where(F.col(sim).isNotNull() & (F.col(label) == "good")).agg(F.count("*").alias("goods"))
    return cum.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("goods")).alias("coverage"))


def pick_threshold(curve: DataFrame, floor: float, precision: float = 0.97, coverage: float = 0.85) -> DataFrame:
    """The feasible threshold with the best precision, then coverage, then the lowest; no row if none is."""
    ok = curve.where((F.col("threshold") >= floor) & (F.col("precision") >= precision) & (F.col("coverage") >= coverage))
    return ok.orderBy(F.desc("precision"), F.desc("coverage"), "threshold").limit(1)


def threshold_impact(decisions: DataFrame, old: float, new: float) -> DataFrame:
    """How many assigned decisions fall and how many others rise when the threshold moves."""
    s = F.col("similarity")
    return decisions.agg(F.count_if(s.isNotNull()).alias("decided"), F.count_if((s >= old) & (s < new)).alias("falling"), F.count_if((s < old) & (s >= new)).alias("rising"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def clustering_scores(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Pairwise precision, recall, F1, purity, NMI (arithmetic mean) and ARI from the contingency table."""
    cells = rows.where(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").cast("double").alias("n"))
    by_t, by_f = cells.groupBy("t").agg(F.sum("n").alias("nt")), cells.groupBy("f").agg(F.sum("n").alias("nf"), F.max("n").alias("best"))
    total = cells.agg(F.sum("n").alias("total"))
    c = cells.agg(F.sum(_pairs(F.col("n"))).alias("tp"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    t = by_t.agg(F.sum(_pairs(F.col("nt"))).alias("pt"), F.sum(F.col("nt") * F.log("nt")).alias("tlogt"))
    f = by_f.agg(F.sum(_pairs(F.col("nf"))).alias("pf"), F.sum(F.col("nf") * F.log("nf")).alias("flogf"), F.sum("best").alias("pure"))
    one = total.crossJoin(c).crossJoin(t).crossJoin(f)  # one row each
    n = F.col("total")
    ht, hf = F.log(n) - F.col("tlogt") / n, F.log(n) - F.col("flogf") / n
    mutual = F.log(n) + (F.col("nlogn") - F.col("tlogt") - F.col("flogf")) / n
    expected = F.col("pt") * F.col("pf") / _pairs(n)
    precision, recall = F.try_divide(F.col("tp"), F.col("pf")), F.try_divide(F.col("tp"), F.col("pt"))
    return one.select(
        precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), F.col("pf") + F.col("pt")).alias("f1"), (F.col("pure") / n).alias("purity"),
        F.when(ht + hf > 0, 2 * mutual / (ht + hf)).otherwise(1.0).alias("nmi"), F.try_divide(F.col("tp") - expected, (F.col("pt") + F.col("pf")) / 2 - expected).alias("ari"))
