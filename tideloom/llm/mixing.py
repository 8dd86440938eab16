"""Mixing sources to target weights: token counts of a public tokenizer and cube-method balanced sampling.

Every record of a source is used `floor` times and, with the same fractional probability, once more. The fractional part
is drawn by the cube method: inclusion probabilities walk through the null space of the balancing constraints (tokens
and documents), so both totals stay what they should be, until at most a few undecided records remain. The walk runs in
bounded blocks; their undecided records meet in further rounds, and the last few land by the nearest whole choice.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.runtime import cut, maybe_broadcast

#: Where the public tokenizers' files lie, unless a path is given.
TOKENIZER_DIR = os.environ.get("TIDELOOM_TOKENIZERS", "/opt/tokenizers")
#: Undecided records walked in one task.
BLOCK_ROWS = 5_000


def source_name(column: Column) -> Column:
    """Sources are the same up to case and blanks at the ends."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")))


def with_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Add `n_tokens`, counted over the whole text by the tokenizer file (`tokenizers` JSON); null texts have 0."""
    path = tokenizer or f"{TOKENIZER_DIR}/byte_bpe_50k.json"

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for s in parts:
            out = np.zeros(len(s), np.int64)
            texts = s.fillna("").tolist()
            for lo in range(0, len(texts), 512):
                out[lo : lo + 512] = [len(x) for x in t.encode_batch(texts[lo : lo + 512], add_special_tokens=False)]
            yield pd.Series(out)

    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("n_tokens", F.pandas_udf(count, "long")(F.col(text)))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The cube method's flight phase for the constraints (sum of pi * size, sum of pi): at most two stay fractional."""
    pi = pi.copy()
    eps = 1e-9
    free = [i for i in range(len(pi)) if eps < pi[i] < 1 - eps]
    held: list[int] = []
    at = 0
    while True:
        while len(held) < 3 and at < len(free):
            held.append(free[at])
            at += 1
        if len(held) < 3:
            return pi
        a, b, c = held
        # Null vector of the rows (sizes) and (1, 1, 1): their cross product.
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        p = pi[[a, b, c]]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + up * u if rng.random() < down / (up + down) else p - down * u
        p = np.where(p < eps, 0.0, np.where(p > 1 - eps, 1.0, p))
        pi[[a, b, c]] = p
        held = [i for i, x in zip(held, p) if 0 < x < 1]


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing phase for a few fractional records: the whole choice nearest to their expected size and number."""
    free = np.nonzero((pi > 0) & (pi < 1))[0][:12]
    want, number = float((pi[free] * size[free]).sum()), float(pi[free].sum())
    scale = max(1.0, float(size[free].mean()) if len(free) else 1.0)
    best, out = None, pi.copy()
    for code in range(1 << len(free)):
        bits = np.array([(code >> j) & 1 for j in range(len(free))])
        off = abs(float((bits * size[free]).sum()) - want) + 0.01 * scale * abs(float(bits.sum()) - number)
        if best is None or off < best:
            best = off
            out[free] = bits
    return out


def whole_and_part(rate: Column, most: Column) -> tuple[Column, Column]:
    """How often every record is used, and the probability of once more; a rate within 1e-9 of a whole number is whole.

    The rate of the source that limits the mix is its cap up to rounding; both parts together never exceed `most`.
    """
    base = F.least(F.floor(rate + 1e-9), most)
    part = rate - base
    return base.cast("long"), F.when((base >= most) | (part <= 1e-9), 0.0).otherwise(part)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, tokenizer: str | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """`(records, shares)`: `records(key, source, n_tokens, copies)` with copies >= 1, and the shares reached.

    `shares(source, target_share, wanted_share, tokens, actual_share, goal_tokens, available_tokens, longest, n_docs, used,
    max_repeats)` has a row for every target; `tokens` is within one longest record of `goal_tokens`. A target whose source has no tokens cannot be met; the other targets keep their proportions
    (`wanted_share`). Without `total_tokens` the mix is as large as the repeat limits allow with every wanted share met;
    a larger total is cut down to that size. No record is used more than `max_repeats` times. Sources without a target
    are left out; of a repeated target row one counts; null sources, null keys, and records without tokens take no part.
    """
    lean = docs.select(F.col(key).cast("long").alias(key), source_name(F.col(source)).alias("source"), F.col(text).alias("__text"))
    sized = cut(with_tokens(lean.where(f"`{key}` is not null and source is not null"), "__text", tokenizer).select(key, "source", "n_tokens").where("n_tokens > 0"))
    plan = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("most")).where("source is not null and share > 0 and most > 0")
    plan = plan.groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"), F.count("*").alias("n"))
    asked = cut(plan.join(have, "source", "left").fillna(0, ["tokens", "longest", "n"]))
    n_targets = asked.count()
    reachable = asked.where("tokens > 0")
    weight = reachable.agg(F.sum("share").alias("weight"))
    size = reachable.crossJoin(F.broadcast(weight)).agg(F.min(F.col("most") * F.col("tokens") * F.col("weight") / F.col("share")).alias("total"), F.first("weight").alias("weight"))  # one row
    if total_tokens:
        size = size.withColumn("total", F.least("total", F.lit(float(total_tokens))))
    wanted = F.col("share") / F.col("weight")
    goal = cut(reachable.crossJoin(F.broadcast(size)).select("source", wanted.alias("wanted"), (wanted * F.col("total")).alias("goal"), (wanted * F.col("total") / F.col("tokens")).alias("rate"), "most", "n"))
    base, pi = whole_and_part(F.col("rate"), F.col("most"))
    rate = sized.join(maybe_broadcast(goal, n_targets), "source").select(key, "source", "n_tokens", base.alias("base"), pi.alias("pi"), "n")
    fixed = rate.select(key, "source", "n_tokens", "base")

    def walk(last: bool):  # noqa: ANN202
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key, kind="stable")
            rng = np.random.default_rng([seed, int(pdf[key].iloc[0]) & 0x7FFFFFFF])
            size = pdf.n_tokens.to_numpy().astype(float)
            pi = flight(pdf.pi.to_numpy(), size, rng)
            pdf["pi"] = land(pi, size) if last else pi
            return pdf[[key, "source", "n_tokens", "pi"]]

        return run

    schema = f"`{key}` long, source string, n_tokens long, pi double"
    open_rows = rate.where("pi > 0").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    grouped = open_rows.withColumn("block", F.pmod(F.xxhash64(key, F.lit(seed)), "blocks"))
    walked = cut(grouped.groupBy("source", "block").applyInPandas(walk(False), schema))
    taken = walked.where("pi >= 1 - 1e-9").select(key)
    left = walked.where("pi > 1e-9 and pi < 1 - 1e-9")
    turn, before = 0, None
    while True:  # undecided records fall by a factor of about BLOCK_ROWS / 2 a round
        sizes = left.groupBy("source").count()
        widest = sizes.agg(F.max("count")).first()[0] or 0
        if widest <= BLOCK_ROWS:
            break
        if before is not None and widest >= before:
            raise RuntimeError(f"{widest} records of a source stay undecided")
        before = widest
        grouped = left.join(sizes, "source").withColumn("block", F.pmod(F.xxhash64(key, F.lit(seed + 1 + turn)), F.ceil(F.col("count") / BLOCK_ROWS)))
        again = cut(grouped.groupBy("source", "block").applyInPandas(walk(False), schema))
        taken = taken.union(again.where("pi >= 1 - 1e-9").select(key))
        left = again.where("pi > 1e-9 and pi < 1 - 1e-9")
        turn += 1
    landed = cut(left.groupBy("source").applyInPandas(walk(True), schema))
    taken = taken.union(landed.where("pi >= 0.5").select(key)).withColumn("one", F.lit(1).cast("long"))
    records = cut(fixed.join(taken, key, "left").select(key, "source", "n_tokens", (F.col("base") + F.coalesce("one", F.lit(0))).cast("long").alias("copies")).where("copies > 0"))
    got = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("used"))
    everything = got.agg(F.sum("tokens").alias("everything"))
    shares = (
        asked.join(got, "source", "left").join(goal.select("source", "wanted", "goal"), "source", "left").crossJoin(F.broadcast(everything))
        .select("source", F.col("share").alias("target_share"), F.coalesce("wanted", F.lit(0.0)).alias("wanted_share"), F.coalesce(got["tokens"], F.lit(0)).alias("tokens"),
            F.coalesce(got["tokens"] / F.col("everything"), F.lit(0.0)).alias("actual_share"), F.coalesce("goal", F.lit(0.0)).alias("goal_tokens"), asked["tokens"].alias("available_tokens"), "longest", F.col("n").alias("n_docs"), F.coalesce("used", F.lit(0)).alias("used"), F.col("most").alias("max_repeats"))
    )
    return records, shares
