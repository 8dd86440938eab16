"""Posts against hubs: best two by cosine, the decision, its reason, tie-break and veto."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.config import DEFAULT, Config
from tideloom.functions.text import entities_conflict, identity_tokens

#: Hub vectors held by a task at once, in rows and once each, as precise as their column; more hubs are matched block by block.
HUB_BLOCK = 20_000
#: Posts multiplied with a block at once, so the matrix of cosines stays at `POST_SLICE` x `HUB_BLOCK` however long a batch is.
POST_SLICE = 256
#: Hubs of a block multiplied at once: the cosines of a slice with so many stay in the processor's cache, and no others are held.
HUB_TILE = 500
#: Hubs of one post whose cosine is taken anew in double; a post with more near ties is multiplied in double as a whole.
NEAR_TIES = 32
#: Pairs of post and hub that are brought to double at once.
PAIRS = 1024


def fresh_hubs(hubs: DataFrame, as_of: datetime, hours: float = DEFAULT.hub_freshness_hours) -> DataFrame:
    """Active hubs with a centroid, updated within `hours` before `as_of`."""
    return hubs.where(F.col("is_active") & F.col("centroid").isNotNull() & (F.col("last_updated_at") >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(hours * 3600))))


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as double rows; nulls as NaN."""
    flat = column.flatten()
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two that brings their length into [0.5, 1), which loses no digit, and that length; in double."""
    power = np.frexp(np.linalg.norm(c, axis=1))[1]
    c = np.ldexp(c, -power[:, None])
    return c, np.linalg.norm(c, axis=1)


def best_two(x: np.ndarray, wide: np.ndarray, narrow: np.ndarray, length: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, cosine) of the best and of the second best of `wide` for unit rows `x`; ties go to the smaller place.

    `narrow` is `wide` in single precision: its product is off by a known bound at most, so all that may be among the
    best two in double is within twice that bound of the second, and only those cosines are taken in double. Of each
    `HUB_TILE` hubs the two best values are kept; tiles that reach the second of all are multiplied once more. Rows of
    `wide` are unit rows, or have the given `length` in double: of `scaled` single-precision rows no copy is held.
    """
    single, at = x.astype(np.float32), np.arange(len(x))
    short = None if length is None else length.astype(np.float32)

    def cosines(rows: np.ndarray, lo: int) -> np.ndarray:
        s = rows @ narrow[lo : lo + HUB_TILE].T
        return s if short is None else np.divide(s, short[lo : lo + HUB_TILE], out=s)

    def unit(places: np.ndarray | slice) -> np.ndarray:
        c = wide[places].astype(np.float64, copy=False)
        return c if length is None else c / length[places, None]

    starts = range(0, len(narrow), HUB_TILE)
    best, second = np.empty((2, len(starts), len(x)), np.float32)
    for k, lo in enumerate(starts):
        s = cosines(single, lo)
        place = s.argmax(axis=1)
        best[k] = s[at, place]
        s[at, place] = -9
        second[k] = s.max(axis=1)
    floor = second[best.argmax(axis=0), at]  # the second best is in the tile of the best, or the best of another one
    if len(starts) > 1:
        floor = np.maximum(floor, np.partition(best, -2, axis=0)[-2])
    floor -= np.float32(4 * (x.shape[1] + 8) * 2.0**-24)
    ties = np.zeros(len(x), int)
    near = []
    for k, lo in enumerate(starts):
        rows = np.flatnonzero((best[k] >= floor) & (ties <= NEAR_TIES))
        if len(rows):
            i, c = np.nonzero(cosines(single[rows], lo) >= floor[rows, None])
            ties += np.bincount(rows[i], minlength=len(x))
            near.append((rows[i], c + lo))
    r, c = (np.concatenate(a) for a in zip(*near))
    many = ties > NEAR_TIES
    r, c = r[~many[r]], c[~many[r]]
    v = np.empty(len(r))
    for lo in range(0, len(r), PAIRS):
        v[lo : lo + PAIRS] = np.einsum("ij,ij->i", x[r[lo : lo + PAIRS]], unit(c[lo : lo + PAIRS]))
    v = np.round(v, 12)
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    start = np.searchsorted(r, at[~many])
    out = [(r[start], c[start], v[start])]
    start = start[ties[~many] > 1] + 1
    out.append((r[start], c[start], v[start]))
    for rows in np.array_split(at[many], -(-int(many.sum()) // 64)) if many.any() else []:
        d = np.empty((len(rows), len(wide)))
        for lo in starts:
            d[:, lo : lo + HUB_TILE] = x[rows] @ unit(slice(lo, lo + HUB_TILE)).T
        np.round(d, 12, out=d)
        for _ in range(2):
            best = d.argmax(axis=1)  # of equals the smaller place
            here = np.arange(len(rows))
            out.append((rows, best, d[here, best]))
            d[here, best] = -9
    return out


def match_top2(posts: DataFrame, hubs: DataFrame, dim: int, post_key: str = "id", post_vector: str = "embedding", hub_key: str = "id", hub_vector: str = "centroid") -> DataFrame:
    """`(post_id, event_id, sim, runner_id, runner_sim)` for every post, the two most similar hubs by cosine.

    Ties go to the smaller hub id. Posts without a usable vector, and all posts if there are no hubs, get nulls; hubs
    without one are passed over. Hubs travel to the tasks in blocks of `HUB_BLOCK`, each a matrix product against
    `POST_SLICE` posts at a time, and the blocks' best two are merged by key, so neither side has to fit into one task.
    """
    spark = posts.sparkSession
    lean = posts.select(F.col(post_key).cast("long").alias("post_id"), F.col(post_vector).alias("v"))
    usable = hubs.where((F.size(hub_vector) == dim) & F.col(hub_key).isNotNull()).select(F.col(hub_key).cast("long").alias("h"), F.col(hub_vector).alias("c"))
    kind = np.float32 if dict(usable.dtypes)["c"] == "array<float>" else np.float64
    schema = "post_id long, h long, s double"
    parts: list[DataFrame] = []

    def packed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Usable hubs as rows of bytes: ids, then scaled vectors as precise as they came, then their lengths."""
        for b in stream:
            c = _rows(b.column(1)) if b.num_rows else np.zeros((0, dim))
            length = np.linalg.norm(c, axis=1)
            good = np.isfinite(length) & (length > 0)
            if good.any():
                c, length = scaled(c[good])
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (b.column(0).to_numpy()[good], c.astype(kind, copy=False), length)], names=["ids", "vectors", "lengths"])

    def block(ids: list[np.ndarray], vectors: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        names = np.concatenate(ids)
        order = np.argsort(names, kind="stable")
        sent = spark.sparkContext.broadcast((names[order], np.concatenate(vectors)[order], np.concatenate(lengths)[order]))

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub_ids, centres, lengths = sent.value
            narrow = centres.astype(np.float32, copy=False)
            for whole in stream:
                found = []
                for lo in range(0, whole.num_rows, POST_SLICE):
                    b = whole.slice(lo, POST_SLICE)
                    x = _rows(b.column(1))
                    size = np.linalg.norm(x, axis=1)
                    ok = np.isfinite(size) & (size > 0)
                    keys = b.column(0).to_numpy()[ok]
                    if len(keys):
                        found += [(keys[row], hub_ids[place], sims) for row, place, sims in best_two(x[ok] / size[ok, None], centres, narrow, lengths)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["post_id", "h", "s"])

        parts.append(lean.where(F.size("v") == dim).mapInArrow(run, schema))

    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    for row in usable.mapInArrow(packed, "ids binary, vectors binary, lengths binary").toLocalIterator():  # at most HUB_BLOCK hubs and one batch are held
        ids.append(np.frombuffer(row.ids, np.int64))
        vectors.append(np.frombuffer(row.vectors, kind).reshape(-1, dim))
        lengths.append(np.frombuffer(row.lengths, np.float64))
        if sum(map(len, ids)) >= HUB_BLOCK:
            block(ids, vectors, lengths)
            ids, vectors, lengths = [], [], []
    if ids:
        block(ids, vectors, lengths)
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.union(p)
    best = found.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct((-F.round("s", 12)).alias("o"), "h", "s"))).alias("t"))  # two rows a block
    ranked = best.select("post_id", F.col("t")[0]["h"].alias("event_id"), F.col("t")[0]["s"].alias("sim"), F.get("t", F.lit(1))["h"].alias("runner_id"), F.get("t", F.lit(1))["s"].alias("runner_sim"))
    return lean.select("post_id").join(ranked, "post_id", "left")


def decision(sim: Column, runner: Column, threshold: float | Column = DEFAULT.assign_threshold, cfg: Config = DEFAULT) -> Column:
    """assigned / candidate / unassigned."""
    sure = (sim >= threshold) & (runner.isNull() | (sim - runner >= cfg.similarity_margin))
    return F.when(sim.isNull(), "unassigned").when(sure, "assigned").when(sim >= cfg.candidate_threshold, "candidate").otherwise("unassigned")


def reason(sim: Column, runner: Column, status: Column, threshold: float | Column = DEFAULT.assign_threshold, cfg: Config = DEFAULT) -> Column:
    return (
        F.when(status == "assigned", "confident_assign").when(sim.isNull() | (sim < cfg.candidate_threshold), "below_candidate_floor")
        .when((sim >= threshold) & runner.isNotNull() & (sim - runner < cfg.similarity_margin), "margin_fail").otherwise("below_threshold")
    )


def margin(sim: Column, runner: Column, threshold: float | Column = DEFAULT.assign_threshold) -> Column:
    """Lead over the runner-up, or over the threshold where there is none; 4 decimals."""
    return F.round(sim - F.coalesce(runner, threshold if isinstance(threshold, Column) else F.lit(threshold)), 4)


def hub_identity(posts: DataFrame) -> DataFrame:
    """`(event_id, tokens)`: the identity tokens named by the live posts of each hub."""
    live = posts.where("deleted_at is null and event_id is not null").select("event_id", F.explode(identity_tokens(F.col("entities"))).alias("token"))
    return live.distinct().groupBy("event_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))


def assign(matches: DataFrame, post_entities: DataFrame, identity: DataFrame, threshold: float = DEFAULT.assign_threshold, cfg: Config = DEFAULT) -> DataFrame:
    """The decision with tie-break and veto: `(post_id, status, event_id, confidence, reason, margin)`.

    A candidate whose tokens meet exactly one of its two hubs is assigned there; an assigned post whose tokens conflict
    with its hub's becomes a candidate without hub. `post_entities(post_id, entities)`, `identity(event_id, tokens)`.
    """
    none = F.array().cast("array<string>")
    rows = (
        matches.join(post_entities.select("post_id", identity_tokens(F.col("entities")).alias("mine")), "post_id", "left")
        .join(identity.withColumnsRenamed({"tokens": "best_tokens"}), "event_id", "left")
        .join(identity.select(F.col("event_id").alias("runner_id"), F.col("tokens").alias("runner_tokens")), "runner_id", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("mine", "best_tokens", "runner_tokens")})
    )
    sim, runner = F.col("sim"), F.col("runner_sim")
    rows = rows.withColumn("first", decision(sim, runner, threshold, cfg))
    with_best, with_runner = F.arrays_overlap("mine", "best_tokens"), F.arrays_overlap("mine", "runner_tokens")
    tie = (F.col("first") == "candidate") & (sim >= cfg.tiebreak_sim) & F.col("runner_id").isNotNull() & (with_best != with_runner)
    rows = rows.withColumns({"tie": tie, "hub": F.when(tie & with_runner, F.col("runner_id")).otherwise(F.col("event_id")), "conf": F.when(tie & with_runner, runner).otherwise(sim)})
    assigned = (F.col("first") == "assigned") | F.col("tie")
    theirs = F.when(F.col("hub") == F.col("runner_id"), F.col("runner_tokens")).otherwise(F.col("best_tokens"))
    veto = assigned & entities_conflict(F.col("mine"), theirs)
    status = F.when(veto, "candidate").when(assigned, "assigned").otherwise(F.col("first"))
    why = F.when(veto, "entity_conflict").when(F.col("tie"), "entity_tiebreak").otherwise(reason(sim, runner, F.col("first"), threshold, cfg))
    return rows.select("post_id", status.alias("status"), F.when(assigned & ~veto, F.col("hub")).alias("event_id"), F.col("conf").alias("confidence"), why.alias("reason"), margin(sim, runner, threshold).alias("margin"))
