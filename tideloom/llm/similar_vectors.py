"""Most similar vectors for every vector: an inverted multi-index.

Each vector is cut into two halves, each half quantised by its own codebook, so a pair of codes names one of K x K
cells. A search visits the cells in order of the summed half distances (a heap over the two sorted lists of codewords)
and reranks the entries of those cells by exact cosine. Equal vectors share one entry; the index is spread over the
first codes, and a search travels only to the first codes it visits, with the vectors in compressed blocks. A first code
with many entries is cut by groups of second codes, so a search still goes only to the groups that hold its cells.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.vectors import Coded, batches_of, blocks, decoded, first_vectors, matrix, pack, unit, unpack, usable
from tideloom.runtime import cut

#: Vectors the codebooks are fitted on, in expectation, or eight times the codes if that is more.
SAMPLE_ROWS = 20_000
#: Entries kept in one task: a first code with more is cut by its second codes, a single cell with more by a salt.
ENTRIES_A_TASK = 20_000
#: Codes a half at most; their products make 16.7 million cells.
MOST_CODES = 4_096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster restarts at a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c)).argmax(axis=1)
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


def multi_sequence(d1: list[float], d2: list[float], cells: int) -> list[tuple[int, int]]:
    """The first `cells` positions (r, s) of two ascending lists by d1[r] + d2[s], from a heap."""
    heap, seen, out = [(d1[0] + d2[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < cells:
        _, r, s = heapq.heappop(heap)
        out.append((r, s))
        if r + 1 < len(d1) and (s == 0 or (r + 1, s - 1) in seen) and (r + 1, s) not in seen:
            seen.add((r + 1, s))
            heapq.heappush(heap, (d1[r + 1] + d2[s], r + 1, s))
        if s + 1 < len(d2) and (r, s + 1) not in seen:
            seen.add((r, s + 1))
            heapq.heappush(heap, (d1[r] + d2[s + 1], r, s + 1))
    return out


class Codebooks:
    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left, right
        self.half = left.shape[1]

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared half distances less the rows' own norms (equal for all codewords of a row)."""
        a, b = u[:, : self.half], u[:, self.half :]
        return (np.einsum("ij,ij->i", self.left, self.left) - 2 * a @ self.left.T, np.einsum("ij,ij->i", self.right, self.right) - 2 * b @ self.right.T)

    def visits(self, d1: np.ndarray, d2: np.ndarray, cells: int, lists: int) -> Iterator[list[tuple[int, int]]]:
        """For each row the (first, second) codes of the cells it visits, at most `lists` different codes a half."""
        m1, m2 = min(lists, d1.shape[1]), min(max(lists, 8), d2.shape[1])
        t1 = np.argpartition(d1, m1 - 1, axis=1)[:, :m1]
        t2 = np.argpartition(d2, m2 - 1, axis=1)[:, :m2]
        v1, v2 = np.take_along_axis(d1, t1, 1), np.take_along_axis(d2, t2, 1)
        o1, o2 = v1.argsort(axis=1), v2.argsort(axis=1)
        t1, t2 = np.take_along_axis(t1, o1, 1).tolist(), np.take_along_axis(t2, o2, 1).tolist()
        v1, v2 = np.take_along_axis(v1, o1, 1).tolist(), np.take_along_axis(v2, o2, 1).tolist()
        for c1, c2, x1, x2 in zip(t1, t2, v1, v2):
            yield [(c1[r], c2[s]) for r, s in multi_sequence(x1, x2, cells)]


def fit(vectors: DataFrame, vector: str, dim: int, key: str, rows: int, codes: int | None = None, seed: int = 7) -> Codebooks:
    """Codebooks from about `SAMPLE_ROWS` rows chosen by the hash of the key; they alone meet in one task for the fit.

    The number of codes grows with the rows, so that one first code keeps some 16,000 of them at most, and is small for few.
    """
    if codes is None:
        codes = 1
        while codes < MOST_CODES and (rows / codes > 16_000 or (codes < 256 and rows / codes > 64)):
            codes *= 2

    def train(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [usable(matrix(b.column(0), dim))[1] for b in stream if b.num_rows]
        x = np.concatenate(held) if held else np.zeros((0, dim), np.float32)
        if len(x):
            left, right = kmeans(x[:, : dim // 2], codes, 8, seed), kmeans(x[:, dim // 2 :], codes, 8, seed + 1)
            yield pa.RecordBatch.from_arrays([pa.array([pack(left, right)], pa.binary())], names=["books"])

    every = max(1, rows // max(SAMPLE_ROWS, 8 * codes))
    sample = vectors.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(vector)
    got = sample.repartition(1).mapInArrow(train, "books binary").collect()  # two codebooks
    if not got:
        return Codebooks(np.zeros((1, dim // 2), np.float32), np.zeros((1, dim - dim // 2), np.float32))
    return Codebooks(*unpack(got[0].books))


def _above(h: np.ndarray, u: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (query, entry, cosine) of the visited cells with cosine at least `floor`; a query visits a cell once."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for entries, askers in spans:
        for lo in range(0, len(askers), 4096):
            qs = askers[lo : lo + 4096]
            s = u[qs] @ u[entries].T
            a, b = np.nonzero(s >= floor - 1e-6)
            other = h[qs[a]] != h[entries[b]]
            parts.append((h[qs[a]][other], h[entries[b]][other], s[a, b][other]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _best(h: np.ndarray, u: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best (query, entry, cosine) of each query, kept as a running list while the cells are visited."""
    askers = np.unique(np.concatenate([x for _, x in spans])) if spans else np.zeros(0, np.int64)
    row = np.full(len(h), -1)
    row[askers] = np.arange(len(askers))
    sims, ids = np.full((len(askers), k), -9.0, np.float32), np.full((len(askers), k), -1)
    for entries, visitors in spans:
        for lo in range(0, len(visitors), 4096):
            qs = visitors[lo : lo + 4096]
            s = u[qs] @ u[entries].T
            at = row[qs]
            hopeful = s.max(axis=1) >= sims[at].min(axis=1)  # most queries have better ones than a later cell's
            qs, s, at = qs[hopeful], s[hopeful], at[hopeful]
            if not len(qs):
                continue
            if s.shape[1] > k + 1:  # one more than k, as a query's own entry may be among them
                top = np.argpartition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1 :]
                new, who = np.take_along_axis(s, top, 1), entries[top]
            else:
                new, who = s, np.broadcast_to(entries, s.shape)
            new = np.where(h[who] == h[qs][:, None], np.float32(-9.0), new)
            both, names = np.concatenate([sims[at], new], axis=1), np.concatenate([ids[at], who], axis=1)
            top = np.argpartition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            sims[at], ids[at] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
    a, b = np.nonzero(sims > -2)
    return h[askers[a]], h[ids[a, b]], sims[a, b]


def search(entries: DataFrame, dim: int, books: Codebooks, k: int, min_sim: float | None, cells: int, lists: int) -> DataFrame:
    """`entries(h long, v array<float>, q boolean)` -> `(hq, hp, sim)`: for each entry with q its best others found.

    At most `k` a query and task, with cosine at least `min_sim` if given; pairs found from either side count for both
    where both are queries.
    """
    spark = entries.sparkSession
    sent = spark.sparkContext.broadcast(books)
    floor = -2.0 if min_sim is None else float(min_sim)

    width = len(books.left)
    tall = len(books.right)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for b in stream:
            if b.num_rows:
                _, u = usable(matrix(b.column(0), dim))
                d1, d2 = sent.value.distances(u)
                for cell, n in zip(*np.unique(d1.argmin(axis=1) * tall + d2.argmin(axis=1), return_counts=True)):
                    total[int(cell)] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    cells_n = cut(entries.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    groups = np.ones(width, np.int64)
    for r in cells_n.groupBy(F.floor(F.col("cell") / tall).alias("code")).agg(F.sum("n").alias("n")).collect():  # one row a first code
        groups[r.code] = min(tall, max(1, -(-r.n // ENTRIES_A_TASK)))
    full: dict[int, tuple[int, int]] = {}
    at = width * tall
    for r in cells_n.where(F.col("n") > ENTRIES_A_TASK).orderBy("cell").collect():  # fewer than all entries / ENTRIES_A_TASK
        parts = -(-r.n // ENTRIES_A_TASK)
        full[r.cell] = (at, parts)
        at += parts
    splits = spark.sparkContext.broadcast((groups, full))

    def route(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        groups, full = splits.value
        for b in batches_of(stream, 12_000):
            x = matrix(b.column(1), dim)
            ok, u = usable(x)
            if not len(u):
                continue
            x, h, q = x[ok], b.column(0).to_numpy()[ok], b.column(2).to_numpy(zero_copy_only=False).astype(bool)[ok]
            _, first = np.unique(h, return_index=True)
            if len(first) < len(h):  # equal vectors of this batch travel once
                asked = set(h[q].tolist())
                x, u, h = x[first], u[first], h[first]
                q = np.array([y in asked for y in h.tolist()])
            d1, d2 = books.distances(u)
            home1, home2 = d1.argmin(axis=1), d2.argmin(axis=1)
            rows: dict[int, dict[int, list[int]]] = defaultdict(dict)  # block -> row -> second codes visited
            home: dict[int, dict[int, int]] = defaultdict(dict)
            of = groups.tolist()
            for i, (a, c, key) in enumerate(zip(home1.tolist(), home2.tolist(), h.tolist())):
                start, parts = full.get(a * tall + c, (0, 0))
                home[start + key % parts if parts else a + width * (c % of[a])][i] = c
            asks = np.nonzero(q)[0]
            for i, visited in zip(asks.tolist(), books.visits(d1[asks], d2[asks], cells, lists)):
                for a, c in visited:
                    start, parts = full.get(a * tall + c, (0, 0))
                    for block in range(start, start + parts) if parts else (a + width * (c % of[a]),):
                        rows[block].setdefault(i, []).append(c)
            coded = Coded(x)
            keys, packed = [], []
            for block in sorted(set(rows) | set(home)):
                at = sorted(set(rows[block]) | set(home[block]))
                second = np.array([home[block].get(i, -1) for i in at], np.int16)
                lengths = np.array([len(rows[block].get(i, ())) for i in at], np.int16)
                codes = np.array([c for i in at for c in rows[block].get(i, ())], np.int16)
                keys.append(block)
                packed.append(pack(h[at], second, lengths, codes, *coded.rows(at)))
            yield blocks(keys, packed)

    def rerank(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table.column("block").to_pylist()]
        h, second, lengths, codes = (np.concatenate([p[j] for p in parts]) for j in range(4))
        u = np.concatenate([unit(decoded(p[4:])) for p in parts])
        del parts
        places = np.nonzero(second >= 0)[0]
        _, once = np.unique(h[places], return_index=True)
        places = places[once]
        places = places[np.argsort(second[places], kind="stable")]
        of = second[places]
        owner = np.repeat(np.arange(len(h)), lengths)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        spans = [(places[np.searchsorted(of, c) : np.searchsorted(of, c, "right")], owner[np.searchsorted(codes, c) : np.searchsorted(codes, c, "right")]) for c in np.unique(of).tolist()]
        hq, hp, sim = _above(h, u, spans, floor) if min_sim is not None else _best(h, u, spans, k)
        order = np.lexsort((hp, -sim, hq))
        hq, hp, sim = hq[order], hp[order], sim[order]
        at = np.arange(len(hq))
        fresh = np.ones(len(hq), bool)
        fresh[1:] = hq[1:] != hq[:-1]
        keep = at - np.maximum.accumulate(np.where(fresh, at, 0)) < k if len(hq) else fresh
        return pa.table({"hq": pa.array(hq[keep], pa.int64()), "hp": pa.array(hp[keep], pa.int64()), "sim": pa.array(sim[keep].astype(np.float64))})

    spread = entries.select("h", "v", "q").mapInArrow(route, "block_key long, block binary")
    return spread.groupBy("block_key").applyInArrow(rerank, "hq long, hp long, sim double")


def most_similar(rows: DataFrame, key: str, vector: str, dim: int, k: int = 10, min_sim: float | None = None, order: str | None = None, queries: str | None = None, cells: int = 24, lists: int = 4, codes: int | None = None) -> DataFrame:
    """`(key, other_id, sim, rank)`: the `k` most similar other rows of each row, as far as the index finds them.

    `queries` is a condition on the key that names the rows to search for (all by default); every row is indexed. Ties
    go to the smaller key; equal vectors have similarity 1 and each counts as a neighbour. `min_sim` leaves out pairs
    below it. Rows with null keys or unusable vectors (null, not `dim` long, all zero, not finite) take no part; of a
    repeated key the row first in `order` counts; an empty table gives an empty result; other columns are ignored.
    """
    base = first_vectors(rows, key, vector, dim, order)
    hashed = base.select(F.col(key).cast("long").alias("id"), F.xxhash64(vector).alias("h"), F.col(vector).alias("v"))
    n = rows.count()
    ask = F.expr(queries) if queries else F.lit(True)
    entries = hashed.withColumn("q", ask).select("h", "v", "q")
    books = fit(hashed, "v", dim, "id", n, codes)
    near = search(entries, dim, books, k + 1, min_sim, cells, lists)
    if queries is None:
        near = near.union(near.select(F.col("hp").alias("hq"), F.col("hq").alias("hp"), "sim"))
    near = cut(near.groupBy("hq", "hp").agg(F.max("sim").alias("sim")))
    finite = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    members = hashed.where(finite).select("id", "h").distinct()
    by_h = Window.partitionBy("h").orderBy("id")
    sample = members.withColumn("r", F.row_number().over(by_h)).where(F.col("r") <= k + 1).drop("r")
    many = sample.join(sample.groupBy("h").count().where("count > 1").select("h"), "h", "left_semi")
    others = near.join(sample, near.hp == sample.h).select(F.col("hq").alias("h"), F.col("id").alias("other_id"), "sim").union(many.select("h", F.col("id").alias("other_id"), F.lit(1.0).alias("sim")))
    best = others.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("sim"), "other_id"))).where(F.col("r") <= k + 1).drop("r")
    asked = members.where(F.expr(queries)) if queries else members
    pairs = asked.join(best, "h").where("id <> other_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "other_id", F.least("sim", F.lit(1.0)).alias("sim"), F.col("rank").cast("long").alias("rank"))
