"""Grouping records into similarity clusters: cluster-feature trees, Ward agglomeration, one assignment pass, exact links.

1. Each partition condenses its vectors into a tree of at most `max_leaves` cluster features (count, sum, squared sum), a
   row joining the nearest leaf entry of its branch within a similarity or opening its own; beyond the bound the lightest
   entries give way, as in BIRCH's outlier option (their rows are still assigned in step 3).
2. The leaves of all partitions are reduced in a tree of tasks, by the same rule, to one bounded set; in the last task
   Ward's criterion agglomerates leaves of the same dense region into anchors.
3. One pass assigns every row to its nearest anchors.
4. Rows of one anchor are linked by exact cosine; the links' components are joined through the rows they share.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.vectors import Coded, batches_of, blocks, decoded, first_vectors, matrix, pack, unit, unpack, usable
from tideloom.operators.graph import connected_components
from tideloom.runtime import cut

#: Rows of one anchor handled in one task; an anchor with more is cut into parts. Its dense core, the rows linked to one
#: of a few connected pivots, needs no further links among itself and stays in its own part; every other row visits all.
ROWS_A_TASK = 30_000
#: Rows sampled as pivots of a split anchor, in expectation.
PIVOTS = 48


class CFTree:
    """A cluster-feature tree: leaf entries (count, sum, sum of squared norms) under inner entries that carry their sums.

    A row descends to the nearest inner entry and there joins the nearest leaf entry, if their similarity is at least
    `near`, or opens its own. An inner entry with more than `fan` leaf entries splits by its two least similar ones.
    Rows come in batches, so each step is a matrix product. Features are additive: `add` takes those of other trees.
    """

    def __init__(self, dim: int, near: float, max_leaves: int, fan: int = 128) -> None:
        self.near, self.max_leaves, self.fan = near, max_leaves, fan
        self.sums = np.zeros((0, dim), np.float32)
        self.n = np.zeros(0, np.float64)
        self.squares = np.zeros(0, np.float64)
        self.branch = np.zeros(0, np.int64)
        self.tops = np.zeros((0, dim), np.float32)

    def add(self, sums: np.ndarray, n: np.ndarray, squares: np.ndarray) -> None:
        """Insert features (for single rows the unit vector, 1 and 1)."""
        for lo in range(0, len(sums), 1024):
            self._add(sums[lo : lo + 1024], n[lo : lo + 1024], squares[lo : lo + 1024])
        self._bound()

    def radius(self) -> np.ndarray:
        """Root mean squared distance of each leaf entry's rows from their centroid."""
        mean = self.sums / np.maximum(self.n, 1)[:, None]
        return np.sqrt(np.maximum(self.squares / np.maximum(self.n, 1) - np.einsum("ij,ij->i", mean, mean), 0))

    def _add(self, sums: np.ndarray, n: np.ndarray, squares: np.ndarray) -> None:
        u = unit(sums)
        at = (u @ unit(self.tops).T).argmax(axis=1) if len(self.tops) else np.zeros(len(u), np.int64)
        opened = []
        for top in np.unique(at).tolist():
            mine = np.nonzero(at == top)[0]
            own = np.nonzero(self.branch == top)[0]
            if len(own):
                s = u[mine] @ unit(self.sums[own]).T
                best = s.argmax(axis=1)
                hit = s[np.arange(len(mine)), best] >= self.near
                to = own[best[hit]]
                np.add.at(self.sums, to, sums[mine[hit]])
                np.add.at(self.n, to, n[mine[hit]])
                np.add.at(self.squares, to, squares[mine[hit]])
                mine = mine[~hit]
            if len(mine):
                opened.append((top, mine))
        for top, mine in opened:
            self._open(top, u[mine], sums[mine], n[mine], squares[mine])
        self._totals()
        for top in np.nonzero(np.bincount(self.branch, minlength=len(self.tops)) > self.fan)[0].tolist():
            self._split(top)
        if len(self.n) > 2 * self.max_leaves:
            self._bound()

    def _open(self, top: int, u: np.ndarray, sums: np.ndarray, n: np.ndarray, squares: np.ndarray) -> None:
        s = u @ u.T >= self.near
        leader = np.full(len(u), -1)
        for i in np.argsort(-n, kind="stable"):
            if leader[i] < 0:
                leader[s[i] & (leader < 0)] = i
                leader[i] = i
        heads, back = np.unique(leader, return_inverse=True)
        new = [np.zeros((len(heads), sums.shape[1]), np.float32), np.zeros(len(heads)), np.zeros(len(heads))]
        for to, x in zip(new, (sums, n, squares)):
            np.add.at(to, back, x)
        self.sums, self.n, self.squares = np.concatenate([self.sums, new[0]]), np.concatenate([self.n, new[1]]), np.concatenate([self.squares, new[2]])
        self.branch = np.concatenate([self.branch, np.full(len(heads), top)])

    def _totals(self) -> None:
        self.tops = np.zeros((int(self.branch.max()) + 1 if len(self.branch) else 0, self.sums.shape[1]), np.float32)
        np.add.at(self.tops, self.branch, self.sums)

    def _split(self, top: int) -> None:
        pending = [top]
        while pending:
            top = pending.pop()
            own = np.nonzero(self.branch == top)[0]
            if len(own) <= self.fan:
                continue
            u = unit(self.sums[own])
            one = int((u @ u[0]).argmin())
            two = int((u @ u[one]).argmin())
            lean = u @ (u[one] - u[two])
            away = own[np.argsort(lean, kind="stable")[: len(own) // 2]] if (lean >= 0).all() or (lean < 0).all() else own[lean < 0]
            new = len(self.tops)
            self.branch[away] = new
            self.tops = np.concatenate([self.tops, self.sums[away].sum(axis=0, keepdims=True)])
            self.tops[top] = self.sums[self.branch == top].sum(axis=0)
            pending += [top, new]

    def _bound(self) -> None:
        if len(self.n) > self.max_leaves:
            keep = np.sort(np.argsort(-self.n, kind="stable")[: self.max_leaves])
            self.sums, self.n, self.squares = self.sums[keep], self.n[keep], self.squares[keep]
            self.branch = np.unique(self.branch[keep], return_inverse=True)[1]
            self._totals()


def ward(sums: np.ndarray, n: np.ndarray, stop: float) -> np.ndarray:
    """Agglomerate features by Ward's criterion while the merged pair's centroids are at least `stop` similar; unit anchors."""
    sums, n = sums.astype(np.float64).copy(), n.astype(np.float64).copy()
    alive = np.ones(len(n), bool)
    c = sums / np.maximum(n, 1e-9)[:, None]
    u = (c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]).astype(np.float32)
    pairs = []
    for lo in range(0, len(u), 1024):
        i, j = np.nonzero(u[lo : lo + 1024] @ u.T >= stop)
        later = j > i + lo
        pairs += zip((i[later] + lo).tolist(), j[later].tolist())
    cost = lambda i, j: n[i] * n[j] / (n[i] + n[j]) * float(((c[i] - c[j]) ** 2).sum())
    import heapq

    version = np.zeros(len(n), int)
    heap = [(cost(i, j), int(i), int(j), 0, 0) for i, j in pairs]
    heapq.heapify(heap)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj:
            continue
        alive[j] = False
        sums[i] += sums[j]
        n[i] += n[j]
        version[i] += 1
        c[i] = sums[i] / n[i]
        u[i] = c[i] / max(float(np.linalg.norm(c[i])), 1e-12)
        s = u @ u[i]
        for m in np.nonzero((s >= stop) & alive)[0].tolist():
            if m != i:
                a, b = min(i, m), max(i, m)
                heapq.heappush(heap, (cost(a, b), a, b, int(version[a]), int(version[b])))
    return u[alive].astype(np.float32)


def anchors(rows: DataFrame, dim: int, near: float, max_leaves: int, fan_in: int = 8) -> np.ndarray:
    """Steps 1 and 2 over `rows(v)`: unit anchors, at most `max_leaves`."""

    def blob(*parts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(*parts)], pa.binary())], names=["leaves"])

    def condense(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = CFTree(dim, near, max_leaves)
        for b in stream:
            if b.num_rows:
                _, u = usable(matrix(b.column(0), dim))
                tree.add(u, np.ones(len(u)), np.ones(len(u)))
        if len(tree.n):
            yield blob(tree.sums, tree.n, tree.squares)

    leaves = cut(rows.select("v").mapInArrow(condense, "leaves binary"))

    def merge(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = CFTree(dim, near, max_leaves)
            for b in stream:
                for x in b.column(0).to_pylist():
                    tree.add(*unpack(x))
            if len(tree.n):
                yield blob(ward(tree.sums, tree.n, near)) if last else blob(tree.sums, tree.n, tree.squares)

        return run

    n = leaves.count()
    while n > fan_in:
        n = -(-n // fan_in)
        leaves = cut(leaves.repartition(n).mapInArrow(merge(False), "leaves binary"))
    got = leaves.repartition(1).mapInArrow(merge(True), "leaves binary").collect()  # at most fan_in bounded trees meet in the last task, one row of anchors comes back
    return unpack(got[0].leaves)[0] if got else np.zeros((0, dim), np.float32)


def reached(v: np.ndarray, front: np.ndarray, is_open: np.ndarray, least: float, toward: np.ndarray) -> np.ndarray:
    """The open rows of `v` with cosine >= `least` to a row of `front`; they are closed in `is_open`.

    `toward` has the cosine of every row to some direction: two rows can be that near only if their angles to it differ by
    no more than the angle of `least`. The front goes in slices, nearest to the direction first, each against the rows
    within its reach, so with the mean of a dense cluster unrelated rows meet its loose end only.
    """
    front = front[np.argsort(-toward[front], kind="stable")]
    reach = np.arccos(np.clip(least, -1, 1)) + 5e-3  # angles near 0 are off by 1e-3 in single precision
    out = []
    for lo in range(0, len(front), 64):
        part = front[lo : lo + 64]
        widest = np.arccos(np.clip(toward[part[-1]], -1, 1)) + reach
        near = np.nonzero(is_open & (toward >= np.cos(widest)) if widest < np.pi else is_open)[0]
        if not len(near):
            continue
        if 2 * len(near) > len(v):
            hit = np.nonzero((v[part] @ v.T >= least).any(axis=0) & is_open)[0]
        else:
            hit = near[(v[part] @ v[near].T >= least).any(axis=0)]
        is_open[hit] = False
        out.append(hit)
    return np.concatenate([np.zeros(0, np.int64), *out])


def components(u: np.ndarray, least: float) -> np.ndarray:
    """Label of each row's component under cosine >= `least`: breadth first, each row once against those not reached."""
    label = np.full(len(u), -1)
    rest = np.arange(len(u))
    while len(rest):
        v = u[rest] if len(rest) < len(u) else u
        guess = v[:256] @ v.T >= least  # a block of seeds against all that are left
        # Seeds with others to reach and no link to an earlier seed: the mean directions of what they are linked to.
        heads = [i for i in np.nonzero(guess.sum(axis=1) > 1)[0].tolist() if not guess[i, :i].any()]
        means = [v[guess[i]].sum(axis=0, dtype=np.float64) for i in heads]
        toward = dict(zip(heads, unit(np.array(means)) @ v.T if heads else ()))
        is_open = np.ones(len(rest), bool)
        for i in range(len(guess)):
            if not is_open[i]:
                continue
            is_open[i] = False
            label[rest[i]] = rest[i]
            front = np.nonzero(guess[i] & is_open)[0]
            is_open[front] = False
            along = toward.get(i)
            while len(front):
                label[rest[front]] = rest[i]
                if along is None or len(front) > 256:
                    along = v @ unit(v[front].sum(axis=0, dtype=np.float64)[None])[0]
                front = reached(v, front, is_open, least, along)
        rest = rest[is_open]
    return label


def similarity_clusters(rows: DataFrame, key: str, vector: str, dim: int, least: float = 0.62, min_size: int = 8, order: str | None = None, keep: list[str] | None = None, max_leaves: int | None = None, assign: int = 4, where: str | None = None) -> DataFrame:
    """`(key, cluster_id, size, *keep)` for the rows of every cluster of at least `min_size` rows.

    Rows are linked if their cosine similarity is at least `least`; a cluster is what is linked directly or through
    others, named by its smallest key. Rows with null keys or unusable vectors (null, not `dim` long, all zero, not
    finite) take no part; of a repeated key the row first in `order` counts; equal vectors are linked; an empty table
    gives an empty result. `where` is a condition on `keep` that the row of a key must meet. A link can be missed only between rows whose `assign` nearest anchors have none in common.
    """
    spark = rows.sparkSession
    keep = keep or []
    base = first_vectors(rows, key, vector, dim, order, keep)
    if where:
        base = base.where(where)
    lean = base.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    if max_leaves is None:  # so that an anchor's rows stay within a task's reach as the table grows
        max_leaves = min(8_192, max(2_048, rows.count() // 8_000))
    heads = anchors(lean, dim, least, max_leaves)
    sent = spark.sparkContext.broadcast(heads)

    def chosen(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of the assignment pass, in slices that keep the similarity matrix small."""
        heads = sent.value
        if not len(heads):
            return np.arange(len(u)), np.zeros(len(u), np.int64)
        m = min(assign, len(heads))
        rows, found = [], []
        for lo in range(0, len(u), 1024):
            s = u[lo : lo + 1024] @ heads.T
            top = np.argpartition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m :]
            rows.append(np.repeat(np.arange(lo, lo + len(s)), m))
            found.append(top.ravel())
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(max(1, len(sent.value)), np.int64)
        for b in stream:
            if b.num_rows:
                _, u = usable(matrix(b.column(0), dim))
                total += np.bincount(chosen(u)[1], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["a", "n"])

    sizes = np.zeros(max(1, len(heads)), np.int64)
    for r in lean.select("v").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():  # one row an anchor
        sizes[r.a] = r.n
    parts = np.maximum(1, -(-sizes // ROWS_A_TASK))
    splits = spark.sparkContext.broadcast(parts)

    def mixed(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def sample(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.maximum(1, sizes // PIVOTS).astype(np.uint64)
        for b in stream:
            ok, u = usable(matrix(b.column(1), dim))
            ids = b.column(0).to_numpy()[ok]
            r, a = chosen(u)
            take = (parts[a] > 1) & (mixed(ids[r]) % every[a] == 0)
            r, a = r[take], a[take]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[r]), pa.array([pack(x) for x in u[r]], pa.binary())], names=["a", "id", "v"])

    cores: dict[int, tuple[int, np.ndarray]] = {}
    if (parts > 1).any():
        seen: dict[int, list] = defaultdict(list)
        for r in lean.mapInArrow(sample, "a long, id long, v binary").orderBy("a", "id").collect():  # about PIVOTS rows a split anchor
            seen[r.a].append((r.id, unpack(r.v)[0]))
        for a, rows_of in seen.items():
            x = np.array([v for _, v in rows_of])
            label = components(x, least)
            main = label == np.bincount(label).argmax()
            cores[a] = (rows_of[int(np.nonzero(main)[0][0])][0], x[main])
    pivots = spark.sparkContext.broadcast(cores)

    def route(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = splits.value
        width = len(parts)
        for b in batches_of(stream, 12_000):
            x = matrix(b.column(1), dim)
            ok, u = usable(x)
            x, ids = x[ok], b.column(0).to_numpy()[ok]
            if not len(u):
                continue
            r, a = chosen(u)
            part = (mixed(ids[r]) % parts[a].astype(np.uint64)).astype(np.int64)
            core = np.zeros(len(r), bool)
            known: list[tuple[int, int]] = []  # links to the core, proven here
            for at, (root, x_core) in pivots.value.items():
                mine = np.nonzero(a == at)[0]
                if len(mine):
                    core[mine] = (u[r[mine]] @ x_core.T >= least).any(axis=1)
                    known += [(root, int(i)) for i in ids[r[mine[core[mine]]]]]
            copies = np.where(core, 1, parts[a])
            several = np.repeat(np.arange(len(r)), copies)
            turn = np.arange(len(several)) - np.repeat(np.cumsum(copies) - copies, copies)
            block = a[several] + width * np.where(core[several], part[several], turn)
            r = r[several]
            proven = np.array(known, np.int64).reshape(-1, 2)
            by = np.argsort(block, kind="stable")
            r, block = r[by], block[by]
            ends = np.nonzero(np.concatenate([block[1:] != block[:-1], [True]]))[0] + 1
            coded = Coded(x)
            keys, packed, lo = [], [], 0
            for hi in ends.tolist():
                keys.append(int(block[lo]))
                packed.append(pack(proven, ids[r[lo:hi]], *coded.rows(r[lo:hi])))
                proven = proven[:0]
                lo = hi
            yield blocks(keys, packed)

    def link(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table.column("block").to_pylist()]
        proven = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([p[1] for p in parts])
        u = np.concatenate([unit(decoded(p[2:])) for p in parts])
        del parts
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        label = components(u[order], least)
        root = ids[label]
        several = np.bincount(label, minlength=len(ids))[label] > 1
        return pa.table({"src": pa.array(np.concatenate([root[several], proven[:, 0]])), "dst": pa.array(np.concatenate([ids[several], proven[:, 1]]))})

    links = lean.mapInArrow(route, "block_key long, block binary").groupBy("block_key").applyInArrow(link, "src long, dst long")
    found = cut(connected_components(cut(links)))
    big = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    members = found.join(big, "component").select(F.col("id").alias(key), F.col("component").alias("cluster_id"), "size")
    if not keep:
        return members
    # The key's other columns, without the vectors; equal double rows count once.
    extra = base.select(F.col(key).cast("long").alias(key), *keep).dropDuplicates([key])
    return members.join(extra, key)


def describe(rows: DataFrame, members: DataFrame, key: str, vector: str, dim: int, typical: int = 3, order: str | None = None) -> DataFrame:
    """`(cluster_id, size, typical_ids)`: size and the `typical` members nearest to the centroid of each cluster.

    Sums are combined in each task before the shuffle, so one cluster may hold any share of the rows; ties go to the
    smaller key.
    """
    base = first_vectors(rows, key, vector, dim, order).select(F.col(key).cast("long").alias(key), F.col(vector).alias("v"))
    tagged = cut(base.join(members.select(key, "cluster_id", "size"), key))

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(stream, 12_000):
            c = b.column(0).to_numpy()
            _, u = usable(matrix(b.column(1), dim))
            names, at = np.unique(c, return_inverse=True)
            total = np.zeros((len(names), dim))
            np.add.at(total, at, u)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([pack(t) for t in total], pa.binary())], names=["cluster_id", "s"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([unpack(x)[0] for x in table.column("s").to_pylist()], axis=0)
        return pa.table({"cluster_id": table.column("cluster_id")[:1], "centroid": pa.array([unit(total[None])[0].astype(np.float32)], pa.list_(pa.float32()))})

    centres = tagged.select("cluster_id", "v").mapInArrow(sums, "cluster_id long, s binary").groupBy("cluster_id").applyInArrow(add, "cluster_id long, centroid array<float>")
    dot = F.aggregate(F.zip_with("v", "centroid", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    scored = tagged.join(centres, "cluster_id").select("cluster_id", "size", key, (dot / norm).alias("sim"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("sim", 6)), key))).where(F.col("r") <= typical)
    return ranked.groupBy("cluster_id", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("typical_ids"))


def main_label(members: DataFrame, label: str) -> DataFrame:
    """`(cluster_id, main_label)`: the label most rows of a cluster hold, nulls aside; ties go to the smaller label."""
    counts = members.where(F.col(label).isNotNull()).groupBy("cluster_id", label).agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster_id").agg(F.min(F.struct(-F.col("n"), F.col(label).alias("main_label"))).alias("b"))
    return best.select("cluster_id", "b.main_label")
