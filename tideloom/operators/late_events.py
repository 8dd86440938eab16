"""Per-period aggregates by event time, corrected while late records are admitted and closed at a cut-off.

The aggregates live in a finger B-tree: a B-tree whose inner nodes hold the partial aggregate of all below them, with a
finger on the newest leaf. Records arrive in order of receipt; a record near the newest period starts at the finger, a
late one climbs only as far as needed and updates the partials on its way (logarithmic in its distance), and the
cut-off drops whole subtrees of closed periods.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ON_TIME, AMENDS, REFUSED = "on_time", "amends", "refused"


class _Node:
    __slots__ = ("keys", "kids", "vals", "sums", "up")

    def __init__(self, leaf: bool, up: _Node | None = None) -> None:
        self.keys: list[int] = []  # leaf: periods; inner: smallest period of each child
        self.kids: list[_Node] | None = None if leaf else []
        self.vals: list[list[float]] = []  # leaf: one aggregate per period
        self.sums = [0, 0, 0.0]  # on time, amended, sum of values
        self.up = up


class FingerBTree:
    """Partial aggregates `[on_time, amended, value]` by integer period; `order` is the most keys of a node."""

    def __init__(self, order: int = 16) -> None:
        self.order = max(4, order)
        self.root = self.finger = _Node(True)
        self.floor = None  # periods up to here are closed

    def add(self, period: int, slot: int, value: float = 0.0) -> bool:
        """Count one record in `period`; False if that period has been evicted."""
        if self.floor is not None and period <= self.floor:
            return False
        leaf = self._leaf(period)
        at = bisect_left(leaf.keys, period)
        fresh = at == len(leaf.keys) or leaf.keys[at] != period
        if fresh:
            leaf.keys.insert(at, period)
            leaf.vals.insert(at, [0, 0, 0.0])
        leaf.vals[at][slot] += 1
        leaf.vals[at][2] += value
        node = leaf
        while node is not None:
            node.sums[slot] += 1
            node.sums[2] += value
            node = node.up
        if fresh:
            if at == 0:
                self._lower(leaf)
            if len(leaf.keys) > self.order:
                self._split(leaf)
        return True

    def evict(self, floor: int) -> Iterator[tuple[int, int, int, float]]:
        """Close all periods up to `floor`: whole subtrees are cut off the left edge; yields their aggregates."""
        if self.floor is not None and floor <= self.floor:
            return
        self.floor = floor
        node = self.root
        dropped: list[_Node] = []
        while node.kids is not None:
            gone = bisect_right(node.keys, floor) - 1  # the child at `gone` may hold both sides of the floor
            if gone > 0:
                for kid in node.kids[:gone]:
                    dropped.append(kid)
                    self._less(node, kid.sums)
                del node.kids[:gone], node.keys[:gone]
            if not node.kids:
                break
            node = node.kids[0]
        for kid in dropped:
            yield from self._walk(kid)
        if node.kids is None:
            at = bisect_right(node.keys, floor)
            for key, val in zip(node.keys[:at], node.vals[:at]):
                yield (key, *val)
                self._less(node, val)
            del node.keys[:at], node.vals[:at]

    def total(self, low: int, high: int) -> list[float]:
        """Aggregate of the open periods in [low, high], from the partials of whole subtrees where they fit."""
        out = [0, 0, 0.0]

        def go(node: _Node, bound: int | None) -> None:
            if node.kids is None:
                for key, val in zip(node.keys, node.vals):
                    if low <= key <= high:
                        for i in range(3):
                            out[i] += val[i]
                return
            for i, kid in enumerate(node.kids):
                end = node.keys[i + 1] - 1 if i + 1 < len(node.kids) else bound
                if node.keys[i] > high or (end is not None and end < low):
                    continue
                if low <= node.keys[i] and end is not None and end <= high:
                    for j in range(3):
                        out[j] += kid.sums[j]
                else:
                    go(kid, end)

        go(self.root, None)
        return out

    def __iter__(self) -> Iterator[tuple[int, int, int, float]]:
        return self._walk(self.root)

    def _walk(self, node: _Node) -> Iterator[tuple[int, int, int, float]]:
        if node.kids is None:
            for key, val in zip(node.keys, node.vals):
                yield (key, *val)
        else:
            for kid in node.kids:
                yield from self._walk(kid)

    def _less(self, node: _Node | None, sums: list[float]) -> None:
        while node is not None:
            for i in range(3):
                node.sums[i] -= sums[i]
            node = node.up

    def _leaf(self, period: int) -> _Node:
        """Climb from the finger until the period is covered, then descend."""
        node = self.finger
        while node.up is not None and (not node.keys or period < node.keys[0]):
            node = node.up
        while node.kids is not None:
            node = node.kids[max(0, bisect_right(node.keys, period) - 1)]
        return node

    def _lower(self, node: _Node) -> None:
        while node.up is not None:
            up = node.up
            at = up.kids.index(node)
            up.keys[at] = min(up.keys[at], node.keys[0])
            if at:
                return
            node = up

    def _split(self, node: _Node) -> None:
        while len(node.keys) > self.order:
            half = len(node.keys) // 2
            right = _Node(node.kids is None, node.up)
            right.keys, node.keys = node.keys[half:], node.keys[:half]
            if node.kids is None:
                right.vals, node.vals = node.vals[half:], node.vals[:half]
                if self.finger is node:
                    self.finger = right
                parts = right.vals
            else:
                right.kids, node.kids = node.kids[half:], node.kids[:half]
                for kid in right.kids:
                    kid.up = right
                parts = [kid.sums for kid in right.kids]
            right.sums = [sum(p[i] for p in parts) for i in range(3)]
            node.sums = [node.sums[i] - right.sums[i] for i in range(3)]
            if node.up is None:
                root = _Node(False)
                root.kids, root.keys = [node, right], [node.keys[0], right.keys[0]]
                root.sums = [node.sums[i] + right.sums[i] for i in range(3)]
                node.up = right.up = self.root = root
                return
            up = node.up
            at = up.kids.index(node) + 1
            up.kids.insert(at, right)
            up.keys.insert(at, right.keys[0])
            node = up


def event_time_counts(events: DataFrame, key: str, event_at: str, received_at: str, value: str | None = None, period_s: int = 3600, grace_s: int = 900, cutoff_s: int = 86400, emit: str = "periods") -> DataFrame:
    """Run the tree over `events`, each partition over its own range of periods in order of receipt.

    A record received up to `grace_s` after the end of its period is on time, up to `cutoff_s` after it amends the
    period, later it is refused. `emit="records"` gives `(key, period_start, fate)` for each record, `emit="periods"`
    gives `(period_start, on_time, amended, refused, value)`, one row a period.

    Records without key, event time or time of receipt are no cases; equal times and repeated rows count one by one;
    an empty table gives an empty result; other columns are ignored. Periods are ranged over the partitions together
    with a salt, so that one period with a third of all records is spread over several trees, whose partial aggregates
    add up.
    """
    if emit not in ("records", "periods"):
        raise ValueError("emit is 'records' or 'periods'")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    lean = (
        events.select(F.col(key).cast("long").alias("k"), micros(event_at).alias("e"), micros(received_at).alias("r"), amount.alias("v"))
        .where("k is not null and e is not null and r is not null")
        .withColumn("p", F.floor(F.col("e") / (period_s * 1_000_000)).cast("long"))
    )
    ranged = lean.repartitionByRange(F.col("p"), F.xxhash64("k")).sortWithinPartitions("r", "k")
    schema = "k long, p long, fate string" if emit == "records" else "p long, on_time long, amended long, refused long, v double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, refused = FingerBTree(), {}
        span, grace, cutoff = period_s * 1_000_000, grace_s * 1_000_000, cutoff_s * 1_000_000
        for pdf in batches:
            fates, closed = [], []
            for p, r, v in zip(pdf.p.tolist(), pdf.r.tolist(), pdf.v.tolist()):
                # A period p ends at (p + 1) * span and is closed once r passes that end by more than the cut-off.
                closed.extend(tree.evict(-(-(r - cutoff) // span) - 2))
                late = r > (p + 1) * span + grace
                if tree.add(p, 1 if late else 0, v):
                    fates.append(AMENDS if late else ON_TIME)
                else:
                    refused[p] = refused.get(p, 0) + 1
                    fates.append(REFUSED)
            if emit == "records":
                yield pd.DataFrame({"k": pdf.k, "p": pdf.p, "fate": fates})
            elif closed:
                yield pd.DataFrame([(p, a, b, 0, v) for p, a, b, v in closed], columns=["p", "on_time", "amended", "refused", "v"])
        if emit == "periods":
            rest = [(p, a, b, 0, v) for p, a, b, v in tree] + [(p, 0, 0, n, 0.0) for p, n in refused.items()]
            if rest:
                yield pd.DataFrame(rest, columns=["p", "on_time", "amended", "refused", "v"])

    start = F.timestamp_micros(F.col("p") * F.lit(period_s * 1_000_000)).alias("period_start")
    out = ranged.mapInPandas(run, schema)
    if emit == "records":
        return out.select(F.col("k").alias(key), start, "fate")
    return out.groupBy("p").agg(*[F.sum(c).alias(c) for c in ("on_time", "amended", "refused", "v")]).select(start, "on_time", "amended", "refused", F.col("v").alias("value"))
