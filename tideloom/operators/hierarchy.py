"""Parent-child links to full hierarchies: nested-set ranges, paths, depths, roots and rings.

Subtree sizes are computed upward and preorder ranges downward, both by doubling the step length, so the rounds grow
with the logarithm of the depth, not with the depth. After the last round the nodes whose pointer still leads somewhere
are exactly those on a ring or leading into one. Paths are built on the way down, for the others only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.runtime import cut, drop_cut


def nested_sets(links: DataFrame, node: str = "id", parent: str = "parent_id", order_buckets: int = 64, max_rounds: int = 40) -> DataFrame:
    """`links(node, parent)` -> `(node, parent, root, depth, path, size, left_at, right_at, on_ring)`.

    - a null parent, or one that names no node, makes the node a root (depth 0);
    - `path` lists the nodes from the root down to the node, `size` counts the node and all below it;
    - all descendants of `n` are the nodes of the same root with `left_at` in (n.left_at, n.right_at];
    - nodes on a ring or leading into one have `on_ring` true, root and depth -1, and null path, size and range;
    - repeated rows count once; of two parents for one node the smaller counts; null nodes are dropped; an empty table
      gives an empty result; other columns, whatever their names, are ignored.
    """
    raw = links.select(F.col(node).cast("long").alias("n"), F.col(parent).cast("long").alias("p")).where("n is not null")
    raw = cut(raw.groupBy("n").agg(F.min("p").alias("p")))
    ids = raw.select(F.col("n").alias("p"))
    base = raw.where("p is not null").join(ids, "p", "left_semi")
    # `jump` is the ancestor 2^k steps up (null beyond the root); `below` counts the descendants fewer than 2^k steps down.
    state = cut(
        raw.select("n").join(base, "n", "left").select("n", F.col("p").alias("parent"), F.col("p").alias("jump"), F.lit(1).cast("long").alias("below"),
            F.when(F.col("p").isNull(), F.col("n")).alias("root"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    )
    live = None
    for _ in range(max_rounds):
        now = state.where("jump is not null").count()
        if now == 0 or now == live:
            break
        live = now
        up = state.select(F.col("n").alias("jump"), F.col("jump").alias("j2"), F.col("root").alias("r2"), F.col("steps").alias("s2"))
        gained = state.where("jump is not null").groupBy(F.col("jump").alias("n")).agg(F.sum("below").alias("more"))
        after = (
            state.join(up, "jump", "left").join(gained, "n", "left")
            .select("n", "parent", F.col("j2").alias("jump"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"),
                F.coalesce("root", "r2").alias("root"),
                F.when(F.col("jump").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("s2")).alias("steps"))
        )
        after = cut(after)
        drop_cut(state)
        state = after
    rings = state.where("jump is not null").select("n", "parent")
    tree = state.where("jump is null").select("n", "parent", "root", F.col("steps").alias("depth"), F.col("below").alias("size"))
    left = preorder(tree, order_buckets, max_rounds)
    done = tree.join(left, "n").select(
        F.col("n").alias(node), F.col("parent").alias(parent), F.col("root").alias("root"), F.col("depth").cast("long"), "path", "size",
        F.col("left_at"), (F.col("left_at") + F.col("size") - 1).alias("right_at"), F.lit(False).alias("on_ring"))
    minus, none = F.lit(-1).cast("long"), F.lit(None).cast("long")
    bad = rings.select(F.col("n").alias(node), F.col("parent").alias(parent), minus.alias("root"), minus.alias("depth"), F.lit(None).cast("array<long>").alias("path"),
        none.alias("size"), none.alias("left_at"), none.alias("right_at"), F.lit(True).alias("on_ring"))
    return done.unionByName(bad)


def preorder(tree: DataFrame, buckets: int, max_rounds: int) -> DataFrame:
    """`tree(n, parent, size)` -> `(n, left_at, path)`: preorder position under the node's root, the root at 1, and the path.

    A child's offset is 1 plus the sizes of its earlier siblings. Siblings are summed in two levels (within an id
    bucket, then over the bucket totals), so the children of one huge parent are spread over `buckets` tasks.
    """
    cuts = tree.where("parent is not null").approxQuantile("n", [i / buckets for i in range(1, buckets)], 0.01) if buckets > 1 else []
    points = sorted(set(cuts))
    kids = tree.where("parent is not null").withColumn("b", F.size(F.filter(F.array(*[F.lit(float(x)) for x in points]), lambda x: x < F.col("n"))) if points else F.lit(0))
    inside = Window.partitionBy("parent", "b").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    totals = kids.groupBy("parent", "b").agg(F.sum("size").alias("t"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("t").over(Window.partitionBy("parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    kids = kids.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, ["parent", "b"])
    state = cut(
        kids.select("n", F.col("parent").alias("jump"), (F.col("within") + F.col("ahead") + 1).alias("left_at"), F.array("n").alias("path"))
        .unionByName(tree.where("parent is null").select("n", F.lit(None).cast("long").alias("jump"), F.lit(1).cast("long").alias("left_at"), F.array("n").alias("path")))
    )
    for _ in range(max_rounds):
        if state.where("jump is not null").isEmpty():
            break
        up = state.select(F.col("n").alias("jump"), F.col("jump").alias("j2"), F.col("left_at").alias("l2"), F.col("path").alias("p2"))
        path = F.when(F.col("jump").isNull(), F.col("path")).otherwise(F.concat("p2", "path"))
        after = cut(state.join(up, "jump", "left").select("n", F.col("j2").alias("jump"), (F.col("left_at") + F.coalesce("l2", F.lit(0))).alias("left_at"), path.alias("path")))
        drop_cut(state)
        state = after
    return state.select("n", "left_at", "path")


def ancestor_pairs(sets: DataFrame, node: str = "id") -> DataFrame:
    """All `(ancestor_id, descendant_id, steps)` read off nested-set paths; ring nodes have none."""
    return (
        sets.where("not on_ring and depth > 0")
        .select(F.col(node).alias("descendant_id"), F.col("depth").alias("d"), F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"))
        .select("ancestor_id", "descendant_id", (F.col("d") - F.col("at")).cast("long").alias("steps"))
    )
