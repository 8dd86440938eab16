"""Connected components by alternating large-star / small-star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.runtime import cut, drop_cut


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """`edges(src long, dst long)` -> `(id, component)`, `component` the smallest id reached.

    Ids that occur in no edge are not returned; self links and repeated links are harmless. Each round joins nothing
    but pre-aggregates by key, so a hub that holds a third of all links is combined before the shuffle. Rounds grow
    with the logarithm of the diameter; if links still move after `max_rounds`, an error is raised. Null ends are dropped.
    """
    links = (
        edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        .where("src is not null and dst is not null")
        .select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .distinct()
    )
    nodes = links.select(F.col("lo").alias("id")).union(links.select("hi")).distinct()
    links = cut(links.where("lo < hi"))
    nodes = cut(nodes)
    seen = None
    for _ in range(max_rounds):
        # Large star: every neighbour above a node is linked to the node's smallest neighbour.
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to the smallest.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        done = cut(small)
        drop_cut(links)
        links = done
        now = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first()
        if seen == now or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = links.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id")
    return nodes.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
