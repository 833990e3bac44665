"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the smallest node of its component, for every node that has an edge.

    Rounds go on until nothing changes, and are about as many as the logarithm of the number of nodes;
    each is written to the shared folder, so its lineage is short, and the one before it is deleted.
    Loops and repeated edges do no harm; an empty table gives no rows.
    """
    links = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "components")
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("label")).distinct()
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: neighbours above u are tied to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large, before = materialize(large, "components"), links
        # small star: u and its lower neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = materialize(small.distinct(), "components")
        discard(before, large)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    known = nodes.unionByName(roots)
    return known.unionByName(alone.join(known, "node", "left_anti"))
