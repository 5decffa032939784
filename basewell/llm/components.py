"""Connected components by alternating large and small stars, each a group and a join; the written edges end the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewell.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node of an edge the smallest node that it is connected with, itself included.

    Self-loops count as a node on its own, null ends are left out, repeated edges are as one. A star with very many
    rays has a hot centre: minima are pre-aggregated, and the join on the centre is one that adaptive execution splits.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = ends.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    stars = materialize(ends.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        discard(stars)
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(nearest, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        stars = materialize(moved.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct())
        discard(large)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = found.select(F.col("label").alias("node"), "label").distinct()
    alone = loops.join(found.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("label"))
    return found.unionByName(roots).unionByName(alone)
