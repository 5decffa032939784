"""Reference sequences in tiles, so that no row, array or task has a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.operators.runs import run_array

SIZE = 1 << 14
#: A run of one base at the start or end of a tile.
_LEAD, _TAIL = "^(A+|C+|G+|T+)", "(A+|C+|G+|T+)$"


def reference_tiles(refs: DataFrame, name: str = "refname", seq: str = "rseq", size: int = SIZE, halo: int = 10) -> DataFrame:
    """(name, tile, begin, text, left, right): pieces of each sequence with up to halo bases of what lies beside them. An empty or null sequence has none.

    The sequence is cut in one pass; a later step sees a tile and its halo only. A tile is no shorter than the halo.
    """
    if size < halo:
        raise ValueError("a tile must have at least the bases of the halo")
    parts = refs.select(F.col(name), F.regexp_extract_all(F.coalesce(seq, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("parts"))
    near = lambda i: F.coalesce(F.get("parts", i), F.lit(""))

    def piece(text: Column, i: Column) -> Column:
        return F.struct(i.alias("tile"), (i.cast("long") * size).alias("begin"), text.alias("text"), F.right(near(i - 1), F.lit(halo)).alias("left"), F.left(near(i + 1), F.lit(halo)).alias("right"))

    return parts.select(name, F.inline(F.transform("parts", piece)))


def reference_runs(refs: DataFrame, name: str = "refname", seq: str = "rseq", least: int = 2, size: int = SIZE) -> DataFrame:
    """(name, start, end, base): runs of at least ``least`` equal bases of each sequence.

    Runs inside a tile are complete. Those at a tile's edges are joined over as many tiles as they go on, in a window
    over one or two rows for each tile.
    """
    tiles = reference_tiles(refs, name, seq, size, 0).select(name, "begin", "text", F.length("text").alias("n"))
    inner = tiles.select(name, "begin", "n", F.inline(run_array("text", least))).where("start > 0 and end < n")
    inner = inner.select(name, (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("end")).alias("end"), "base")
    lead, tail = F.regexp_extract("text", _LEAD, 1), F.regexp_extract("text", _TAIL, 1)
    edge = lambda start, text: F.struct(start.alias("start"), (start + F.length(text)).alias("end"), F.left(text, F.lit(1)).alias("base"))
    first, last = edge(F.col("begin"), lead), edge(F.col("begin") + F.col("n") - F.length(tail), tail)
    edges = tiles.select(name, F.inline(F.when(F.length(lead) == F.col("n"), F.array(first)).otherwise(F.array(first, last)))).where("base <> ''")
    order = Window.partitionBy(name).orderBy("start")
    goes_on = (F.lag("end").over(order) == F.col("start")) & (F.lag("base").over(order) == F.col("base"))
    marked = edges.withColumn("fresh", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = marked.groupBy(name, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("base").alias("base")).drop("island")
    return inner.unionByName(joined.where(F.col("end") - F.col("start") >= least))
