"""Joins of read tables: whitelists, pairs, ranges, renumbering. None assumes that a side is small; Spark broadcasts what it knows to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import rate
from basewell.operators.ordered import last_mark


def keep_listed(df: DataFrame, key: Column | str, listed: DataFrame, listed_key: Column | str) -> DataFrame:
    """Rows whose key is in the other table."""
    return _listed(df, key, listed, listed_key, "left_semi")


def drop_listed(df: DataFrame, key: Column | str, listed: DataFrame, listed_key: Column | str) -> DataFrame:
    return _listed(df, key, listed, listed_key, "left_anti")


def _listed(df: DataFrame, key: Column | str, listed: DataFrame, listed_key: Column | str, how: str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    names = listed.select((F.col(listed_key) if isinstance(listed_key, str) else listed_key).alias("listed_key")).distinct()
    return df.withColumn("own_key", key).join(names, F.col("own_key") == F.col("listed_key"), how).drop("own_key")


def join_all(frames: list[DataFrame | None], key: str) -> DataFrame:
    """Inner join of all frames that are there; other columns get their frame's number as suffix."""
    out = None
    for n, frame in enumerate(frames):
        if frame is None:
            continue
        named = frame.withColumnsRenamed({c: f"{c}_{n}" for c in frame.columns if c != key})
        out = named if out is None else out.join(named, key)
    if out is None:
        raise ValueError("no frame to join")
    return out


def single_hits(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("hits", F.count(F.lit(1)).over(Window.partitionBy(key))).where("hits = 1").drop("hits")


def points_in_regions(points: DataFrame, regions: DataFrame, *, name: str, pos: str, start: str, end: str, region_name: str, width: int = 1000, how: str = "left_semi") -> DataFrame:
    """Points inside a half-open region of the same name (or, with ``left_anti``, in none).

    A region is listed under every bin of ``width`` it touches and a point under its own, so this is an equi-join
    with the bounds as a rest condition, whatever the sizes.
    """
    binned = regions.select(F.col(region_name).alias("r_name"), F.col(start).alias("r_start"), F.col(end).alias("r_end"))
    binned = binned.where("r_end > r_start").withColumn("r_bin", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor((F.col("r_end") - 1) / width))))
    inside = (F.col(name) == F.col("r_name")) & (F.floor(F.col(pos) / width) == F.col("r_bin")) & (F.col(pos) >= F.col("r_start")) & (F.col(pos) < F.col("r_end"))
    return points.join(binned, inside, how)


def numbered(df: DataFrame, order: list[str], name: str = "new_id", start: int = 0) -> DataFrame:
    """Dense numbers in the order of distinct keys, without bringing all rows to one task.

    The keys are range-partitioned; numbers within a partition are moved by the sizes of those before it, a table
    with a row for each partition.
    """
    keys = df.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keys.withColumns({"part": F.spark_partition_id(), "serial": F.monotonically_increasing_id()})
    placed = placed.withColumn("serial", F.col("serial") - F.shiftleft(F.col("part").cast("long"), 33))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before.select("part", "offset"), "part").select(*order, (F.col("serial") + F.col("offset") + start).alias(name))


def newest_below(values: DataFrame, steps: DataFrame, *, value: str, step: str, result: str, default: float) -> DataFrame:
    """For each value the result of the largest step at or below it, else the default; of equal steps the largest result counts."""
    marks = steps.groupBy(F.col(step).alias(value)).agg(F.max(result).cast("double").alias(result))
    return last_mark(values, marks, [], value, result).withColumn(result, F.coalesce(result, F.lit(default)))


def compare_runs(a: DataFrame, b: DataFrame, key: str, *, value: str = "concordance", passes: str | None = None, least_passes: float = 0, span: str | None = None) -> DataFrame:
    """One row: keys of both runs, how many are better, worse and equal in the first, and shares.

    Only keys of more passes than least_passes in the first run count, and, where span is given, only those of the same span in both.
    """
    right = b.select(key, F.col(value).alias("__value"), *([F.col(span).alias("__span")] if span else []))
    both = a.join(right, key)
    if passes:
        both = both.where(F.col(passes) > least_passes)
    if span:
        both = both.where(F.col(span) == F.col("__span"))
    n, better, worse = F.count(F.lit(1)), F.count_if(F.col(value) > F.col("__value")), F.count_if(F.col(value) < F.col("__value"))
    return both.agg(n.alias("channels"), better.alias("better"), worse.alias("worse"), (n - better - worse).alias("equal"), rate(better, n).alias("better_share"), rate(worse, n).alias("worse_share"))
