"""Per-base arrays of reads: kinetics by base, head and tail statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import rate
from basewell.operators.ordered import same_group, with_quantiles

BASES = "ACGT"


def base_table(df: DataFrame, *, name: str = "qname", seq: str = "seq", arrays: tuple[str, ...] = ("dw", "ar")) -> DataFrame:
    """(name, base, base_cnt, sums): four rows for each read, whatever bases it has; other characters are ignored."""
    letters = F.filter(F.split(F.col(seq), ""), lambda c: c != "")
    each = df.select(name, F.explode(F.arrays_zip(letters.alias("base"), *[F.col(a) for a in arrays])).alias("x")).select(name, "x.*")
    counted = each.where(F.col("base").isin(*BASES)).groupBy(name, "base").agg(F.count(F.lit(1)).alias("base_cnt"), *[F.sum(a).alias(f"{a}_sum") for a in arrays])
    every = df.select(name, F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    return every.join(counted, [name, "base"], "left").fillna(0, ["base_cnt", *[f"{a}_sum" for a in arrays]])


def array_mean(x: Column) -> Column:
    return rate(F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double")), F.size(x))


def array_median(x: Column) -> Column:
    """Mean of the two middle values; null for an empty array."""
    ordered, n = F.array_sort(x), F.size(x)
    middle = lambda i: F.try_element_at(ordered, i.cast("int")).cast("double")
    return (middle(F.floor((n + 1) / 2)) + middle(F.floor((n + 2) / 2))) / 2


def head(x: Column, n: int) -> Column:
    """Values 1..n-1: the first one is left out."""
    return F.slice(x, F.lit(2), F.greatest(F.least(F.size(x), F.lit(n)) - 1, F.lit(0)))


def tail(x: Column, n: int) -> Column:
    """The last n values, never the first one."""
    begin = F.greatest(F.size(x) - n, F.lit(1))
    return F.slice(x, begin + 1, F.greatest(F.size(x) - begin, F.lit(0)))


def ends_table(df: DataFrame, columns: list[str], n: int, keep: list[str]) -> DataFrame:
    """Median and mean of the first and last n values of each array."""
    out = [f(part(F.col(c), n)).alias(f"{c}_{where}_{what}") for c in columns for where, part in (("first", head), ("last", tail)) for what, f in (("median", array_median), ("mean", array_mean))]
    return df.select(*keep, *out)


def run_kinetics(df: DataFrame, by: list[str], *, seq: str = "seq", dwell: str = "dw", arrival: str = "ar", capture: str = "cr", quality: str = "cq", evidence: str = "oe") -> DataFrame:
    """(by, name, value): means over the bases of each run, in ms for dwell and arrival times (two a tick), overall and by base; means and medians over its reads; bases a second.

    A read without an array counts -1 for each of its bases, one without a value -1. Bases are counted by base where
    they are read; the medians are found by rank over all reads, so neither needs a run in one task.
    """
    letters = F.filter(F.split(F.col(seq), ""), lambda c: c != "")
    missing = F.array_repeat(F.lit(-1.0), F.length(seq))
    scaled = lambda c, k: F.coalesce(F.transform(F.col(c), lambda v: v.cast("double") * k), missing)
    arrays = F.arrays_zip(letters.alias("base"), scaled(dwell, 2).alias("dw"), scaled(arrival, 2).alias("ar"), scaled(capture, 1).alias("cr"))
    each = df.select(*by, F.inline(arrays)).where("base is not null")
    counted = each.groupBy(*by, "base").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("dw", "ar", "cr")])
    known = [F.sum(F.when(F.col("base") == b, F.col(c)) / F.col("n")).alias(f"{c}-mean-{b}") for c in ("dw", "ar") for b in BASES]
    bases = counted.groupBy(*by).agg(
        *[rate(F.sum(c), F.sum("n")).alias(f"{c}-mean") for c in ("dw", "ar", "cr")], F.when(F.sum(F.col("dw") + F.col("ar")) > 0, F.sum("n") / (F.sum(F.col("dw") + F.col("ar")) * 0.001)).otherwise(0.0).alias("speed"), *known
    )
    reads = df.select(*by, F.coalesce(F.col(quality).cast("double"), F.lit(-1.0)).alias("cq"), F.coalesce(F.col(evidence).cast("double"), F.lit(-1.0)).alias("oe"), F.length(seq).alias("length"))
    per_read = with_quantiles(reads.groupBy(*by).agg(F.avg("cq").alias("cq-mean")), reads, by, {"oe-median": ("oe", 0.5), "readlen-median": ("length", 0.5)})
    wide = same_group(per_read, bases, by)
    names = [c for c in wide.columns if c not in by]
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias("value")) for n in names])).alias("x")).select(*by, "x.*")


def sampled_channels(df: DataFrame, by: list[str], k: int = 5000, seed: int = 0, *, name: str = "qname", seq: str = "seq", dwell: str = "dw", arrival: str = "ar", salts: int = 256) -> DataFrame:
    """The k reads of each run with the smallest digest of their name: mean dwell and arrival time in ms (-1 without an array) and length.

    A bottom-k sample: that of a union is that of the samples. Each of ``salts`` shares of a run gives its k first, and
    these are ranked again, so the last task of a run sees k rows a share at most.
    """
    mean = lambda c: F.coalesce(2 * array_mean(F.col(c)), F.lit(-1.0))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(name)).cast("binary"))
    rows = df.select(*by, name, mean(dwell).alias("dw"), mean(arrival).alias("ar"), F.length(seq).alias("length"), turn.alias("turn"), F.pmod(F.xxhash64(name), F.lit(salts)).alias("salt"))
    for within in ([*by, "salt"], by):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("turn", name))).where(F.col("place") <= k).drop("place")
    return rows.drop("turn", "salt")


def speed(bases: Column, ticks: Column, tick_seconds: float = 0.002) -> Column:
    return rate(bases, ticks * tick_seconds)
