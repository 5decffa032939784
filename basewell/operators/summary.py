"""Summaries of reads and read groups: counts, lengths, N50, shares and their tall form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import rate
from basewell.operators.ordered import distribution, in_parts, quantiles_of, running, same_group, with_quantiles

PERCENTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def metric_table(wide: DataFrame) -> DataFrame:
    """A one-row frame as (name, value)."""
    doubles = wide.select([F.col(c).cast("double").alias(c) for c in wide.columns])
    return doubles.unpivot([], doubles.columns, "name", "value")


def with_defaults(metrics: DataFrame, names: list[str]) -> DataFrame:
    """The metric table with every name, 0 where it has no value, as for an empty input."""
    spark = metrics.sparkSession
    return spark.createDataFrame([(n,) for n in names], "name string").join(metrics, "name", "left").select("name", F.coalesce("value", F.lit(0.0)).alias("value"))


def n50(df: DataFrame, length: str, share: float = 0.5) -> DataFrame:
    """Length at which the longest reads together hold the share of all bases: one row.

    Lengths are counted first, so the one task that adds up sees a row for each different length only.
    """
    return _n50_of(df.groupBy(F.col(length).alias("length")).agg((F.count(F.lit(1)) * F.first(length)).alias("bases")), share)


def _n50_of(lengths: DataFrame, share: float = 0.5) -> DataFrame:
    """The same from a row (length, bases) for each different length."""
    order = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lengths.withColumns({"reached": F.sum("bases").over(order), "total": F.sum("bases").over(Window.partitionBy())})
    return summed.where(F.col("reached") >= share * F.col("total")).agg(F.max("length").alias("n50"))


def read_summary(df: DataFrame, *, length: str = "n", quality: str = "q", thresholds: tuple[int, ...] = (8, 10, 15, 20, 30)) -> DataFrame:
    """(name, value): reads, bases, lengths, reads at or above each quality, N50. The reads are passed over once; all comes from how often each value occurs."""
    found = distribution(df.withColumn("__one", F.lit(1)), [], ["__one", length, quality])
    n, v = F.col("n"), F.col("v")
    size, q = lambda x: found.of(length, x), lambda x: F.coalesce(found.of(quality, x), F.lit(0))
    wide = found.table.agg(
        F.coalesce(F.sum(found.of("__one", n)), F.lit(0)).alias("reads"), F.sum(size(v * n)).alias("bases"), rate(F.sum(size(v * n)), F.sum(size(n))).alias("mean_length"), F.min(size(v)).alias("min_length"),
        F.max(size(v)).alias("max_length"), *[F.coalesce(F.sum(q(F.when(v >= t, n).otherwise(0))), F.lit(0)).alias(f"reads_q{t}") for t in thresholds],
    )
    wide = same_group(wide, quantiles_of(found, {f"p{int(100 * p)}_length": (length, p) for p in (0.25, 0.5, 0.75)}), [])
    lengths = found.table.where(F.col("m") == found.columns.index(length)).select(v.alias("length"), (v * n).alias("bases"))
    return metric_table(wide).unionByName(metric_table(_n50_of(lengths)))


def with_percentile_text(out: DataFrame, df: DataFrame, by: list[str], value: str, name: str, points: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """out, one row for each group of df, with the group's percentiles as whole numbers, comma-joined."""
    found = with_quantiles(out, df, by, {f"__q{i}": (value, p) for i, p in enumerate(points)})
    text = F.concat_ws(", ", *[F.round(f"__q{i}").cast("long").cast("string") for i in range(len(points))])
    return found.select(*out.columns, text.alias(name))


def share_of(df: DataFrame, by: list[str], count: str = "n", within: list[str] | None = None) -> DataFrame:
    """Rows by key with their share of all rows, or of those of the same ``within`` key."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count))
    return counted.withColumn("ratio", rate(count, F.sum(count).over(Window.partitionBy(*(within or [])))))


def by_passes(df: DataFrame, *, passes: str = "np", quality: str = "q", length: str = "n", thresholds: tuple[int, ...] = (20, 30)) -> DataFrame:
    """One row for each number of passes: count and its share, quality and length quantiles, shares at or above each quality."""
    found = distribution(df.withColumn("__one", F.lit(1)), [passes], ["__one", quality, length])
    n, v = F.col("n"), F.col("v")
    q, size = lambda x: found.of(quality, x), lambda x: found.of(length, x)
    out = found.table.groupBy(passes).agg(
        F.sum(found.of("__one", n)).alias("reads"), *[F.round(rate(F.sum(q(F.when(v >= t, n).otherwise(0))), F.sum(q(n))), 9).alias(f"share_q{t}") for t in thresholds],
        F.round(rate(F.sum(size(v * n)), F.sum(size(n))), 6).alias("mean_length"), F.max(size(v)).cast("long").alias("max_length"),
    )
    points = {f"q_p{int(100 * p)}": (quality, p) for p in (0.0, 0.05, 0.25, 0.5, 1.0)}
    out = same_group(out, quantiles_of(found, points | {"median_length": (length, 0.5)}), [passes]).withColumns({n: F.round(n, 6) for n in points})
    return out.withColumn("ratio", F.round(F.col("reads") / F.sum("reads").over(Window.partitionBy()), 9))


def channel_subreads(df: DataFrame, *, channel: str = "ch", kind: str = "cx", length: str = "n", full: int = 3) -> DataFrame:
    """One row for each channel: passes (full-length subreads), bases, median and mean full length."""
    is_full = F.col(kind) == full
    out = df.groupBy(channel).agg(
        F.count_if(is_full).alias("passes"), F.sum(length).alias("bases"), F.coalesce(F.sum(F.when(is_full, F.col(length))), F.lit(0)).alias("full_bases"),
        F.round(F.avg(F.when(is_full, F.col(length))), 6).alias("mean_full"),
    )
    return with_quantiles(out, df.where(is_full), [channel], {"median_full": (length, 0.5)})


def gap_report(df: DataFrame, segments: str, gaps: str, k: int = 20) -> DataFrame:
    """(name, value): reads of several segments and their share, the k most common gaps between segments with their shares, and the total of these.

    gaps is a comma-joined list whose first entry lies before the first segment; of equally common gaps the smaller counts.
    """
    many = F.col(segments) > 1
    share = df.agg(F.count_if(many).cast("double").alias("[segs>1]Cnt"), F.avg(many.cast("double")).alias("[segs>1]Ratio"))
    inner = F.slice(F.split(gaps, ","), F.lit(2), F.col(segments).cast("int") - 1)
    counted = df.where(many).select(F.explode(inner).alias("gap")).groupBy(F.col("gap").cast("long").alias("gap")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("all"))  # one row
    top = counted.orderBy(F.desc("n"), "gap").limit(k).join(F.broadcast(whole), F.lit(True)).select("gap", rate("n", "all").alias("ratio"))
    rows = top.select(F.concat(F.lit("[segs>1]gap="), "gap").alias("name"), F.col("ratio").alias("value"))
    return share.unpivot([], share.columns, "name", "value").unionByName(top.agg(F.sum("ratio").alias("value")).select(F.lit(f"[segs>1]gapTop{k}Ratio").alias("name"), "value")).unionByName(rows)


def log_summary(log: DataFrame) -> DataFrame:
    """One row for each metric of a log (metric, epoch, step, value): granularity, steps, epochs, extremes, mean and last value.

    A metric is of ``epoch`` granularity if most epochs have one value: one is the most common number of values of an epoch
    (of equally common ones the smallest), and more than four fifths of the epochs have it. Null values don't count there.
    """
    epochs = log.where(F.col("value").isNotNull() & F.col("epoch").isNotNull()).groupBy("metric", "epoch").agg(F.count(F.lit(1)).alias("n"))
    sizes = epochs.groupBy("metric", "n").agg(F.count(F.lit(1)).alias("k"))
    single = (F.min_by("n", F.struct(-F.col("k"), "n")) == 1) & (rate(F.sum(F.when(F.col("n") == 1, F.col("k")).otherwise(0)), F.sum("k")) > 0.8)
    grain = sizes.groupBy("metric").agg(F.when(single, "epoch").otherwise("step").alias("granularity"), F.sum("k").alias("epochs"))
    out = log.groupBy("metric").agg(F.max("step").alias("steps"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.max_by("value", "step").alias("final"))
    return same_group(out, grain, ["metric"]).select("metric", F.coalesce("granularity", F.lit("step")).alias("granularity"), "steps", F.coalesce("epochs", F.lit(0)).alias("epochs"), "least", "most", "mean", "final")


def arrival_groups(df: DataFrame, order: str, channel: str, *, least: int = 3, length: str = "n") -> DataFrame:
    """Stretches of consecutive rows of one channel, in the order of arrival: their first place, channel, rows and median length, from ``least`` rows on.

    A channel that comes back later is another stretch. Places must be unique. The order is cut into parts; what a
    part's first row follows is carried over from the part before.
    """
    parts = in_parts(df.select(order, channel, length), [], [order])
    follows = running(parts, [], [order], "part", before={"last": F.col(channel)})
    fresh = follows.withColumn("fresh", (~F.col("last").eqNullSafe(F.col(channel)) | F.col("last").isNull()).cast("int"))
    marked = running(fresh, [], [order], "part", sums={"stretch": F.col("fresh")})
    out = marked.groupBy("stretch").agg(F.min(order).alias(order), F.first(channel).alias(channel), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)
    return with_quantiles(out, marked, ["stretch"], {f"median_{length}": (length, 0.5)}).drop("stretch")


def adjacent_groups(df: DataFrame, channel: str, order: list[str]) -> DataFrame:
    """(channel, adjacent): whether a channel's rows stand next to each other where the rows are numbered by channel and order.

    Rows are counted on from partition to partition of the sort, since a channel may begin in one and end in another.
    """
    key = [channel, *order]
    placed = running(in_parts(df.select(*key), [], key), [], key, "part", sums={"place": F.lit(1)})
    return placed.groupBy(channel).agg((F.max("place") - F.min("place") + 1 == F.count(F.lit(1))).alias("adjacent"))


def first_channels(df: DataFrame, order: str, channel: str, n: int) -> DataFrame:
    """All rows of the n channels that arrive first, whenever the rows come. Rows without a channel are left out."""
    firsts = df.where(F.col(channel).isNotNull()).groupBy(channel).agg(F.min(order).alias("__first")).orderBy("__first", channel).limit(n)
    return df.join(firsts.select(channel), channel, "left_semi")


def at_least(df: DataFrame, value: str, thresholds: list[float], name: str = "threshold") -> DataFrame:
    """Each row once for every threshold that its value reaches; all thresholds in one pass."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(value) >= t)
    return df.withColumn(name, F.explode(reached))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Smallest value with at least half of the weight at or below it."""
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumns({"reached": F.sum(weight).over(order), "whole": F.sum(weight).over(Window.partitionBy(*by))})
    return summed.where(2 * F.col("reached") >= F.col("whole")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def survival(df: DataFrame, by: list[str], order: str, ratio: str = "ratio") -> DataFrame:
    """1 - the ratios of all smaller values."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("survival", 1 - F.coalesce(F.sum(ratio).over(before), F.lit(0.0)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, or of all."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), in the order of a digest of the key: the same rows at every run and partitioning."""
    return df.withColumn("turn", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary"))).orderBy("turn").limit(n).drop("turn")


#: Letters that are counted at a time, and places of a read that are counted together.
LETTERS, PLACES = 1 << 23, 1 << 12


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts in a row, and how many each text has."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.sum(pc.binary_length(texts)).as_py() != sizes.sum():
        return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), sizes
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], sizes


def _counts(letters: np.ndarray, sizes: np.ndarray, bins: int | None) -> Iterator[pa.RecordBatch]:
    """Letters by place and quality. All reads are walked side by side, PLACES places at a time, so a long read widens no table of counts."""
    starts, width = np.cumsum(sizes) - sizes, int(letters.max(initial=0)) + 1
    found = [np.empty((3, 0), np.int64)]
    for first in range(0, int(sizes.max(initial=0)), PLACES):
        here = np.flatnonzero(sizes > first)
        n = np.minimum(sizes[here] - first, PLACES)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first
        letter = letters[np.repeat(starts[here], n) + place]
        if bins is not None:
            place = place * bins // np.repeat(sizes[here], n)
        low = place.min()
        code = (place - low) * width + letter
        if code.max() < code.size:
            counted = np.bincount(code)
            code = np.flatnonzero(counted)
            n = counted[code]
        else:
            code, n = np.unique(code, return_counts=True)
        found.append(np.stack([code // width + low, code % width - 33, n]))
    yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), ["pos", "q", "n"])


def _letter_counts(bins: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).drop_null().cast(pa.large_string())
            # A piece ends with the text that fills it.
            filled = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // LETTERS
            cuts = [0, *np.flatnonzero(np.diff(filled)) + 1, len(texts)]
            for a, b in pairwise(cuts):
                yield from _counts(*_letters(texts.slice(a, b - a)), bins)

    return run


def _quality_counts(df: DataFrame, qual: str, bins: int | None) -> DataFrame:
    """(pos, q, n): letters are counted in each task, piece by piece, and only counts are rows."""
    counted = df.select(F.col(qual).alias("qual")).mapInArrow(_letter_counts(bins), "pos long, q long, n long")
    return counted.groupBy("pos", "q").agg(F.sum("n").alias("n"))


def quality_heat_map(df: DataFrame, qual: str, bins: int) -> DataFrame:
    """(bin, q, n): bases by their place in the read, scaled to bins, and quality."""
    return _quality_counts(df, qual, bins).withColumnRenamed("pos", "bin")


def quality_by_position(df: DataFrame, qual: str) -> DataFrame:
    """(pos, q, n): bases by their 0-based place in the read and quality."""
    return _quality_counts(df, qual, None)
