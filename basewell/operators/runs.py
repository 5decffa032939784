"""Runs of equal bases, motifs, tandem repeats and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import col, in_blocks, let, rate, reverse_complement
from basewell.operators.ordered import running

def run_array(seq: Column | str, least: int = 2) -> Column:
    """Runs of at least ``least`` equal bases as array<struct<start, end, base>>: start 0-based, end exclusive.

    The runs are cut out by one expression and what lies between them by its complement; their lengths, added up, say
    where each begins, so shorter runs cost nothing.
    """
    pattern = "|".join(f"{c}{{{least},}}" for c in "ACGT")

    def sized(text: Column) -> Column:
        one = lambda r, gap: F.struct(F.length(gap).alias("gap"), F.length(r).alias("n"), F.substring(r, 1, 1).alias("base"))
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, F.slice(F.split(text, pattern), F.lit(1), F.size(found)), one))

    begins = lambda blocks: F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + x["gap"] + x["n"])), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"],
    )

    def place(block: Column, begin: Column) -> Column:
        one = lambda s, x: F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), x["base"].alias("base"))
        start = F.struct(begin.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,base:string>>)").alias("out"))
        return F.aggregate(block, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(s["out"], one(s, x)).alias("out")), lambda s: s["out"])

    return let(in_blocks(let(col(seq), sized)), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), place)))


def base_runs(df: DataFrame, seq: str, keep: list[str], least: int = 2) -> DataFrame:
    """One row for each run of at least ``least`` equal bases: start, end, base. Nothing is exploded to bases and nothing is shuffled."""
    return df.select(*keep, F.inline(run_array(seq, least)))


def run_histogram(df: DataFrame, seq: str, by: list[str] | None = None) -> DataFrame:
    """Number of runs by length and base, with a total over the bases. Runs are counted as strings, not as places."""
    by = by or []
    runs = df.select(*by, F.explode(F.regexp_extract_all(F.col(seq), F.lit("A+|C+|G+|T+"), F.lit(0))).alias("run"))
    first = F.substring("run", 1, 1)
    return runs.groupBy(*by, F.length("run").alias("length")).agg(*[F.count_if(first == b).alias(b) for b in "ACGT"], F.count(F.lit(1)).alias("total"))


def motif_contexts(df: DataFrame, seq: str, motif: str, before: int = 6) -> DataFrame:
    """(context, n): the bases before each occurrence, overlapping ones included, padded with N at a read's start."""
    text = F.concat(F.lit("N" * before), F.col(seq))
    contexts = F.regexp_extract_all(text, F.lit(f"(?=(.{{{before}}}){motif})"), F.lit(1))
    found = df.where(F.col(seq).contains(motif)).select(F.explode(contexts).alias("context"))
    return found.groupBy("context").agg(F.count(F.lit(1)).alias("n"))


def repeat_share(df: DataFrame, seq: str, units: dict[int, int]) -> DataFrame:
    """Adds ``repeat_bases``: bases in tandem repeats of a unit of k bases, at least units[k] times; overlaps count once.

    Each unit length's repeats are blanked out by one expression; a base that any of them blanks counts.
    """
    masks = []
    for k, times in units.items():
        marked = F.regexp_replace(F.col(seq), rf"(.{{{k}}})\1{{{times - 1},}}", "<$0>")
        masks.append(F.split(marked, "[<>]"))

    def places(parts: Column) -> Column:
        """Intervals of every second part."""
        step = F.aggregate(
            F.zip_with(parts, F.sequence(F.lit(0), F.size(parts) - 1), lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out")),
            lambda s, x: F.struct((s["at"] + F.length(x["p"])).alias("at"), F.when(x["i"] % 2 == 1, F.array_append(s["out"], F.struct(s["at"].alias("a"), (s["at"] + F.length(x["p"])).alias("b")))).otherwise(s["out"]).alias("out")),
        )
        return step["out"]

    every = F.array_sort(F.concat(*map(places, masks)))
    union = F.aggregate(
        every, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
    )["n"]
    return df.withColumn("repeat_bases", union)


#: Places of a tile of a coordinate.
TILE = 1 << 16


def _tile(at: str) -> Column:
    return F.floor(F.col(at) / TILE)


def _reached(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The farthest end for each start of a group, with ``reach``: the farthest end of all smaller starts.

    Starts are unique then, so a tile holds at most TILE rows; what earlier tiles reach is carried from tile to tile.
    """
    ends = df.groupBy(*by, start).agg(F.max(end).alias(end)).withColumn("tile", _tile(start))
    return running(ends, by, [start], "tile", reach={"reach": F.col(end)})


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching half-open intervals of a group."""
    fresh = _reached(df, by, start, end).withColumn("fresh", F.coalesce(F.col(start) > F.col("reach"), F.lit(True)).cast("int"))
    marked = running(fresh, by, [start], "tile", sums={"island": F.col("fresh")})
    return marked.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What lies between the intervals of a group, merged or not: from the farthest end so far to a start beyond it."""
    return _reached(df, by, start, end).where(F.col(start) > F.col("reach")).select(*by, F.col("reach").alias("gap_start"), F.col(start).alias("gap_end"))


def depth_profile(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Stretches of equal depth > 0 by a sweep over starts and ends, tile by tile.

    What a tile takes over, the depth before it and the first place behind it, is a row of its own that opens the tile, so
    places are dealt out by tile once and joined with nothing.
    """
    events = df.select(*by, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))))
    summed = events.groupBy(*by, "at").agg(F.sum("step").alias("step")).withColumn("tile", _tile("at"))
    across = Window.partitionBy(*by).orderBy("tile")
    before = F.sum("step").over(across.rowsBetween(Window.unboundedPreceding, -1))
    tiles = summed.groupBy(*by, "tile").agg(F.sum("step").alias("step"), F.min("at").alias("at"))
    opened = tiles.select(*by, "tile", F.lit(None).cast(summed.schema["at"].dataType).alias("at"), F.coalesce(before, F.lit(0)).alias("step"), F.lead("at").over(across).alias("behind"), F.lit(0).alias("kind"))
    both = summed.select(*by, "tile", "at", "step", F.lit(None).cast(summed.schema["at"].dataType).alias("behind"), F.lit(1).alias("kind")).unionByName(opened)
    along = Window.partitionBy(*by, "tile").orderBy("kind", "at")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.select(*by, "at", "kind", F.sum("step").over(upto).alias("depth"), F.coalesce(F.lead("at").over(along), F.first("behind").over(upto)).alias("b"))
    return swept.where("kind = 1 and depth > 0").select(*by, F.col("at").alias("a"), "b", "depth")


def kmers(seq: Column, k: int) -> Column:
    """Distinct k-mers of a sequence; none where it is shorter."""
    return F.array_distinct(F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1)))


def folds_back(seq: Column | str, k: int = 11) -> Column:
    """Share of the k-mers of a read's first half that its second half, reverse-complemented, has too: near 1 for a self-complementary read."""
    seq = col(seq)
    half = F.floor(F.length(seq) / 2).cast("int")
    head, tail = kmers(F.substring(seq, F.lit(1), half), k), kmers(reverse_complement(F.substring(seq, half + 1, F.length(seq))), k)
    return rate(F.size(F.array_intersect(head, tail)), F.size(head))


def joined_to_itself(seq: Column | str, k: int = 11) -> Column:
    """The same for a read whose halves repeat each other on one strand."""
    seq = col(seq)
    half = F.floor(F.length(seq) / 2).cast("int")
    head, tail = kmers(F.substring(seq, F.lit(1), half), k), kmers(F.substring(seq, half + 1, F.length(seq)), k)
    return rate(F.size(F.array_intersect(head, tail)), F.size(head))
