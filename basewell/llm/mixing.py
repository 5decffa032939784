"""Mixing sources to target weights along a curriculum.

Each source has a weight that varies with training time t in [0, 1], given by points between which it is linear.
Integrated over time and scaled to the source's target, the weight gives the words that the source has to supply up
to t (its cumulative demand). A source's documents stand in a fixed pseudo-random order, whole epochs one after the
other; the place of a document's first word on that tape, put into the inverse of the demand, is its training
position. Range-sorting by position gives the training order.

Targets follow the sources' mean weights and stop at ``max_epochs`` times a source's size; what a stopped source
can't take is shared among the others by weight until none is above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.llm.common import WORD

#: Documents of a source are ordered within so many slices of their hash, so that no task holds a whole source.
SLICES = 1024
#: Curriculum used unless another is given, as fixed values: the factor on a source's weight at t = 0, 0.5 and 1, for
#: weights of 5, 2 and 1. Each integrates to 1, so the mean weight is the weight itself.
SHAPES = {5: (0.5, 1.0, 1.5), 2: (1.0, 1.0, 1.0), 1: (1.5, 1.0, 0.5)}
WEIGHTS = (5, 2, 1)


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source_col: str) -> Column:
    """Never null, and sorted like the source with null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """Hexadecimal digest that orders a source's documents. The text is in it, so rows of one id, or of none, are spread like others."""
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text).cast("binary"))


def mean_factor(shape: tuple[float, float, float]) -> float:
    """Integral of a shape over the whole training time."""
    return (shape[0] + 2 * shape[1] + shape[2]) / 4


def targets(sizes: DataFrame, budget: Column, max_epochs: float, weights: tuple[float, ...] = WEIGHTS, shapes: dict[float, tuple[float, float, float]] | None = None) -> DataFrame:
    """sizes (source_key, source_size), one row for each source, with ``weight`` and ``target``. A target follows the weight integrated along its shape.

    The level is found in closed form: sources sorted by cap / weight are filled up one after the other, and the rest
    of the budget over the rest of the weights is the level once the next cap is not below it.
    """
    by_key, by_ratio = Window.orderBy("source_key"), Window.orderBy("ratio", "source_key")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_key) - 1) % len(weights) + 1))
    means = F.element_at(F.array(*[F.lit(float(w) * mean_factor((shapes or {}).get(w, (1.0, 1.0, 1.0)))) for w in weights]), (F.row_number().over(by_key) - 1) % len(weights) + 1)
    ranked = ranked.withColumn("mean", means).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("mean"))
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("open_weight", F.sum("mean").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (budget - F.col("filled")) / F.col("open_weight"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(whole)["level"]
    return ranked.select("source_key", "source_size", "weight", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("mean"))).alias("target"))


def inverse_demand(share: Column, shape: Column) -> Column:
    """Time at which the given share of a source's demand is reached. shape: its factors at t = 0, 0.5 and 1."""
    total = (shape[0] + 2 * shape[1] + shape[2]) / 4
    first = (shape[0] + shape[1]) / 4
    wanted = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * total

    def solve(start: Column, end: Column, area: Column) -> Column:
        """Within a half: start*x + (end-start)*x^2 = area."""
        bend = end - start
        root = F.sqrt(F.greatest(start * start + 4 * bend * area, F.lit(0.0)))
        return F.when(start + root <= 0, F.lit(0.0)).otherwise(2 * area / (start + root))

    return F.when(wanted <= first, solve(shape[0], shape[1], wanted)).otherwise(0.5 + solve(shape[1], shape[2], wanted - first))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.5, max_epochs: int = 2, weights: tuple[float, ...] = WEIGHTS,
    shapes: dict[float, tuple[float, float, float]] | None = None, seed: int = 0, keep: bool = False,
) -> DataFrame:
    """One row for each document: size, source_size, target, taken, and ``positions``, one for each copy it enters with.

    With ``keep`` the document itself comes along as the struct ``whole``.

    The mix takes a source's tape up to its target and cuts the last document there, so a source supplies its target
    to the word (rounded down). Null texts have no words and a null source is a source of its own, the last. A
    document without words is in the mix with nothing. Repeated rows count as documents of their own, whatever ids
    they share or lack.

    A source's tape is cut into slices of its documents' hash. Slice totals, at most SLICES for each source, give
    where each slice begins; within a slice a window adds up the documents. A source that holds a third of all rows is
    so spread over SLICES groups.
    """
    shapes = SHAPES if shapes is None else shapes
    whole = [F.struct("*").alias("whole")] if keep else []
    sized = docs.select(F.col(id_col).alias("doc_id"), _key(source_col).alias("source_key"), word_count(text_col).alias("size"), _order(id_col, text_col, seed).alias("turn"), F.xxhash64(text_col).alias("tie"), *whole)
    # Documents without words take no room, so any slice will do for them; they may be very many of one kind.
    spread = F.when(F.col("size") > 0, F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")).otherwise(F.monotonically_increasing_id())
    sized = sized.withColumn("slice", spread % SLICES)
    per_slice = sized.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    along = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("slice_begin", F.coalesce(F.sum("slice_size").over(along), F.lit(0)))
    sizes = per_slice.groupBy("source_key").agg(F.sum("slice_size").alias("source_size"))
    aims = targets(sizes, budget_share * F.sum("source_size").over(Window.partitionBy()), max_epochs, weights, shapes)
    begins = per_slice.join(aims, "source_key").drop("slice_size")

    within = Window.partitionBy("source_key", "slice").orderBy("turn", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("slice_at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begins, ["source_key", "slice"])
    placed = placed.withColumn("begin", F.col("slice_begin") + F.col("slice_at"))
    room = F.floor("target").cast("long")
    shape = F.create_map(*[x for w, s in shapes.items() for x in (F.lit(float(w)), F.array(*[F.lit(float(v)) for v in s]))])
    shape = F.coalesce(shape[F.col("weight")], F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    epochs = F.transform(F.array(*[F.lit(e) for e in range(max_epochs)]), lambda e: e * F.col("source_size") + F.col("begin"))
    took = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room - e * F.col("source_size") - F.col("begin"))) for e in range(max_epochs)]
    copies = F.filter(epochs, lambda at: (at < room) & (F.col("size") > 0))
    positions = F.transform(copies, lambda at: inverse_demand(at / F.col("target"), shape))
    taken = sum(took[1:], took[0])
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"), *(["whole"] if keep else []))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy, range-sorted by training position; ties by id and copy."""
    each = mixed.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return each.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its nth word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
