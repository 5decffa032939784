"""Running values and quantiles over an order of any length, without a window that holds a whole group.

The order is cut into pieces, each known by a column: tiles of a coordinate, or the partitions of a range sort. A
value runs inside its piece, and one row for each piece carries what the earlier pieces hold. So the largest window
has the rows of a piece, or one row for each piece of a group.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.sources.scratch import materialize


def in_parts(df: DataFrame, by: list[str], order: list[str], name: str = "part") -> DataFrame:
    """The rows range-sorted by group and order, with the number of their partition, as a written table: another run of the sort could cut elsewhere."""
    return materialize(df.repartitionByRange(*by, *order).withColumn(name, F.spark_partition_id()))


def same_group(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """left joined with right on the columns by, where null equals null; without any, each row meets right's one row."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in by})
    if not by:
        left, named = left.withColumn("__one", F.lit(1)), named.withColumn("__other", F.lit(1))
        return left.join(named, F.col("__one") == F.col("__other"), how).drop("__one", "__other")
    return left.join(named, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), how).drop(*[f"__{c}" for c in by])


def running(
    df: DataFrame, by: list[str], order: list[str], piece: str, *, sums: dict[str, Column] | None = None, reach: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds values that run along the order inside each group: sums up to the row, the largest of the rows before (reach),
    the value of the row before and after, and totals of the group.

    The order must be total inside a group, and the pieces must follow it.
    """
    sums, reach, before, after, totals = (x or {} for x in (sums, reach, before, after, totals))
    local = Window.partitionBy(*by, piece).orderBy(*order)
    own = {f"__s_{n}": F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}
    own |= {f"__r_{n}": F.max(c).over(local.rowsBetween(Window.unboundedPreceding, -1)) for n, c in reach.items()}
    own |= {f"__b_{n}": F.lag(F.struct(c.alias("v"))).over(local) for n, c in before.items()}
    own |= {f"__a_{n}": F.lead(F.struct(c.alias("v"))).over(local) for n, c in after.items()}
    key = F.struct(*order)
    edge = [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()] + [F.max(c).alias(f"__r_{n}") for n, c in reach.items()] + [F.sum(c).alias(f"__t_{n}") for n, c in totals.items()]
    edge += [F.max_by(F.struct(c.alias("v")), key).alias(f"__b_{n}") for n, c in before.items()] + [F.min_by(F.struct(c.alias("v")), key).alias(f"__a_{n}") for n, c in after.items()]
    across = Window.partitionBy(*by).orderBy(piece)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"__s_{n}").over(earlier).alias(f"__c_s_{n}") for n in sums] + [F.max(f"__r_{n}").over(earlier).alias(f"__c_r_{n}") for n in reach]
    carry += [F.lag(f"__b_{n}").over(across).alias(f"__c_b_{n}") for n in before] + [F.lead(f"__a_{n}").over(across).alias(f"__c_a_{n}") for n in after]
    carry += [F.sum(f"__t_{n}").over(Window.partitionBy(*by)).alias(n) for n in totals]
    edges = df.groupBy(*by, piece).agg(*edge).select(*by, piece, *carry)
    joined = same_group(df.withColumns(own), edges, [*by, piece])
    made = {n: F.col(f"__s_{n}") + F.coalesce(f"__c_s_{n}", F.lit(0)) for n in sums}
    made |= {n: F.greatest(f"__r_{n}", f"__c_r_{n}") for n in reach}
    made |= {n: F.coalesce(f"__{k}_{n}", f"__c_{k}_{n}")["v"] for k, names in (("b", before), ("a", after)) for n in names}
    return joined.select(*df.columns, *totals, *[c.alias(n) for n, c in made.items()])


class Distribution(NamedTuple):
    """How often each value of some columns occurs in each group, as a written table in the order of the values: (by, m, v, n, part), m being the column's number."""

    table: DataFrame
    by: list[str]
    columns: list[str]

    def of(self, column: str, value: Column) -> Column:
        """value in the rows of one column, null in the others."""
        return F.when(F.col("m") == self.columns.index(column), value)


def distribution(df: DataFrame, by: list[str], columns: list[str]) -> Distribution:
    """Counts the different values of columns in one pass; nulls don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    counted = df.select(*by, each).select(*by, "x.m", "x.v").where("v is not null").groupBy(*by, "m", "v").agg(F.count(F.lit(1)).alias("n"))
    return Distribution(in_parts(counted, [*by, "m"], ["v"]), by, columns)


def quantiles_of(found: Distribution, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of a distribution, interpolated linearly: one row for each group, with a column for each (column, share) wanted."""
    by, columns = found.by, found.columns
    group = [*by, "m"]
    ranked = running(found.table, group, ["v"], "part", sums={"upto": F.col("n")}, totals={"whole": F.col("n")})
    points = F.array(*[F.struct(F.lit(columns.index(c)).alias("m"), F.lit(float(p)).alias("p")) for c, p in sorted(set(wanted.values()), key=lambda w: (columns.index(w[0]), w[1]))])
    at = lambda p: p * (F.col("whole") - 1)
    holds = lambda rank: (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
    mine = F.filter(points, lambda x: (x["m"] == F.col("m")) & (holds(F.floor(at(x["p"]))) | holds(F.ceil(at(x["p"])))))
    chosen = ranked.select(*group, "v", "n", "upto", "whole", F.explode(mine).alias("x")).withColumns({"p": F.col("x.p"), "pos": at(F.col("x.p"))})
    low, high = F.floor("pos"), F.ceil("pos")
    ends = chosen.groupBy(*group, "p", "pos").agg(F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"))
    value = F.when(low == high, F.col("low")).otherwise((high - F.col("pos")) * F.col("low") + (F.col("pos") - low) * F.col("high"))
    values = ends.select(*group, "p", value.alias("value"))
    pick = [F.max(F.when((F.col("m") == columns.index(c)) & (F.col("p") == float(p)), F.col("value"))).alias(n) for n, (c, p) in wanted.items()]
    return values.groupBy(*by).agg(*pick)


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles, interpolated linearly: one row for each group, with a column for each (column, share) wanted.

    Different values are counted, range-sorted and numbered; only the rows of the wanted ranks go on. No buffer or task
    holds all values of a group. Nulls don't count; a group without any value has nulls, or no row if no column has one.
    """
    return quantiles_of(distribution(df, by, sorted({c for c, _ in wanted.values()})), wanted)


def with_quantiles(out: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """out, which has one row for each group of df, with the quantiles as further columns."""
    return same_group(out, quantiles(df, by, wanted), by)


def last_mark(points: DataFrame, marks: DataFrame, by: list[str], at: str, what: str, tile: int | None = None) -> DataFrame:
    """points with ``what`` of the last mark of their group at or before them, null without one.

    Both tables have the columns by and at; marks are unique by them. Different places are looked up once, in a sweep
    over marks and places; tile gives the width of its pieces for whole-number coordinates, else they are range-sorted.
    """
    entry = F.struct(F.col(at).alias("at"), F.col(what).alias("v"))
    both = marks.select(*by, at, F.lit(0).alias("kind"), entry.alias("mark")).unionByName(points.select(*by, at).where(F.col(at).isNotNull()).distinct().select(*by, at, F.lit(1).alias("kind"), F.lit(None).cast(marks.select(entry).schema[0].dataType).alias("mark")))
    swept = in_parts(both, by, [at, "kind"], "piece") if tile is None else both.withColumn("piece", F.floor(F.col(at) / tile))
    found = running(swept, by, [at, "kind"], "piece", reach={"last": F.col("mark")}).where("kind = 1")
    return same_group(points, found.select(*by, at, F.col("last.v").alias(what)), [*by, at])
