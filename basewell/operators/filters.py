"""Predicates and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewell.functions.seq import REF_OPS, col, placed_ops


def audited(flag: Column | str, secondary: bool = False, supplementary: bool = False) -> Column:
    """Mapped, and neither secondary nor supplementary unless allowed."""
    drop = 4 | (0 if secondary else 256) | (0 if supplementary else 2048)
    return col(flag).bitwiseAND(drop) == 0


def in_ranges(value: Column | str, ranges: str) -> Column:
    """``1:3,5,7:9``: a value in one of the closed ranges; an open side has no bound."""

    def one(text: str) -> Column:
        low, _, high = text.partition(":") if ":" in text else (text, "", text)
        tests = [col(value) >= float(x) for x in [low] if x] + [col(value) <= float(x) for x in [high] if x]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return reduce(lambda a, b: a | b, map(one, ranges.split(",")))


def by_bands(df: DataFrame, value: str, bands: list[tuple[float, float]]) -> DataFrame:
    """Each row once for every band [low, high] that holds its value."""
    literal = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in bands])
    return df.select("*", F.inline(F.filter(literal, lambda b: (F.col(value) >= b["low"]) & (F.col(value) <= b["high"]))))


def clamp(value: Column | str, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(col(value), low), high)


def kept_and_dropped(df: DataFrame, keep: Column) -> DataFrame:
    """One row: rows kept, rows dropped, share dropped."""
    return df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"), F.round(F.avg((~keep).cast("double")), 9).alias("dropped_share"))


def deletion_ratio(ops: Column | str, rstart: Column | str, start: Column, end: Column) -> Column:
    """Deleted share of the reference interval [start, end) that an alignment covers; null where it covers none."""

    def overlap(kinds: str) -> Column:
        inside = F.filter(placed_ops(ops, rstart), lambda o: F.instr(F.lit(kinds), o["op"]) > 0)
        return F.aggregate(inside, F.lit(0), lambda n, o: n + F.greatest(F.lit(0), F.least(end, o["r"] + o["n"]) - F.greatest(start, o["r"])))

    return overlap("D") / F.nullif(overlap(REF_OPS), F.lit(0))


def overlaps(rstart: Column | str, rend: Column | str, start: Column | int, end: Column | int) -> Column:
    """Half-open alignment [rstart, rend) meets [start, end)."""
    return (col(rstart) < end) & (col(rend) > start)
