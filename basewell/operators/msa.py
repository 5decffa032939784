"""Padded alignments of many reads to one reference: a column for each reference position and as many behind it as the longest insertion there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewell.functions.seq import QUERY_OPS, REF_OPS, cigar_ops, cigar_total, cut, once, placed_ops
from basewell.operators.ordered import running
from basewell.operators.tiles import reference_tiles

SIZE = 256


def _ops(df: DataFrame) -> DataFrame:
    """Adds ``ops`` with their places, and ``rend``."""
    end = (F.col("rstart") + cigar_total(cigar_ops("cigar"), REF_OPS)).cast("long")
    return df.withColumns({"ops": placed_ops(cigar_ops("cigar"), "rstart"), "rend": end}).where(F.col("rend") > F.col("rstart"))


def insertion_widths(df: DataFrame) -> DataFrame:
    """(refname, pos, width): the longest insertion behind each reference position that has one. What stands before a read's first reference base doesn't count."""
    each = df.select("refname", "rstart", F.inline(placed_ops(cigar_ops("cigar"), "rstart"))).where("op = 'I' and r > rstart")
    return each.groupBy("refname", (F.col("r") - 1).cast("long").alias("pos")).agg(F.max("n").cast("long").alias("width"))


def column_tiles(df: DataFrame, size: int = SIZE) -> DataFrame:
    """(refname, start, end, tile, before, widths): for each tile of what the reads of a reference cover, the columns that insertions took before it and the widths at its places.

    The columns of earlier tiles are a running sum over tiles, so no array or task has a whole reference.
    """
    ends = df.select("refname", F.col("rstart").cast("long").alias("rstart"), (F.col("rstart") + cigar_total(cigar_ops("cigar"), REF_OPS)).alias("rend")).where("rend > rstart")
    bounds = ends.groupBy("refname").agg(F.min("rstart").alias("start"), F.max("rend").cast("long").alias("end"))
    tiles = bounds.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("tile"))
    found = insertion_widths(df).groupBy("refname", F.floor(F.col("pos") / size).alias("tile")).agg(F.sum("width").alias("total"), F.sort_array(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("off"), "width"))).alias("some"))
    gap = lambda x, i: x["off"] - F.coalesce(F.get("some", i - 1)["off"], F.lit(-1)) - 1
    zero = F.lit(0).cast("long")
    dense = F.flatten(F.transform("some", lambda x, i: F.concat(F.array_repeat(zero, gap(x, i)), F.array(x["width"]))))
    dense = F.coalesce(dense, F.array().cast("array<bigint>"))
    wide = once(tiles.join(found, ["refname", "tile"], "left").withColumn("dense", dense), "dense")
    wide = wide.select("refname", "start", "end", "tile", F.coalesce("total", zero).alias("total"), F.concat("dense", F.array_repeat(zero, F.lit(size) - F.size("dense"))).alias("widths"))
    summed = running(wide.withColumn("piece", F.floor(F.col("tile") / (1 << 16))), ["refname"], ["tile"], "piece", sums={"upto": F.col("total")})
    return summed.select("refname", "start", "end", "tile", (F.col("upto") - F.col("total")).alias("before"), "widths")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda t, v: t + v)


def padded_reads(df: DataFrame, size: int = SIZE) -> DataFrame:
    """(refname, qname, col_start, text): each read's bases in the columns of its reference, from its first column on; a dot stands for what it lacks.

    A read meets the tiles that it spans, gets their widths in order, and is put together in its own row.
    """
    placed = _ops(df).select("refname", "qname", F.col("rstart").cast("long").alias("rstart"), "rend", "seq", "ops")
    key = ["refname", "qname", "rstart", "rend"]
    spans = placed.select(*key).distinct().withColumn("tile", F.explode(F.sequence(F.floor(F.col("rstart") / size), F.floor((F.col("rend") - 1) / size))))
    met = spans.join(column_tiles(df, size), ["refname", "tile"]).groupBy(*key).agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("tile", "before", "widths"))).alias("tiles"))
    first = F.get("tiles", F.lit(0))
    inside = (F.col("rstart") - first["tile"] * size).cast("int")
    met = met.select(*key, (F.col("rstart") - F.col("start") + first["before"] + _sum(F.slice(first["widths"], F.lit(1), inside))).alias("col_start"), F.flatten(F.transform("tiles", lambda t: t["widths"])).alias("widths"), inside.alias("inside"))
    joined = once(placed.join(met, key), "seq", "ops", "widths", "rstart", "inside")
    width = lambda r: F.coalesce(F.get("widths", (r - F.col("rstart")).cast("int") + F.col("inside")), F.lit(0).cast("long")).cast("int")
    dots = lambda n: F.repeat(F.lit("."), n)

    def piece(o: Column, i: Column) -> Column:
        inserted_next = F.coalesce(F.get("ops", i + 1)["op"] == "I", F.lit(False))
        base = lambda k: F.when(F.instr(F.lit(QUERY_OPS), o["op"]) > 0, cut("seq", o["q"] + k, F.lit(1))).otherwise(F.lit("."))
        pad = lambda k: F.when(inserted_next & (k == o["n"] - 1), F.lit("")).otherwise(dots(width(o["r"] + k)))
        on_ref = F.array_join(F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda k: F.concat(base(k), pad(k))), "")
        inserted = F.when(o["r"] > F.col("rstart"), F.concat(cut("seq", o["q"], o["n"]), dots(width(o["r"] - 1) - o["n"]))).otherwise(F.lit(""))
        return F.when(o["op"] == "I", inserted).when((F.instr(F.lit(REF_OPS), o["op"]) > 0) & (o["n"] > 0), on_ref).otherwise(F.lit(""))

    return joined.select("refname", "qname", "col_start", F.array_join(F.transform("ops", piece), "").alias("text"))


def padded_reference(df: DataFrame, refs: DataFrame, size: int = SIZE) -> DataFrame:
    """(refname, tile, col_start, text): the covered part of each reference in the same columns, a row for each tile."""
    tiles = reference_tiles(refs, size=size, halo=0).select("refname", F.col("tile").cast("long").alias("tile"), "begin", "text")
    met = tiles.join(column_tiles(df, size), ["refname", "tile"])
    # Of a tile's letters those from the first covered place to the last; they go from column to column, most of which have nothing behind them.
    first, last = (F.greatest(F.least(F.col(c) - F.col("begin"), F.length("text").cast("long")), F.lit(0)).cast("int") for c in ("start", "end"))
    letters = F.filter(F.split(F.substring(F.col("text"), first + 1, last - first), ""), lambda c: c != "")
    met = once(met.withColumns({"letters": letters, "some": F.slice("widths", first + 1, F.size("widths"))}), "letters", "some")
    text = F.array_join(F.transform("letters", lambda c, k: F.when(F.get("some", k) == 0, c).otherwise(F.concat(c, F.repeat(F.lit("."), F.get("some", k).cast("int"))))), "")
    return met.select("refname", "tile", (F.greatest("begin", "start") - F.col("start") + F.col("before")).alias("col_start"), text.alias("text"))


def whole_row(text: Column, col_start: Column, n_columns: Column) -> Column:
    """A row with dots up to its first column and behind its last one, for matrices of a small region."""
    return F.rpad(F.concat(F.repeat(F.lit("."), col_start.cast("int")), text), n_columns.cast("int"), ".")
