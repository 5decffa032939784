"""Rates and distributions over fact tables of aligned counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import phred, rate
from basewell.operators.ordered import with_quantiles


def total(*columns: str) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out + F.col(c)
    return out


def alignment_rates(*, eq: str = "eq", diff: str = "diff", ins: str = "ins", homo_ins: str = "homo_ins", dele: str = "del", homo_del: str = "homo_del", digits: int = 9) -> list[Column]:
    """Aggregates: identity and error shares of the aligned span, with insertions and deletions inside and outside runs."""
    span = F.sum(total(eq, diff, ins, homo_ins, dele, homo_del))
    parts = {"identity": total(eq), "mismatch": total(diff), "nh_ins": total(ins), "homo_ins": total(homo_ins), "nh_del": total(dele), "homo_del": total(homo_del), "all_ins": total(ins, homo_ins), "all_del": total(dele, homo_del)}
    return [span.alias("span"), *[F.round(rate(F.sum(v), span), digits).alias(k) for k, v in parts.items()]]


def rates_by(df: DataFrame, by: list[str], **columns: str) -> DataFrame:
    return df.groupBy(*by).agg(*alignment_rates(**columns))


def share_table(df: DataFrame, key: Column, count: str = "n") -> DataFrame:
    """(key, n, ratio) over all rows."""
    counted = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias(count))
    return counted.withColumn("ratio", F.round(rate(count, F.sum(count).over(Window.partitionBy())), 9))


def confusion(df: DataFrame, by: list[str], called: str, n: str, tag: str | None = None, rollup_name: str = "all") -> DataFrame:
    """Counts by key and call with their share of the key, and, where tag is given, once more over all tags.

    One grouping-sets aggregate gives both levels, so the facts are read once.
    """
    keys = [*by, *([tag] if tag else []), called]
    counted = df.groupBy(*keys).agg(F.sum(n).alias("num"))
    if tag:
        both = F.explode(F.array(F.col(tag), F.lit(rollup_name))).alias(tag)
        counted = counted.select(*by, called, "num", both).groupBy(*keys).agg(F.sum("num").alias("num"))
    key = Window.partitionBy(*keys[:-1])
    before = key.orderBy(called).rowsBetween(Window.unboundedPreceding, -1)
    out = counted.withColumn("ratio", rate("num", F.sum("num").over(key)))
    return out.withColumn("survival", 1 - F.coalesce(F.sum("ratio").over(before), F.lit(0.0)))


def calibration(df: DataFrame, predicted: str, measured: str, levels: tuple[int, ...] = (13, 20, 25, 30)) -> DataFrame:
    """One row: errors of predicted against measured quality, and precision and recall of each level."""
    p, m = F.col(predicted), F.col(measured)
    errors = [F.avg(p - m).alias("me"), F.avg(F.abs(p - m)).alias("mae"), F.avg(rate(F.abs(p - m), m)).alias("mape"), F.sqrt(F.avg((p - m) ** 2)).alias("rmse")]
    for k in levels:
        both = F.count_if((p >= k) & (m >= k))
        errors += [rate(both, F.count_if(p >= k)).alias(f"precision_{k}"), rate(both, F.count_if(m >= k)).alias(f"recall_{k}")]
    return with_quantiles(df.agg(*errors), df.select((p - m).alias("off")), [], {"med_e": ("off", 0.5)})


def pooled_quality(eq: Column, span: Column, eps: float = 1e-8) -> Column:
    return phred(rate(eq, span), eps=eps)


def likeliest(observed: DataFrame, model: DataFrame, *, item: str, key: str, candidate: str, ratio: str, missing: float = -100.0) -> DataFrame:
    """Naive Bayes: for each item the posterior of the candidates that know one of its keys, from log ratios.

    A key that a candidate doesn't know counts ``missing``. The other candidates, which know none, share what is left
    evenly; they are counted and not listed, so no item meets every candidate.
    """
    logs = model.select(F.col(key), F.col(candidate), F.ln(ratio).alias("log_ratio"))
    base = observed.groupBy(F.col(item).alias("base_item")).agg((F.count(F.lit(1)) * missing).alias("base"))
    gains = observed.join(logs, key).groupBy(item, candidate).agg(F.sum(F.col("log_ratio") - missing).alias("gain"))
    every = model.agg(F.count_distinct(candidate).alias("candidates"))  # one row
    scored = gains.join(base, F.col(item) == F.col("base_item")).drop("base_item").crossJoin(F.broadcast(every)).withColumn("score", F.col("base") + F.col("gain"))
    whole = Window.partitionBy(item)
    top = F.greatest(F.max("score").over(whole), F.col("base"))
    weighed = scored.withColumns({"weight": F.exp(F.col("score") - top), "rest": (F.col("candidates") - F.count(F.lit(1)).over(whole)) * F.exp(F.col("base") - top)})
    return weighed.withColumn("posterior", F.col("weight") / (F.sum("weight").over(whole) + F.col("rest"))).select(item, candidate, "score", "posterior")


def empirical_quality(table: DataFrame) -> DataFrame:
    """Base-quality table (baseq, eq, depth) of all references to (baseq, depth, emp_rq, emp_phred)."""
    summed = table.groupBy("baseq").agg(F.sum("depth").alias("depth"), F.sum("eq").alias("eq"))
    return summed.select("baseq", "depth", rate("eq", "depth").alias("emp_rq"), phred(rate("eq", "depth"), cap=1 - 1e-6).alias("emp_phred"))


def base_quality_errors(found: DataFrame, levels: tuple[int, ...] = (20, 30, 35), least_depth: int = 10_000) -> DataFrame:
    """One row: share of bases from each level on, and errors of stated against empirical quality, each quality over least_depth counting once."""
    q, emp = F.col("baseq"), F.col("emp_phred")
    off = F.when(F.col("depth") > least_depth, F.abs(q - emp))
    shares = [rate(F.sum(F.when(q >= k, F.col("depth"))), F.sum("depth")).alias(f"share_{k}") for k in levels]
    return found.agg(*shares, F.avg(off * off).alias("mse"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("mae"), F.median(off).alias("med_ae"), F.avg(rate(off, emp)).alias("mape"), F.avg(rate(2 * off, q + emp)).alias("smape"))


def two_segment_class(q_overlap: Column, r_overlap: Column, gap: Column, identity: Column, low: float = 0.02, high: float = 0.9, near: int = 20) -> Column:
    """Class of a read of two segments, by how far they overlap on the read and on the reference and by the gap between them."""
    apart = q_overlap < low
    sv, cut = apart & (r_overlap > high), apart & (r_overlap < low)
    kind = F.when(sv & (gap < near), "sv").when(cut & (gap < near), "noCut").when(sv, "svCandidate").when(cut, "noCutCandidate")
    return kind.when(identity < 0.85, "badCase-lowIdentity").otherwise("badCase")


def coverage_rates(df: DataFrame, *, covered: Column, primary: Column, misc: Column, size: Column, identity: Column) -> DataFrame:
    """One row: aligned bases, coverage of the reads by primary, primary and secondary, and all segments, and quartiles of coverage and identity."""
    own = df.select(covered.alias("c"), primary.alias("p"), misc.alias("m"), size.alias("s"), rate(primary, size).alias("coverage"), identity.alias("identity"))
    quartiles = {f"{c}_p{int(100 * p)}": (c, p) for c in ("coverage", "identity") for p in (0.25, 0.5, 0.75)}
    out = own.agg(F.sum("c").cast("double").alias("aligned_bases"), *[rate(F.sum(c), F.sum("s")).alias(n) for c, n in (("p", "query_coverage"), ("m", "query_coverage_2"), ("c", "query_coverage_3"))])
    return with_quantiles(out, own, [], quartiles)


def calibration_by_level(df: DataFrame, predicted: str, measured: str) -> DataFrame:
    """One row for each whole predicted quality: reads, mean and quartiles of the measured one."""
    levels = df.select(F.floor(predicted).alias("level"), F.col(measured).alias("measured"))
    out = levels.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("measured").alias("mean"))
    return with_quantiles(out, levels, ["level"], {f"p{int(100 * p)}": ("measured", p) for p in (0.25, 0.5, 0.75)})


def barcode_errors(df: DataFrame, expected: DataFrame, *, name: str, barcode: str, rname: str, samples: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Barcodes against alignments, each taken for true in turn. expected: (barcode, expected reference).

    Three tables: by barcode (all, on the expected reference, on a wrong one, not aligned), by reference (aligned, of
    another barcode), and names of the first reads of each barcode on each wrong reference. A null or empty reference
    is not aligned; a barcode without an expected reference has only wrong ones.
    """
    known = expected.select(F.col(barcode).alias("code"), F.col("expected"))
    rows = df.select(F.col(name).alias("name"), F.col(barcode).alias("code"), F.nullif(F.col(rname), F.lit("")).alias("rname")).join(known, "code", "left")
    right = F.coalesce(F.col("rname") == F.col("expected"), F.lit(False))
    aligned = F.col("rname").isNotNull()
    rows = rows.withColumns({"right": right & aligned, "wrong": ~right & aligned})
    by_code = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_expected"), F.count_if("wrong").alias("n_wrong"), F.count_if(~aligned).alias("n_unaligned"))
    by_ref = rows.where(aligned).groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("n_wrong"))
    place = F.row_number().over(Window.partitionBy("code", "rname").orderBy("name"))
    picked = rows.where("wrong").select("code", "rname", "name").withColumn("place", place).where(F.col("place") <= samples)
    return by_code.withColumn("wrong_share", rate("n_wrong", "n")), by_ref.withColumn("wrong_share", rate("n_wrong", "n")), picked
