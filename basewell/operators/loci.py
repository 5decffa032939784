"""Tables over the locus table: what kinds of errors fall on which bases, corrected by how many places those have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewell.functions.seq import rate

TYPES = ("total", "diff", "ins", "del")
BASES = "ACGT"


def worst_places(loci: DataFrame, k: int = 50) -> DataFrame:
    """(type, place, refname, pos, n, depth, ratio, around): the k places with most errors of each type, the first of equal ones by name and position. Ratio is null without depth."""
    out = None
    for kind in TYPES[1:]:
        top = loci.where(F.col(kind) > 0).orderBy(F.desc(kind), "refname", "pos").limit(k).select(F.lit(kind).alias("type"), "refname", "pos", F.col(kind).alias("n"), "depth", rate(kind, "depth").alias("ratio"), "around")
        out = top if out is None else out.unionByName(top)
    return out


def composition(loci: DataFrame) -> DataFrame:
    """(cur_base, cur_is_homo, n_pos, n_pos_err, diff, ins, del, total): errors by base, inside and outside homopolymers."""
    total = F.col("diff") + F.col("ins") + F.col("del")
    return loci.groupBy("cur_base", "cur_is_homo").agg(
        F.count(F.lit(1)).alias("n_pos"), F.count_if(total > 0).alias("n_pos_err"), *[F.sum(c).alias(c) for c in TYPES[1:]], F.sum(total).alias("total")
    )


def homo_against_rest(composed: DataFrame) -> DataFrame:
    """(cur_base, type, pos_ratio, homo, rest, homo_corrected, rest_corrected, ratio): counts over the share of the base's places that they fall on, cut to whole numbers.

    Bases without errors in both regions are left out.
    """
    wide = composed.where("n_pos_err > 0").groupBy("cur_base").agg(*[F.max(F.when(F.col("cur_is_homo") == h, F.col(c))).alias(f"{n}_{c}") for n, h in (("homo", True), ("rest", False)) for c in ("n_pos", *TYPES)])
    wide = wide.where("homo_n_pos is not null and rest_n_pos is not null").withColumn("pos_ratio", rate("homo_n_pos", F.col("homo_n_pos") + F.col("rest_n_pos")))
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"homo_{t}").alias("homo"), F.col(f"rest_{t}").alias("rest")) for t in TYPES])).alias("x")
    tall = wide.select("cur_base", "pos_ratio", kinds).select("cur_base", "x.type", "pos_ratio", "x.homo", "x.rest")
    corrected = {"homo_corrected": F.floor(F.col("homo") / F.col("pos_ratio")), "rest_corrected": F.floor(F.col("rest") / (1 - F.col("pos_ratio")))}
    return tall.withColumns(corrected).withColumn("ratio", rate("homo_corrected", "rest_corrected"))


def across_bases(composed: DataFrame, compared: DataFrame) -> DataFrame:
    """One row for each type: corrected errors of each base, and once more over the base's share of all places."""
    share = composed.groupBy("cur_base").agg(F.sum("n_pos").alias("n"))
    whole = share.agg(F.sum("n").alias("n_all"))  # one row
    shares = share.join(F.broadcast(whole), F.lit(True)).select("cur_base", (F.col("n") / F.col("n_all")).alias("share"))
    raw = F.col("homo_corrected") + F.col("rest_corrected")
    tall = compared.join(shares, "cur_base").select("type", "cur_base", raw.alias("raw"), F.floor(raw / F.col("share")).alias("corr"))
    return tall.groupBy("type").pivot("cur_base", list(BASES)).agg(F.max("raw").alias("raw"), F.max("corr").alias("corr"))
