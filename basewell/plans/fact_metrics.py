"""Metrics over the facts view (A series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import filters, metrics, summary
from basewell.operators.ordered import quantiles, with_quantiles
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import FACTS_SQL, READS_SQL, table

_SPAN = "sum(eq + diff + ins + homo_ins + del + homo_del)"
_RATES = f"{_SPAN}::BIGINT AS span, " + ", ".join(
    f"round(sum({v})::DOUBLE / nullif({_SPAN}, 0), 9) AS {k}"
    for k, v in {"identity": "eq", "mismatch": "diff", "nh_ins": "ins", "homo_ins": "homo_ins", "nh_del": "del", "homo_del": "homo_del", "all_ins": "ins + homo_ins", "all_del": "del + homo_del"}.items()
)
_ID = "eq::DOUBLE / (eq + diff + ins + homo_ins + del + homo_del)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).withColumn("identity", F.col("eq") / metrics.total("eq", "diff", "ins", "homo_ins", "del", "homo_del").cast("double"))


@query(FACTS_SQL + " SELECT CASE WHEN rname IS NULL OR rname = '' THEN 'notAligned' ELSE 'aligned' END AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM facts GROUP BY 1")
def a06_aligned_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.share_table(_facts(spark, sf_dir), F.when(F.coalesce(F.col("rname"), F.lit("")) == "", "notAligned").otherwise("aligned"))


@query(FACTS_SQL + " SELECT least(seg * 4, 20)::INT AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM facts GROUP BY 1")
def a07_segment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.share_table(_facts(spark, sf_dir), F.least(F.col("seg") * 4, F.lit(20)))


_CLASSES = """CASE WHEN q >= 0.02 THEN CASE WHEN identity < 0.85 THEN 'badCase-lowIdentity' ELSE 'badCase' END WHEN r > 0.9 AND gap < 20 THEN 'sv' WHEN r < 0.02 AND gap < 20 THEN 'noCut' WHEN r > 0.9 THEN 'svCandidate'
  WHEN r < 0.02 THEN 'noCutCandidate' WHEN identity < 0.85 THEN 'badCase-lowIdentity' ELSE 'badCase' END"""


@query(FACTS_SQL + f", segs AS (SELECT diff * 0.008 AS q, ins * 0.24 AS r, del * 10 AS gap, {_ID} AS identity FROM facts WHERE seg = 2) SELECT {_CLASSES} AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM segs GROUP BY 1")
def a08_two_segment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = metrics.two_segment_class(F.col("diff") * 0.008, F.col("ins") * 0.24, F.col("del") * 10, F.col("identity"))
    return metrics.share_table(_facts(spark, sf_dir).where("seg = 2"), kind)


@query(FACTS_SQL + ", c AS (SELECT eq + diff + ins + homo_ins AS c, eq + diff AS p, eq + diff + ins AS m, qlen AS s, " + _ID + " AS identity FROM facts) SELECT sum(c)::DOUBLE AS aligned_bases, round(sum(p) / sum(s), 9) AS query_coverage, round(sum(m) / sum(s), 9) AS query_coverage_2, round(sum(c) / sum(s), 9) AS query_coverage_3, "
       + ", ".join(f"round(quantile_cont({x}, {q}), 9) AS {n}_p{int(100 * q)}" for n, x in (("coverage", "p::DOUBLE / s"), ("identity", "identity")) for q in (0.25, 0.5, 0.75)) + " FROM c")
def a11_coverage_and_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.coverage_rates(_facts(spark, sf_dir), covered=metrics.total("eq", "diff", "ins", "homo_ins"), primary=metrics.total("eq", "diff"), misc=metrics.total("eq", "diff", "ins"), size=F.col("qlen"), identity=F.col("identity"))
    return out.select([F.round(c, 9).alias(c) if c != "aligned_bases" else F.col(c) for c in out.columns])


_BARCODES = FACTS_SQL + ", b AS (SELECT qname || '.' || seg AS name, tag, nullif(rname, '') AS rname, CASE tag WHEN 'A' THEN 'chr2' WHEN 'N' THEN 'chr3' WHEN 'R' THEN 'chr4' END AS expected FROM facts)"


def _barcodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    expected = F.broadcast(spark.createDataFrame([("A", "chr2"), ("N", "chr3"), ("R", "chr4")], "tag string, expected string"))  # one row a literal; a join dealt by barcode would have three tasks
    return metrics.barcode_errors(_facts(spark, sf_dir).withColumn("name", F.concat_ws(".", "qname", "seg")), expected, name="name", barcode="tag", rname="rname")


@query(_BARCODES + " SELECT tag AS code, count(*) AS n, count_if(rname = expected) AS n_expected, count_if(rname <> expected) AS n_wrong, count_if(rname IS NULL) AS n_unaligned, round(count_if(rname <> expected) / count(*), 9) AS wrong_share FROM b GROUP BY tag")
def a59_errors_by_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barcodes(spark, sf_dir)[0].withColumn("wrong_share", F.round("wrong_share", 9))


@query(_BARCODES + " SELECT rname, count(*) AS n, count_if(rname <> expected) AS n_wrong, round(count_if(rname <> expected) / count(*), 9) AS wrong_share FROM b WHERE rname IS NOT NULL GROUP BY rname")
def a59_errors_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barcodes(spark, sf_dir)[1].withColumn("wrong_share", F.round("wrong_share", 9))


@query(_BARCODES + ", o AS (SELECT tag AS code, rname, name, row_number() OVER (PARTITION BY tag, rname ORDER BY name, expected)::INT AS place FROM b WHERE rname <> expected) SELECT * FROM o WHERE place <= 3")
def a59_samples_of_each_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barcodes(spark, sf_dir)[2]


_GAPS = "WITH lists AS (SELECT l_orderkey, count(*) AS segs, string_agg(l_quantity::BIGINT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity::BIGINT::VARCHAR) AS gaps FROM lineitem GROUP BY l_orderkey), each AS (SELECT unnest(string_split(gaps, ',')[2:segs]) AS gap FROM lists WHERE segs > 1), c AS (SELECT gap::BIGINT AS gap, count(*) AS n FROM each GROUP BY gap), top AS (SELECT gap, n / (SELECT sum(n) FROM c) AS ratio FROM c ORDER BY n DESC, gap LIMIT 20)"


@query(_GAPS + " SELECT '[segs>1]Cnt' AS name, count_if(segs > 1)::DOUBLE AS value FROM lists UNION ALL SELECT '[segs>1]Ratio', round(count_if(segs > 1) / count(*), 9) FROM lists UNION ALL SELECT '[segs>1]gapTop20Ratio', round(sum(ratio), 9) FROM top UNION ALL SELECT '[segs>1]gap=' || gap, round(ratio, 9) FROM top")
def a09_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").cast("string").alias("q"))))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("segs"), F.array_join(F.transform(order, lambda x: x["q"]), ",").alias("gaps"))
    return summary.gap_report(lists, "segs", "gaps").withColumn("value", F.round("value", 9))


@query("WITH lists AS (SELECT l_orderkey, string_agg(l_quantity::BIGINT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity::BIGINT::VARCHAR) AS gaps FROM lineitem GROUP BY l_orderkey), each AS (SELECT unnest(string_split(gaps, ',')[2:]) AS gap FROM lists), c AS (SELECT gap::BIGINT AS gap, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM each GROUP BY gap) SELECT * FROM c ORDER BY ratio DESC, gap LIMIT 20")
def a09_gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").cast("string").alias("q"))))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(order, lambda x: x["q"]), ",").alias("gaps"))
    each = lists.select(F.explode(F.slice(F.split("gaps", ","), F.lit(2), F.greatest(F.size(F.split("gaps", ",")) - 1, F.lit(0)))).alias("gap"))
    counted = each.groupBy(F.col("gap").cast("long").alias("gap")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("ratio", F.round(S.rate("n", F.sum("n").over(Window.partitionBy())), 9))
    return counted.orderBy(F.desc("ratio"), "gap").limit(20)


@query(FACTS_SQL + " SELECT tag, round(count(rname) / count(*), 9) AS ratio FROM facts GROUP BY tag")
def a10_non_null_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("tag").agg(F.round(F.count("rname") / F.count(F.lit(1)), 9).alias("ratio"))


@query(FACTS_SQL + f" SELECT base, {_RATES} FROM facts GROUP BY base UNION ALL SELECT 'all', {_RATES} FROM facts")
def a11_alignment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _facts(spark, sf_dir).drop("identity").withColumn("base", F.explode(F.array(F.col("base"), F.lit("all"))))
    return metrics.rates_by(both, ["base"])


@query(FACTS_SQL + f", i AS (SELECT tag, {_ID} AS c FROM facts) SELECT tag, " + ", ".join(f"round(avg((c >= {t})::INT), 9) AS share_{str(t)[2:]}" for t in (0.83, 0.9, 0.95, 0.99)) + ", round(sum(c) / count(*), 9) AS mean_identity FROM i GROUP BY tag")
def a12_identity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("identity")
    return _facts(spark, sf_dir).groupBy("tag").agg(*[F.round(F.avg((c >= t).cast("double")), 9).alias(f"share_{str(t)[2:]}") for t in (0.83, 0.9, 0.95, 0.99)], F.round(F.sum(c) / F.count(F.lit(1)), 9).alias("mean_identity"))


@query(FACTS_SQL + f" SELECT np, {_RATES} FROM facts JOIN orders ON o_orderkey = qname GROUP BY np")
def a13_rates_by_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _facts(spark, sf_dir).drop("identity").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qname")), "qname")
    return metrics.rates_by(joined, ["np"])


_CONFUSION = """, one AS (SELECT base, true_cnt, tag, called, sum(eq)::BIGINT AS num FROM facts GROUP BY ALL UNION ALL SELECT base, true_cnt, 'all', called, sum(eq)::BIGINT FROM facts GROUP BY base, true_cnt, called),
  r AS (SELECT *, num / sum(num) OVER (PARTITION BY base, true_cnt, tag) AS x FROM one)"""


@query(FACTS_SQL + _CONFUSION + " SELECT base, true_cnt, tag, called, num, round(x, 9) AS ratio, round(1 - coalesce(sum(x) OVER (PARTITION BY base, true_cnt, tag ORDER BY called ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS survival FROM r")
def a17_motif_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(_facts(spark, sf_dir), ["base", "true_cnt"], "called", "eq", tag="tag")
    return out.select("base", "true_cnt", "tag", "called", "num", F.round("ratio", 9).alias("ratio"), F.round("survival", 9).alias("survival"))


@query(FACTS_SQL + ", least_ AS (SELECT qname, base, min(eq) AS eq, min(qlen) AS span FROM facts GROUP BY ALL) SELECT base, round(sum(eq) / sum(span), 9) AS identity FROM least_ GROUP BY base")
def a18_run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = _facts(spark, sf_dir).groupBy("qname", "base").agg(F.min("eq").alias("eq"), F.min("qlen").alias("span"))
    return least.groupBy("base").agg(F.round(S.rate(F.sum("eq"), F.sum("span")), 9).alias("identity"))


@query(FACTS_SQL + ", m AS (SELECT '(' || base || ')' || true_cnt AS motif, eq, diff, ins, del FROM facts) SELECT motif, round(sum(eq) / sum(eq + diff + ins + del), 9) AS eq_rate, round(sum(diff) / sum(eq + diff + ins + del), 9) AS diff_rate, round(sum(ins) / sum(eq + diff + ins + del), 9) AS ins_rate, round(sum(del) / sum(eq + diff + ins + del), 9) AS del_rate FROM m GROUP BY motif")
def a19_repeat_motif_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.sum(metrics.total("eq", "diff", "ins", "del"))
    motifs = _facts(spark, sf_dir).withColumn("motif", F.concat(F.lit("("), "base", F.lit(")"), "true_cnt"))
    out = motifs.groupBy("motif").agg(*[F.round(S.rate(F.sum(c), span), 9).alias(f"{c}_rate") for c in ("eq", "diff", "ins", "del")])
    unit, n = S.motif_parts("motif")
    return out.orderBy(F.length(unit), unit, n)


@query(FACTS_SQL + " SELECT seg AS minutes, round(sum(diff) / sum(qlen), 9) AS diff_rate, round(sum(ins) / sum(qlen), 9) AS ins_rate, round(sum(del) / sum(qlen), 9) AS del_rate FROM facts GROUP BY seg UNION ALL SELECT -1, round(sum(diff) / sum(qlen), 9), round(sum(ins) / sum(qlen), 9), round(sum(del) / sum(qlen), 9) FROM facts")
def a20_errors_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _facts(spark, sf_dir).withColumn("minutes", F.explode(F.array(F.col("seg"), F.lit(-1))))
    return both.groupBy("minutes").agg(*[F.round(S.rate(F.sum(c), F.sum("qlen")), 9).alias(f"{c}_rate") for c in ("diff", "ins", "del")])


@query(FACTS_SQL + f" SELECT np, " + ", ".join(f"round(quantile_cont({_ID}, {p}), 9) AS p{int(100 * p)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM facts GROUP BY np")
def a21_quantiles_by_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = {f"p{int(100 * p)}": ("identity", p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    return quantiles(_facts(spark, sf_dir), ["np"], points).withColumns({n: F.round(n, 9) for n in points})


_TWO = FACTS_SQL + ", a AS (SELECT ch, avg(np) AS np, sum(eq) AS eq, sum(qlen) AS span FROM facts WHERE status = 'F' GROUP BY ch), b AS (SELECT ch, sum(eq) AS eq, sum(qlen) AS span FROM facts WHERE status = 'O' GROUP BY ch), j AS (SELECT ch, least(np, 25)::BIGINT AS np, a.eq AS eq_0, a.span AS span_0, b.eq AS eq_1, b.span AS span_1 FROM a JOIN b USING (ch))"


@query(_TWO + " SELECT np, count(*) AS channels, round(-10 * log10(1 - sum(eq_0) / sum(span_0) + 1e-8), 6) AS qv_0, round(-10 * log10(1 - sum(eq_1) / sum(span_1) + 1e-8), 6) AS qv_1, round(median(eq_0 / span_0), 9) AS median_0, round(median(eq_1 / span_1), 9) AS median_1 FROM j GROUP BY np")
def a22_joined_by_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    a = facts.where("status = 'F'").groupBy("ch").agg(F.least(F.avg("np"), F.lit(25)).cast("long").alias("np"), F.sum("eq").alias("eq_0"), F.sum("qlen").alias("span_0"))
    b = facts.where("status = 'O'").groupBy("ch").agg(F.sum("eq").alias("eq_1"), F.sum("qlen").alias("span_1"))
    pooled = [F.round(metrics.pooled_quality(F.sum(f"eq_{i}"), F.sum(f"span_{i}")), 6).alias(f"qv_{i}") for i in (0, 1)]
    both = a.join(b, "ch").withColumns({f"identity_{i}": S.rate(f"eq_{i}", f"span_{i}") for i in (0, 1)})
    out = both.groupBy("np").agg(F.count(F.lit(1)).alias("channels"), *pooled)
    return with_quantiles(out, both, ["np"], {f"median_{i}": (f"identity_{i}", 0.5) for i in (0, 1)}).withColumns({f"median_{i}": F.round(f"median_{i}", 9) for i in (0, 1)})


#: Channels of two runs, joined: spans, errors and qualities of both, and the passes of the first.
_BOTH = FACTS_SQL + "".join(
    f""", c{i} AS (SELECT ch, least(avg(np), 25)::BIGINT AS np, sum(qlen) AS tp, sum(eq) AS eq, {_SPAN} AS span, sum(diff) AS diff, sum(ins) AS ins, sum(homo_ins) AS homo_ins, sum(del) AS del, sum(homo_del) AS homo_del FROM facts WHERE status = '{s}' GROUP BY ch),
  q{i} AS (SELECT *, -10 * log10(1 - eq / span + 1e-8) AS qv FROM c{i})""" for i, s in enumerate("FO")
) + ", j AS MATERIALIZED (SELECT a.ch, a.np, " + ", ".join(f"{t}.{c} AS {c}_{i}" for i, t in enumerate("ab") for c in ("tp", "eq", "span", "diff", "ins", "homo_ins", "del", "homo_del", "qv")) + " FROM q0 a JOIN q1 b USING (ch))"
_LEVELS = {"p0": 0.0, "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p100": 1.0}
_PARTS = {"nh_ins": "ins", "homo_ins": "homo_ins", "nh_del": "del", "homo_del": "homo_del", "mismatch": "diff", "identity": "eq"}


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of both runs, each with counts and quality."""
    facts = _facts(spark, sf_dir)
    counts = ("eq", "diff", "ins", "homo_ins", "del", "homo_del")
    made = []
    for i, status in enumerate("FO"):
        c = facts.where(F.col("status") == status).groupBy("ch").agg(F.least(F.avg("np"), F.lit(25)).cast("long").alias("np"), F.sum("qlen").alias("tp"), *[F.sum(x).alias(x) for x in counts])
        c = c.withColumn("span", metrics.total(*counts)).withColumn("qv", metrics.pooled_quality(F.col("eq"), F.col("span")))
        made.append(c.select("ch", *([F.col("np")] if i == 0 else []), *[F.col(x).alias(f"{x}_{i}") for x in ("tp", *counts, "span", "qv")]))
    return made[0].join(made[1], "ch")


@query(_BOTH + " SELECT np, count(*) AS channels, " + ", ".join("array_to_string([" + ", ".join(f"round(quantile_cont(qv_{i}, {p}), 2)::VARCHAR" for p in _LEVELS.values()) + f"], ', ') AS qv_{i}, round(median(eq_{i} / span_{i}), 9) AS identity_{i}" for i in (0, 1)) + " FROM j GROUP BY np")
def a22_percentile_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both(spark, sf_dir).withColumns({f"identity_{i}": S.rate(f"eq_{i}", f"span_{i}") for i in (0, 1)})
    points = {f"{n}_{i}": (f"qv_{i}", p) for i in (0, 1) for n, p in _LEVELS.items()} | {f"median_{i}": (f"identity_{i}", 0.5) for i in (0, 1)}
    out = with_quantiles(both.groupBy("np").agg(F.count(F.lit(1)).alias("channels")), both, ["np"], points)
    text = lambda i: F.concat_ws(", ", *[F.round(f"{n}_{i}", 2).cast("string") for n in _LEVELS])
    return out.select("np", "channels", *[c for i in (0, 1) for c in (text(i).alias(f"qv_{i}"), F.round(f"median_{i}", 9).alias(f"identity_{i}"))])


@query(_BOTH + " SELECT count(*) AS channels, " + ", ".join(f"sum(eq_{i})::BIGINT || ', ' || sum(tp_{i})::BIGINT AS bases_{i}, round(median(qv_{i}), 2) AS qv_median_{i}, round(count_if(qv_{i} >= 30) / count(*), 2) AS q30_{i}, round(-10 * log10(1 - sum(eq_{i}) / sum(span_{i}) + 1e-8), 6) AS qv_{i}" for i in (0, 1)) + " FROM j")
def a22_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both(spark, sf_dir)
    sums = [F.sum(f"{c}_{i}").alias(f"{c}_{i}") for i in (0, 1) for c in ("eq", "tp", "span")]
    out = both.agg(F.count(F.lit(1)).alias("channels"), *sums, *[F.round(F.avg((F.col(f"qv_{i}") >= 30).cast("double")), 2).alias(f"q30_{i}") for i in (0, 1)])
    out = with_quantiles(out, both, [], {f"qv_median_{i}": (f"qv_{i}", 0.5) for i in (0, 1)})
    made = lambda i: [F.concat_ws(", ", F.col(f"eq_{i}").cast("string"), F.col(f"tp_{i}").cast("string")).alias(f"bases_{i}"), F.round(f"qv_median_{i}", 2).alias(f"qv_median_{i}"), F.col(f"q30_{i}"), F.round(metrics.pooled_quality(F.col(f"eq_{i}"), F.col(f"span_{i}")), 6).alias(f"qv_{i}")]
    return out.select("channels", *made(0), *made(1))


@query(_BOTH + " SELECT count(*) AS channels, " + ", ".join(f"round(sum({c}_{i}) / sum(span_{i}), 9) AS {n}_{i}" for i in (0, 1) for n, c in _PARTS.items()) + " FROM j")
def a22_error_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).agg(F.count(F.lit(1)).alias("channels"), *[F.round(S.rate(F.sum(f"{c}_{i}"), F.sum(f"span_{i}")), 9).alias(f"{n}_{i}") for i in (0, 1) for n, c in _PARTS.items()])


@query(_BOTH + " SELECT count(*) AS channels, sum(tp_0)::BIGINT AS tp, sum(eq_0)::BIGINT AS etp, sum(span_0)::BIGINT AS span, count_if(qv_0 >= 30) AS q30, round(count_if(qv_0 >= 30) / count(*), 4) AS q30_r, round(median(eq_0 / span_0), 9) AS m_r_median, "
       + ", ".join(f"round(sum({c}_0) / sum(span_0), 9) AS {n}_r" for n, c in _PARTS.items()) + ", round(sum(eq_0) / sum(tp_0), 9) AS valid_r, round(sum(eq_0 + diff_0 + ins_0 + homo_ins_0) / sum(tp_0), 9) AS cov_r, round(-10 * log10(1 - sum(eq_0) / sum(span_0)), 6) AS phreq FROM j")
def a23_funnel_of_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both(spark, sf_dir).withColumn("m_r", S.rate("eq_0", "span_0"))
    total = lambda *names: F.sum(metrics.total(*[f"{n}_0" for n in names]))
    out = both.agg(
        F.count(F.lit(1)).alias("channels"), total("tp").alias("tp"), total("eq").alias("etp"), total("span").alias("span"), F.count_if(F.col("qv_0") >= 30).alias("q30"), F.round(F.avg((F.col("qv_0") >= 30).cast("double")), 4).alias("q30_r"),
        *[F.round(S.rate(total(c), total("span")), 9).alias(f"{n}_r") for n, c in _PARTS.items()], F.round(S.rate(total("eq"), total("tp")), 9).alias("valid_r"), F.round(S.rate(total("eq", "diff", "ins", "homo_ins"), total("tp")), 9).alias("cov_r"),
        F.round(S.phred(S.rate(total("eq"), total("span"))), 6).alias("phreq"),
    )
    return with_quantiles(out, both, [], {"m_r_median": ("m_r", 0.5)}).withColumn("m_r_median", F.round("m_r_median", 9))


@query(FACTS_SQL + " SELECT sum(qlen)::BIGINT AS tp, sum(eq)::BIGINT AS etp, round(sum(eq) / sum(qlen), 9) AS valid_r, round(-10 * log10(1 - least(sum(eq) / sum(qlen), 0.99999)), 6) AS phreq FROM facts")
def a23_global_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = S.rate(F.sum("eq"), F.sum("qlen"))
    return _facts(spark, sf_dir).agg(F.sum("qlen").alias("tp"), F.sum("eq").alias("etp"), F.round(share, 9).alias("valid_r"), F.round(S.phred(share, cap=0.99999), 6).alias("phreq"))


_CALIBRATED = READS_SQL + ", m AS (SELECT -10 * log10(1 - least(rq, 0.99999)) AS p, least(40.0, length(seq) / 50.0 + 1)::DOUBLE AS m FROM reads)"


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select(S.phred("rq", cap=0.99999).alias("p"), F.least(F.lit(40.0), F.length("seq") / 50.0 + 1).alias("m"))


@query(_CALIBRATED + " SELECT round(avg(p - m), 9) AS me, round(median(p - m), 9) AS med_e, round(avg(abs(p - m)), 9) AS mae, round(avg(abs(p - m) / m), 9) AS mape, round(sqrt(avg((p - m) * (p - m))), 9) AS rmse, "
       + ", ".join(f"round(count_if(p >= {k} AND m >= {k}) / nullif(count_if(p >= {k}), 0), 9) AS precision_{k}, round(count_if(p >= {k} AND m >= {k}) / nullif(count_if(m >= {k}), 0), 9) AS recall_{k}" for k in (13, 20, 25, 30)) + " FROM m")
def a24_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration(_calibrated(spark, sf_dir), "p", "m")
    return out.select([F.round(c, 9).alias(c) for c in out.columns])


@query(_CALIBRATED + " SELECT floor(p)::BIGINT AS level, count(*) AS n, round(avg(m), 9) AS mean, " + ", ".join(f"round(quantile_cont(m, {q}), 9) AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75)) + " FROM m GROUP BY 1")
def a24_calibration_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration_by_level(_calibrated(spark, sf_dir), "p", "m")
    return out.select("level", "n", *[F.round(c, 9).alias(c) for c in ("mean", "p25", "p50", "p75")])


@query(FACTS_SQL + ", q AS (SELECT ch, sum(eq) AS e, sum(qlen) AS d, avg(np) + 5 AS p FROM facts GROUP BY ch HAVING sum(qlen) > 10000), x AS (SELECT p, -10 * log10(1 - e / d) AS m FROM q) SELECT round(avg((p - m) * (p - m)), 6) AS mse, round(avg(abs(p - m)), 6) AS mae, round(median(abs(p - m)), 6) AS med_ae, round(avg(2 * abs(p - m) / (abs(p) + abs(m))), 9) AS smape FROM x")
def a25_base_quality_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _facts(spark, sf_dir).groupBy("ch").agg(F.sum("eq").alias("e"), F.sum("qlen").alias("d"), (F.avg("np") + 5).alias("p")).where("d > 10000")
    off = F.col("p") - F.col("m")
    pairs = grouped.select("p", S.phred(S.rate("e", "d")).alias("m"))
    out = pairs.agg(F.round(F.avg(off * off), 6).alias("mse"), F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.avg(2 * F.abs(off) / (F.abs("p") + F.abs("m"))), 9).alias("smape"))
    return with_quantiles(out, pairs.select(F.abs(off).alias("off")), [], {"med_ae": ("off", 0.5)}).withColumn("med_ae", F.round("med_ae", 6))


@query(FACTS_SQL + f" SELECT tag, list_transform(quantile_cont({_ID}, [0.05, 0.5, 0.95]), lambda x: round(x, 9)) AS points FROM facts GROUP BY tag")
def a26_identity_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(_facts(spark, sf_dir), ["tag"], {"p5": ("identity", 0.05), "p50": ("identity", 0.5), "p95": ("identity", 0.95)})
    return found.select("tag", F.array(*[F.round(c, 9) for c in ("p5", "p50", "p95")]).alias("points"))


@query(FACTS_SQL + ", k AS (SELECT base, true_cnt, called, count(*) AS n FROM facts WHERE called > 0 GROUP BY ALL) SELECT base || true_cnt AS key, called, n, round(n / sum(n) OVER (PARTITION BY base, true_cnt), 9) AS ratio FROM k")
def a29_run_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _facts(spark, sf_dir).where("called > 0").withColumn("key", F.concat("base", F.col("true_cnt").cast("string")))
    return summary.share_of(keyed, ["key", "called"], within=["key"]).withColumn("ratio", F.round("ratio", 9))


_MODEL = FACTS_SQL + """, model AS (SELECT called, true_cnt, count(*) / sum(count(*)) OVER (PARTITION BY true_cnt) AS ratio FROM facts GROUP BY called, true_cnt),
  obs AS (SELECT qname, called FROM facts), cand AS (SELECT DISTINCT true_cnt FROM model),
  scored AS (SELECT qname, c.true_cnt, sum(coalesce(ln(m.ratio), -100.0)) AS score FROM obs CROSS JOIN cand c LEFT JOIN model m ON m.called = obs.called AND m.true_cnt = c.true_cnt GROUP BY qname, c.true_cnt),
  w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qname)) AS weight FROM scored), p AS (SELECT qname, true_cnt, weight / sum(weight) OVER (PARTITION BY qname) AS posterior FROM w)"""


@query(_MODEL + " SELECT qname, true_cnt, round(posterior, 6) AS posterior FROM p WHERE posterior > 0.01")
def a30_repeat_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    model = summary.share_of(facts, ["called", "true_cnt"], within=["true_cnt"]).select("called", "true_cnt", "ratio")
    found = metrics.likeliest(facts.select("qname", "called"), model, item="qname", key="called", candidate="true_cnt", ratio="ratio")
    return found.where("posterior > 0.01").select("qname", "true_cnt", F.round("posterior", 6).alias("posterior"))


@query(FACTS_SQL + ", p AS (SELECT (eq * 100 // qlen)::BIGINT AS a, (ins * 10)::BIGINT AS b FROM facts), s AS (SELECT 'identity' AS name, a AS bin FROM p UNION ALL SELECT 'coverage', b FROM p UNION ALL SELECT 'product', a * b // 100 FROM p), c AS (SELECT name, bin, count(*) AS n FROM s GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, bin) <= 5")
def a39_top_percent_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _facts(spark, sf_dir).select(F.floor(F.col("eq") * 100 / F.col("qlen")).alias("identity"), (F.col("ins") * 10).alias("coverage"))
    tall = p.withColumn("product", F.floor(F.col("identity") * F.col("coverage") / 100)).unpivot([], ["identity", "coverage", "product"], "name", "bin")
    return summary.top_k(tall.groupBy("name", "bin").agg(F.count(F.lit(1)).alias("n")), ["name"], [F.desc("n"), F.col("bin")], 5).drop("place")


@query("SELECT event_type AS run, (floor(value / 5) * 5)::BIGINT AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 9) AS share FROM events WHERE value < 100 GROUP BY 1, 2")
def a46_histogram_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value < 100").select(F.col("event_type").alias("run"), (F.floor(F.col("value") / 5) * 5).alias("bucket"))
    return summary.share_of(events, ["run", "bucket"], within=["run"]).select("run", "bucket", "n", F.round("ratio", 9).alias("share"))


@query(FACTS_SQL + _CONFUSION + ", w AS (SELECT * FROM r WHERE x > 0.15 AND x < 0.3 AND called <> true_cnt) SELECT base, called - true_cnt AS off, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY base), 9) AS probability FROM w GROUP BY 1, 2")
def a51_ratio_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(_facts(spark, sf_dir), ["base", "true_cnt"], "called", "eq", tag="tag").where("ratio > 0.15 and ratio < 0.3 and called <> true_cnt")
    off = out.withColumn("off", F.col("called") - F.col("true_cnt"))
    return summary.share_of(off, ["base", "off"], within=["base"]).select("base", "off", "n", F.round("ratio", 9).alias("probability"))


@query(FACTS_SQL + ", c AS (SELECT ch, base, true_cnt, called, count(*) AS n FROM facts GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY ch, base, true_cnt) AS x FROM c) SELECT base, true_cnt, called, count(*) AS n, round(median(x), 9) AS median, list_transform(quantile_cont(x, [0.05, 0.95]), lambda v: round(v, 9)) AS ends FROM r WHERE abs(called - true_cnt) <= 2 GROUP BY ALL")
def a52_ratio_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_channel = summary.share_of(_facts(spark, sf_dir), ["ch", "base", "true_cnt", "called"], within=["ch", "base", "true_cnt"]).where("abs(called - true_cnt) <= 2")
    by = ["base", "true_cnt", "called"]
    out = with_quantiles(per_channel.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), per_channel, by, {"low": ("ratio", 0.05), "median": ("ratio", 0.5), "high": ("ratio", 0.95)})
    return out.select(*by, "n", F.round("median", 9).alias("median"), F.array(F.round("low", 9), F.round("high", 9)).alias("ends"))


@query(FACTS_SQL + ", c AS (SELECT qname, base, count(*) FILTER (called = true_cnt - 1) AS less, count(*) FILTER (called = true_cnt) AS same, count(*) AS n FROM facts GROUP BY qname, base), d AS (SELECT base, (less - same) / n AS delta FROM c WHERE less > 0 AND same > 0) SELECT base, least(20, greatest(0, floor((delta + 1) * 10)))::BIGINT AS bin, count(*) AS k FROM d GROUP BY 1, 2")
def a53_delta_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("called") == F.col("true_cnt") - 1, "less").when(F.col("called") == F.col("true_cnt"), "same").otherwise("rest")
    wide = _facts(spark, sf_dir).withColumn("kind", kind).groupBy("qname", "base").pivot("kind", ["less", "same", "rest"]).agg(F.count(F.lit(1))).where("less > 0 and same > 0")
    delta = wide.withColumn("delta", (F.col("less") - F.col("same")) / (F.col("less") + F.col("same") + F.coalesce("rest", F.lit(0))))
    return delta.groupBy("base", filters.clamp(F.floor((F.col("delta") + 1) * 10), 0, 20).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("k"))


@query(FACTS_SQL + " SELECT ch, base, true_cnt, called, count(*) AS n FROM facts WHERE abs(called - true_cnt) <= 1 GROUP BY ALL")
def a54_facts_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("abs(called - true_cnt) <= 1").groupBy("ch", "base", "true_cnt", "called").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT event_type AS metric, ts::DATE AS epoch, event_id AS step, value FROM events WHERE event_id % 7 < 5), e AS (SELECT metric, epoch, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT metric, n, count(*) AS k FROM e GROUP BY ALL),
  g AS (SELECT metric, CASE WHEN arg_min(n, (-k, n)) = 1 AND sum(k) FILTER (n = 1) / sum(k) > 0.8 THEN 'epoch' ELSE 'step' END AS granularity FROM m GROUP BY metric)
  SELECT t.metric, any_value(granularity) AS granularity, max(step) AS steps, count(DISTINCT epoch) AS epochs, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, arg_max(value, step) AS final FROM t JOIN g USING (metric) GROUP BY t.metric""")
def a55_log_by_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").where("event_id % 7 < 5").select(F.col("event_type").alias("metric"), F.to_date("ts").alias("epoch"), F.col("event_id").alias("step"), "value")
    return summary.log_summary(log).withColumn("mean", F.round("mean", 6))


@query("WITH t AS (SELECT user_id, event_type AS metric, event_id AS step, value FROM events) SELECT metric, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, arg_max(value, step) AS final FROM t GROUP BY metric")
def a55_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")
    return log.groupBy("metric").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", "step").alias("final"))


@query(FACTS_SQL + ", d AS (SELECT *, ts::DATE AS day, min(ch) OVER (PARTITION BY ts::DATE) AS first_ch FROM facts), k AS (SELECT day, base, tag, called, count(*) AS n FROM d WHERE ch = first_ch GROUP BY ALL) SELECT day, base, tag, called, round(n / sum(n) OVER (PARTITION BY day, base, tag), 9) AS ratio FROM k")
def a56_trend_of_first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _facts(spark, sf_dir).withColumn("day", F.to_date("ts"))
    first = days.withColumn("first_ch", F.min("ch").over(Window.partitionBy("day"))).where("ch = first_ch")
    return summary.share_of(first, ["day", "base", "tag", "called"], within=["day", "base", "tag"]).select("day", "base", "tag", "called", F.round("ratio", 9).alias("ratio"))


@query(FACTS_SQL + f", c AS (SELECT ch, sum(eq) / {_SPAN} AS identity, sum(ins) / {_SPAN} AS nh_ins FROM facts GROUP BY ch) SELECT ch, round(identity, 9) AS identity, round(nh_ins, 9) AS nh_ins FROM c WHERE identity > 0.88 AND nh_ins > 0.003 ORDER BY nh_ins DESC, ch LIMIT 10")
def a61_screen_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.rates_by(_facts(spark, sf_dir).drop("identity"), ["ch"]).select("ch", "identity", "nh_ins")
    return rates.where("identity > 0.88 and nh_ins > 0.003").orderBy(F.desc("nh_ins"), "ch").limit(10)


@query("SELECT p_type, split_part(p_name, ' ', -1) AS last, count(*) AS n FROM part WHERE starts_with(p_type, 'S') GROUP BY ALL")
def a62_prefix_and_last_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").startswith("S")).groupBy("p_type", F.element_at(F.split("p_name", " "), -1).alias("last")).agg(F.count(F.lit(1)).alias("n"))


@query(FACTS_SQL + " SELECT qname, seg, called FROM facts WHERE abs(called - true_cnt) <= 1 AND true_cnt >= 1")
def f09_near_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("abs(called - true_cnt) <= 1 and true_cnt >= 1").select("qname", "seg", "called")


@query(FACTS_SQL + " SELECT qname, seg, CASE WHEN ins / qlen < 0.01 AND (del / qlen < 0.01 OR (del / qlen > 0.9 AND diff < 20)) THEN eq ELSE qlen END AS covered FROM facts")
def f10_valid_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = S.rate("ins", "qlen"), S.rate("del", "qlen")
    return _facts(spark, sf_dir).select("qname", "seg", F.when((q < 0.01) & ((r < 0.01) | ((r > 0.9) & (F.col("diff") < 20))), F.col("eq")).otherwise(F.col("qlen")).alias("covered"))


@query(FACTS_SQL + " SELECT qname, seg, least(greatest(called, true_cnt - 1), true_cnt + 1) AS clamped, least(greatest(qlen, 100), 500) AS clipped FROM facts")
def f15_f16_clamp_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("qname", "seg", filters.clamp("called", F.col("true_cnt") - 1, F.col("true_cnt") + 1).alias("clamped"), filters.clamp("qlen", 100, 500).cast("long").alias("clipped"))


@query(FACTS_SQL + " SELECT homo_ins, homo_del, count(*) AS n FROM facts GROUP BY ALL")
def f17_columns_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    homo = facts.select(facts.colRegex("`^homo_.*$`"))
    return homo.groupBy(*homo.columns).agg(F.count(F.lit(1)).alias("n"))
