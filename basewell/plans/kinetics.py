"""Kinetics of per-base arrays (B-10 to B-16 and A-14 to A-16). A base's values are rules on its letter and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import alignment, kinetics, summary
from basewell.operators.ordered import with_quantiles
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import ALN_SQL, SUBREADS_SQL, table

_K = SUBREADS_SQL + """, k AS (SELECT ch || '/' || turn AS qname, ch, seq, list_transform(range(length(seq)), lambda i: 1 + (i * 7 + ch) % 40) AS dw, list_transform(range(length(seq)), lambda i: 2 + (i * 3 + ch) % 25) AS ar FROM subreads),
  pos AS (SELECT qname, ch, seq, dw, ar, unnest(range(length(seq))) AS i FROM k), per AS (SELECT qname, ch, substr(seq, i + 1, 1) AS base, dw[i + 1] AS dw, ar[i + 1] AS ar FROM pos),
  bases AS (SELECT k.qname, b.base, coalesce(c.n, 0) AS base_cnt, coalesce(c.dw, 0)::BIGINT AS dw_sum, coalesce(c.ar, 0)::BIGINT AS ar_sum FROM k CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b
    LEFT JOIN (SELECT qname, base, count(*) AS n, sum(dw) AS dw, sum(ar) AS ar FROM per GROUP BY ALL) c ON c.qname = k.qname AND c.base = b.base)"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    subs = views.subreads(spark, sf_dir).select(F.concat_ws("/", "ch", "turn").alias("qname"), "ch", "seq")
    return subs.withColumns({"dw": F.transform(places, lambda i: 1 + (i * 7 + F.col("ch")) % 40), "ar": F.transform(places, lambda i: 2 + (i * 3 + F.col("ch")) % 25)})


@query(_K + " SELECT * FROM bases")
def b10_base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinetics.base_table(_reads(spark, sf_dir))


@query(_K + " SELECT base, round(avg(dw), 9) AS dw_mean, round(avg(ar), 9) AS ar_mean, median(dw)::DOUBLE AS dw_median, round(count(*) / (sum(dw + ar) * 0.002), 9) AS speed FROM per GROUP BY base")
def b11_b12_kinetics_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    each = _reads(spark, sf_dir).select(F.inline(F.arrays_zip(letters.alias("base"), F.col("dw"), F.col("ar"))))
    return each.groupBy("base").agg(F.round(F.avg("dw"), 9).alias("dw_mean"), F.round(F.avg("ar"), 9).alias("ar_mean"), F.median("dw").alias("dw_median"), F.round(kinetics.speed(F.count(F.lit(1)), F.sum(F.col("dw") + F.col("ar"))), 9).alias("speed"))


def _ends(c: str, part: str, what: str) -> str:
    source = f"{c}[2:50]" if part == "first" else f"{c}[greatest(len({c}) - 50, 1) + 1:]"
    return f"round(list_{'median' if what == 'median' else 'avg'}({source}), 9) AS {c}_{part}_{what}"


@query(_K + " SELECT qname, " + ", ".join(_ends(c, p, w) for c in ("dw", "ar") for p in ("first", "last") for w in ("median", "mean")) + " FROM k WHERE length(seq) >= 20")
def b13_head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinetics.ends_table(_reads(spark, sf_dir).where(F.length("seq") >= 20), ["dw", "ar"], 50, ["qname"])
    return out.select("qname", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(_K + ", o AS (SELECT qname, dw, row_number() OVER (ORDER BY len(dw), qname) AS place, count(*) OVER () AS n FROM k) SELECT qname, dw[1:5] AS head FROM o WHERE len(dw) >= (SELECT quantile_disc(len(dw), 0.9) FROM k)")
def b14_longest_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).select("qname", "dw", F.size("dw").alias("n"))
    limit = reads.select(F.expr("percentile_disc(0.9) within group (order by n)").cast("int").alias("least"))
    return reads.join(F.broadcast(limit), F.col("n") >= F.col("least")).select("qname", F.slice("dw", 1, 5).alias("head"))


@query(SUBREADS_SQL + ", c AS (SELECT ch, count(*) AS passes, sum(length(seq)) AS bases, sum(cx) AS cx FROM subreads GROUP BY ch) SELECT ch, least(passes, 4) AS np, bases::BIGINT AS bases, round(cx / (passes * 3), 9) AS concordance, round(-10 * log10(1 - least(cx / (passes * 3), 1 - 1e-6)), 6) AS qv FROM c WHERE passes >= 2")
def b15_channel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = views.subreads(spark, sf_dir).groupBy("ch").agg(F.count(F.lit(1)).alias("passes"), F.sum(F.length("seq")).alias("bases"), S.rate(F.sum("cx"), F.count(F.lit(1)) * 3).alias("c")).where("passes >= 2")
    return channels.select("ch", F.least("passes", F.lit(4)).cast("long").alias("np"), "bases", F.round("c", 9).alias("concordance"), F.round(S.phred("c", cap=1 - 1e-6), 6).alias("qv"))


@query(ALN_SQL + """, refs AS (SELECT qname, regexp_extract_all(rseq, 'A+|C+|G+|T+') AS parts FROM alignments), each AS (SELECT qname, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM refs),
  qs AS (SELECT qname, regexp_extract_all(seq, 'A+|C+|G+|T+') AS parts FROM alignments), qeach AS (SELECT qname, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM qs),
  rp AS (SELECT qname, left(part, 1) AS base, length(part) AS n, sum(length(part)) OVER (PARTITION BY qname ORDER BY k) - length(part) AS a FROM each), qp AS (SELECT qname, length(part) AS n, sum(length(part)) OVER (PARTITION BY qname ORDER BY k) - length(part) AS a FROM qeach),
  j AS (SELECT r.base || r.n AS key, q.n AS query_run FROM rp r JOIN aln x ON x.qname = r.qname AND x.rpos = r.a AND x.op = '=' JOIN qp q ON q.qname = r.qname AND x.qpos >= q.a AND x.qpos < q.a + q.n WHERE r.n > 1 AND abs(q.n - r.n) <= 1)
  SELECT key, query_run, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY key), 9) AS ratio FROM j GROUP BY key, query_run""")
def b16_run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.run_pairs(views.alignments(spark, sf_dir).drop("qual")).where("abs(n_query - n_ref) <= 1")
    pairs = found.select(F.concat("base", "n_ref").alias("key"), F.col("n_query").cast("long").alias("query_run"))
    return summary.share_of(pairs, ["key", "query_run"], within=["key"]).withColumn("ratio", F.round("ratio", 9))


@query(_K + " SELECT base, round(2 * sum(dw_sum) / sum(base_cnt), 9) AS dw_ms, round(2 * sum(ar_sum) / sum(base_cnt), 9) AS ar_ms, round(sum(base_cnt) / (2 * sum(dw_sum + ar_sum) * 0.001), 9) AS speed FROM bases GROUP BY base")
def a14_kinetic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, dw, ar = F.sum("base_cnt"), F.sum("dw_sum"), F.sum("ar_sum")
    return kinetics.base_table(_reads(spark, sf_dir)).groupBy("base").agg(F.round(2 * S.rate(dw, n), 9).alias("dw_ms"), F.round(2 * S.rate(ar, n), 9).alias("ar_ms"), F.round(S.rate(n, 2 * (dw + ar) * 0.001), 9).alias("speed"))


@query(_K + ", r AS (SELECT qname, sum(base_cnt) AS n, sum(dw_sum) AS dw, sum(ar_sum) AS ar FROM bases GROUP BY qname) SELECT qname, n::BIGINT AS n, round(dw / n, 9) AS dw, round(ar / n, 9) AS ar FROM r WHERE n > 0 ORDER BY md5('0:' || qname) LIMIT 10000")
def a15_sampled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = kinetics.base_table(_reads(spark, sf_dir)).groupBy("qname").agg(F.sum("base_cnt").alias("n"), F.sum("dw_sum").alias("dw"), F.sum("ar_sum").alias("ar")).where("n > 0")
    return summary.seeded_sample(reads, "qname", 10_000).select("qname", "n", F.round(F.col("dw") / F.col("n"), 9).alias("dw"), F.round(F.col("ar") / F.col("n"), 9).alias("ar"))


@query(_K + ", e AS (SELECT list_avg(dw[2:50]) AS a, list_median(dw[greatest(len(dw) - 50, 1) + 1:]) AS b FROM k WHERE length(seq) >= 20) SELECT round(avg(a), 9) AS head_mean, round(median(a), 9) AS head_median, round(stddev_samp(a), 9) AS head_sd, round(avg(b), 9) AS tail_mean, round(median(b), 9) AS tail_median, round(stddev_samp(b), 9) AS tail_sd FROM e")
def a16_end_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = kinetics.ends_table(_reads(spark, sf_dir).where(F.length("seq") >= 20), ["dw"], 50, ["qname"])
    sides = {"head": "dw_first_mean", "tail": "dw_last_median"}
    out = ends.agg(*[f(c).alias(f"{w}_{n}") for w, c in sides.items() for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    out = with_quantiles(out, ends, [], {f"{w}_median": (c, 0.5) for w, c in sides.items()})
    return out.select([F.round(c, 9).alias(c) for c in out.columns])


#: Reads of three runs with all kinetics; every seventh turn lacks its arrays and values.
_RUN = SUBREADS_SQL + """, kin AS (SELECT ch || '/' || turn AS qname, 'run' || ch % 3 AS run, seq, turn % 7 = 5 AS bare, length(seq) AS n, (ch * 7 + turn) % 40 / 4 AS cq, (ch * 3 + turn * 11) % 50 / 4 AS oe, ch FROM subreads),
  spots AS (SELECT *, unnest(range(n)) AS i FROM kin),
  each AS (SELECT run, qname, substr(seq, i + 1, 1) AS base, CASE WHEN bare THEN -1 ELSE 2 * (1 + (i * 7 + ch) % 40) END AS dw, CASE WHEN bare THEN -1 ELSE 2 * (2 + (i * 3 + ch) % 25) END AS ar, CASE WHEN bare THEN -1 ELSE (i * 5 + ch) % 9 / 8 END AS cr FROM spots)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch, turn = F.col("ch"), F.col("turn")
    bare = turn % 7 == 5
    subs = views.subreads(spark, sf_dir)
    places = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    array = lambda f: F.when(~bare, F.transform(places, f))
    return subs.select(
        F.concat_ws("/", "ch", "turn").alias("qname"), F.concat(F.lit("run"), ch % 3).alias("run"), "seq", array(lambda i: 1 + (i * 7 + ch) % 40).alias("dw"), array(lambda i: 2 + (i * 3 + ch) % 25).alias("ar"),
        array(lambda i: (i * 5 + ch) % 9 / 8).alias("cr"), F.when(~bare, (ch * 7 + turn) % 40 / 4).alias("cq"), F.when(~bare, (ch * 3 + turn * 11) % 50 / 4).alias("oe"),
    )


@query(_RUN + """, b AS (SELECT run, avg(dw) AS "dw-mean", avg(ar) AS "ar-mean", avg(cr) AS "cr-mean", count(*) / (sum(dw + ar) * 0.001) AS "speed", """ + ", ".join(f"""avg({c}) FILTER (base = '{x}') AS "{c}-mean-{x}\"""" for c in ("dw", "ar") for x in "ACGT") + """ FROM each GROUP BY run),
  r AS (SELECT run, avg(CASE WHEN bare THEN -1 ELSE cq END) AS "cq-mean", median(CASE WHEN bare THEN -1 ELSE oe END) AS "oe-median", median(n) AS "readlen-median" FROM kin GROUP BY run)
  SELECT run, name, round(value, 9) AS value FROM (UNPIVOT (SELECT run, COLUMNS(* EXCLUDE (run))::DOUBLE FROM b JOIN r USING (run)) ON COLUMNS(* EXCLUDE (run)) INTO NAME name VALUE value)""")
def b11_run_kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinetics.run_kinetics(_runs(spark, sf_dir), ["run"]).withColumn("value", F.round("value", 9))


@query(_RUN + """, m AS (SELECT run, qname, avg(dw) AS dw, avg(ar) AS ar FROM each GROUP BY run, qname), s AS (SELECT k.run, k.qname, coalesce(m.dw, -1) AS dw, coalesce(m.ar, -1) AS ar, n AS length FROM kin k LEFT JOIN m USING (run, qname))
  SELECT run, qname, round(dw, 9)::DOUBLE AS dw, round(ar, 9)::DOUBLE AS ar, length::INT AS length FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY md5('0:' || qname), qname) <= 5000""")
def b11_sampled_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinetics.sampled_channels(_runs(spark, sf_dir), ["run"]).withColumns({"dw": F.round("dw", 9), "ar": F.round("ar", 9)})


@query(_RUN + """, g AS (SELECT qname, base, count(*) AS n, sum(dw) AS dw, sum(ar) AS ar, sum(cr) AS cr FROM each GROUP BY qname, base), reads AS (SELECT avg(CASE WHEN bare THEN -1 ELSE cq END) AS cq, median(CASE WHEN bare THEN -1 ELSE oe END) AS oe FROM kin),
  t AS (SELECT base, n, dw, ar, cr FROM g UNION ALL SELECT 'all', n, dw, ar, cr FROM g)
  SELECT base, sum(n)::BIGINT AS n, round(sum(dw) / sum(n), 9)::DOUBLE AS dw_ms, round(sum(ar) / sum(n), 9)::DOUBLE AS ar_ms, round(sum(cr) / sum(n), 9)::DOUBLE AS cr, round(sum(n) / (sum(dw + ar) * 0.001), 9)::DOUBLE AS speed,
    CASE WHEN base = 'all' THEN (SELECT round(cq, 9) FROM reads) END::DOUBLE AS cq, CASE WHEN base = 'all' THEN (SELECT oe FROM reads) END::DOUBLE AS oe FROM t GROUP BY base""")
def a14_kinetic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14 with capture rate, quality and evidence, from the base table's sums."""
    reads = _runs(spark, sf_dir)
    missing = lambda c: F.coalesce(c, F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1))), lambda _: F.lit(-1.0)))
    ms = reads.withColumns({c: missing(F.transform(c, lambda v: v.cast("double") * k)) for c, k in (("dw", 2), ("ar", 2), ("cr", 1))})  # noqa: B023
    sums = kinetics.base_table(ms, arrays=("dw", "ar", "cr")).where("base_cnt > 0")
    both = sums.withColumn("base", F.explode(F.array(F.col("base"), F.lit("all"))))
    n, dw, ar, cr = (F.sum(c) for c in ("base_cnt", "dw_sum", "ar_sum", "cr_sum"))
    out = both.groupBy("base").agg(n.alias("n"), *[F.round(v, 9).alias(c) for c, v in (("dw_ms", S.rate(dw, n)), ("ar_ms", S.rate(ar, n)), ("cr", S.rate(cr, n)), ("speed", S.rate(n, (dw + ar) * 0.001)))])
    values = reads.select(F.lit("all").alias("base"), *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in ("cq", "oe")])
    whole = with_quantiles(values.groupBy("base").agg(F.round(F.avg("cq"), 9).alias("cq")), values, ["base"], {"oe": ("oe", 0.5)})
    return out.join(whole, "base", "left")


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS median FROM events GROUP BY user_id")
def b12_run_level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    by_user = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return with_quantiles(by_user, events, ["user_id"], {"median": ("value", 0.5)})
