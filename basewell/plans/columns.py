"""Voting over the columns view (M series, B-25 and A-57)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import joins, reinsert, summary, voting
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import COLUMNS_SQL, SAMPLES_SQL, table
from basewell.sources.scratch import materialize

_N = "len(list_filter(subs, lambda b: b <> '-'))"
_PCT = "100.0 * len(list_filter(subs, lambda b: b = {0})) / nullif(" + _N + ", 0)"
_WRONG = COLUMNS_SQL + f""", pct AS (SELECT *, {_PCT.format("smc")} AS smc_pct, {_PCT.format("ref")} AS ref_pct FROM cols WHERE smc <> ref AND smc <> '-' AND ref <> '-'),
  wrong AS (SELECT *, CASE WHEN ref_pct >= 75 AND smc_pct < 25 THEN 'ref_support' WHEN smc_pct >= 75 AND ref_pct < 25 THEN 'smc_support' ELSE 'ambiguous' END AS verdict FROM pct)"""


def _cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.columns(views.columns(spark, sf_dir))


@query(_WRONG + " SELECT rec, verdict, count(*) AS n, round(avg(smc_pct), 6) AS smc_pct, round(avg(ref_pct), 6) AS ref_pct FROM wrong GROUP BY ALL")
def m01_mismatch_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.mismatches(_cols(spark, sf_dir)).groupBy("rec", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("smc_pct"), 6).alias("smc_pct"), F.round(F.avg("ref_pct"), 6).alias("ref_pct"))


_INDELS = COLUMNS_SQL + f""", one AS (SELECT *, CASE WHEN smc = '-' THEN 'del_in_smc' ELSE 'ins_in_smc' END AS kind, 100.0 * {_N} / len(subs) AS base_pct FROM cols WHERE (smc = '-') <> (ref = '-')),
  p AS (SELECT *, CASE WHEN kind = 'ins_in_smc' THEN base_pct ELSE 100 - base_pct END AS pct FROM one), indels AS (SELECT *, CASE WHEN pct >= 75 THEN 'smc_support' WHEN pct < 25 THEN 'ref_support' ELSE 'ambiguous' END AS verdict FROM p)"""


@query(_INDELS + " SELECT kind, verdict, count(*) AS n, round(avg(base_pct), 6) AS base_pct FROM indels GROUP BY ALL")
def m02_indel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.indels(_cols(spark, sf_dir)).groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("base_pct"), 6).alias("base_pct"))


@query(_WRONG + " SELECT ref, smc, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio, ref || smc IN ('AG', 'GA', 'CT', 'TC') AS transition FROM wrong GROUP BY ref, smc")
def m03_error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.error_matrix(voting.mismatches(_cols(spark, sf_dir))).withColumn("ratio", F.round("ratio", 9))


@query(_WRONG + ", i AS (SELECT rec, avg((smc = ref)::INT) AS identity FROM cols GROUP BY rec), s AS (SELECT rec, identity, CASE WHEN identity < 0.94 THEN 'low' WHEN identity < 0.98 THEN 'middle' ELSE 'high' END AS stratum FROM i) SELECT stratum, count(DISTINCT s.rec) AS records, round(min(identity), 9) AS least, round(max(identity), 9) AS most, count(w.rec) AS errors, coalesce(count_if(w.verdict = 'ref_support'), 0) AS ref_support FROM s LEFT JOIN wrong w USING (rec) GROUP BY stratum")
def m04_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = _cols(spark, sf_dir)
    identity = cols.groupBy("rec").agg(F.avg((F.col("smc") == F.col("ref")).cast("double")).alias("identity"))
    strata = identity.withColumn("stratum", F.when(F.col("identity") < 0.94, "low").when(F.col("identity") < 0.98, "middle").otherwise("high"))
    errors = voting.mismatches(cols).groupBy("rec").agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("verdict") == "ref_support").alias("ref_support"))
    joined = strata.join(errors, "rec", "left").fillna(0, ["errors", "ref_support"])
    return joined.groupBy("stratum").agg(F.count(F.lit(1)).alias("records"), F.round(F.min("identity"), 9).alias("least"), F.round(F.max("identity"), 9).alias("most"), F.sum("errors").alias("errors"), F.sum("ref_support").alias("ref_support"))


_ISLANDS = COLUMNS_SQL + """, f AS (SELECT *, coalesce(lag(ref) OVER w <> ref, true)::INT AS fresh, CASE WHEN smc = '-' OR ref = '-' THEN pos END AS g FROM cols WINDOW w AS (PARTITION BY rec ORDER BY pos)),
  k AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY pos) AS island, pos - last_value(g IGNORE NULLS) OVER (PARTITION BY rec ORDER BY pos) AS before,
    first_value(g IGNORE NULLS) OVER (PARTITION BY rec ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos AS after FROM f),
  r AS (SELECT *, count(*) OVER (PARTITION BY rec, island) AS run, least(before, after) AS distance FROM k)"""


@query(_ISLANDS + " SELECT CASE WHEN distance <= 5 THEN 'near_gap' WHEN run >= 5 THEN 'homopolymer' ELSE 'true_error' END AS origin, count(*) AS n FROM r WHERE smc <> ref AND smc <> '-' AND ref <> '-' GROUP BY 1")
def m05_error_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.provenance(views.columns(spark, sf_dir)).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(_WRONG + " SELECT rec, count_if(verdict = 'smc_support') AS n, round(avg(smc_pct), 6) AS confidence FROM wrong GROUP BY rec ORDER BY n DESC, rec LIMIT 20")
def m06_top_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_record = voting.mismatches(_cols(spark, sf_dir)).groupBy("rec").agg(F.count_if(F.col("verdict") == "smc_support").alias("n"), F.round(F.avg("smc_pct"), 6).alias("confidence"))
    return per_record.orderBy(F.desc("n"), "rec").limit(20)


@query(_INDELS + " SELECT CASE WHEN ref = '-' THEN smc ELSE ref END AS base, CASE WHEN CASE WHEN ref = '-' THEN smc ELSE ref END IN ('G', 'C') THEN 'strong' ELSE 'weak' END AS bond, kind, count(*) AS n FROM indels GROUP BY ALL")
def m07_gap_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("ref") == "-", F.col("smc")).otherwise(F.col("ref"))
    biased = voting.indels(_cols(spark, sf_dir)).select(base.alias("base"), F.when(base.isin("G", "C"), "strong").otherwise("weak").alias("bond"), "kind")
    return biased.groupBy("base", "bond", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(COLUMNS_SQL + f", g AS (SELECT ref, 1 - {_N} / len(subs) AS gap_ratio, smc = '-' AS called_gap FROM cols WHERE ref <> '-') SELECT least(floor(gap_ratio * 20), 19)::BIGINT AS bin, called_gap, count(*) AS n, count_if((gap_ratio >= 0.5) = called_gap) AS agree FROM g GROUP BY 1, 2")
def m08_gap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = 1 - F.size(F.filter("subs", lambda b: b != "-")) / F.size("subs")
    gaps = _cols(spark, sf_dir).where("ref <> '-'").select(ratio.alias("gap_ratio"), (F.col("smc") == "-").alias("called_gap"))
    return gaps.groupBy(F.least(F.floor(F.col("gap_ratio") * 20), F.lit(19)).cast("long").alias("bin"), "called_gap").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("gap_ratio") >= 0.5) == F.col("called_gap")).alias("agree"))


@query(COLUMNS_SQL + f""", c AS (SELECT *, smc = '-' AND ref <> '-' AS gap, 1 - {_N} / len(subs) AS gap_ratio, CASE WHEN ref = '-' THEN pos END AS g FROM cols),
  k AS (SELECT *, coalesce(sum(gap::INT) OVER (PARTITION BY rec ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS gaps_before,
    least(pos - last_value(g IGNORE NULLS) OVER (PARTITION BY rec ORDER BY pos), first_value(g IGNORE NULLS) OVER (PARTITION BY rec ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos) AS d FROM c)
  SELECT CASE WHEN gap_ratio >= 0.7 THEN 'true_deletion' WHEN gaps_before >= 3 THEN 'offset_artefact' WHEN d <= 5 THEN 'local_gap' ELSE 'residual' END AS kind, round(gap_ratio, 6) AS gap_ratio, count(*) AS n FROM k WHERE gap GROUP BY ALL""")
def m09_gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.gap_classes(_cols(spark, sf_dir)).groupBy("kind", F.round("gap_ratio", 6).alias("gap_ratio")).agg(F.count(F.lit(1)).alias("n"))


@query(COLUMNS_SQL + """, g AS (SELECT *, unnest(range(length(smc))) AS pos FROM msa), b AS (SELECT *, substr(ref, pos + 1, 1) AS base, replace(substr(ref, 1, pos), '-', '') AS l, replace(substr(ref, pos + 2), '-', '') AS r,
    100.0 * ((substr(s1, pos + 1, 1) = '-')::INT + (substr(s2, pos + 1, 1) = '-')::INT + (substr(s3, pos + 1, 1) = '-')::INT + (substr(s4, pos + 1, 1) = '-')::INT) / 4 AS share FROM g WHERE substr(smc, pos + 1, 1) = '-' AND substr(ref, pos + 1, 1) <> '-'),
  k AS (SELECT base, 1 + length(l) - length(rtrim(l, base)) + length(r) - length(ltrim(r, base)) AS run, least(floor(share / 5), 19)::BIGINT AS bin FROM b),
  t AS (SELECT 'all' AS key, bin FROM k UNION ALL SELECT base || '(' || CASE WHEN run < 2 THEN 'no_HP' ELSE run::VARCHAR END || ')', bin FROM k), c AS (SELECT key, bin, count(*) AS n FROM t GROUP BY ALL),
  p AS (SELECT *, sum(n) OVER (PARTITION BY key)::BIGINT AS n_positions FROM c), q AS (SELECT *, round(100.0 * n / n_positions, 1) AS pct FROM p)
  SELECT *, round(sum(pct) OVER (PARTITION BY key ORDER BY bin), 1) AS cum_pct FROM q""")
def m09_gap_ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.gap_ratio_histogram(views.columns(spark, sf_dir))


_FEATURES = COLUMNS_SQL + """, cutoff AS (SELECT rec, smc, ref, [s1, s2, repeat('-', length(s3) // 3) || substr(s3, length(s3) // 3 + 1), left(s4, length(s4) - length(s4) // 4) || repeat('-', length(s4) // 4), repeat('-', length(s1))] AS subs FROM msa),
  spots2 AS (SELECT *, unnest(range(length(smc))) AS pos FROM cutoff), g AS (SELECT *, replace(substr(smc, 1, pos), '-', '') AS l, replace(substr(smc, pos + 2), '-', '') AS r FROM spots2 WHERE substr(smc, pos + 1, 1) = '-'),
  c AS (SELECT rec, pos, nullif(right(l, 1), '') AS lb, nullif(left(r, 1), '') AS rb, length(l) - length(rtrim(l, right(l, 1))) AS lr, length(r) - length(ltrim(r, left(r, 1))) AS rr, substr(ref, pos + 1, 1) <> '-' AS label,
    len(list_filter(subs, lambda s: length(s) - length(ltrim(s, '-')) <= pos AND pos < length(rtrim(s, '-')))) AS depth, len(list_filter(subs, lambda s: substr(s, pos + 1, 1) <> '-')) AS evidence FROM g),
  feats AS (SELECT rec, pos, coalesce(rb, lb) AS base, CASE WHEN lb = rb THEN lr + rr WHEN rb IS NOT NULL THEN rr ELSE lr END AS hp, depth, evidence, evidence / depth AS ratio, label FROM c WHERE evidence > 0 AND coalesce(rb, lb) IS NOT NULL AND evidence / depth >= 0.1)"""


@query(_FEATURES + " SELECT rec, pos::BIGINT AS pos, base, hp, depth::INT AS depth, evidence::INT AS evidence, round(ratio, 9) AS ratio, label FROM feats")
def m10_gap_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.gap_features(_cut_off(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


def _cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns view with a subread that begins late, one that ends early, and one of gaps only."""
    third, quarter = (F.floor(F.length("ref") / n).cast("int") for n in (3, 4))
    s = lambda i: F.get("subs", F.lit(i))
    late = F.concat(F.repeat(F.lit("-"), third), F.substring(s(2), third + 1, F.length("ref")))
    early = F.concat(F.left(s(3), F.length("ref") - quarter), F.repeat(F.lit("-"), quarter))
    return views.columns(spark, sf_dir).withColumn("subs", F.array(s(0), s(1), late, early, F.repeat(F.lit("-"), F.length("ref"))))


@query(_FEATURES + " SELECT base, hp, label, count(*) AS n, round(avg(ratio), 9) AS ratio FROM feats GROUP BY ALL")
def m10_gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.gap_features(_cut_off(spark, sf_dir)).groupBy("base", "hp", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 9).alias("ratio"))


_SAMPLES = """WITH samples AS (SELECT l_partkey % 4 AS base, l_suppkey % 5 AS hp, round(l_discount + l_partkey % 7 / 20, 2) AS ratio, (l_orderkey * 13 + l_partkey * 7) % 10 < 2 + l_partkey % 7 AS label, l_orderkey AS rec FROM lineitem),
  c AS (SELECT base, hp, ratio, count_if(label) AS pos, count(*) AS n FROM samples GROUP BY base, hp, ratio),
  s AS (SELECT *, sum(n) OVER w AS all_n, sum(pos) OVER w AS all_pos, coalesce(sum(pos) OVER a, 0) AS tp, coalesce(sum(n) OVER a, 0) AS called FROM c WINDOW w AS (PARTITION BY base, hp), a AS (PARTITION BY base, hp ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, coalesce(2.0 * tp / nullif(called + all_pos, 0), 0) AS f1 FROM s WHERE all_n >= 10 AND all_pos >= 5),
  t AS (SELECT base, hp, arg_min(ratio, (-f1, ratio)) AS threshold, max(f1) AS f1, any_value(all_n)::BIGINT AS n, any_value(all_pos)::BIGINT AS positives FROM f GROUP BY base, hp)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select((p % 4).alias("base"), (s % 5).alias("hp"), F.round(F.col("l_discount") + p % 7 / 20, 2).alias("ratio"), ((o * 13 + p * 7) % 10 < 2 + p % 7).alias("label"), o.alias("rec"))


@query(_SAMPLES + " SELECT base, hp, threshold, round(f1, 9) AS f1, n, positives FROM t")
def m11_find_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.find_thresholds(_samples(spark, sf_dir), ["base", "hp"]).withColumn("f1", F.round("f1", 9))


_CALLED = _SAMPLES + ", e AS (SELECT s.*, s.ratio > coalesce(threshold, 0.6) AS called FROM samples s LEFT JOIN t USING (base, hp)), q AS (SELECT base, count_if(label AND called) AS tp, count_if(NOT label AND called) AS fp, count_if(label AND NOT called) AS fn, count_if(NOT label AND NOT called) AS tn FROM e GROUP BY base)"


@query(_CALLED + " SELECT base, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM q")
def m12_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    out = voting.evaluate(samples, voting.find_thresholds(samples, ["base", "hp"]), ["base", "hp"], by=["base"])
    return out.select("base", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("WITH di AS (SELECT l_orderkey AS rec, string_agg(l_partkey || ',' || l_returnflag || ',' || l_suppkey || ',' || (l_suppkey + l_linenumber), ';') AS di FROM lineitem GROUP BY l_orderkey), p AS (SELECT rec, string_split(unnest(string_split(di, ';')), ',') AS f FROM di), s AS (SELECT rec, f[1]::BIGINT AS pos, f[2] AS base, f[3]::BIGINT AS support, f[4]::BIGINT AS depth FROM p)"
       " SELECT base, count(*) AS n, round(avg(support / depth), 9) AS share, count_if(rec % 5 = 0) AS validation FROM s GROUP BY base")  # fmt: skip
def m13_tag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat_ws(",", "l_partkey", "l_returnflag", "l_suppkey", F.col("l_suppkey") + F.col("l_linenumber"))
    tags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("rec")).agg(F.array_join(F.collect_list(entry), ";").alias("di"))
    f = F.split(F.col("part"), ",")
    rows = tags.select("rec", F.explode(F.split("di", ";")).alias("part")).select("rec", f[0].cast("long").alias("pos"), f[1].alias("base"), f[2].cast("long").alias("support"), f[3].cast("long").alias("depth"))
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.rate("support", "depth")), 9).alias("share"), F.count_if(F.col("rec") % 5 == 0).alias("validation"))


@query(SAMPLES_SQL + " SELECT qname, refname, pos, base, repeat::BIGINT AS repeat, support, depth, refcoord, cons_run, ref_run, label, insert_cnt, round(pos_frac, 9) AS pos_frac FROM samples")
def m13_labelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).withColumn("pos_frac", F.round("pos_frac", 9))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.tagged(spark, sf_dir)
    return reinsert.labelled_samples(reads, reads.select("refname", "rseq").distinct())


_TRAIN = SAMPLES_SQL + """, named AS (SELECT qname, row_number() OVER (ORDER BY qname) AS place, count(*) OVER () AS names FROM (SELECT DISTINCT qname FROM samples)), parted AS (SELECT s.*, place <= floor(names * (1 - 0.2)) AS train FROM samples s JOIN named USING (qname)),
  t AS (SELECT * FROM parted WHERE train), c AS (SELECT base, repeat, support AS ratio, count_if(label) AS pos, count(*) AS n FROM t GROUP BY ALL),
  w AS (SELECT *, sum(n) OVER w AS all_n, sum(pos) OVER w AS all_pos, coalesce(sum(pos) OVER a, 0) AS tp, coalesce(sum(n) OVER a, 0) AS called FROM c WINDOW w AS (PARTITION BY base, repeat), a AS (PARTITION BY base, repeat ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, coalesce(2.0 * tp / nullif(called + all_pos, 0), 0) AS f1 FROM w WHERE all_n >= 10 AND all_pos >= 5),
  b AS (SELECT base, repeat, arg_min(ratio, (-f1, ratio)) AS best, round(max(f1), 4) AS best_f1 FROM f GROUP BY base, repeat),
  cells AS (SELECT base, repeat, count(*) AS n, count_if(label) AS positives, count_if(NOT label) AS negatives, CASE WHEN count_if(label) > 0 THEN 2 * (count_if(label) / count(*)) / (count_if(label) / count(*) + 1) ELSE 0 END AS all_f1 FROM t GROUP BY base, repeat),
  reasons AS (SELECT cells.*, best, best_f1, CASE WHEN n < 10 THEN 'few samples' WHEN repeat >= 5 AND positives / n >= 0.5 THEN 'long repeat' WHEN positives < 5 THEN 'few positives' WHEN negatives = 0 THEN 'no negatives'
    WHEN positives >= 50 AND best_f1 >= 0.4 AND best_f1 - all_f1 >= 0.1 THEN 'separates' ELSE 'overlaps' END AS reason FROM cells LEFT JOIN b USING (base, repeat)),
  rules AS (SELECT *, CASE reason WHEN 'long repeat' THEN 'long_poly_fixed' WHEN 'separates' THEN 'separable' ELSE 'inseparable' END AS strategy, CASE reason WHEN 'long repeat' THEN 0.2 WHEN 'separates' THEN best END AS threshold,
    CASE reason WHEN 'long repeat' THEN round(all_f1, 4) WHEN 'separates' THEN best_f1 END AS f1 FROM reasons)"""


@query(_TRAIN + " SELECT train, count(*) AS n, count_if(label) AS positives, count(DISTINCT qname) AS reads, min(qname) AS first_read, max(qname) AS last_read FROM parted GROUP BY train")
def m13_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = reinsert.split_by_name(_tagged(spark, sf_dir))
    # Names of a part are counted once each before the parts are.
    names = parted.groupBy("train", "qname").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positives"))
    return names.groupBy("train").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.count(F.lit(1)).alias("reads"), F.min("qname").alias("first_read"), F.max("qname").alias("last_read"))


@query(_TRAIN + " SELECT base, repeat::BIGINT AS repeat, n, positives, negatives, round(all_f1, 9) AS all_f1, best_f1, strategy, reason, threshold, f1 FROM rules")
def m13_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = reinsert.split_by_name(_tagged(spark, sf_dir)).where("train")
    return reinsert.strategies(train).withColumn("all_f1", F.round("all_f1", 9))


@query(_TRAIN + ", v AS (SELECT p.label, p.support > r.threshold AS called, r.threshold IS NOT NULL AS covered FROM parted p LEFT JOIN rules r USING (base, repeat) WHERE NOT train), k AS (SELECT count_if(covered) AS covered, count_if(NOT covered) AS uncovered, count_if(covered AND label AND called) AS tp, count_if(covered AND NOT label AND called) AS fp, count_if(covered AND label AND NOT called) AS fn, count_if(covered AND NOT label AND NOT called) AS tn FROM v)"
       " SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy FROM k")  # fmt: skip
def m13_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = materialize(reinsert.split_by_name(_tagged(spark, sf_dir)))
    out = reinsert.apply_strategies(parted.where("not train"), reinsert.strategies(parted.where("train")))
    return out.select("covered", "uncovered", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("WITH steps AS (SELECT n_nationkey * 2 AS rep, n_nationkey / 50.0 AS threshold FROM nation WHERE n_nationkey >= 3) SELECT p_partkey, p_size::BIGINT AS n, round(coalesce((SELECT arg_max(threshold, rep) FROM steps WHERE rep <= p_size), 0.6), 9) AS threshold FROM part")
def m14_threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "nation").where("n_nationkey >= 3").select((F.col("n_nationkey") * 2).alias("rep"), (F.col("n_nationkey") / 50.0).alias("threshold"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    return joins.newest_below(parts, steps, value="n", step="rep", result="threshold", default=0.6).select("p_partkey", "n", F.round("threshold", 9).alias("threshold"))


_VOTES = COLUMNS_SQL + ", v AS (SELECT rec, pos, " + ", ".join(f"len(list_filter(subs, lambda b: b = '{b}')) AS {n}" for b, n in (("A", "a"), ("C", "c"), ("G", "g"), ("T", "t"), ("-", "gap"))) + " FROM cols)"


@query(_VOTES + ", o AS (SELECT *, list_sort([{'n': -a, 'b': 'A'}, {'n': -c, 'b': 'C'}, {'n': -g, 'b': 'G'}, {'n': -t, 'b': 'T'}, {'n': -gap, 'b': '-'}]) AS opts FROM v) SELECT rec, pos, a, c, g, t, gap, opts[1].b AS major, -opts[2].n >= 0.15 * (a + c + g + t + gap) AND a + c + g + t + gap >= 4 AS mixed FROM o")
def b25_column_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.consensus(_cols(spark, sf_dir))


def _h(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN {c} / 4 * log2({c} / 4) ELSE 0.0 END"


@query(_VOTES + f" SELECT rec, pos + 1 AS pos, round(-({' + '.join(map(_h, ('a', 'c', 'g', 't', 'gap')))}), 9) AS entropy FROM v WHERE -({' + '.join(map(_h, ('a', 'c', 'g', 't', 'gap')))}) > 0.9")
def a57_high_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Where all subreads agree the entropy is 0. A filter on it would also be moved below counts made by expressions, and count anew for each use.
    counted = voting.varied_counts(views.columns(spark, sf_dir)).withColumn("entropy", voting.entropy(list(voting.COUNTS.values())))
    return counted.where("entropy > 0.9").select("rec", (F.col("pos") + 1).alias("pos"), F.round("entropy", 9).alias("entropy"))
