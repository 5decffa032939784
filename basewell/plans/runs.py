"""Homopolymers, motifs, tandem repeats and intervals (B-08 and the sequence part of the A series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import runs
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import READS_SQL, SUBREADS_SQL, table

_RUNS = READS_SQL + """, parts AS (SELECT qname, run AS source_run, barcode, unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS part, generate_subscripts(regexp_extract_all(seq, 'A+|C+|G+|T+'), 1) AS k FROM reads)"""


@query(_RUNS + ", placed AS (SELECT qname, part, sum(length(part)) OVER (PARTITION BY qname ORDER BY k)::BIGINT AS e FROM parts) SELECT left(part, 1) AS base, length(part)::BIGINT AS length, count(*) AS n, sum(e - length(part))::BIGINT AS starts, sum(e)::BIGINT AS ends FROM placed WHERE length(part) >= 2 GROUP BY 1, 2")
def b08_base_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.base_runs(views.reads(spark, sf_dir), "seq", ["qname"])
    return found.groupBy("base", (F.col("end") - F.col("start")).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query(_RUNS + " SELECT length(part)::BIGINT AS length, count_if(part LIKE 'A%') AS A, count_if(part LIKE 'C%') AS C, count_if(part LIKE 'G%') AS G, count_if(part LIKE 'T%') AS T, count(*) AS total FROM parts GROUP BY 1")
def a34_run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_histogram(views.reads(spark, sf_dir), "seq").withColumn("length", F.col("length").cast("long"))


@query(_RUNS + " SELECT barcode, max(length(part))::BIGINT AS longest, arg_min(left(part, 1), (-length(part), left(part, 1))) AS base FROM parts GROUP BY barcode")
def a34_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = views.reads(spark, sf_dir).select("barcode", F.explode(S.runs("seq")).alias("run")).groupBy("barcode", F.substring("run", 1, 1).alias("base")).agg(F.max(F.length("run")).cast("long").alias("longest"))
    return hist.groupBy("barcode").agg(F.max("longest").alias("longest"), F.min_by("base", F.struct(-F.col("longest"), "base")).alias("base"))


@query(READS_SQL + ", spots AS (SELECT qname, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads WHERE contains(seq, 'GGC')) SELECT substr('NNNNNN' || seq, i, 6) AS context, count(*) AS n FROM spots WHERE substr(seq, i, 3) = 'GGC' GROUP BY 1 ORDER BY n DESC, context LIMIT 20")
def a47_motif_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.motif_contexts(views.reads(spark, sf_dir), "seq", "GGC").orderBy(F.desc("n"), "context").limit(20)


#: Tandem repeats of the table src (id, seq): stretches in which a base equals the one a unit further on, walked from the
#: left as whole units, for units of 1 to 3 bases; then the union of a sequence's repeats.
_WALK_SQL = """units(k, t) AS (VALUES (1, 4), (2, 3), (3, 3)),
  letters_r AS (SELECT id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS i FROM src),
  near_r AS (SELECT id, i, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM letters_r WINDOW w AS (PARTITION BY id ORDER BY i)),
  same AS (SELECT id, k, t, i FROM near_r, units WHERE c = CASE k WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END),
  marked_r AS (SELECT *, i - row_number() OVER (PARTITION BY id, k ORDER BY i) AS grp FROM same),
  islands_r AS MATERIALIZED (SELECT id, k, t, min(i) - 1 AS a, max(i) AS e FROM marked_r GROUP BY id, k, t, grp HAVING max(i) - min(i) + 1 >= k * (t - 1)),
  walk AS (
    SELECT DISTINCT id, k, t, 0::BIGINT AS p, NULL::BIGINT AS a, NULL::BIGINT AS b FROM islands_r
    UNION ALL
    SELECT id, k, t, i + k * (1 + (e - i) // k), i, i + k * (1 + (e - i) // k) FROM (
      SELECT w.id, w.k, w.t, min(greatest(l.a, w.p)) AS i, arg_min(l.e, greatest(l.a, w.p)) AS e FROM walk w JOIN islands_r l ON l.id = w.id AND l.k = w.k AND l.e - greatest(l.a, w.p) >= w.k * (w.t - 1) GROUP BY w.id, w.k, w.t, w.p)),"""
_UNION_R = """
  found_r AS (SELECT id, a, b, coalesce(a > max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM walk WHERE a IS NOT NULL),
  numbered_r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM found_r),
  repeats AS (SELECT id, sum(n)::BIGINT AS repeat_bases FROM (SELECT id, max(b) - min(a) AS n FROM numbered_r GROUP BY id, island) GROUP BY id)"""
REPEATS_SQL = _WALK_SQL + _UNION_R
#: Repeats of different units may have the same ends. Each is taken once, since two windows may order equal rows differently.
_DISTINCT_R = _UNION_R.replace("FROM walk WHERE a IS NOT NULL", "FROM (SELECT DISTINCT id, a, b FROM walk WHERE a IS NOT NULL)")


@query(READS_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", src AS MATERIALIZED (SELECT qname AS id, run, seq FROM reads WHERE rq >= 0.95), " + _WALK_SQL + _DISTINCT_R + " SELECT run, coalesce(sum(repeat_bases), 0)::BIGINT AS repeat_bases, sum(length(seq))::BIGINT AS bases, round(coalesce(sum(repeat_bases), 0) / nullif(sum(length(seq)), 0), 9) AS share FROM src LEFT JOIN repeats USING (id) GROUP BY run")
def a48_repeat_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = runs.repeat_share(views.reads(spark, sf_dir).where("rq >= 0.95"), "seq", {1: 4, 2: 3, 3: 3})
    return marked.groupBy("run").agg(F.sum("repeat_bases").alias("repeat_bases"), F.sum(F.length("seq")).alias("bases"), F.round(S.rate(F.sum("repeat_bases"), F.sum(F.length("seq"))), 9).alias("share"))


_HALVES = SUBREADS_SQL + """, halves AS (SELECT ch, turn, substr(seq, 1, length(seq) // 2) AS a, substr(seq, length(seq) // 2 + 1) AS b FROM subreads),
  mers AS (SELECT ch, turn, CASE WHEN length(a) < 11 THEN [] ELSE list_distinct(list_transform(range(length(a) - 10), lambda i: substr(a, i + 1, 11))) END AS x,
    CASE WHEN length(b) < 11 THEN [] ELSE list_distinct(list_transform(range(length(b) - 10), lambda i: substr(b, i + 1, 11))) END AS y,
    CASE WHEN length(b) < 11 THEN [] ELSE list_distinct(list_transform(range(length(b) - 10), lambda i: substr(reverse(translate(b, 'ACGT', 'TGCA')), i + 1, 11))) END AS z FROM halves)"""


@query(_HALVES + " SELECT ch, turn, round(len(list_intersect(x, z)) / nullif(len(x), 0), 9) AS fold, round(len(list_intersect(x, y)) / nullif(len(x), 0), 9) AS self FROM mers")
def a49_fold_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.subreads(spark, sf_dir).select("ch", "turn", F.round(runs.folds_back("seq"), 9).alias("fold"), F.round(runs.joined_to_itself("seq"), 9).alias("self"))


_SPANS = "WITH spans AS (SELECT l_suppkey AS name, l_partkey * 13 % 5000 AS a, l_partkey * 13 % 5000 + l_quantity::BIGINT AS b FROM lineitem), marked AS (SELECT name, a, b, coalesce(a > max(b) OVER (PARTITION BY name ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM spans), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked), joined AS (SELECT name, min(a) AS a, max(b) AS b FROM islands GROUP BY name, island)"

#: The same with each interval taken once: a supplier's items may span the same places, and two windows may order equal rows differently.
_JOINED = _SPANS.replace("AS fresh FROM spans)", "AS fresh FROM (SELECT DISTINCT name, a, b FROM spans))")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_partkey") * 13 % 5000
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name"), a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"))


@query(_JOINED + " SELECT j.name, count(*) AS pieces, sum(b - a)::BIGINT AS merged, (t.total - sum(b - a))::BIGINT AS overlap FROM joined j JOIN (SELECT name, sum(b - a) AS total FROM spans GROUP BY name) t USING (name) GROUP BY j.name, t.total")
def a50_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    total = spans.groupBy("name").agg(F.sum(F.col("b") - F.col("a")).alias("total"))
    merged = runs.merged_intervals(spans, ["name"], "a", "b").groupBy("name").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("b") - F.col("a")).alias("merged"))
    return merged.join(total, "name").select("name", "pieces", "merged", (F.col("total") - F.col("merged")).alias("overlap"))


@query(_JOINED + " SELECT name, b AS gap_start, lead(a) OVER (PARTITION BY name ORDER BY a) AS gap_end FROM joined QUALIFY gap_end IS NOT NULL")
def a50_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gaps(_spans(spark, sf_dir), ["name"], "a", "b")


@query(_SPANS + ", events AS (SELECT name, a AS at_, 1 AS step FROM spans UNION ALL SELECT name, b, -1 FROM spans), summed AS (SELECT name, at_, sum(step) AS step FROM events GROUP BY ALL), swept AS (SELECT name, at_ AS a, lead(at_) OVER w AS b, sum(step) OVER w AS depth FROM summed WINDOW w AS (PARTITION BY name ORDER BY at_))"
       " SELECT name, sum(b - a)::BIGINT AS covered, round(sum((b - a) * depth) / sum(b - a), 9) AS mean_depth, round(100.0 * sum(b - a) / 5000, 6) AS percent FROM swept WHERE depth > 0 GROUP BY name")  # fmt: skip
def b26_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("b") - F.col("a")
    swept = runs.depth_profile(_spans(spark, sf_dir), ["name"], "a", "b")
    return swept.groupBy("name").agg(F.sum(size).alias("covered"), F.round(F.sum(size * F.col("depth")) / F.sum(size), 9).alias("mean_depth"), F.round(100.0 * F.sum(size) / 5000, 6).alias("percent"))


@query(READS_SQL + " SELECT qname, ((length(seq) - length(replace(seq, 'GGC', ''))) // 3)::BIGINT AS n FROM reads")
def b20_motif_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("qname", S.count_motif("seq", "GGC").alias("n"))


@query("SELECT source AS seqid, sum(n_chars - doc_id % 7 + 1)::BIGINT AS bases FROM documents GROUP BY source")
def o12_interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    gff = table(spark, sf_dir, "documents").select(F.col("source").alias("seqid"), (F.col("doc_id") % 7).alias("start"), F.col("n_chars").alias("end"))
    return gff.groupBy("seqid").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
