"""Dereplication, clusters and pairs (A-31 to A-33, A-60, S-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import clusters, runs
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.runs import _HALVES, REPEATS_SQL
from basewell.plans.views import ERRORS_SQL, READS_SQL, SUBREADS_SQL


@query(READS_SQL + f", e AS (SELECT md5(seq) AS digest, length(seq) AS length, {ERRORS_SQL} AS errors FROM reads) SELECT digest, length::INT AS length, count(*) AS n, round(sum(errors) / nullif(count(*) * length, 0), 9) AS mean_error FROM e GROUP BY digest, length")
def a31_dereplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dereplicate(views.reads(spark, sf_dir)).withColumn("mean_error", F.round("mean_error", 9)).orderBy(F.desc("n"), "digest")


#: All pairs of like length whose counts of 4-mers are near enough: an edit changes at most four of them on each side, so no link is lost. Then edit distances, and what is connected.
_CLUSTERS = READS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(qname)) AS id, seq, min(qname) AS first_name, length(seq) AS n FROM reads GROUP BY seq),
  g AS MATERIALIZED (SELECT id, g, count(*) AS c FROM (SELECT id, substr(seq, unnest(range(1, greatest(n - 2, 1))), 4) AS g FROM u) GROUP BY ALL),
  near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, floor((1 - 0.99) * greatest(a.n, b.n) + 1e-9)::BIGINT AS most FROM u a JOIN u b ON a.id < b.id AND least(a.n, b.n) >= 0.99 * greatest(a.n, b.n)),
  both_ AS (SELECT p.a, p.b, sum(least(x.c, y.c)) AS shared FROM near p JOIN g x ON x.id = p.a JOIN g y ON y.id = p.b AND y.g = x.g GROUP BY ALL),
  likely AS MATERIALIZED (SELECT p.* FROM near p LEFT JOIN both_ s USING (a, b) WHERE greatest(na - 3, 0) + greatest(nb - 3, 0) - 2 * coalesce(shared, 0) <= 8 * most),
  links AS MATERIALIZED (SELECT p.a, p.b FROM likely p JOIN u x ON x.id = p.a JOIN u y ON y.id = p.b WHERE levenshtein(x.seq, y.seq) <= most),
  steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT id, id AS root FROM u UNION SELECT s.b, r.root FROM reach r JOIN steps s ON s.a = r.id),
  roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query(_CLUSTERS + " SELECT r.qname, w.first_name AS cluster FROM reads r JOIN u ON u.seq = r.seq JOIN roots USING (id) JOIN u w ON w.id = roots.root")
def a32_near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.near_duplicates(views.reads(spark, sf_dir), least_identity=0.99, least_coverage=0.99)


_PAIRS = SUBREADS_SQL + ", p AS (SELECT x.ch, x.turn AS a, y.turn AS b, 1 - levenshtein(x.seq, y.seq) / nullif(greatest(length(x.seq), length(y.seq)), 0) AS identity, least(length(x.seq), length(y.seq)) / nullif(greatest(length(x.seq), length(y.seq)), 0) AS coverage FROM subreads x JOIN subreads y ON x.ch = y.ch AND x.turn < y.turn)"


@query(_PAIRS + " SELECT ch, a, b, round(identity, 9) AS identity, round(coverage, 9) AS coverage FROM p")
def j20_a33_pairwise_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.pairwise(views.subreads(spark, sf_dir), ["ch"], "turn", "seq")
    return out.withColumns({c: F.round(c, 9) for c in ("identity", "coverage")})


@query(SUBREADS_SQL + """, g AS (SELECT ch, turn, seq, CASE WHEN length(seq) < 7 THEN [] ELSE list_transform(range(1, length(seq) - 5), lambda i: substr(seq, i, 7)) END AS grams FROM subreads),
  m AS (SELECT ch, turn, unnest(list_distinct(list_transform(range(1, greatest(len(grams) - 4, 1) + 1), lambda i: list_min(grams[i:i + 4])))) AS gram FROM g WHERE len(grams) > 0),
  s AS (SELECT x.ch, x.turn AS a, y.turn AS b, count(*) AS shared FROM m x JOIN m y ON x.ch = y.ch AND x.gram = y.gram AND x.turn <> y.turn GROUP BY ALL),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ch, a ORDER BY shared DESC, b) <= 3)
  SELECT t.ch, t.a, t.b, shared, round(1 - levenshtein(x.seq, y.seq) / greatest(length(x.seq), length(y.seq)), 9) AS identity, round(least(length(x.seq), length(y.seq)) / greatest(length(x.seq), length(y.seq)), 9) AS coverage
  FROM t JOIN subreads x ON x.ch = t.ch AND x.turn = t.a JOIN subreads y ON y.ch = t.ch AND y.turn = t.b""")
def a33_best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best partners of each subread in its channel, by shared minimizers of seven bases among five."""
    found = clusters.best_hits(views.subreads(spark, sf_dir), ["ch"], "turn", "seq", best=3)
    return found.withColumns({c: F.round(c, 9) for c in ("identity", "coverage")})


@query(_PAIRS + " SELECT ch, a, round(max(identity) FILTER (b = 1), 9) AS t1, round(max(identity) FILTER (b = 2), 9) AS t2, round(max(identity) FILTER (b = 3), 9) AS t3 FROM p GROUP BY ch, a")
def a33_identity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = clusters.pairwise(views.subreads(spark, sf_dir), ["ch"], "turn", "seq")
    wide = tall.groupBy("ch", "a").pivot("b", [1, 2, 3]).agg(F.max("identity"))
    return wide.select("ch", "a", *[F.round(str(i), 9).alias(f"t{i}") for i in (1, 2, 3)])


@query(_PAIRS + ", m AS (SELECT ch, a, b, max(identity) AS identity FROM p GROUP BY ALL) SELECT ch, a, list(b ORDER BY b) AS b, list(round(identity, 9) ORDER BY b) AS identity FROM m GROUP BY ch, a")
def a33_identity_matrix_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix over any number of turns; a33_identity_matrix has the columns of its SQL, turns 1 to 3."""
    whole = clusters.identity_matrix(clusters.pairwise(views.subreads(spark, sf_dir), ["ch"], "turn", "seq"), ["ch"])
    return whole.withColumn("identity", F.transform("identity", lambda x: F.round(x, 9)))


@query(SUBREADS_SQL + ", f AS (SELECT ch, turn, left(seq, 60) AS f, right(seq, length(seq) - 30) AS r FROM subreads WHERE length(seq) >= 90), k AS (SELECT ch, turn, f, r, unnest(range(10, least(60, length(f), length(r)) + 1)) AS n FROM f), b AS (SELECT ch, turn, f, r, arg_min(n, (levenshtein(right(f, n), left(r, n)) / n, -n)) AS n FROM k GROUP BY ALL) SELECT ch, turn, n::INT AS overlap, md5(f || substr(r, n + 1)) AS merged FROM b")
def s25_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.subreads(spark, sf_dir).where(F.length("seq") >= 90)
    pairs = reads.select("ch", "turn", F.left("seq", F.lit(60)).alias("f"), F.right("seq", F.length("seq") - 30).alias("r"))
    merged = clusters.merge_pair(F.col("f"), F.col("r"))
    return pairs.select("ch", "turn", (F.length("f") + F.length("r") - F.length(merged)).alias("overlap"), F.md5(merged.cast("binary")).alias("merged"))


@query(_HALVES.replace("WITH", "WITH RECURSIVE", 1) + ", " + READS_SQL.removeprefix("WITH ") + ", src AS MATERIALIZED (SELECT ch || '/' || turn AS id, seq FROM subreads WHERE seq <> ''), " + REPEATS_SQL + """,
  shares AS (SELECT avg((coalesce(len(list_intersect(x, z)) / nullif(len(x), 0), NULL) >= 0.8)::INT) AS fold_back, avg((coalesce(len(list_intersect(x, y)) / nullif(len(x), 0), NULL) >= 0.85)::INT) AS self_joined FROM mers JOIN subreads USING (ch, turn) WHERE seq <> ''),
  bins AS (SELECT floor(rq * 100)::BIGINT AS bin, count(*) AS n FROM reads GROUP BY 1), top AS (SELECT row_number() OVER (ORDER BY n DESC, bin) AS rank, bin, n / (SELECT sum(n) FROM bins) AS share FROM bins)
  SELECT name, round(value, 9) AS value FROM (SELECT 'fold_back' AS name, fold_back AS value FROM shares UNION ALL SELECT 'self_joined', self_joined FROM shares
  UNION ALL SELECT 'repeats', (SELECT sum(repeat_bases) FROM repeats) / (SELECT sum(length(seq)) FROM src) UNION ALL SELECT 'low_accuracy', avg((rq < 0.99)::INT) FROM reads
  UNION ALL SELECT 'accuracy rank ' || rank || ' value ' || bin, share FROM top WHERE rank <= 5)""")
def a60_low_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-complementary and self-joined shares, repeat share, low-accuracy share and the five most common accuracies in percent, as (name, value)."""
    subs = views.subreads(spark, sf_dir).where("seq <> ''")
    shares = subs.agg(F.avg((runs.folds_back("seq") >= 0.8).cast("double")).alias("fold_back"), F.avg((runs.joined_to_itself("seq") >= 0.85).cast("double")).alias("self_joined"))
    repeats = runs.repeat_share(subs, "seq", {1: 4, 2: 3, 3: 3}).agg(S.rate(F.sum("repeat_bases"), F.sum(F.length("seq"))).alias("repeats"))
    low = views.reads(spark, sf_dir).agg(F.avg((F.col("rq") < 0.99).cast("double")).alias("low_accuracy"))
    tables = [t.unpivot([], t.columns, "name", "value") for t in (shares, repeats, low)]
    bins = views.reads(spark, sf_dir).groupBy(F.floor(F.col("rq") * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # 101 rows at most
    ranked = bins.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("n"), "bin")), "share": S.rate("n", F.sum("n").over(Window.partitionBy()))}).where("rank <= 5")
    common = ranked.select(F.concat_ws(" ", F.lit("accuracy rank"), "rank", F.lit("value"), "bin").alias("name"), F.col("share").alias("value"))
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(common).withColumn("value", F.round("value", 9))
