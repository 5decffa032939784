"""Joins and set comparisons (J and U series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import joins
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import ALIGNMENTS_SQL, FACTS_SQL, READS_SQL, SUBREADS_SQL, table

_F_AND_O = FACTS_SQL + ", basics AS (SELECT o_orderkey AS qname, o_custkey AS ch, o_totalprice AS price, o_orderstatus AS state FROM orders)"


def _basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qname"), F.col("o_custkey").alias("ch"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))


@query(_F_AND_O + " SELECT state, count(*) AS n, sum(eq)::BIGINT AS eq FROM facts JOIN basics USING (qname) GROUP BY state")
def j01_basics_with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facts(spark, sf_dir).join(_basics(spark, sf_dir), "qname").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("eq").alias("eq"))


_PER_CHANNEL = "SELECT ch, sum(eq)::BIGINT AS eq, count(*) AS passes FROM facts WHERE tag = '{}' GROUP BY ch"


@query(FACTS_SQL + f", a AS ({_PER_CHANNEL.format('A')}), n AS ({_PER_CHANNEL.format('N')}), r AS ({_PER_CHANNEL.format('R')}) SELECT ch, a.eq AS eq_0, a.passes AS passes_0, n.eq AS eq_1, n.passes AS passes_1, r.eq AS eq_3, r.passes AS passes_3 FROM a JOIN n USING (ch) JOIN r USING (ch)")
def j02_many_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.facts(spark, sf_dir)
    frames = [facts.where(F.col("tag") == t).groupBy("ch").agg(F.sum("eq").alias("eq"), F.count(F.lit(1)).alias("passes")) for t in "ANR"]
    return joins.join_all([*frames[:2], None, frames[2]], "ch")


_IDENTITY = "SELECT ch, sum(eq)::DOUBLE / nullif(sum(eq + diff + ins + del), 0) AS c FROM facts WHERE status = '{}' GROUP BY ch"


@query(FACTS_SQL + f", a AS ({_IDENTITY.format('F')}), b AS ({_IDENTITY.format('O')}) SELECT count_if(a.c > b.c) AS better, count_if(a.c < b.c) AS worse, count_if(a.c = b.c) AS equal FROM a JOIN b USING (ch)")
def j03_compare_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.facts(spark, sf_dir)
    whole = F.col("eq") + F.col("diff") + F.col("ins") + F.col("del")
    a, b = (facts.where(F.col("status") == s).groupBy("ch").agg(S.rate(F.sum("eq"), F.sum(whole)).alias(n)) for s, n in (("F", "a"), ("O", "b")))
    return a.join(b, "ch").agg(F.count_if(F.col("a") > F.col("b")).alias("better"), F.count_if(F.col("a") < F.col("b")).alias("worse"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


_SPANNED = "SELECT ch, avg(np) AS np, sum(eq) / nullif(sum(eq + diff + ins + del), 0) AS c, sum(eq + diff + del) // 2000 AS span FROM facts WHERE status = '{}' GROUP BY ch"


@query(FACTS_SQL + f", a AS ({_SPANNED.format('F')}), b AS ({_SPANNED.format('O')}), m AS (SELECT a.ch, a.c, b.c AS d FROM a JOIN b USING (ch) WHERE a.np > 5 AND a.span = b.span) SELECT count(*) AS channels, count(*) FILTER (c > d) AS better, count(*) FILTER (c < d) AS worse, count(*) - count(*) FILTER (c > d) - count(*) FILTER (c < d) AS equal, round(count(*) FILTER (c > d) / nullif(count(*), 0), 9) AS better_share, round(count(*) FILTER (c < d) / nullif(count(*), 0), 9) AS worse_share FROM m")
def j03_compare_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of more than five passes that span as much of the reference, here in steps of 2000 bases, in both runs."""
    facts = views.facts(spark, sf_dir)
    whole = F.col("eq") + F.col("diff") + F.col("ins") + F.col("del")
    span = F.floor(F.sum(F.col("eq") + F.col("diff") + F.col("del")) / 2000)
    a, b = (facts.where(F.col("status") == s).groupBy("ch").agg(F.avg("np").alias("np"), S.rate(F.sum("eq"), F.sum(whole)).alias("concordance"), span.alias("span")) for s in "FO")
    out = joins.compare_runs(a, b, "ch", passes="np", span="span", least_passes=5)
    return out.withColumns({c: F.round(c, 9) for c in ("better_share", "worse_share")})


@query(FACTS_SQL + ", k AS (SELECT base, true_cnt, called, count(*) AS n FROM facts GROUP BY ALL) SELECT base, true_cnt, max(n) FILTER (called = true_cnt) AS same, max(n) FILTER (called = true_cnt - 1) AS less, max(n) FILTER (called = true_cnt + 1) AS more FROM k GROUP BY base, true_cnt")
def j04_neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.col("called") - F.col("true_cnt")
    counted = views.facts(spark, sf_dir).groupBy("base", "true_cnt", "called").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("base", "true_cnt").agg(*[F.max(F.when(off == d, F.col("n"))).alias(name) for d, name in ((0, "same"), (-1, "less"), (1, "more"))])


@query(FACTS_SQL + ", a AS (SELECT rname AS name, count(*) AS value FROM facts WHERE tag = 'A' AND rname > 'chr3' GROUP BY 1), b AS (SELECT rname AS name, count(*) AS value FROM facts WHERE tag = 'N' AND rname < 'chr8' GROUP BY 1) SELECT name, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b USING (name)")
def j05_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.facts(spark, sf_dir)
    a = facts.where("tag = 'A' and rname > 'chr3'").groupBy(F.col("rname").alias("name")).agg(F.count(F.lit(1)).alias("value_a"))
    b = facts.where("tag = 'N' and rname < 'chr8'").groupBy(F.col("rname").alias("name")).agg(F.count(F.lit(1)).alias("value_b"))
    return a.join(b, "name", "full_outer")


@query(READS_SQL + " SELECT qname, ch FROM reads WHERE ch IN (SELECT conv_id FROM conversations)")
def j06_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keep_listed(views.reads(spark, sf_dir), S.channel_of("qname"), table(spark, sf_dir, "conversations"), "conv_id").select("qname", "ch")


@query(READS_SQL + " SELECT qname, CASE WHEN ch IN (SELECT doc_id FROM labels) THEN 'kept' ELSE 'dropped' END AS fate FROM reads")
def j07_split_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, listed = views.reads(spark, sf_dir), table(spark, sf_dir, "labels")
    kept = joins.keep_listed(reads, "ch", listed, "doc_id").select("qname", F.lit("kept").alias("fate"))
    return kept.unionByName(joins.drop_listed(reads, "ch", listed, "doc_id").select("qname", F.lit("dropped").alias("fate")))


@query(ALIGNMENTS_SQL + ", named AS (SELECT DISTINCT split_part(qname, '/', 1)::BIGINT AS ch FROM alignments WHERE length(rseq) > 400) SELECT ch, turn FROM subreads WHERE ch IN (SELECT ch FROM named)")
def j08_prefix_then_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = views.alignments(spark, sf_dir).where(F.length("rseq") > 400).select(F.regexp_extract("qname", r"^(\d+)/", 1).cast("long").alias("ch"))
    return joins.keep_listed(views.subreads(spark, sf_dir), "ch", picked, "ch").select("ch", "turn")


@query("SELECT l_orderkey, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1")
def j09_single_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.single_hits(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")


@query(READS_SQL + ", rated AS (SELECT qname, rq FROM reads) SELECT d.doc_id, round(rq, 9) AS rq FROM documents d JOIN rated ON qname = 'run/' || doc_id || '/ccs' WHERE rq >= 0.999")
def j10_quality_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.reads(spark, sf_dir).select("qname", "rq").where("rq >= 0.999")
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("run/"), "doc_id", F.lit("/ccs")).alias("qname"))
    return named.join(rated, "qname").select("doc_id", F.round("rq", 9).alias("rq"))


@query(ALIGNMENTS_SQL + ", covered AS (SELECT DISTINCT ch FROM alignments WHERE length(regexp_replace(ops, '[^=X]', '', 'g')) / length(rseq) > 0.93) SELECT ch, turn FROM subreads WHERE ch IN (SELECT ch FROM covered)")
def j11_by_target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = views.alignments(spark, sf_dir).where(S.rate(S.cigar_total(S.cigar_ops("cigar"), "=X"), F.length("rseq")) > 0.93)
    return joins.keep_listed(views.subreads(spark, sf_dir), "ch", covered, "ch").select("ch", "turn")


@query(READS_SQL + ", best AS (SELECT ch // 2 AS pair, max(rq) FILTER (fwd) AS f, max(rq) FILTER (NOT fwd) AS r FROM reads GROUP BY 1) SELECT qname FROM reads WHERE ch // 2 IN (SELECT pair FROM best WHERE f >= 0.999 OR r >= 0.999)")
def j12_either_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.reads(spark, sf_dir).withColumn("pair", F.floor(F.col("ch") / 2))
    best = reads.groupBy("pair").agg(F.max(F.when(F.col("fwd"), F.col("rq"))).alias("f"), F.max(F.when(~F.col("fwd"), F.col("rq"))).alias("r"))
    return joins.keep_listed(reads, "pair", best.where("f >= 0.999 or r >= 0.999"), "pair").select("qname")


@query("WITH regions AS (SELECT n_regionkey AS name, n_nationkey * 7000 AS a, n_nationkey * 7000 + 3500 AS b FROM nation), points AS (SELECT c_custkey, c_custkey % 5 AS name, c_custkey * 37 % 200000 AS pos FROM customer) SELECT c_custkey, pos FROM points WHERE EXISTS (SELECT 1 FROM regions r WHERE r.name = points.name AND pos >= a AND pos < b)")
def j13_points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("rname"), (F.col("n_nationkey") * 7000).alias("a"), (F.col("n_nationkey") * 7000 + 3500).alias("b"))
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("name"), (F.col("c_custkey") * 37 % 200000).alias("pos"))
    return joins.points_in_regions(points, regions, name="name", pos="pos", start="a", end="b", region_name="rname").select("c_custkey", "pos")


@query("WITH parents AS (SELECT vec_id AS ch, embedding AS dw FROM embeddings), parts AS (SELECT conv_id AS ch, turn, turn AS a, turn + 4 AS b FROM conversations) SELECT ch, turn, dw[a + 1 : b] AS part FROM parts JOIN parents USING (ch)")
def j14_slice_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ch"), F.col("embedding").alias("dw"))
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ch"), "turn")
    return parts.join(parents, "ch").select("ch", "turn", F.slice("dw", (F.col("turn") + 1).cast("int"), F.lit(4)).alias("part"))


@query(READS_SQL + ", ids AS (SELECT run, ch, row_number() OVER (ORDER BY run, ch)::BIGINT AS new_ch FROM (SELECT DISTINCT run, ch FROM reads)) SELECT qname, new_ch FROM reads JOIN ids ON reads.ch = ids.ch AND reads.run IS NOT DISTINCT FROM ids.run")
def j15_renumber_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.reads(spark, sf_dir).select("run", "ch", "qname")
    ids = joins.numbered(reads, ["run", "ch"], "new_ch", start=1).withColumnsRenamed({"run": "id_run", "ch": "id_ch"})
    return reads.join(ids, (F.col("ch") == F.col("id_ch")) & F.col("run").eqNullSafe(F.col("id_run"))).select("qname", "new_ch")


@query(ALIGNMENTS_SQL + " SELECT refname, qname, substr(rseq, greatest(0, turn * 20 - 10) + 1, least(length(rseq), turn * 20 + 11) - greatest(0, turn * 20 - 10)) AS part FROM alignments WHERE turn * 20 < length(rseq)")
def j16_reference_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("turn") * 20
    low, high = F.greatest(F.lit(0), at - 10), F.least(F.length("rseq"), at + 11)
    return views.alignments(spark, sf_dir).where(at < F.length("rseq")).select("refname", "qname", F.substring(F.col("rseq"), low + 1, high - low).alias("part"))


@query(FACTS_SQL + ", life AS (SELECT qname, max(seg) OVER (PARTITION BY qname) AS life_time, seg, eq, diff FROM facts) SELECT life_time, seg, sum(eq)::BIGINT AS eq, sum(diff)::BIGINT AS diff FROM life GROUP BY life_time, seg")
def j17_life_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = views.facts(spark, sf_dir).withColumn("life_time", F.max("seg").over(Window.partitionBy("qname")))
    return life.groupBy("life_time", "seg").agg(F.sum("eq").alias("eq"), F.sum("diff").alias("diff"))


@query(READS_SQL + " SELECT f.ch // 2 AS pair, f.qname AS fwd_name, r.qname AS rev_name FROM reads f JOIN reads r ON f.ch // 2 = r.ch // 2 AND f.fwd AND NOT r.fwd WHERE f.np >= 5 AND r.np >= 5")
def j18_strand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.reads(spark, sf_dir).where("np >= 5").withColumn("pair", F.floor(F.col("ch") / 2))
    f, r = (reads.where(w).select("pair", F.col("qname").alias(n)) for w, n in (("fwd", "fwd_name"), ("not fwd", "rev_name")))
    return f.join(r, "pair")


@query("SELECT split_part(d.source, 'c', 2) AS stem, d.doc_id, l.quality::BIGINT AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND 'src' || (l.doc_id % 20) = d.source")
def j19_pairs_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.split("source", "c")[1].alias("stem"), "doc_id")
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).cast("string").alias("stem"), "doc_id", F.col("quality").cast("long").alias("quality"))
    return docs.join(labels, ["stem", "doc_id"])


@query(FACTS_SQL + ", expected AS (SELECT o_orderkey AS qname, 'chr' || (o_custkey % 10) AS want FROM orders) SELECT want, count(*) AS n, count_if(rname = want) AS hits, round(count_if(rname = want) / count(*), 9) AS rate FROM expected LEFT JOIN facts USING (qname) GROUP BY want")
def j21_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qname"), F.concat(F.lit("chr"), F.col("o_custkey") % 10).alias("want"))
    hit = F.count_if(F.coalesce(F.col("rname") == F.col("want"), F.lit(False)))
    return expected.join(views.facts(spark, sf_dir), "qname", "left").groupBy("want").agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), F.round(hit / F.count(F.lit(1)), 9).alias("rate"))


@query("SELECT r_name AS sample, n_name AS reference, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def j22_mapping_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("sample"), F.col("n_name").alias("reference")).agg(F.count(F.lit(1)).alias("n"))


@query(SUBREADS_SQL + " SELECT ch, turn FROM subreads WHERE ch IN (SELECT ch FROM subreads WHERE cx = 1 AND length(seq) > 300)")
def j23_anchored_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = views.subreads(spark, sf_dir)
    return joins.keep_listed(subs, "ch", subs.where("cx = 1").where(F.length("seq") > 300), "ch").select("ch", "turn")


@query("WITH a AS (SELECT source AS file, md5(coalesce(text, '')) AS name FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT source AS file, md5(coalesce(text, '')) AS name FROM documents WHERE doc_id % 3 <> 1),"
       " x AS (SELECT file, name, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT file, name, count(*) AS n FROM b GROUP BY ALL), j AS (SELECT coalesce(x.file, y.file) AS file, x.n AS n_a, y.n AS n_b FROM x FULL JOIN y ON x.file = y.file AND x.name = y.name)"
       " SELECT file, CASE WHEN count_if(n_a IS NULL OR n_b IS NULL) > 0 THEN 'DIFFERENT' WHEN count_if(n_a <> n_b) > 0 THEN 'SAME_NAMES_DIFF_COUNT' ELSE 'IDENTICAL' END AS status, count_if(n_b IS NULL) AS only_a, count_if(n_a IS NULL) AS only_b FROM j GROUP BY file")  # fmt: skip
def u02_compare_name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("name"))
    a, b = (docs.where(F.col("doc_id") % 3 != r).groupBy("file", "name").agg(F.count(F.lit(1)).alias(n)) for r, n in ((0, "n_a"), (1, "n_b")))
    lone, counts = F.count_if(F.col("n_a").isNull() | F.col("n_b").isNull()), F.count_if(F.coalesce(F.col("n_a") != F.col("n_b"), F.lit(False)))
    status = F.when(lone > 0, "DIFFERENT").when(counts > 0, "SAME_NAMES_DIFF_COUNT").otherwise("IDENTICAL")
    return a.join(b, ["file", "name"], "full_outer").groupBy("file").agg(status.alias("status"), F.count_if(F.col("n_b").isNull()).alias("only_a"), F.count_if(F.col("n_a").isNull()).alias("only_b"))


@query("SELECT l_suppkey AS id, 'both' AS kind FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.09 INTERSECT SELECT l_suppkey, 'both' FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09 UNION ALL (SELECT l_suppkey, 'only' FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.09 EXCEPT SELECT l_suppkey, 'only' FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)")
def u03_intersect_and_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_discount > 0.09")
    a, r = (items.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("id")) for f in "AR")
    return a.intersect(r).withColumn("kind", F.lit("both")).unionByName(a.subtract(r).withColumn("kind", F.lit("only")))


@query(SUBREADS_SQL + ", k AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT ch FROM subreads)), copies AS (SELECT k.ch, place + total * c AS new_ch FROM k CROSS JOIN (SELECT unnest([0, 1, 2]) AS c)) SELECT new_ch::BIGINT AS new_ch, turn FROM copies JOIN subreads USING (ch)")
def u06_expand_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = views.subreads(spark, sf_dir)
    ids = joins.numbered(subs, ["ch"], "place")
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    copies = ids.crossJoin(F.broadcast(total)).withColumn("new_ch", F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda c: F.col("place") + F.col("total") * c)))
    return subs.join(copies, "ch").select("new_ch", "turn").repartitionByRange("new_ch").sortWithinPartitions("new_ch", "turn")
