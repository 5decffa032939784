"""Fact tables over the alignments view (T-01 and the B series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.functions.seq import once
from basewell.operators import alignment, loci, metrics, msa, summary
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import ALIGNMENTS_SQL, ALN_SQL, table
from basewell.sources import fastx
from basewell.sources.scratch import materialize, new_path


@query(ALN_SQL + " SELECT qname, refname, col_idx, op, qpos, rpos, qbase, rbase FROM aln")
def t01_alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aln_columns(views.alignments(spark, sf_dir).drop("qual"))


@query(ALIGNMENTS_SQL + " SELECT qname, refname, 0 AS rstart, length(rseq)::BIGINT AS rend, 0::BIGINT AS qstart, length(seq)::BIGINT AS qend, length(seq)::BIGINT AS qlen FROM alignments")
def b01_aligned_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.basics(views.alignments(spark, sf_dir))


_NEXT = ALN_SQL + """, near AS (SELECT *, last_value(rbase IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(rbase IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM aln),
  kinds AS (SELECT qname, op, CASE WHEN op = 'I' THEN coalesce(qbase = before, false) OR coalesce(qbase = after, false) WHEN op = 'D' THEN coalesce(rbase = before, false) OR coalesce(rbase = after, false) END AS hp FROM near),
  c AS (SELECT qname, count_if(op = '=') AS m, count_if(op = 'X') AS x, count_if(op = 'I') AS i, count_if(op = 'D') AS d, count_if(op = 'I' AND hp) AS hi, count_if(op = 'D' AND hp) AS hd, count_if(op <> 'D') AS qlen FROM kinds GROUP BY qname)"""


@query(_NEXT + " SELECT qname, round((i + m + x) / nullif(qlen, 0), 9) AS coverage, round(m / (m + x + i + d), 9) AS concordance, round(-10 * log10(greatest(1 - m / (m + x + i + d), 1e-6)), 6) AS concordance_qv, m AS match_bp, x AS mismatch_bp, i - hi AS nh_ins_bp, d - hd AS nh_del_bp, hi AS hp_ins_bp, hd AS hp_del_bp, 0::BIGINT AS ignored_bp FROM c")
def b02_record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.record_stats(views.alignments(spark, sf_dir))
    return out.withColumns({"coverage": F.round("coverage", 9), "concordance": F.round("concordance", 9), "concordance_qv": F.round("concordance_qv", 6)})


_LOCUS = ALN_SQL + """, marked AS (SELECT *, first_value(rpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_r FROM aln),
  counts AS (SELECT refname, rpos AS pos, count_if(op = '=') AS eq, count_if(op = 'X') AS diff, count_if(op = 'D') AS del, count(*) AS depth FROM aln WHERE rpos IS NOT NULL GROUP BY ALL),
  strings AS (SELECT refname, qname, next_r AS pos, string_agg(qbase, '' ORDER BY col_idx) AS s FROM marked WHERE op = 'I' AND next_r IS NOT NULL GROUP BY ALL),
  ins AS (SELECT refname, pos, sum(n)::BIGINT AS ins, string_agg(s || ':' || n, ',' ORDER BY s) AS ins_detail FROM (SELECT refname, pos, s, count(*) AS n FROM strings GROUP BY ALL) GROUP BY ALL),
  dif AS (SELECT refname, pos, string_agg(qbase || ':' || n, ',' ORDER BY qbase) AS diff_detail FROM (SELECT refname, rpos AS pos, qbase, count(*) AS n FROM aln WHERE op = 'X' GROUP BY ALL) GROUP BY ALL),
  refs AS (SELECT DISTINCT refname, rseq FROM alignments), spots2 AS (SELECT refname, rseq, unnest(range(length(rseq))) AS i FROM refs),
  r AS (SELECT refname, i::BIGINT AS pos, substr(rseq, i + 1, 1) AS c0, nullif(substr(rseq, i + 2, 1), '') AS c1, nullif(substr(rseq, i + 3, 1), '') AS c2, CASE WHEN i > 0 THEN substr(rseq, i, 1) END AS b1,
    substr(rseq, greatest(i - 10, 0) + 1, i - greatest(i - 10, 0)) || '[' || substr(rseq, i + 1, 1) || ']' || substr(rseq, i + 2, 10) AS around FROM spots2),
  loci AS (SELECT r.refname, r.pos, coalesce(eq, 0) AS eq, coalesce(diff, 0) AS diff, coalesce(ins, 0) AS ins, coalesce(del, 0) AS del, coalesce(depth, 0) AS depth, c0 AS cur_base, c1 AS next_base,
    coalesce(c0 = b1, false) OR coalesce(c0 = c1, false) AS cur_is_homo, coalesce(c1 = c0, false) OR coalesce(c1 = c2, false) AS next_is_homo, around, coalesce(diff_detail, '') AS diff_detail, coalesce(ins_detail, '') AS ins_detail
    FROM r LEFT JOIN counts USING (refname, pos) LEFT JOIN ins USING (refname, pos) LEFT JOIN dif USING (refname, pos))"""


def _loci(spark: SparkSession, sf_dir: str, details: bool = False) -> DataFrame:
    alns = views.alignments(spark, sf_dir)
    return alignment.locus_table(alns.drop("qual"), alns.select("refname", "rseq").distinct(), details=details)


@query(_LOCUS + " SELECT * FROM loci")
def b04_locus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loci(spark, sf_dir, details=True)


_SPANS = ALN_SQL + """, flagged AS (SELECT *, sum((op = '=')::INT) OVER (PARTITION BY qname ORDER BY col_idx) AS grp FROM aln),
  runs AS (SELECT qname, grp, min(col_idx) AS a, max(col_idx) AS b FROM flagged WHERE op <> '=' GROUP BY ALL),
  closed AS (SELECT r.* FROM runs r JOIN aln n ON n.qname = r.qname AND n.col_idx = r.b + 1),
  strings AS (SELECT qname, string_agg(coalesce(qbase, '-'), '' ORDER BY col_idx) AS qa, string_agg(coalesce(rbase, '-'), '' ORDER BY col_idx) AS ra FROM aln GROUP BY qname),
  ends AS (SELECT c.qname, c.a, c.b, n.qpos AS q1, n.rpos AS r1, (SELECT 0) AS z FROM closed c JOIN aln n ON n.qname = c.qname AND n.col_idx = c.b + 1),
  lens AS (SELECT e.qname, e.a, e.b, q1, r1, count(x.qpos) AS nq, count(x.rpos) AS nr FROM ends e JOIN aln x ON x.qname = e.qname AND x.col_idx BETWEEN e.a AND e.b GROUP BY ALL),
  prev AS (SELECT l.qname, l.a, l.b, l.q1, l.r1, l.nq, l.nr, max(y.col_idx) AS bad FROM lens l LEFT JOIN aln y ON y.qname = l.qname AND y.col_idx < l.a AND y.op <> '=' GROUP BY ALL),
  foll AS (SELECT l.qname, l.a, min(y.col_idx) AS bad FROM lens l LEFT JOIN aln y ON y.qname = l.qname AND y.col_idx > l.b AND y.op <> '=' GROUP BY ALL),
  nxt AS (SELECT p.*, coalesce(p.a - 1 - p.bad, p.a) AS same_before, coalesce(f.bad - p.b - 1, 1000000) AS same_after FROM prev p JOIN foll f ON f.qname = p.qname AND f.a = p.a)"""


@query(_SPANS + " SELECT qname, (q1 - nq)::INT AS qstart, q1::INT AS qend, (r1 - nr)::INT AS rstart, r1::INT AS rend, substr(qa, a - least(5, same_before) + 1, least(5, same_before)) || '[' || substr(qa, a + 1, b - a + 1) || ']' || substr(qa, b + 2, least(6, same_after)) AS qseq,"
       " substr(ra, a - least(5, same_before) + 1, least(5, same_before)) || '[' || substr(ra, a + 1, b - a + 1) || ']' || substr(ra, b + 2, least(6, same_after)) AS rseq FROM nxt JOIN strings USING (qname)")  # fmt: skip
def b06_error_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.error_spans(views.alignments(spark, sf_dir))


_QUALITY = "CASE qbase WHEN 'A' THEN 10 WHEN 'C' THEN 20 WHEN 'G' THEN 30 ELSE 40 END"


@query(ALN_SQL + f", b AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY qname ORDER BY col_idx) = 'D', false) AS behind FROM aln) SELECT refname, {_QUALITY} AS baseq, count_if(op = '=') AS eq, count_if(op = 'X') AS diff, count_if(op = 'I') AS ins, count_if(behind) AS del, count(*) AS depth FROM b WHERE qpos IS NOT NULL GROUP BY 1, 2")
def b07_base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.base_quality_table(views.alignments(spark, sf_dir))


_POLY = ALN_SQL + """, refs AS (SELECT qname, regexp_extract_all(rseq, 'A+|C+|G+|T+') AS parts FROM alignments), each AS (SELECT qname, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM refs),
  placed AS (SELECT qname, left(part, 1) AS base, length(part) AS n, sum(length(part)) OVER (PARTITION BY qname ORDER BY k)::BIGINT AS e FROM each), regions AS (SELECT qname, base, e - n AS a, e AS b FROM placed WHERE n >= 2),
  marked AS (SELECT *, coalesce(last_value(rpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_r,
    first_value(qpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_q FROM aln),
  j AS (SELECT r.qname, base, a, b, m.col_idx, coalesce(m.qbase, '') AS qb, m.qpos, m.next_q FROM regions r JOIN marked m ON m.qname = r.qname AND ((m.rpos >= a AND m.rpos < b) OR (m.rpos IS NULL AND last_r >= a - 1 AND last_r < b))),
  g AS (SELECT qname, base, a, b, string_agg(qb, '' ORDER BY col_idx) AS s, coalesce(min(qpos), min(next_q)) AS q FROM j GROUP BY ALL)"""


@query(_POLY + " SELECT qname, a::INT AS rstart, b::INT AS rend, base AS rbase, (b - a)::INT AS rrepeats, q AS qstart, q + length(s) AS qend, s AS qseq, (length(s) - length(replace(s, base, '')))::INT AS qrepeats, length(replace(s, base, '')) = 0 AS qclean FROM g")
def b09_poly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.poly_table(views.alignments(spark, sf_dir).drop("qual"))


@query(ALN_SQL + ", p AS (SELECT refname, rpos AS pos, coalesce(qbase, '-') AS base, count(*) AS n FROM aln WHERE rpos IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY refname, pos), 9) AS ratio FROM p")
def b17_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.pileup(views.alignments(spark, sf_dir).drop("qual")).withColumn("ratio", F.round("ratio", 9))


@query(ALN_SQL + f" SELECT rpos AS pos, op = '=' AS is_match, {_QUALITY} AS baseq, count(*) AS n FROM aln WHERE rpos IN (10, 50, 100) AND qpos IS NOT NULL GROUP BY ALL")
def b18_quality_at_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = alignment.aln_columns(views.alignments(spark, sf_dir)).where("rpos in (10, 50, 100) and qpos is not null")
    return columns.groupBy(F.col("rpos").alias("pos"), (F.col("op") == "=").alias("is_match"), "baseq").agg(F.count(F.lit(1)).alias("n"))


@query(ALN_SQL + " SELECT rpos AS pos, qname FROM aln WHERE op = 'D' QUALIFY row_number() OVER (PARTITION BY rpos ORDER BY qname) <= 10")
def b19_reads_with_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aln_columns(views.alignments(spark, sf_dir).drop("qual")).where("op = 'D'").select(F.col("rpos").alias("pos"), "qname")
    return summary.top_k(found, ["pos"], [F.col("qname")], 10).drop("place")


@query(ALN_SQL + ", n AS (SELECT qname, length(rseq) AS n FROM alignments), m AS (SELECT *, last_value(rpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx) AS at_r FROM aln) SELECT qname, coalesce(string_agg(qbase, '' ORDER BY col_idx) FILTER (CASE WHEN rpos IS NULL THEN at_r >= 50 AND at_r < 149 ELSE rpos >= 50 AND rpos < 150 END), '') AS part FROM m JOIN n USING (qname) WHERE n >= 150 GROUP BY qname")
def b20_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.subsequence(views.alignments(spark, sf_dir), 50, 150)


@query(ALN_SQL + ", e AS (SELECT refname, qname, count_if(op = 'X') AS mm, count_if(op = 'I') AS ins, count_if(op = 'D') AS del FROM aln GROUP BY ALL) SELECT refname, arg_min(qname, (mm + ins + del, qname)) AS best, min(mm + ins + del) AS errors FROM e GROUP BY refname")
def b21_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = S.cigar_ops("cigar")
    errors = views.alignments(spark, sf_dir).select("refname", "qname", S.cigar_total(ops, "XID").alias("errors"))
    return errors.groupBy("refname").agg(F.min_by("qname", F.struct("errors", "qname")).alias("best"), F.min("errors").alias("errors"))


@query(ALN_SQL + f", q AS (SELECT rpos // 5 * 5 AS bin, {_QUALITY} AS v FROM aln WHERE op = 'X') SELECT bin, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS sd, median(v)::DOUBLE AS median FROM q GROUP BY bin")
def b22_mismatch_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = alignment.aln_columns(views.alignments(spark, sf_dir)).where("op = 'X'").select((F.floor(F.col("rpos") / 5) * 5).alias("bin"), "baseq")
    return wrong.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("baseq"), 9).alias("mean"), F.round(F.stddev_pop("baseq"), 9).alias("sd"), F.median("baseq").alias("median"))


@query(ALIGNMENTS_SQL + " SELECT qname FROM alignments WHERE (length(ops) - length(replace(ops, '=', ''))) / length(ops) > 0.93")
def b23_full_length_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns = views.alignments(spark, sf_dir)
    ops = S.cigar_ops("cigar")
    whole = (S.cigar_total(ops, "=XI") == F.length("seq")) & (S.cigar_total(ops, "=XD") == F.length("rseq"))
    return alns.where(whole & (S.cigar_identity(ops) > 0.93)).select("qname")


@query("WITH placed AS (SELECT l_orderkey AS name, l_partkey * 31 % 2000 AS a, l_partkey * 31 % 2000 + l_quantity::BIGINT * 9 AS b FROM lineitem), k AS (SELECT *, CASE WHEN a < 1000 AND b > 1000 THEN 0 WHEN b <= 1000 THEN 1 ELSE 2 END AS kind FROM placed), best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind, a - b, a) = 1)"
       " SELECT name, kind, a % 1000 AS a, CASE WHEN kind = 0 THEN 1000 ELSE a % 1000 + b - a END AS b FROM best UNION ALL SELECT name, kind, 0, b - 1000 FROM best WHERE kind = 0")  # fmt: skip
def b27_fold_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_partkey") * 31 % 2000
    placed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), a.alias("a"), (a + F.col("l_quantity").cast("long") * 9).alias("b"), F.lit(1000).cast("long").alias("size"))
    return alignment.fold_circle(placed, name="name", start="a", end="b", size="size")


@query(_LOCUS + " SELECT refname, count_if(eq > 0.2 * (eq + diff) AND diff > 0.2 * (eq + diff)) AS variants, count_if(depth > 0 AND del / depth > 0.4) AS deletions, round(sum(eq) / sum(depth), 9) AS eq_rate FROM loci GROUP BY refname")
def a27_locus_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("eq") + F.col("diff")
    loci = _loci(spark, sf_dir)
    variant, gone = (F.col("eq") > 0.2 * both) & (F.col("diff") > 0.2 * both), F.coalesce(S.rate("del", "depth") > 0.4, F.lit(False))
    return loci.groupBy("refname").agg(F.count_if(variant).alias("variants"), F.count_if(gone).alias("deletions"), F.round(S.rate(F.sum("eq"), F.sum("depth")), 9).alias("eq_rate")).orderBy("eq_rate")


@query(_LOCUS + ", e AS (SELECT cur_base, cur_is_homo, count(*) AS places, sum(diff)::BIGINT AS diff, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del FROM loci GROUP BY ALL) SELECT cur_base, cur_is_homo, places, diff, ins, del, round(diff / sum(diff) OVER () / (places / sum(places) OVER ()), 9) AS diff_over_share FROM e")
def a28_error_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _loci(spark, sf_dir).groupBy("cur_base", "cur_is_homo").agg(F.count(F.lit(1)).alias("places"), *[F.sum(c).alias(c) for c in ("diff", "ins", "del")])
    whole = Window.partitionBy()
    return grouped.withColumn("diff_over_share", F.round(S.rate("diff", F.sum("diff").over(whole)) / S.rate("places", F.sum("places").over(whole)), 9))


@query(_LOCUS + ", ".join(["", *[f"t_{c} AS (SELECT '{c}' AS type, refname, pos, {c} AS n, depth, round({c} / nullif(depth, 0), 9) AS ratio, around FROM loci WHERE {c} > 0 ORDER BY {c} DESC, refname, pos LIMIT 50)" for c in ("diff", "ins", "del")]]) + " SELECT * FROM t_diff UNION ALL SELECT * FROM t_ins UNION ALL SELECT * FROM t_del")
def a28_worst_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_loci(spark, sf_dir).select("refname", "pos", "diff", "ins", "del", "depth", "around").where("diff > 0 or ins > 0 or del > 0"))
    return loci.worst_places(found).withColumn("ratio", F.round("ratio", 9))


_COMPOSED = _LOCUS + """, comp AS MATERIALIZED (SELECT cur_base, cur_is_homo, count(*) AS n_pos, count_if(diff + ins + del > 0) AS n_pos_err, sum(diff)::BIGINT AS diff, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del, sum(diff + ins + del)::BIGINT AS total FROM loci GROUP BY ALL),
  tall AS (SELECT cur_base, cur_is_homo, n_pos, unnest(['total', 'diff', 'ins', 'del']) AS type, unnest([total, diff, ins, del]) AS n FROM comp WHERE n_pos_err > 0),
  pairs AS (SELECT h.cur_base, h.type, h.n_pos / (h.n_pos + r.n_pos) AS pos_ratio, h.n AS homo, r.n AS rest FROM tall h JOIN tall r ON h.cur_base = r.cur_base AND h.type = r.type AND h.cur_is_homo AND NOT r.cur_is_homo),
  corrected AS (SELECT *, floor(homo / pos_ratio)::BIGINT AS homo_corrected, floor(rest / (1 - pos_ratio))::BIGINT AS rest_corrected FROM pairs),
  shares AS (SELECT cur_base, sum(n_pos) / (SELECT sum(n_pos) FROM comp) AS share FROM comp GROUP BY cur_base),
  across_ AS (SELECT type, cur_base, homo_corrected + rest_corrected AS raw, floor((homo_corrected + rest_corrected) / share)::BIGINT AS corr FROM corrected JOIN shares USING (cur_base))"""


@query(_COMPOSED + " SELECT cur_base, type, round(pos_ratio, 9) AS pos_ratio, homo, rest, homo_corrected, rest_corrected, round(homo_corrected / nullif(rest_corrected, 0), 9) AS ratio FROM corrected")
def a28_homo_against_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = loci.homo_against_rest(loci.composition(_loci(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("pos_ratio", "ratio")})


@query(_COMPOSED + " SELECT type, " + ", ".join(f'max({c}) FILTER (cur_base = \'{b}\') AS "{b}_{c}"' for b in "ACGT" for c in ("raw", "corr")) + " FROM across_ GROUP BY type")
def a28_across_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = materialize(loci.composition(_loci(spark, sf_dir)))  # two rows a base
    return loci.across_bases(composed, loci.homo_against_rest(composed))


@query(ALIGNMENTS_SQL + ", i AS (SELECT qname, coalesce(list_sum(list_transform(regexp_extract_all(ops, 'I+'), lambda x: length(x))), 0) AS n, length(seq) AS size FROM alignments) SELECT round(avg((n > 0)::INT), 9) AS read_share, round(sum(n) / sum(size), 9) AS base_share FROM i")
def a40_long_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_ = F.filter(S.cigar_ops("cigar"), lambda o: (o["op"] == "I") & (o["n"] >= 1))
    sizes = views.alignments(spark, sf_dir).select(F.aggregate(long_, F.lit(0), lambda t, o: t + o["n"]).alias("n"), F.length("seq").alias("size"))
    return sizes.agg(F.round(F.avg((F.col("n") > 0).cast("double")), 9).alias("read_share"), F.round(F.sum("n") / F.sum("size"), 9).alias("base_share"))


@query(ALIGNMENTS_SQL + ", m AS (SELECT qname, replace(replace(ops, 'D', ''), 'I', 'X') AS s FROM alignments), w AS (SELECT qname, s, unnest(range(0, length(s) - 49, 10)) AS a FROM m WHERE length(s) >= 50), i AS (SELECT qname, length(replace(substr(s, a + 1, 50), 'X', '')) / 50 AS identity FROM w) SELECT qname, count(*) AS windows, count_if(identity < 0.95) AS low, round(min(identity), 9) AS least FROM i GROUP BY qname")
def a41_low_identity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = alignment.window_identity(views.alignments(spark, sf_dir))
    return windows.groupBy("qname").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("identity") < 0.95).alias("low"), F.round(F.min("identity"), 9).alias("least"))


@query(ALN_SQL + " SELECT op, coalesce(rbase, '-') AS rbase, coalesce(qbase, '-') AS qbase, count(*) AS n FROM aln WHERE op <> '=' GROUP BY ALL")
def a42_substitution_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = alignment.aln_columns(views.alignments(spark, sf_dir).drop("qual")).where("op <> '='")
    return wrong.groupBy("op", F.coalesce("rbase", F.lit("-")).alias("rbase"), F.coalesce("qbase", F.lit("-")).alias("qbase")).agg(F.count(F.lit(1)).alias("n"))


@query(ALIGNMENTS_SQL + ", c AS (SELECT least(length(regexp_replace(ops, '[^D]', '', 'g')), 10) AS d, least(length(regexp_replace(ops, '[^I]', '', 'g')), 10) AS i, least(length(regexp_replace(ops, '[^X]', '', 'g')), 10) AS x FROM alignments), t AS (SELECT 'del' AS kind, d AS bin FROM c UNION ALL SELECT 'ins', i FROM c UNION ALL SELECT 'mm', x FROM c) SELECT kind, bin::BIGINT AS bin, count(*) AS n FROM t GROUP BY ALL")
def a42_error_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = S.cigar_ops("cigar")
    counts = views.alignments(spark, sf_dir).select(*[F.least(S.cigar_total(ops, o), F.lit(10)).cast("long").alias(k) for k, o in (("del", "D"), ("ins", "I"), ("mm", "X"))])
    return counts.unpivot([], counts.columns, "kind", "bin").groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(ALN_SQL + ", m AS (SELECT refname, qname, rpos, op, last_value(rpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx) AS at_r FROM aln), w AS (SELECT refname, qname, coalesce(at_r, -1) AS at_r, count(*) AS width FROM m WHERE op = 'I' GROUP BY ALL) SELECT refname, at_r AS pos, max(width)::BIGINT AS width FROM w GROUP BY ALL")
def b24_insertion_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    inserted = alignment.with_ops(views.alignments(spark, sf_dir)).select("refname", F.inline("ops")).where("op = 'I'")
    return inserted.groupBy("refname", (F.col("r") - 1).cast("long").alias("pos")).agg(F.max("n").cast("long").alias("width"))


#: Alignments of which every second one begins later: at its first run of matches from place 20 on.
_CUT = ALN_SQL + """, runs AS (SELECT *, op = '=' AND coalesce(lag(op) OVER (PARTITION BY qname ORDER BY col_idx) <> '=', true) AND rpos >= 20 AS fresh FROM aln),
  begins AS (SELECT qname, CASE WHEN ends_with(qname, '/1') THEN min(col_idx) FILTER (fresh) ELSE 0 END AS b FROM runs GROUP BY qname),
  kept AS MATERIALIZED (SELECT a.* FROM aln a JOIN begins USING (qname) WHERE col_idx >= b),
  attached AS MATERIALIZED (SELECT *, last_value(rpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx) AS at_r FROM kept),
  strings AS (SELECT refname, qname, at_r AS pos, string_agg(qbase, '' ORDER BY col_idx) AS s FROM attached WHERE op = 'I' AND at_r IS NOT NULL GROUP BY ALL),
  widths AS (SELECT refname, pos, max(length(s)) AS width FROM strings GROUP BY ALL),
  bounds AS (SELECT refname, min(rpos) AS s0, max(rpos) AS s1 FROM kept GROUP BY refname),
  loci2 AS (SELECT refname, unnest(range(s0, s1 + 1)) AS pos, s0 FROM bounds),
  placed2 AS MATERIALIZED (SELECT l.refname, l.pos, coalesce(width, 0) AS width, l.pos - s0 + coalesce(sum(coalesce(width, 0)) OVER (PARTITION BY l.refname ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM loci2 l LEFT JOIN widths USING (refname, pos))"""


def _cut_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns = views.alignments(spark, sf_dir).drop("qual")
    placed = once(alns.withColumn("ops", S.placed_ops(S.cigar_ops("cigar"), "rstart")), "ops")
    first = F.when(F.col("qname").endswith("/1"), F.get(F.filter("ops", lambda o: (o["op"] == "=") & (o["r"] >= 20)), F.lit(0))["c"]).otherwise(0)
    kept = once(placed.withColumn("begin", first).where("begin is not null"), "ops", "begin")
    kept = once(kept.withColumn("ops", F.filter("ops", lambda o: o["c"] >= F.col("begin"))), "ops").where(F.size("ops") > 0)
    at = F.get("ops", F.lit(0))
    cigar = F.array_join(F.transform("ops", lambda o: F.concat(o["n"].cast("string"), o["op"])), "")
    return kept.select("qname", "refname", at["r"].alias("rstart"), cigar.alias("cigar"), F.substring(F.col("seq"), at["q"] + 1, F.length("seq")).alias("seq"), "rseq")


@query(_CUT + " SELECT a.refname, a.qname, min(p.col)::BIGINT AS col_start, string_agg(coalesce(a.qbase, '.') || coalesce(s.s, '') || repeat('.', (p.width - length(coalesce(s.s, '')))::BIGINT), '' ORDER BY a.rpos) AS text"
       " FROM kept a JOIN placed2 p ON p.refname = a.refname AND p.pos = a.rpos LEFT JOIN strings s ON s.qname = a.qname AND s.pos = a.rpos WHERE a.rpos IS NOT NULL GROUP BY a.refname, a.qname")  # fmt: skip
def b24_padded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.padded_reads(_cut_alignments(spark, sf_dir))


@query(_CUT + " SELECT p.refname, p.pos // 256 AS tile, min(p.col)::BIGINT AS col_start, string_agg(substr(r.rseq, p.pos + 1, 1) || repeat('.', p.width::BIGINT), '' ORDER BY p.pos) AS text FROM placed2 p JOIN (SELECT DISTINCT refname, rseq FROM alignments) r USING (refname) GROUP BY ALL")
def b24_padded_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Bounds and widths are both told by the alignment strings, which are cut once. A reference without reads meets no tile.
    alns = materialize(_cut_alignments(spark, sf_dir).select("refname", "rstart", "cigar"))
    return msa.padded_reference(alns, views.alignments(spark, sf_dir).select("refname", "rseq").distinct())


_TRUSTED = _NEXT.rsplit(", c AS", 1)[0].replace("kinds AS (SELECT qname, op,", "kinds AS (SELECT qname, refname, op, qpos, CASE WHEN op = 'I' THEN coalesce(last_r, -1) + 1 ELSE rpos END AS p,").replace("near AS (SELECT *,", "near AS (SELECT *, last_value(rpos IGNORE NULLS) OVER (PARTITION BY qname ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_r,") + """,
  refs AS (SELECT DISTINCT refname, length(rseq) AS size FROM alignments),
  judged AS (SELECT k.*, ((p < size // 2) OR (p >= size // 2 + 10 AND p < size)) AND p % 37 <> 5 AS here, p = 0 OR (((p - 1 < size // 2) OR (p - 1 >= size // 2 + 10 AND p - 1 < size)) AND (p - 1) % 37 <> 5) AS before FROM kinds k JOIN refs USING (refname)),
  g AS (SELECT *, here AND (op <> 'I' OR before) AS good FROM judged),
  t AS (SELECT qname, count_if(qpos IS NOT NULL) AS qlen, count_if(good AND op = '=') AS m, count_if(good AND op = 'X') AS x, count_if(good AND op = 'I' AND NOT hp) AS ni, count_if(good AND op = 'I' AND hp) AS hi, count_if(good AND op = 'D' AND NOT hp) AS nd, count_if(good AND op = 'D' AND hp) AS hd, count_if(NOT good) AS ignored FROM g GROUP BY qname)"""


@query(_TRUSTED + " SELECT qname, round((m + x + ni + hi) / nullif(qlen, 0), 9) AS coverage, round(m / nullif(m + x + ni + hi + nd + hd, 0), 9) AS concordance, round(-10 * log10(greatest(1 - m / nullif(m + x + ni + hi + nd + hd, 0), 1e-6)), 6) AS concordance_qv, m AS match_bp, x AS mismatch_bp, ni AS nh_ins_bp, nd AS nh_del_bp, hi AS hp_ins_bp, hd AS hp_del_bp, ignored AS ignored_bp FROM t")
def f02_f03_trusted_record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns = views.alignments(spark, sf_dir)
    sizes = alns.select("refname", F.length("rseq").alias("size")).distinct()
    half = F.floor(F.col("size") / 2)
    path = new_path(spark)
    bounds = F.array(F.struct(F.lit(0).cast("long").alias("a"), half.alias("b")), F.struct((half + 10).alias("a"), F.col("size").cast("long").alias("b")))
    sizes.select("refname", F.inline(bounds)).select(F.concat_ws("\t", "refname", "a", "b").alias("value")).write.text(f"{path}/bed")
    places = sizes.select("refname", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("pos")).where("pos % 37 = 5")
    places.select(F.concat_ws("\t", "refname", "pos", F.lit("."), F.lit("N"), F.lit("N")).alias("value")).write.text(f"{path}/vcf")
    out = alignment.masked_record_stats(alns, fastx.read_bed(spark, f"{path}/bed"), fastx.read_vcf(spark, f"{path}/vcf"))
    return out.withColumns({"coverage": F.round("coverage", 9), "concordance": F.round("concordance", 9), "concordance_qv": F.round("concordance_qv", 6)})


@query(ALN_SQL + " SELECT qname, count(*) AS n, count(rpos) AS mapped, sum(rpos)::BIGINT AS total, max(rpos) FILTER (qpos = 10)::INT AS tenth FROM aln WHERE qpos IS NOT NULL GROUP BY qname")
def s23_query_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = once(alignment.query_to_ref(views.alignments(spark, sf_dir)).select("qname", "ref_of"), "ref_of")
    mapped = F.filter("ref_of", lambda r: r.isNotNull())
    total = F.aggregate(mapped, F.lit(0).cast("long"), lambda t, r: t + r)
    return placed.select("qname", F.size("ref_of").cast("long").alias("n"), F.size(mapped).cast("long").alias("mapped"), F.when(F.size(mapped) > 0, total).alias("total"), F.get("ref_of", F.lit(10)).alias("tenth"))


@query(ALN_SQL + f", q AS (SELECT {_QUALITY} AS baseq, count(*) AS depth, count_if(op = '=') AS eq FROM aln WHERE qpos IS NOT NULL GROUP BY 1), e AS (SELECT *, eq / depth AS emp_rq, -10 * log10(1 - least(eq / depth, 1 - 1e-6)) AS emp_phred FROM q) SELECT baseq, depth::BIGINT AS depth, round(emp_rq, 9) AS emp_rq, round(emp_phred, 6) AS emp_phred FROM e")
def a25_empirical_base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.empirical_quality(alignment.base_quality_table(views.alignments(spark, sf_dir)))
    return found.select("baseq", "depth", F.round("emp_rq", 9).alias("emp_rq"), F.round("emp_phred", 6).alias("emp_phred"))


@query(ALN_SQL + f", q AS (SELECT {_QUALITY} AS baseq, count(*) AS depth, count_if(op = '=') AS eq FROM aln WHERE qpos IS NOT NULL GROUP BY 1), e AS (SELECT *, -10 * log10(1 - least(eq / depth, 1 - 1e-6)) AS emp FROM q) SELECT "
       + ", ".join(f"round(sum(depth) FILTER (baseq >= {k}) / sum(depth), 9) AS share_{k}" for k in (20, 30, 35)) + ", " + ", ".join(f"round({x}, 6) AS {n}" for n, x in {"mse": "avg((baseq - emp) * (baseq - emp)) FILTER (depth > 1000)", "rmse": "sqrt(avg((baseq - emp) * (baseq - emp)) FILTER (depth > 1000))", "mae": "avg(abs(baseq - emp)) FILTER (depth > 1000)", "med_ae": "median(abs(baseq - emp)) FILTER (depth > 1000)", "mape": "avg(abs(emp - baseq) / emp) FILTER (depth > 1000)", "smape": "avg(2 * abs(baseq - emp) / (baseq + emp)) FILTER (depth > 1000)"}.items()) + " FROM e")
def a25_base_quality_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.base_quality_errors(metrics.empirical_quality(alignment.base_quality_table(views.alignments(spark, sf_dir))), least_depth=1000)
    return out.select([F.round(c, 9 if c.startswith("share") else 6).alias(c) for c in out.columns])
