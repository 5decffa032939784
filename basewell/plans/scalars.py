"""Scalar functions over the reads view (S series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators.ordered import quantiles
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import ALIGNMENTS_SQL, ERRORS_SQL, READS_SQL
from basewell.sources import fastx

_PHRED = {
    "cap_1e10": ("-10 * log10(1 - least(rq, 1 - 1e-10))", {"cap": 1 - 1e-10}), "cap_1e6": ("-10 * log10(1 - least(rq, 1 - 1e-6))", {"cap": 1 - 1e-6}), "plus_1e6": ("-10 * log10(1 - rq + 1e-6)", {"eps": 1e-6}),
    "floor_1e6": ("-10 * log10(greatest(1 - rq, 1e-6))", {"floor": 1e-6}), "plus_1e8": ("-10 * log10(1 - rq + 1e-8)", {"eps": 1e-8}), "cap_5n": ("-10 * log10(1 - least(rq, 0.99999))", {"cap": 0.99999}),
}


@query(READS_SQL + " SELECT qname, " + ", ".join(f"round({sql}, 6) AS {n}" for n, (sql, _) in _PHRED.items()) + ", CASE WHEN rq >= 1 THEN 60.0 ELSE round(-10 * log10(1 - rq), 6) END AS sixty FROM reads")
def s01_phred_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("rq") >= 1, 60.0).otherwise(F.round(S.phred("rq"), 6)).alias("sixty")
    return views.reads(spark, sf_dir).select("qname", *[F.round(S.phred("rq", **o), 6).alias(n) for n, (_, o) in _PHRED.items()], own)


@query(READS_SQL + f" SELECT qname, length(qual)::BIGINT AS n, round(1 - ({ERRORS_SQL}) / nullif(length(qual), 0), 9) AS accuracy FROM reads")
def s02_mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("qname", F.length("qual").cast("long").alias("n"), F.round(S.mean_accuracy("qual"), 9).alias("accuracy"))


@query(ALIGNMENTS_SQL + " SELECT qname, round((length(ops) - length(replace(ops, '=', ''))) / length(ops), 9) AS identity FROM alignments")
def s03_cigar_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.alignments(spark, sf_dir).select("qname", F.round(S.cigar_identity(S.cigar_ops("cigar")), 9).alias("identity"))


@query(ALIGNMENTS_SQL + " SELECT qname, " + ", ".join(f"(length(ops) - length(replace(ops, '{o}', '')))::BIGINT AS n_{n}" for n, o in (("eq", "="), ("x", "X"), ("i", "I"), ("d", "D"))) + ", len(regexp_extract_all(ops, '=+|X+|I+|D+'))::BIGINT AS n_ops FROM alignments")
def s04_cigar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = S.cigar_ops("cigar")
    return views.alignments(spark, sf_dir).select("qname", *[S.cigar_total(ops, o).alias(f"n_{n}") for n, o in (("eq", "="), ("x", "X"), ("i", "I"), ("d", "D"))], F.size(ops).cast("long").alias("n_ops"))


@query(READS_SQL + " SELECT qname, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM reads")
def s05_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("qname", F.md5(S.reverse_complement("seq").cast("binary")).alias("digest"))


@query(READS_SQL + " SELECT qname, md5(CASE WHEN fwd THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END) AS seq_digest, md5(CASE WHEN fwd THEN qual ELSE reverse(qual) END) AS qual_digest FROM reads")
def s06_flip_odd_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, qual = F.when(F.col("fwd"), F.col("seq")).otherwise(S.reverse_complement("seq")), F.when(F.col("fwd"), F.col("qual")).otherwise(F.reverse("qual"))
    return views.reads(spark, sf_dir).select("qname", F.md5(seq.cast("binary")).alias("seq_digest"), F.md5(qual.cast("binary")).alias("qual_digest"))


@query(READS_SQL + ", packed AS (SELECT qname, seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS hpc FROM reads)"
       " SELECT qname, md5(hpc) AS digest, length(hpc)::BIGINT AS n, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))), 0)::BIGINT AS longest FROM packed")  # fmt: skip
def s07_compress_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, longest = S.compress_runs("seq"), F.array_max(F.transform(S.runs("seq"), F.length))
    return views.reads(spark, sf_dir).select("qname", F.md5(packed.cast("binary")).alias("digest"), F.length(packed).cast("long").alias("n"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest"))


@query(READS_SQL + ", trimmed AS (SELECT qname, seq, regexp_replace(regexp_replace(seq, '^(A{2,}|C{2,}|G{2,}|T{2,})', ''), '(A{2,}|C{2,}|G{2,}|T{2,})$', '') AS t FROM reads) SELECT qname, length(t)::BIGINT AS n, md5(t) AS digest FROM trimmed")
def s08_trim_end_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = S.trim_ends("seq", least=2)
    return views.reads(spark, sf_dir).select("qname", F.length(trimmed).cast("long").alias("n"), F.md5(trimmed.cast("binary")).alias("digest"))


@query("SELECT vec_id, list_transform(embedding, lambda x: floor(x * 100)::BIGINT + 3) AS boosted FROM embeddings")
def s09_add_to_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A product in the entries' own type, as in the SQL: a float times a whole number would become a double.
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")) + 3).alias("boosted"))


@query(READS_SQL + " SELECT 'cs/' || qname AS qname, 'consensus' AS kind, length(seq)::BIGINT AS n FROM reads UNION ALL SELECT qname, 'subread', length(seq) FROM reads")
def s11_append_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.reads(spark, sf_dir).select("qname", F.length("seq").cast("long").alias("n"))
    own = base.withColumn("kind", F.lit("subread"))
    return own.unionByName(base.select(F.concat(F.lit("cs/"), "qname").alias("qname"), "n", F.lit("consensus").alias("kind"))).select("qname", "kind", "n")


@query("SELECT p_partkey, regexp_extract('(' || substr(p_brand, 1, 3) || ')' || p_size, '\\((\\w+)\\)(\\d+)', 1) AS unit, p_size::INT AS n FROM part")
def s12_motif_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit, n = S.motif_parts(F.concat(F.lit("("), F.substring("p_brand", 1, 3), F.lit(")"), F.col("p_size")))
    return views.table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), n.alias("n"))


@query(READS_SQL + " SELECT qname, try_cast(split_part(qname, '/', 2) AS BIGINT) AS channel, try_cast(split_part(qname, '/', 3) AS BIGINT) AS none FROM reads")
def s13_channel_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("qname", S.channel_of("qname").alias("channel"), S.channel_of("qname", part=2).alias("none"))


@query("SELECT n_name, printf('%s=%.2f%%', n_name, n_nationkey * 100.0 / 25) AS share, format('{:,}', sum(s_suppkey * 1000)::BIGINT) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def s14_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = views.table(spark, sf_dir, "supplier").join(views.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    share = F.format_string("%s=%.2f%%", "n_name", F.col("n_nationkey") * 100.0 / 25)
    return joined.groupBy("n_name", "n_nationkey").agg(F.sum(F.col("s_suppkey") * 1000).alias("total")).select("n_name", share.alias("share"), F.format_number("total", 0).alias("total"))


@query(READS_SQL + " SELECT qname, md5(translate(upper(translate(seq, 'T', 'u')), 'U', 'T')) AS digest FROM reads")
def s15_rna_to_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("qname", F.md5(S.rna_to_dna(F.translate("seq", "T", "u")).cast("binary")).alias("digest"))


@query(READS_SQL + " SELECT qname, levenshtein(left(seq, 50), right(seq, 50))::BIGINT AS ends, levenshtein(left(seq, 50), left(reverse(translate(seq, 'ACGT', 'TGCA')), 50))::BIGINT AS turned FROM reads")
def s16_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, tail, turned = F.left("seq", F.lit(50)), F.right("seq", F.lit(50)), F.left(S.reverse_complement("seq"), F.lit(50))
    return views.reads(spark, sf_dir).select("qname", F.levenshtein(head, tail).cast("long").alias("ends"), F.levenshtein(head, turned).cast("long").alias("turned"))


@query(READS_SQL + ", next AS (SELECT qname, left(seq, 200) AS a, left(seq, 200) AS same, left(reverse(translate(seq, 'ACGT', 'TGCA')), 200) AS b FROM reads)"
       " SELECT qname, CASE WHEN levenshtein(a, substr(same, 2)) <= levenshtein(a, b) THEN '+' ELSE '-' END AS strand FROM next")  # fmt: skip
def s17_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, turned = F.left("seq", F.lit(200)), F.left(S.reverse_complement("seq"), F.lit(200))
    nearer = F.levenshtein(head, F.substring(head, 2, 200)) <= F.levenshtein(head, turned)
    return views.reads(spark, sf_dir).select("qname", F.when(nearer, "+").otherwise("-").alias("strand"))


@query("SELECT vec_id, embedding[label % 4 + 1 : label % 4 + 3] AS part FROM embeddings")
def s18_array_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.col("label") % 4 + 1, F.lit(3)).alias("part"))


@query(READS_SQL + ", n AS (SELECT qname, unnest(['A', 'C', 'G', 'T']) AS base, seq FROM reads), c AS (SELECT qname, base, length(seq) - length(replace(seq, base, '')) AS n FROM n)"
       " SELECT qname, coalesce(string_agg(base || ':' || n, ',' ORDER BY base) FILTER (n > 0), '') AS counts, coalesce(max(n) FILTER (base = 'A' AND n > 0), NULL)::BIGINT AS n_a FROM c GROUP BY qname")  # fmt: skip
def s20_map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, "TGCA")), F.array(*[(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long") for b in "TGCA"])), lambda _, n: n > 0)
    text = S.map_text(counts)
    return views.reads(spark, sf_dir).select("qname", text.alias("counts"), S.text_map(text)["A"].cast("long").alias("n_a"))


@query(READS_SQL + " SELECT run, median(length(seq))::DOUBLE AS median, quantile_cont(length(seq), 0.9)::DOUBLE AS p90 FROM reads GROUP BY run")
def s21_exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.reads(spark, sf_dir).select("run", F.length("seq").alias("n"))
    return quantiles(n, ["run"], {"median": ("n", 0.5), "p90": ("n", 0.9)})


@query(READS_SQL + ", rest AS (SELECT qname, substr(seq, np + 1) AS s FROM reads) SELECT qname, (length(s) - length(ltrim(s, left(s, 1))))::BIGINT AS run FROM rest WHERE s <> ''")
def s22_run_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).where(F.length("seq") > F.col("np")).select("qname", S.run_right("seq", "np").cast("long").alias("run"))


@query("SELECT o_orderkey, try_strptime(nullif(regexp_extract('run_' || strftime(o_orderdate, '%Y%m%d') || '_x.csv', '(\\d{8})', 1), ''), '%Y%m%d')::DATE AS run_date FROM orders")
def s24_date_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("run_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_x.csv"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", S.run_date(name).alias("run_date"))


@query(READS_SQL + " SELECT qname, 'dw:' || array_to_string(list_transform(range(length(seq)), lambda i: '9'), ',') || ';np:' || np AS tags, '@RG' || chr(9) || 'RUN:' || run || chr(9) || 'SM:x:y' AS header FROM reads WHERE length(seq) > 0")
def s10_tags_and_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.reads(spark, sf_dir).where(F.length("seq") > 0)
    tags = F.create_map(F.lit("np"), F.col("np").cast("string"), F.lit("dw"), F.lit("1,2"), F.lit("ar"), F.lit("3"))
    made = fastx.with_constant_tag(fastx.without_tags(tags, ("ar",)), "dw", "9", F.col("seq"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    header = fastx.renamed_fields(F.concat(F.lit("@RG\tID:"), "run", F.lit("\tSM:x:y")), {"ID": "RUN"})
    return reads.select("qname", text.alias("tags"), header.alias("header"))
