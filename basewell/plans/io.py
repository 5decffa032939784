"""Sources and sinks: what is written is read again (O series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.operators import joins
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import COLUMNS_SQL, ERRORS_SQL, FACTS_SQL, READS_SQL
from basewell.sources import fastx
from basewell.sources.scratch import new_path


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir, empty=False)


@query(READS_SQL + " SELECT qname, md5(seq) AS seq, md5(qual) AS qual FROM reads WHERE seq <> ''")
def o01_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.write_fastq(_full(spark, sf_dir), path)
    back = fastx.read_fastq(spark, path)
    return back.select("qname", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("seq", "qual")])


@query(READS_SQL + " SELECT qname, md5(seq) AS seq FROM reads WHERE seq <> ''")
def o02_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.fasta_text(_full(spark, sf_dir)).write.text(path)
    return fastx.read_fasta(spark, path).select("qname", F.md5(F.col("seq").cast("binary")).alias("seq"))


@query(READS_SQL + " SELECT qname, ch, least(np, 25)::INT AS np, round(rq, 9) AS rq FROM reads WHERE seq <> ''")
def o04_sam_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    plain = ("qname", F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    tags = (F.when(F.col("fwd"), F.concat(F.lit("ch:i:"), "ch")).otherwise(F.concat(F.lit("xx:Z:"), "ch")), F.concat(F.lit("np:i:"), "np"), F.concat(F.lit("rq:f:"), "rq"))
    _full(spark, sf_dir).select(F.concat_ws("\t", *plain, *tags).alias("value")).write.text(path)
    return fastx.with_tags(fastx.read_sam(spark, path)).select("qname", "ch", "np", F.round("rq", 9).alias("rq"))


@query(FACTS_SQL + " SELECT tag, sum(eq)::BIGINT AS eq, count(*) AS n FROM facts GROUP BY tag")
def o06_o13_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.write_metrics(views.facts(spark, sf_dir).select("qname", "tag", "eq"), path)
    return fastx.read_table(spark, path, "qname long, tag string, eq long").groupBy("tag").agg(F.sum("eq").alias("eq"), F.count(F.lit(1)).alias("n"))


@query(COLUMNS_SQL + ", i AS (SELECT rec, avg((smc = ref)::INT) AS identity, count(*) AS n FROM cols GROUP BY rec) SELECT round(identity, 9) AS identity, n FROM i WHERE identity >= 0.9 AND identity < 0.99")
def o09_column_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    cols = views.columns(spark, sf_dir)
    same = F.size(F.filter(F.arrays_zip(F.split("smc", "").alias("a"), F.split("ref", "").alias("b")), lambda x: (x["a"] == x["b"]) & (x["a"] != ""))) / F.length("ref")
    cols.select(F.concat(F.array("smc", "smc", "ref"), F.col("subs")).alias("msa_seqs"), same.alias("identity"), F.length("ref").alias("query_aln_len")).write.json(path)
    return fastx.read_columns(spark, path, 0.9, 0.99).select(F.round("identity", 9).alias("identity"), F.col("query_aln_len").cast("long").alias("n"))


@query(READS_SQL + " SELECT t.thr, count(*) AS n, sum(length(seq))::BIGINT AS bases FROM reads JOIN (SELECT unnest([0.99, 0.999])::DOUBLE AS thr) t ON rq >= thr WHERE seq <> '' GROUP BY t.thr")
def o14_fastq_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.write_fastq(_full(spark, sf_dir), path, (0.99, 0.999))
    back = [fastx.read_fastq(spark, f"{path}/thr={t}").select(F.lit(t).alias("thr"), F.length("seq").alias("n")) for t in (0.99, 0.999)]
    return back[0].unionByName(back[1]).groupBy("thr").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n")).alias("bases"))


@query(READS_SQL + f" SELECT qname, ch, round(1 - ({ERRORS_SQL}) / length(qual), 9) AS rq FROM reads WHERE seq <> ''")
def o15_reads_of_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.write_fastq(_full(spark, sf_dir), path)
    return fastx.reads_of_fastq(spark, path).select("qname", "ch", F.round("rq", 9).alias("rq"))


@query(READS_SQL + " SELECT barcode, count(*) AS n FROM reads GROUP BY barcode HAVING count(*) >= 30")
def o18_merged_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.reads(spark, sf_dir)
    merged = reads.where("fwd").unionByName(reads.where("not fwd"))
    return fastx.by_barcode(merged, least=30).groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))


@query(READS_SQL + " SELECT count(*) AS n, sum(length(seq))::BIGINT AS bases, 7::BIGINT AS files FROM reads")
def o20_round_robin_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.write_parts(views.reads(spark, sf_dir).select("seq"), path, 7)
    back = spark.read.parquet(path).select(F.length("seq").alias("n"), F.col("_metadata.file_path").alias("file"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("bases"), F.count_distinct("file").alias("files"))


_TWICE = READS_SQL + " SELECT qname, md5(seq) AS seq, 2::BIGINT AS n FROM reads WHERE seq <> ''"


@query(_TWICE)
def o03_reference_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.fasta_text(_full(spark, sf_dir)).write.text(f"{path}.fa")
    fastx.write_fastq(_full(spark, sf_dir), f"{path}.fastq")
    both = fastx.read_reference(spark, f"{path}.fa").unionByName(fastx.read_reference(spark, f"{path}.fastq"))
    return both.groupBy("qname", F.md5(F.col("seq").cast("binary")).alias("seq")).agg(F.count(F.lit(1)).alias("n"))


@query(READS_SQL + " SELECT qname, CASE WHEN ch % 3 = 0 THEN 0 ELSE np END::INT AS np, round(CASE WHEN ch % 5 = 0 THEN 12.5 ELSE -10 * log10(1 - rq + 1e-6) END, 6) AS rq, length(seq)::BIGINT AS read_len FROM reads WHERE seq <> '' AND (ch % 5 = 0 OR ch % 7 <> 0)")
def o05_basic_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ch = new_path(spark), F.col("ch")
    plain = ("qname", F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    tags = (F.when(ch % 3 != 0, F.concat(F.lit("np:i:"), "np")), F.when(ch % 5 == 0, "cq:f:12.5"), F.when(ch % 7 != 0, F.concat(F.lit("rq:f:"), "rq")))
    _full(spark, sf_dir).select(F.concat_ws("\t", *plain, *tags).alias("value")).write.text(f"{path}/sam")
    found = fastx.dump_basic(fastx.read_sam(spark, f"{path}/sam"), f"{path}/basic")
    rows = fastx.read_table(spark, found, "qname string, np int, rq double, read_len long") if found else fastx.basic_table(fastx.read_sam(spark, f"{path}/sam"))
    return rows.select("qname", "np", F.round("rq", 6).alias("rq"), "read_len")


@query(FACTS_SQL + " SELECT tag || '.' || status AS sample, count(*) AS n, sum(eq)::BIGINT AS eq FROM facts GROUP BY 1")
def o07_tables_under_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    rows = views.facts(spark, sf_dir).select(F.col("tag").alias("a"), F.concat_ws(".", "tag", "status").alias("b"), "qname", "eq")
    rows.write.partitionBy("a", "b").option("sep", "\t").option("header", True).csv(path)
    back = fastx.read_tables_under(spark, path, "qname long, eq long", pattern="part-*", sample=r"/b=([^/]+)/")
    return back.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("eq").alias("eq"))


@query(FACTS_SQL + " SELECT qname, seg, eq FROM facts WHERE eq > 800 AND tag = 'R'")
def o08_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fastx.write_metrics(views.facts(spark, sf_dir).select("qname", "seg", "tag", "eq"), path)
    rows = fastx.read_table(spark, path, "qname long, seg int, tag string, eq long")
    return rows.where("eq > 800 and tag = 'R'").select("qname", "seg", "eq")


_TABLES = "WITH regions AS (SELECT 'chr' || n_regionkey AS refname, n_nationkey * 7000 AS a, n_nationkey * 7000 + 3500 AS b FROM nation), variants AS (SELECT 'chr' || c_custkey % 5 AS refname, c_custkey * 37 % 200000 AS pos FROM customer)"


def _write_regions(spark: SparkSession, sf_dir: str, path: str) -> None:
    a = F.col("n_nationkey") * 7000
    bed = views.table(spark, sf_dir, "nation").select(F.concat_ws("\t", F.concat(F.lit("chr"), "n_regionkey"), a, a + 3500).alias("value"))
    head = spark.createDataFrame([("# regions",)], "value string")
    head.unionByName(bed).write.text(f"{path}/bed")
    vcf = views.table(spark, sf_dir, "customer").select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("c_custkey") % 5), F.col("c_custkey") * 37 % 200000, F.lit("."), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("PASS"), F.lit(".")).alias("value"))
    spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string").unionByName(vcf).write.text(f"{path}/vcf")


@query(_TABLES + " SELECT refname, a AS start, b AS \"end\", (SELECT count(*) FROM variants v WHERE v.refname = regions.refname AND pos >= a AND pos < b) AS n FROM regions")
def o10_regions_and_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    _write_regions(spark, sf_dir, path)
    regions, points = fastx.read_bed(spark, f"{path}/bed"), fastx.read_vcf(spark, f"{path}/vcf").select(F.col("refname").alias("name"), "pos")
    inside = joins.points_in_regions(points, regions, name="name", pos="pos", start="start", end="end", region_name="refname", how="inner")
    counted = inside.groupBy(F.col("r_name").alias("refname"), F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    return regions.join(counted, ["refname", "start", "end"], "left").fillna(0, ["n"])


@query(_TABLES + " SELECT refname, pos FROM variants WHERE refname IN ('chr1', 'chr3')")
def o11_points_of_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    _write_regions(spark, sf_dir, path)
    return fastx.read_vcf(spark, f"{path}/vcf", spark.createDataFrame([("chr1",), ("chr3",)], "refname string")).select("refname", "pos")


@query("SELECT s_name AS qname, translate(md5(s_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, 1::BIGINT AS files FROM supplier")
def o16_a_file_for_each_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    seqs = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("qname"), F.translate(F.md5(F.col("s_name").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    back = fastx.read_fasta_each(spark, path, fastx.write_fasta_each(seqs, path))
    files = back.groupBy(F.col("qname").alias("name")).agg(F.count_distinct("file").alias("files"))
    return back.join(files, back["qname"] == files["name"]).select("qname", "seq", "files")


@query(READS_SQL + " SELECT '@HD' AS name, 'VN:1' AS second UNION ALL SELECT qname, CASE WHEN fwd THEN 'one' ELSE 'two' END FROM reads")
def o19_first_header_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    reads = views.reads(spark, sf_dir)
    for name, part in (("one", reads.where("fwd")), ("two", reads.where("not fwd"))):
        head = spark.createDataFrame([(f"@HD\tVN:{1 if name == 'one' else 2}",)], "value string")
        head.unionByName(part.select(F.concat_ws("\t", "qname", F.lit(name)).alias("value"))).write.text(f"{path}/{name}")
    fields = F.split("value", "\t")
    return fastx.merged_sam(spark, [f"{path}/one", f"{path}/two"]).select(fields[0].alias("name"), fields[1].alias("second"))
