"""Text formats of sequencing as tables, and tables as such files."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions.seq import mean_accuracy, phred
from basewell.sources.scratch import discard, materialize, new_path, setting, spread

BED = "refname string, start long, end long"
VCF = "refname string, pos long, id string, ref string, alt string"
GFF = "seqid string, source string, kind string, start long, end long, score string, strand string, phase string, attributes string"
SAM = "qname string, flag int, refname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"

#: Files of sequences that are written and listed at a time: each takes 5 to 6 KB of the driver's memory meanwhile.
FILES = 1 << 14


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line) with lines numbered from 0 in each file, however the files are split.

    A split knows its first byte. Lines are counted by split, the counts before a split are added up, and a line's
    place in its split is the rest; only the counts, one for each split, meet in a window. They go to all tasks, so lines
    aren't dealt out by split; the driver has planned a task for each of them before.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(F.broadcast(splits), ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("offset")).alias("line_no"), F.col("value").alias("line"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, qname, seq, qual) of four-line records, plain or gzip. A record that isn't whole is left out."""
    lines = numbered_lines(spark, paths).withColumns({"record": F.floor(F.col("line_no") / 4), "part": F.col("line_no") % 4})
    line = lambda part: F.max(F.when(F.col("part") == part, F.col("line")))
    records = lines.groupBy("file", "record").agg(line(0).alias("name"), line(1).alias("seq"), line(3).alias("qual"), F.count(F.lit(1)).alias("n"))
    whole = records.where("n = 4 and startswith(name, '@') and length(seq) = length(qual)")
    return whole.select("file", F.split(F.substring("name", 2, 1 << 30), r"\s")[0].alias("qname"), "seq", "qual")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(qname, seq) with wrapped lines joined; records are told apart by the line separator, so a file may be split."""
    return _fasta(spark.read.option("lineSep", "\n>").text(paths)).drop("file")


def _fasta(texts: DataFrame) -> DataFrame:
    records = texts.where("value <> ''").withColumn("file", F.col("_metadata.file_path"))
    plain = records.select("file", F.regexp_replace("value", "^>", "").alias("value"))
    head = F.split("value", r"\n")[0]
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s", "")
    return plain.select(F.split(head, r"\s")[0].alias("qname"), body.alias("seq"), "file")


def read_table(spark: SparkSession, paths: str | list[str], schema: str, header: bool = True, **options) -> DataFrame:
    """Tab-separated files with a fixed schema; the file's stem is kept as ``sample``."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", header).options(**options).csv(paths)
    return rows.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^/.]+)*$", 1).alias("sample"))


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(BED).option("sep", "\t").option("comment", "#").csv(paths)


def read_vcf(spark: SparkSession, paths: str | list[str], names: DataFrame | None = None) -> DataFrame:
    """Variant places, of all or of the given (refname)."""
    rows = spark.read.schema(VCF).option("sep", "\t").option("comment", "#").csv(paths)
    return rows if names is None else rows.join(names, "refname", "left_semi")


def read_gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(GFF).option("sep", "\t").option("comment", "#").csv(paths)


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of SAM text with their tags as a map; header lines are left out."""
    lines = spark.read.text(paths).where("not startswith(value, '@')")
    f = F.split("value", "\t")
    names = [x.split()[0] for x in SAM.split(", ")]
    kinds = [x.split()[1] for x in SAM.split(", ")]
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    return lines.select(*[F.get(f, F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], tags.alias("tags"))


def read_columns(spark: SparkSession, paths: str | list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """JSON lines of aligned strings with low <= identity < high."""
    schema = "msa_seqs array<string>, names array<string>, strands array<string>, identity double, query_aln_len int"
    return spark.read.schema(schema).json(paths).where((F.col("identity") >= low) & (F.col("identity") < high))


def with_tags(sam: DataFrame, most_passes: int = 25) -> DataFrame:
    """Channel, passes and accuracy with their fallbacks: ``ch``, ``zm`` or the name; ``rq`` or from ``cq``."""
    tag = lambda t, kind: F.get(F.array(F.col("tags")[t]), F.lit(0)).try_cast(kind)
    channel = F.coalesce(tag("ch", "long"), tag("zm", "long"), F.try_element_at(F.split("qname", "/"), F.lit(2)).try_cast("long"))
    return sam.withColumns({"ch": channel, "np": F.least(tag("np", "int"), F.lit(most_passes)), "rq": F.coalesce(tag("rq", "double"), 1 - F.pow(F.lit(10.0), -tag("cq", "double") / 10))})


def fastq_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), "qname"), "seq", F.lit("+"), "qual").alias("value"))


def fasta_text(df: DataFrame, width: int = 80) -> DataFrame:
    return df.select(F.concat(F.lit(">"), "qname", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def write_fastq(df: DataFrame, path: str, thresholds: tuple[float, ...] = (), accuracy: str = "rq") -> None:
    """FASTQ files; with thresholds a folder for each, with the reads that reach it."""
    if not thresholds:
        fastq_text(df).write.text(path)
        return
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(accuracy) >= t)
    each = df.withColumn("thr", F.explode(reached))
    each.select("thr", F.concat_ws("\n", F.concat(F.lit("@"), "qname"), "seq", F.lit("+"), "qual").alias("value")).write.partitionBy("thr").text(path)


def write_fasta_each(df: DataFrame, path: str, files: int = FILES) -> int:
    """A file for each sequence, in a folder named by it. Returns the number of parts: ``part=0`` and so on have about ``files`` folders each.

    A part is a job of its own, since the driver keeps the names of what a job writes. Sequences are dealt out to the parts once, so
    a part's job reads no other's.
    """
    parts = max(math.ceil(df.select("qname").distinct().count() / files), 1)
    text = F.concat(F.lit(">"), "qname", F.lit("\n"), "seq").alias("value")
    h = F.xxhash64("qname")
    dealt = df.select("qname", text, F.pmod(h, F.lit(parts)).alias("part"), F.pmod(F.shiftright(h, 32), F.lit(16)).alias("piece"))
    staged = materialize(spread(dealt, "part", "piece").drop("piece"), "part")
    for part in range(parts):
        rows = staged.where(F.col("part") == part).select("qname", "value")
        spread(rows, "qname").write.partitionBy("qname").text(f"{path}/part={part}")
    discard(staged)
    return parts


def read_fasta_each(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """(qname, seq, file) of the files that write_fasta_each wrote, as a table. The driver lists a part at a time, and keeps no list of its files."""
    found, n = new_path(spark), 4 * spark.sparkContext.defaultParallelism
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", n), setting(spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
        for part in range(parts):
            rows = _fasta(spark.read.options(lineSep="\n>", recursiveFileLookup=True).text(f"{path}/part={part}"))
            rows.coalesce(n).write.mode("append").parquet(found)
            gc.collect()  # Python's handles lie in cycles, and hold the lists of earlier parts in the driver
    return spark.read.schema(rows.schema).parquet(found)


def write_metrics(df: DataFrame, path: str, force: bool = False) -> None:
    """A tab-separated table with header; an existing one is replaced only with force."""
    df.write.mode("overwrite" if force else "error").option("sep", "\t").option("header", True).csv(path)


def write_parts(df: DataFrame, path: str, n: int) -> None:
    """The rows dealt into n files in turn."""
    df.repartition(n).write.parquet(path)


def reads_of_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTQ as a read table with accuracy from the qualities and channel from the name."""
    reads = read_fastq(spark, paths)
    return reads.select("qname", "seq", "qual", mean_accuracy("qual").alias("rq"), F.try_element_at(F.split("qname", "/"), F.lit(2)).try_cast("long").alias("ch"))


def by_barcode(df: DataFrame, barcode: str = "barcode", least: int = 1000) -> DataFrame:
    """Rows of barcodes with at least so many reads."""
    enough = df.groupBy(F.col(barcode).alias("code")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return df.join(enough, df[barcode].eqNullSafe(enough["code"]), "left_semi")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """(qname, seq) of a reference file, by the path's extension."""
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind in ("fa", "fasta", "fna"):
        return read_fasta(spark, path)
    if kind in ("fq", "fastq"):
        return read_fastq(spark, path).select("qname", "seq")
    if kind == "sam":
        return read_sam(spark, path).select("qname", "seq")
    raise ValueError(f"no reader for a reference that ends in .{kind}")


def basic_table(sam: DataFrame) -> DataFrame:
    """(qname, np, rq, read_len): no passes count as 0, and quality is ``cq`` or from ``rq``. Records that have neither, or no bases, are skipped."""
    tag = lambda t, kind: F.get(F.array(F.col("tags")[t]), F.lit(0)).try_cast(kind)
    quality = F.coalesce(tag("cq", "double"), phred(tag("rq", "double"), eps=1e-6))
    rows = sam.where("seq is not null and seq <> '*'").select("qname", F.coalesce(tag("np", "int"), F.lit(0)).alias("np"), quality.alias("rq"), F.length("seq").cast("long").alias("read_len"))
    return rows.where("rq is not null")


def dump_basic(sam: DataFrame, path: str) -> str | None:
    """Writes the basic table; None, and no file, where no record is left."""
    basic = basic_table(sam)
    if basic.isEmpty():
        return None
    write_metrics(basic, path)
    return path


def read_tables_under(spark: SparkSession, folder: str, schema: str, *, pattern: str = "*.csv", sample: str = r"([^/]+?)(\.[^/.]+)*$") -> DataFrame:
    """All tab-separated tables below a folder, with ``sample`` cut out of each file's path."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": pattern, "sep": "\t", "header": True}
    return spark.read.schema(schema).options(**options).csv(folder).select("*", F.regexp_extract("_metadata.file_path", sample, 1).alias("sample"))


def merged_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of many SAM texts as one: the header of the first, and the records of all. Sorted by ``place``, the header stands first and lines keep their order in a file.

    The records of all files are one scan, however many there are.
    """
    header = F.startswith("value", F.lit("@"))

    def lines(of: str | list[str], kind: int) -> DataFrame:
        at = F.struct(F.lit(kind).alias("kind"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        return spark.read.text(of).withColumn("place", at)

    return lines(paths[0], 0).where(header).unionByName(lines(paths, 1).where(~header))


def without_tags(tags: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*names))


def with_constant_tag(tags: Column, name: str, value: str, seq: Column) -> Column:
    """Tags with a per-base one set to the same value for every base."""
    return F.map_concat(without_tags(tags, (name,)), F.create_map(F.lit(name), F.array_join(F.array_repeat(F.lit(value), F.length(seq)), ",")))


def renamed_fields(header: Column, names: dict[str, str]) -> Column:
    """A tab-separated header line with its fields renamed; values stay."""
    field = lambda f: F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.substring_index(f, ":", 1)], F.substring_index(f, ":", 1))
    one = lambda f: F.when(F.instr(f, ":") > 0, F.concat(field(f), F.substring(f, F.instr(f, ":"), F.length(f)))).otherwise(f)
    return F.array_join(F.transform(F.split(header, "\t"), one), "\t")
