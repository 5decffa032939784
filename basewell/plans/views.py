"""Sequencing tables on the given ones, as DataFrames and as SQL for the same.

reads: a document's letters as bases, once more as quality letters. subreads: the turns of a conversation, which is
the channel. alignments: each turn's bases as reference, and two reads of it with differences at fixed motifs.
columns: the same bases as equally long strings with gaps, for voting. facts: line items as counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.sources.scratch import spread

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
QUALITIES = "+5?I.8BK&3>H*6AJ(4=G,7@L)9"
#: Edits of a read of the reference, as fixed values: a motif, and the motif with an edit in it. In the result a
#: lower-case base is a mismatch, w-z are deleted A, C, G, T, and 1 and 2 an inserted A and C.
EDITS = (
    (("ACG", "AcG"), ("GTA", "GzA"), ("TCA", "TC1A"), ("CCC", "CC2C"), ("AAA", "AwA")),
    (("CGT", "CgT"), ("TAC", "TwC"), ("AGG", "AG1G"), ("CCC", "CxC"), ("TTG", "tTG")),
)
#: Gapped rows of a column view: consensus, reference and subreads, each with its motif and what stands for it.
ROWS = {"smc": (("ACG", "A-G"), ("TTA", "TCA"), ("GGA", "GGC")), "ref": (("CTC", "C-C"), ("GGA", "GTA")), "s1": (("ACG", "A-G"), ("TTA", "TCA")), "s2": (("ACG", "A-G"), ("GGA", "GGC")), "s3": (("TTA", "TCA"), ("GGA", "G-A")), "s4": (("CTC", "C-C"),)}

_LETTERS = "lower(regexp_replace(coalesce({0}, ''), '[^A-Za-z]', '', 'g'))"
_READS = f"""letters AS (SELECT doc_id, source, lang, {_LETTERS.format("text")} AS s FROM documents),
reads AS (SELECT 'run/' || doc_id || '/ccs' AS qname, doc_id AS ch, source AS run, lang AS barcode, translate(s, '{ALPHABET}', '{BASES}') AS seq,
  translate(s, '{ALPHABET}', '{QUALITIES}') AS qual, (1 + doc_id % 30)::INT AS np, 1 - 1.0 / (2 + doc_id * 37 % 5000) AS rq, doc_id % 2 = 0 AS fwd, (doc_id * 7 % 64)::INT AS flag FROM letters)"""
READS_SQL = "WITH " + _READS
#: Sum of the error probabilities of a quality string.
ERRORS_SQL = " + ".join(f"(length(qual) - length(replace(qual, '{c}', ''))) * pow(10.0, -{ord(c) - 33} / 10.0)" for c in sorted(set(QUALITIES)))
_SUBREADS = f"""subreads AS (SELECT conv_id AS ch, turn::INT AS turn, role, CASE WHEN turn % 3 = 1 THEN 1 ELSE 3 END AS cx,
  translate({_LETTERS.format("text")}, '{ALPHABET}', '{BASES}') AS seq FROM conversations)"""
SUBREADS_SQL = "WITH " + _SUBREADS


def _edited(edits: tuple[tuple[str, str], ...]) -> str:
    out = "seq"
    for motif, edit in edits:
        out = f"replace({out}, '{motif}', '{edit}')"
    return out


ALIGNMENTS_SQL = (
    SUBREADS_SQL
    + ",\nscripts AS ("
    + " UNION ALL ".join(f"SELECT ch || '/' || turn || '/{n}' AS qname, 'ref' || ch || '.' || turn AS refname, ch, turn, seq AS rseq, {_edited(e)} AS script FROM subreads WHERE seq <> ''" for n, e in enumerate(EDITS))
    + """),
alignments AS (SELECT qname, refname, ch, turn, rseq, translate(script, 'ACGTacgtwxyz12', '====XXXXDDDDII') AS ops, translate(script, 'ACGTacgt12wxyz', 'ACGTCGTAAC') AS seq, translate(translate(script, 'ACGTacgt12wxyz', 'ACGTCGTAAC'), 'ACGT', '+5?I') AS qual, script FROM scripts)"""
)
#: One row for each column of each alignment, found on the script itself and so apart from the alignment string.
ALN_SQL = ALIGNMENTS_SQL.replace(",\nscripts AS", ",\nscripts AS MATERIALIZED") + """,
spots AS (SELECT qname, refname, script, unnest(range(length(script))) AS i FROM scripts),
chars AS (SELECT qname, refname, i, substr(script, i + 1, 1) AS c FROM spots),
aln AS MATERIALIZED (SELECT qname, refname, i::BIGINT AS col_idx, translate(c, 'ACGTacgtwxyz12', '====XXXXDDDDII') AS op,
  CASE WHEN c NOT IN ('w', 'x', 'y', 'z') THEN count(*) FILTER (c NOT IN ('w', 'x', 'y', 'z')) OVER (PARTITION BY qname ORDER BY i) - 1 END AS qpos,
  CASE WHEN c NOT IN ('1', '2') THEN count(*) FILTER (c NOT IN ('1', '2')) OVER (PARTITION BY qname ORDER BY i) - 1 END AS rpos,
  nullif(translate(c, 'ACGTacgt12wxyz', 'ACGTCGTAAC'), '') AS qbase, nullif(translate(c, 'ACGTacgtwxyz12', 'ACGTACGTACGT'), '') AS rbase FROM chars)"""
#: The entries of tagged, each with its place, both runs and its label, from runs cut out of whole sequences.
SAMPLES_SQL = ALN_SQL + """,
marks AS (SELECT qname, refname, i, c, split_part(qname, '/', 1)::BIGINT AS ch, count(*) FILTER (c NOT IN ('w', 'x', 'y', 'z')) OVER (PARTITION BY qname ORDER BY i) - 1 AS pos,
  count(*) FILTER (c NOT IN ('1', '2')) OVER (PARTITION BY qname ORDER BY i) - 1 AS refcoord, coalesce(lag(c) OVER (PARTITION BY qname ORDER BY i) IN ('w', 'x', 'y', 'z'), false) AS behind FROM chars),
entries AS (SELECT *, CASE WHEN behind THEN 30 + 5 * ((i * 7 + ch) % 11) ELSE 5 * ((i * 3 + ch) % 13) END / 100 AS support FROM marks WHERE c IN ('A', 'C', 'G', 'T') AND (behind OR i % 11 = ch % 11)),
qparts AS (SELECT qname, length(seq) AS qlen, unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS part, generate_subscripts(regexp_extract_all(seq, 'A+|C+|G+|T+'), 1) AS k FROM alignments),
qruns AS MATERIALIZED (SELECT qname, qlen, length(part) AS n, (sum(length(part)) OVER (PARTITION BY qname ORDER BY k) - length(part))::BIGINT AS a FROM qparts),
rparts AS (SELECT qname, unnest(regexp_extract_all(rseq, 'A+|C+|G+|T+')) AS part, generate_subscripts(regexp_extract_all(rseq, 'A+|C+|G+|T+'), 1) AS k FROM alignments),
rruns AS MATERIALIZED (SELECT qname, left(part, 1) AS base, length(part) AS n, (sum(length(part)) OVER (PARTITION BY qname ORDER BY k) - length(part))::BIGINT AS a FROM rparts),
samples AS MATERIALIZED (SELECT e.qname, e.refname, e.pos, e.c AS base, q.a + q.n - e.pos AS repeat, e.support, 10 + e.i % 5 AS depth, e.refcoord, q.n AS cons_run, CASE WHEN r.n > 1 AND r.base = e.c THEN r.n ELSE 0 END AS ref_run,
  r.n > 1 AND r.base = e.c AND r.n > q.n AS label, CASE WHEN r.n > 1 AND r.base = e.c AND r.n > q.n THEN r.n - q.n ELSE 0 END AS insert_cnt, e.pos / q.qlen AS pos_frac
  FROM entries e JOIN qruns q ON q.qname = e.qname AND e.pos >= q.a AND e.pos < q.a + q.n JOIN rruns r ON r.qname = e.qname AND e.refcoord >= r.a AND e.refcoord < r.a + r.n)"""
FACTS_SQL = """WITH facts AS (SELECT l_orderkey AS qname, l_linenumber AS seg, l_suppkey AS ch, l_returnflag AS tag, l_linestatus AS status, l_shipdate AS ts,
  CASE WHEN l_partkey % 10 = 0 THEN NULL WHEN l_partkey % 10 = 1 THEN '' ELSE 'chr' || (l_partkey % 10) END AS rname,
  ['A', 'C', 'G', 'T'][(l_partkey % 4 + 1)::INT] AS base, (l_quantity * 20)::BIGINT AS qlen, (l_quantity * 18)::BIGINT AS eq, (l_partkey % 7)::BIGINT AS diff,
  (l_partkey % 5)::BIGINT AS ins, (l_partkey % 3)::BIGINT AS homo_ins, (l_suppkey % 5)::BIGINT AS del, (l_suppkey % 3)::BIGINT AS homo_del,
  (l_suppkey % 30 + 1)::BIGINT AS np, (l_partkey % 12 + 1)::BIGINT AS true_cnt, (l_partkey % 12 + 1 + l_suppkey % 5 - 2)::BIGINT AS called FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(text: str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", ""))


def reads(spark: SparkSession, sf_dir: str, empty: bool = True) -> DataFrame:
    """All reads, or those with a base: texts are asked for a letter, since a filter on seq would make the sequence a second time."""
    docs = table(spark, sf_dir, "documents")
    docs = (docs if empty else docs.where(F.col("text").rlike("[A-Za-z]"))).withColumn("s", _letters("text"))
    i = F.col("doc_id")
    return docs.select(
        F.concat(F.lit("run/"), i, F.lit("/ccs")).alias("qname"), i.alias("ch"), F.col("source").alias("run"), F.col("lang").alias("barcode"), F.translate("s", ALPHABET, BASES).alias("seq"),
        F.translate("s", ALPHABET, QUALITIES).alias("qual"), (1 + i % 30).cast("int").alias("np"), (1 - 1.0 / (2 + i * 37 % 5000)).alias("rq"), (i % 2 == 0).alias("fwd"), (i * 7 % 64).cast("int").alias("flag"),
    )


def subreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.select(F.col("conv_id").alias("ch"), F.col("turn").cast("int").alias("turn"), "role", F.when(F.col("turn") % 3 == 1, 1).otherwise(3).alias("cx"), F.translate(_letters("text"), ALPHABET, BASES).alias("seq"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two alignments of each reference: qname, refname, rstart, cigar, seq, rseq."""
    base = subreads(spark, sf_dir).where("seq <> ''")
    scripts = F.array(*[F.struct(F.lit(n).alias("n"), _script(e).alias("script")) for n, e in enumerate(EDITS)])
    both = base.select("*", F.inline(scripts))
    ops = F.translate("script", "ACGTacgtwxyz12", "====XXXXDDDDII")
    cigar = F.array_join(F.transform(F.regexp_extract_all(ops, F.lit("=+|X+|I+|D+"), F.lit(0)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")
    query = F.translate("script", "ACGTacgt12wxyz", "ACGTCGTAAC")
    return both.select(
        F.concat_ws("/", "ch", "turn", "n").alias("qname"), F.concat(F.lit("ref"), "ch", F.lit("."), "turn").alias("refname"), "ch", "turn", F.lit(0).alias("rstart"), cigar.alias("cigar"),
        query.alias("seq"), F.translate(query, "ACGT", "+5?I").alias("qual"), F.col("seq").alias("rseq"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments' reads with a tag ``di`` of places where bases may be missing: behind each deletion, and at every eleventh column."""
    base = subreads(spark, sf_dir).where("seq <> ''")
    scripts = F.array(*[F.struct(F.lit(n).alias("n"), _script(e).alias("script")) for n, e in enumerate(EDITS)])
    both = base.select("ch", "turn", F.inline(scripts))

    def entry(c: Column, i: Column) -> Column:
        behind = (i > 0) & F.substring("script", i, F.lit(1)).isin("w", "x", "y", "z")
        pos = F.length(F.translate(F.substring("script", F.lit(1), i), "wxyz", ""))
        support = F.when(behind, 30 + 5 * ((i * 7 + F.col("ch")) % 11)).otherwise(5 * ((i * 3 + F.col("ch")) % 13)) / 100
        return F.when(c.isin("A", "C", "G", "T") & (behind | (i % 11 == F.col("ch") % 11)), F.concat_ws(",", pos, c, support, 10 + i % 5))

    letters = F.filter(F.split("script", ""), lambda c: c != "")
    tag = F.array_join(F.filter(F.transform(letters, entry), lambda e: e.isNotNull()), ";")
    tags = both.select(F.concat_ws("/", "ch", "turn", "n").alias("qname"), F.concat(tag, F.lit(";3,N,0.5,2; ;x")).alias("di"))
    return alignments(spark, sf_dir).join(tags, "qname")


def _script(edits: tuple[tuple[str, str], ...]) -> Column:
    out = F.col("seq")
    for motif, edit in edits:
        out = F.replace(out, F.lit(motif), F.lit(edit))
    return out


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapped strings of one length: rec, smc, ref and an array of subreads."""
    base = subreads(spark, sf_dir).where("seq <> ''")
    made = {name: _script(edits) for name, edits in ROWS.items()}
    return base.select((F.col("ch") * 1000 + F.col("turn")).alias("rec"), made["smc"].alias("smc"), made["ref"].alias("ref"), F.array(made["s1"], made["s2"], made["s3"], made["s4"]).alias("subs"))


COLUMNS_SQL = SUBREADS_SQL + ",\nmsa AS (SELECT ch * 1000 + turn AS rec, " + ", ".join(f"{_edited(e)} AS {n}" for n, e in ROWS.items()) + """ FROM subreads WHERE seq <> ''),
spots AS (SELECT *, unnest(range(length(ref))) AS i FROM msa),
cols AS MATERIALIZED (SELECT rec, i::BIGINT AS pos, substr(smc, i + 1, 1) AS smc, substr(ref, i + 1, 1) AS ref, [substr(s1, i + 1, 1), substr(s2, i + 1, 1), substr(s3, i + 1, 1), substr(s4, i + 1, 1)] AS subs FROM spots)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as counts of aligned bases."""
    items = table(spark, sf_dir, "lineitem")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    name = F.when(p % 10 == 0, F.lit(None)).when(p % 10 == 1, "").otherwise(F.concat(F.lit("chr"), p % 10))
    long = {"qlen": q * 20, "eq": q * 18, "diff": p % 7, "ins": p % 5, "homo_ins": p % 3, "del": s % 5, "homo_del": s % 3, "np": s % 30 + 1, "true_cnt": p % 12 + 1, "called": p % 12 + 1 + s % 5 - 2}
    return items.select(
        F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("seg"), s.alias("ch"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("ts"), name.alias("rname"),
        F.element_at(F.array(*map(F.lit, "ACGT")), (p % 4 + 1).cast("int")).alias("base"), *[v.cast("long").alias(k) for k, v in long.items()],
    )
