"""Column functions on sequences, qualities and alignment strings; native expressions, but for mean_accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Operations of an alignment string that consume the query, the reference, or either.
QUERY_OPS, REF_OPS = "=XIS", "=XDN"
CIGAR = r"(\d+)([MIDNSHP=X])"
BLOCK = 32


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(part: Column | str, whole: Column | str) -> Column:
    """part / whole, null where whole is zero."""
    return col(part) / F.nullif(col(whole).cast("double"), F.lit(0.0))


def phred(accuracy: Column | str, *, cap: float | None = None, eps: float = 0.0, floor: float | None = None) -> Column:
    """-10 log10(1 - accuracy + eps). cap bounds the accuracy from above, floor the error from below."""
    value = col(accuracy).cast("double")
    error = 1 - (F.least(value, F.lit(cap)) if cap is not None else value) + eps
    return -10 * F.log10(F.greatest(error, F.lit(floor)) if floor is not None else error)


def accuracy(quality: Column | str) -> Column:
    return 1 - F.pow(F.lit(10.0), -col(quality).cast("double") / 10)


def qualities(text: Column | str, offset: int = 33) -> Column:
    """Array of quality values of a quality string; empty for an empty one."""
    text = col(text)
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


_ERRORS = np.array([10 ** (-q / 10) for q in range(94)])


@F.pandas_udf(DoubleType())
def _mean_accuracy(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> float | None:
        if not isinstance(text, str) or not text:
            return None
        letters = np.frombuffer(text.encode(), np.uint8)
        # Summed in the order of the qualities, so the value doesn't depend on the order of the bases.
        return 1 - float(np.cumsum(np.bincount(letters, minlength=127)[33:127] * _ERRORS)[-1]) / letters.size

    return texts.map(one).astype("float64")


def mean_accuracy(text: Column | str) -> Column:
    """1 - mean error over the bases; null for an empty string. Counts the quality letters in one pass over a text, in numpy."""
    return _mean_accuracy(col(text))


def mean_accuracy_by_base(text: Column | str) -> Column:
    """1 - mean error by a walk over the bases."""
    values = qualities(text)
    total = F.aggregate(values, F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q / F.lit(10.0)))
    return 1 - rate(total, F.size(values))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def rna_to_dna(seq: Column | str) -> Column:
    return F.translate(F.upper(col(seq)), "U", "T")


def compress_runs(seq: Column | str) -> Column:
    """Each run of a base as one base."""
    return F.regexp_replace(col(seq), r"(.)\1+", "$1")


def runs(seq: Column | str, letters: str = "ACGT", least: int = 1) -> Column:
    """Runs of equal bases in order, as strings."""
    pattern = "|".join(f"{c}{{{least},}}" for c in letters)
    return F.regexp_extract_all(col(seq), F.lit(pattern), F.lit(0))


def count_motif(seq: Column | str, motif: str) -> Column:
    """Occurrences that don't overlap."""
    seq = col(seq)
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(motif), F.lit("")))) / len(motif)).cast("long")


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<op, n>> of an alignment string."""
    cigar = col(cigar)
    return F.zip_with(
        F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(1)), F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(2)), lambda n, op: F.struct(op.alias("op"), n.cast("int").alias("n"))
    )


def cigar_total(ops: Column | str, kinds: str) -> Column:
    """Length of all operations of these kinds."""
    return F.aggregate(F.filter(col(ops), lambda o: F.instr(F.lit(kinds), o["op"]) > 0), F.lit(0).cast("long"), lambda total, o: total + o["n"])


def cigar_identity(ops: Column | str) -> Column:
    """Matches over all aligned columns."""
    return rate(cigar_total(ops, "="), cigar_total(ops, "=XID"))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: an expression inside a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows with these columns evaluated once for each, whatever lambdas use them further on."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def in_blocks(items: Column | str) -> Column:
    """An array cut into arrays of BLOCK. An array that grows by one is copied each time, so sums are carried block by block."""

    def blocks(x: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(x) > 0, some).otherwise(F.array(x))

    return let(col(items), blocks)


def placed_ops(ops: Column | str, rstart: Column | str) -> Column:
    """Operations with where each begins in the query (q), the reference (r) and among the columns (c)."""
    used = lambda kinds, o: F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["n"]).otherwise(0)
    at = lambda q, r, c: F.struct(q.alias("q"), r.alias("r"), c.alias("c"))
    moved = lambda s, o: at(s["q"] + used(QUERY_OPS, o), s["r"] + used(REF_OPS, o), s["c"] + o["n"])
    empty = lambda kind: F.expr(f"cast(array() as array<struct<{kind}>>)")
    zero = at(F.lit(0), F.lit(0), F.lit(0))
    begins = lambda blocks: F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, zero, moved)), F.struct(at(F.lit(0), col(rstart).cast("int"), F.lit(0)).alias("at"), empty("q:int,r:int,c:int").alias("out")),
        lambda s, n: F.struct(at(*(s["at"][k] + n[k] for k in "qrc")).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"],
    )

    def place(block: Column, begin: Column) -> Column:
        # What an aggregate carries is copied for each element, so only the places are.
        start = F.struct(begin.alias("at"), empty("q:int,r:int,c:int").alias("out"))
        places = F.aggregate(block, start, lambda s, o: F.struct(moved(s["at"], o).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])
        return F.zip_with(block, places, lambda o, p: F.struct(o["op"].alias("op"), o["n"].alias("n"), *[p[k].alias(k) for k in "qrc"]))

    return let(in_blocks(ops), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), place)))


def cut(text: Column | str, begin: Column, n: Column) -> Column:
    """n letters from the 0-based place on. Sequences are one byte a letter, so bytes are cut and no letter before is walked."""
    return F.substring(col(text).cast("binary"), begin + 1, n).cast("string")


def trim_ends(seq: Column | str, least: int = 5, ends: str = "both") -> Column:
    """Without a run of one base at the ends that is at least so long."""
    out = col(seq)
    if ends in ("5p", "both"):
        out = F.regexp_replace(out, rf"^(A{{{least},}}|C{{{least},}}|G{{{least},}}|T{{{least},}})", "")
    if ends in ("3p", "both"):
        out = F.regexp_replace(out, rf"(A{{{least},}}|C{{{least},}}|G{{{least},}}|T{{{least},}})$", "")
    return out


def run_right(seq: Column | str, at: Column | str) -> Column:
    """Length of the run of equal bases that begins at the 0-based place."""
    rest = F.substring(col(seq), col(at) + 1, F.length(col(seq)))
    return F.length(rest) - F.length(F.ltrim(rest, F.substring(rest, 1, 1)))


def map_text(counts: Column | str) -> Column:
    """A map as ``key:value`` sorted by key and comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(counts))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def text_map(text: Column | str) -> Column:
    return F.str_to_map(col(text), F.lit(","), F.lit(":"))


def channel_of(name: Column | str, separator: str = "/", part: int = 1) -> Column:
    return F.try_element_at(F.split(col(name), separator), F.lit(part + 1)).try_cast("long")


def motif_parts(motif: Column | str) -> tuple[Column, Column]:
    """Unit and count of ``(AC)3``."""
    motif = col(motif)
    return F.regexp_extract(motif, r"\((\w+)\)(\d+)", 1), F.regexp_extract(motif, r"\((\w+)\)(\d+)", 2).try_cast("int")


def run_date(name: Column | str) -> Column:
    """Date of eight digits in a file name, null without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(col(name), r"(\d{8})", 1), F.lit("")), "yyyyMMdd")
