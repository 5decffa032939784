"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest earlier one plus a symbol). A symbol is a
run of up to four characters of a word, counted from the word's start, with the white space behind it, so that parses
of texts that share words fall into step. The set of its phrases is hashed and sketched by one-permutation minimum hashing: the hash space is cut into bins, each keeps
its minimum, and an empty bin borrows from the next full one. Two texts that compress alike share phrases, so the
share of equal bins estimates the likeness of their phrase sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewell.llm import textbytes as tb
from basewell.llm.common import with_row_id

U64 = np.uint64
BINS = 128
#: Bits that a fingerprint keeps of each bin, and the chance that two different minima agree in them.
BITS = 8
CHANCE = 2.0**-BITS
_SYMBOLS = re.compile(r"\S{1,4}\s*|\s+").findall
#: Texts of about so many characters are hashed at once.
GROUP_CHARS = 500_000


def _parse(text: str, at: int, begin: int, end: int, known: set[str], cuts: list[int]) -> int:
    """Goes on with the parse at a word start, up to end; cuts gets the end of each phrase. Returns where the open phrase begins."""
    add, cut, stop = known.add, cuts.append, begin
    for symbol in _SYMBOLS(text, begin, end):
        stop += len(symbol)
        phrase = text[at:stop]
        if phrase not in known:
            add(phrase)
            cut(stop)
            at = stop
    return at


def phrases(text: str) -> list[str]:
    """The phrases of a text in order; the last one may be unfinished and then repeats an earlier one."""
    cuts = _cuts(text)
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _cuts(text: str) -> list[int]:
    cuts = [0]
    at = _parse(text, 0, 0, len(text), set(), cuts)
    return cuts if at == len(text) else [*cuts, len(text)]


def _sketches(parsed: list[tuple[str, list[int]]]) -> list[np.ndarray]:
    """For each text with its cuts the kept bits of its bins; none for an empty text."""
    if not parsed:
        return []
    points = np.frombuffer("".join(t for t, _ in parsed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    begin = np.cumsum([0, *(len(t) for t, _ in parsed)])[:-1]
    edges = [np.array(c, np.int64) + b for (_, c), b in zip(parsed, begin, strict=True)]
    starts, ends = np.concatenate([e[:-1] for e in edges]), np.concatenate([e[1:] for e in edges])
    owner = np.repeat(np.arange(len(parsed)), [len(e) - 1 for e in edges])
    keys = tb.Hasher(points, codes=tb.mix(points + U64(1)))(starts, ends)
    top = np.iinfo(U64).max
    minima = np.full(len(parsed) * BINS, top, U64)
    np.minimum.at(minima, owner * BINS + (keys >> U64(64 - BINS.bit_length() + 1)).astype(np.int64), keys)
    minima = minima.reshape(-1, BINS)
    full = minima != top
    place = np.where(np.hstack([full, full]), np.arange(2 * BINS), 4 * BINS)
    source = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    distance = (source - np.arange(BINS)).astype(U64)
    taken = np.take_along_axis(minima, source % BINS, axis=1)
    bits = (tb.mix(taken + distance * U64(0x9E3779B97F4A7C15)) & U64((1 << BITS) - 1)).astype(np.uint8)
    return [b if f else b[:0] for b, f in zip(bits, full.any(axis=1), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated likeness of two fingerprints, 0 to 1. Two empty texts are alike, an empty and a full one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    equal = float((a == b).mean())
    return max(0.0, (equal - CHANCE) / (1 - CHANCE))


def fingerprint(text: str) -> str:
    """The kept bits in hexadecimal; an empty text has an empty fingerprint."""
    return _sketches([(text, _cuts(text))])[0].tobytes().hex()


def _edited_cuts(text: str, tail: str, keep: int) -> tuple[list[int], str, list[int]]:
    """Cuts of text, the edited text text[:keep] + tail, and its cuts; what the two share is parsed once."""
    known: set[str] = set()
    edited = text[:keep] + tail
    word = 1 + max(text.rfind(" ", 0, max(keep - 1, 0)), text.rfind("\n", 0, max(keep - 1, 0)))
    if word >= keep or text[word].isspace():
        word = 0
    cuts = [0]
    at = _parse(text, 0, 0, word, known, cuts)
    shared = cuts[:]
    open_at = _parse(text, at, word, len(text), known, cuts)
    known.difference_update([text[a:b] for a, b in zip(cuts[len(shared) - 1 :], cuts[len(shared) :], strict=False)])
    edited_open = _parse(edited, at, word, len(edited), known, shared)
    return cuts if open_at == len(text) else [*cuts, len(text)], edited, shared if edited_open == len(edited) else [*shared, len(edited)]


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each text (null: that of an empty one), row by row."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.fillna("").map(fingerprint)

    return docs.withColumn(out_col, run(text_col))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last quarter of its code points (rounded down) replaced by the first as many (or all) of
    the next document; documents follow by id (nulls last, then by text), the first one after the last. Rows that
    share an id are documents of their own. A single document is its own next one.

    The order is cut into ranges of about equal counts; each range also gets the first document of the one after it,
    so texts are shuffled once and no task needs more than its range. The first ids of the ranges, one for each, are
    all that the driver sees.
    """
    rows, _ = with_row_id(docs.select(id_col, text_col), id_col, text_col)
    spark = docs.sparkSession
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [(i + 1) / n_ranges for i in range(n_ranges - 1)]
    cuts = rows.agg(F.percentile_approx("row_id", wanted, 10 * n_ranges)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], schema)
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(row_id):
        return pd.Series(np.searchsorted(cuts, row_id.to_numpy(), "left").astype(np.int32))

    ranged = rows.withColumn("part", range_of("row_id"))
    firsts = [(r["part"], r["low"]) for r in ranged.groupBy("part").agg(F.min("row_id").alias("low")).orderBy("part").collect()]
    # Each first document is sent to its own range and, as the next of the last one there, to the range before.
    lows = pd.Series([firsts[i - 1][0] for i in range(len(firsts))], index=[low for _, low in firsts], dtype="Int32")

    @F.pandas_udf("int")
    def range_before(row_id):
        return lows.reindex(row_id).reset_index(drop=True)

    target = F.struct(F.col("part"), F.lit(0).alias("borrowed"))
    lent = F.struct(F.col("before").alias("part"), F.lit(1).alias("borrowed"))
    ranged = ranged.withColumn("before", range_before("row_id"))
    dealt = ranged.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(target)).otherwise(F.array(target, lent))))
    dealt = dealt.select(F.col("to.part").alias("part"), F.col("to.borrowed").alias("borrowed"), "row_id", F.col(id_col).cast("long").alias(id_col), text_col)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "borrowed", "row_id")

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def flush(waiting: list[tuple]) -> list[tuple]:
        """Rows of the documents whose next one is known; the last, if its next one isn't, stays in waiting."""
        parsed = [x for w in waiting for x in ((w[1], w[2]), (w[3], w[4]), *([(w[5], _cuts(w[5]))] if w[5] is not None else []))]
        prints = iter(_sketches(parsed))
        own = [(next(prints), next(prints), next(prints) if w[5] is not None else None) for w in waiting]
        rows = []
        for i, (doc_id, text, _, edited, _, _) in enumerate(waiting):
            mine, other, following = own[i]
            if following is None:
                if i + 1 == len(waiting):
                    break
                following = own[i + 1][0]
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, len(text), digest, mine.tobytes().hex(), other.tobytes().hex(), likeness(mine, other), likeness(mine, following)))
        del waiting[: len(rows)]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # id, text, cuts, edited text, its cuts, the next text where it is a borrowed one
        last, chars = None, 0
        for batch in batches:
            for part, borrowed, doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                text = cell.as_py() or ""
                if last is not None and last[0] == part:
                    before = last[2]
                    keep = len(before) - len(before) // 4
                    cuts, edited, edited_cuts = _edited_cuts(before, text[: len(before) // 4], keep)
                    waiting.append((last[1], before, cuts, edited, edited_cuts, text if borrowed else None))
                    chars += 2 * len(before)
                    if chars > GROUP_CHARS:
                        rows, chars = flush(waiting), 0
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                last = None if borrowed else (part, doc_id, text)
        if rows := flush(waiting):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, schema)
