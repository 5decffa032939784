"""Substring dedup on sentences: every run of several consecutive sentences is hashed and looked up in the whole corpus.

A text is cut into sentences: a sentence ends with a word that ends in ``.``, ``!`` or ``?`` (quotes and brackets may
follow), at a line end, and with the text. From each sentence the run of RUN sentences is taken. Runs are compared by
their words, lower-cased (A-Z). The first occurrence in the corpus stays; sentences that a later occurrence covers go.
Options, off unless given: ``words``, the least words of a run (it then grows until it has them), and ``long``, from
which on a sentence counts as several of that many words.

Runs begin at sentences, so with the option ``passage`` every stretch of that many words is looked up besides,
wherever it begins, in two steps. Of the word grams in a stretch the one of least hash is its anchor, and equal
stretches have equal anchors. An anchor stands for all stretches that select it: anchors whose gram is alone drop out,
and of equal ones all but the first go. Only the stretches of what is left are looked up one by one, by their own
hashes, so a gram that very many texts hold is spread over what surrounds it.

Each task settles the repeats among its own rows first, so a passage that a third of all documents share reaches the
shuffle once for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewell.llm import textbytes as tb
from basewell.llm.common import with_row_id
from basewell.llm.spans import FOUND, SHIFT, STRIPPED, found_rows, merged, removed_rows, settle, still_open, strip, without

RUN = 3
SETTLE_ROWS = 500_000
#: Words of an anchor's gram, and of the stretches that the query looks up besides runs.
GRAM = 16
PASSAGE = 51

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True


def sentence_runs(block: tb.Block, run: int = RUN, words: int = 0, long: int = 0) -> tuple[np.ndarray, ...]:
    """(two hashes, row, start, length) of each run, in bytes of its text."""
    starts, ends, bounds = tb.words(block)
    n = len(starts)
    if not n:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    tail = ends - 1
    for _ in range(2):
        tail = np.where(_CLOSE[block.data[tail]] & (tail > starts), tail - 1, tail)
    lines = np.r_[0, np.cumsum(block.data == 10)]
    last = _STOP[block.data[tail]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    first = np.r_[True, last[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    unit = np.flatnonzero(first | ((np.arange(n) - begin) % long == 0 if long else False))
    row = np.searchsorted(bounds, unit, "right") - 1
    edge = np.r_[unit, n]
    close = np.maximum(np.searchsorted(edge, unit + words), np.arange(len(unit)) + run)
    fits = close < len(edge)
    fits &= edge[np.minimum(close, len(edge) - 1)] <= bounds[row + 1]
    a, b, row = unit[fits], edge[close[fits]], row[fits]
    codes = tb.word_codes(block, starts, ends, lower=True)
    keys = [tb.Hasher(codes, codes=tb.mix(codes + np.uint64(seed)))(a, b) for seed in (1, 2)]
    return *keys, row, starts[a] - block.offsets[row], ends[b - 1] - starts[a]


def _run_rows(run: int, words: int, long: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            one, two, doc, start, size = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, again = settle((one, two), doc, start)
            later, first = order[again], order[~again]
            if len(later):
                yield removed_rows(doc[later], start[later], size[later])
            yield found_rows(one[first], two[first], doc[first], start[first], size[first], False)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column(1)):
                one, two, row, start, size = sentence_runs(block, run, words, long)
                held.append((one, two, ids[block.first + row], start, size))
                if sum(len(h[0]) for h in held) >= SETTLE_ROWS:
                    yield from settled()
        if held:
            yield from settled()

    return rows


def passage_anchors(block: tb.Block, size: int) -> tuple[np.ndarray, ...]:
    """(gram hash, hash of all its words, row, first word, words) of each anchor with the stretches of size words that select it."""
    starts, ends, bounds = tb.words(block)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin = np.flatnonzero(np.arange(len(starts)) + size <= bounds[row + 1])
    if not len(begin):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    gram = min(GRAM, size)
    codes = tb.word_codes(block, starts, ends, lower=True)
    at = np.arange(len(starts) - gram + 1)
    grams = tb.Hasher(codes, codes=tb.mix(codes + np.uint64(3)))(at, at + gram)
    anchor = begin + np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1)[begin].argmin(axis=1)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)])
    last = begin[np.r_[new[1:], len(begin)] - 1]
    first = begin[new]
    whole = tb.Hasher(codes, codes=tb.mix(codes + np.uint64(4)))(first, last + size)
    return grams[anchor[new]], whole, row[first], first - bounds[row[first]], last + size - first


def _anchor_rows(size: int):
    """Places are counted in words here. Word k is 2k and what follows it 2k + 1, so that removed stretches that only touch stay two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            gram, whole, doc, word, many = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, again = settle((gram, whole), doc, word)
            later, first = order[again], order[~again]
            if len(later):
                yield removed_rows(doc[later], 2 * word[later], 2 * many[later] - 1)
            yield found_rows(gram[first], whole[first], doc[first], 2 * word[first], 2 * many[first] - 1, False)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column(1)):
                gram, whole, row, word, many = passage_anchors(block, size)
                held.append((gram, whole, ids[block.first + row], word, many))
                if sum(len(h[0]) for h in held) >= SETTLE_ROWS:
                    yield from settled()
        if held:
            yield from settled()

    return rows


def _stretch_rows(size: int):
    """From (row_id, text, open places) each stretch of size words there, by its hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            one, two, doc, word = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, again = settle((one, two), doc, word)
            later, first = order[again], order[~again]
            if len(later):
                yield removed_rows(doc[later], 2 * word[later], np.full(len(later), 2 * size - 1))
            yield found_rows(one[first], two[first], doc[first], 2 * word[first], np.full(len(first), 2 * size - 1), False)

        for batch in batches:
            ids, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for block in tb.blocks(batch.column(1)):
                starts, ends, bounds = tb.words(block)
                codes = tb.word_codes(block, starts, ends, lower=True)
                hashers = [tb.Hasher(codes, codes=tb.mix(codes + np.uint64(seed))) for seed in (5, 6)]
                begin, doc, word = [], [], []
                for row in range(len(bounds) - 1):
                    for place in places[block.first + row]:
                        first, many = (place >> SHIFT) // 2, ((place & ((1 << SHIFT) - 1)) + 1) // 2
                        own = np.arange(first, first + many - size + 1)
                        begin.append(bounds[row] + own)
                        doc.append(np.full(len(own), ids[block.first + row]))
                        word.append(own)
                if not begin:
                    continue
                begin, doc, word = (np.concatenate(x) for x in (begin, doc, word))
                held.append((*(h(begin, begin + size) for h in hashers), doc, word))
                if sum(len(h[0]) for h in held) >= SETTLE_ROWS:
                    yield from settled()
        if held:
            yield from settled()

    return rows


def repeated_passages(rows: DataFrame, size: int) -> DataFrame:
    """rows (row_id, text) to (doc, passages): stretches of size words that have occurred before, as places in words."""
    open_ = still_open(rows.mapInArrow(_anchor_rows(size), FOUND))
    lists = open_.where("not removed").groupBy("doc").agg(F.collect_list("place").alias("open"))
    stretches = rows.join(lists, rows["row_id"] == lists["doc"]).select("row_id", "text", "open").mapInArrow(_stretch_rows(size), FOUND)
    turn = F.row_number().over(Window.partitionBy("key", "digest").orderBy("doc", "place"))
    later = stretches.withColumn("turn", turn).where("removed or turn > 1").select("doc", "place")
    return open_.where("removed").select("doc", "place").unionByName(later).groupBy("doc").agg(F.collect_list("place").alias("passages"))


def in_bytes(data: bytes, passages: list[int]) -> list[int]:
    """Places in words as places in bytes."""
    most, out = (1 << SHIFT) - 1, []
    starts, ends, _ = tb.words(tb.Block(0, np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    for first, last in merged(passages):
        start, end = int(starts[first // 2]), int(ends[(last - 1) // 2])
        out += [(a << SHIFT) | (min(a + most, end) - a) for a in range(start, end, most)]
    return out


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """strip, with passages as a fourth column."""

    def placed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for text, own, words in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                places.append((own or []) + (in_bytes(text.as_py().encode("utf-8", "surrogatepass"), words) if words else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int64()))], ["row_id", "text", "places"])

    yield from strip(placed())


def repeated_places(rows: DataFrame, run: int = RUN, words: int = 0, long: int = 0) -> DataFrame:
    """rows (row_id, text) to (doc, places): stretches covered by a run that isn't the first of its kind."""
    found = rows.mapInArrow(_run_rows(run, words, long), FOUND)
    turn = F.row_number().over(Window.partitionBy("key", "digest").orderBy("doc", "place"))
    later = found.withColumn("turn", turn).where("removed or turn > 1")
    return later.groupBy("doc").agg(F.collect_list("place").alias("places"))


def _joined(docs: DataFrame, id_col: str, text_col: str, passage: int = 0, **options) -> tuple[DataFrame, DataFrame, bool]:
    keyed, same = with_row_id(docs, id_col, text_col)
    rows = keyed.select("row_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = repeated_places(rows, **options)
    if passage:
        return keyed, places.join(repeated_passages(rows, passage), "doc", "full_outer"), same
    return keyed, places.withColumn("passages", F.lit(None).cast("array<long>")), same


def strip_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: n_bytes, n_removed, n_spans and the digest of what is left, in UTF-8 bytes.

    Null and empty texts have nothing to remove. Earlier means a smaller id, then further left; rows without an id
    come last, and rows that share an id are documents of their own, in the order of their texts. With ``passage``
    every stretch of so many words that has occurred before goes, too, wherever it begins.
    """
    keyed, places, same = _joined(docs.select(id_col, text_col), id_col, text_col, **options)
    rows = keyed.select("row_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.join(places, rows["row_id"] == places["doc"], "left").select("row_id", "text", "places", "passages").mapInArrow(_strip, STRIPPED)
    if same:
        return out.withColumnRenamed("row_id", id_col)
    ids = keyed.select("row_id", F.col(id_col).cast("long").alias("own_id"))
    return out.join(ids, "row_id").select(F.col("own_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with what repeats cut out of their texts; other columns, null texts and all rows stay."""
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed, places, _ = _joined(whole, "id", "text", **options)

    @F.pandas_udf("string")
    def cut(texts, spans, passages):
        def left(text, own, words):
            if text is None:
                return None
            data = text.encode("utf-8", "surrogatepass")
            found = [*([] if own is None else own), *([] if words is None else in_bytes(data, list(words)))]
            return without(data, merged(found)).decode("utf-8", "surrogatepass")

        return texts.__class__([left(*row) for row in zip(texts, spans, passages, strict=True)], dtype=object)

    joined = keyed.join(places, keyed["row_id"] == places["doc"], "left")
    left_over = F.when(F.col("places").isNull() & F.col("passages").isNull(), F.col("text")).otherwise(cut("text", "places", "passages"))
    return joined.select(*[left_over.alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])
