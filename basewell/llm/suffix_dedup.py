"""Suffix-array deduplication of byte strings: a radix sort of suffixes that stops at the threshold.

Only whether two suffixes agree in their first ``length`` bytes matters, so suffixes are ordered no further than that,
by most-significant-digit passes, each a shuffle; groups that are equal at full depth are the repeated windows.
Suffixes are not taken at every byte but at anchors that the text itself selects: of the first-digit strings (GRAM
bytes) inside a window, the one of smallest hash, the leftmost of equals. Equal windows select the same anchor, so a
window that repeats does so together with its anchor, and the order of all other suffixes follows from those.

A window with its anchor at offset j starts j bytes before it. The passes, each a shuffle by the digits so far:

1. The anchor's gram (32 bytes). An anchor stands for its block, the bytes of all windows that select it. Anchors
   whose gram is alone drop out; of equal blocks (64-bit digests within a gram) all but the first are removed with all
   their windows. From here on rows carry their bytes, and equal means equal bytes.
2. What is left is cut into cells of neighbouring offsets, first CELLS[0] wide, then narrower, at last one window
   each. The windows of a cell share all but size - 1 of their bytes, and these are the digits of the pass. Again rows
   that are alone drop out, and of equal ones all but the first are removed. So a gram that very many documents hold
   in different surroundings is split by what surrounds it, and at full depth equal groups are the repeated windows.

Each task settles what repeats within its own rows before it shuffles, so a string that a third of all documents
share arrives once for each task, not once for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewell.llm import textbytes as tb
from basewell.llm.common import materialize, with_row_id
from basewell.llm.spans import FOUND, SHIFT, STRIPPED, found_rows, removed_rows, settle, still_open, strip

LENGTH = 100
GRAM = 32
#: A task settles repeats among so many anchors or windows at a time.
SETTLE_ROWS = 500_000
#: Widths of the cells of offsets in the passes after the first; the last is a single window.
CELLS = (35, 8, 1)
#: A task settles repeats among about so many bytes of cells at a time.
SETTLE_BYTES = 16 << 20
#: Chunk of a longer text; an anchor's windows may be cut here, which only leaves more to compare.
CHUNK = 2 << 20
U64 = np.uint64
#: Low bits of a gram's hash that give way to its place; a chunk has fewer places than they hold.
PLACE = U64((1 << 22) - 1)


def _chunks(block: tb.Block, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets of texts, first row, bytes before): whole texts, or a long text in chunks that overlap by a window less one byte."""
    if len(block.data) <= CHUNK or len(block.offsets) > 2:
        yield block.data, block.offsets, block.first, 0
        return
    for begin in range(0, len(block.data), CHUNK):
        part = block.data[begin : begin + CHUNK + length - 1]
        if len(part) >= length or not begin:
            yield part, np.array([0, len(part)]), block.first, begin


def select_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, block hash, row, start, windows, place) of each anchor: the windows that start at start, start+1, ... select the gram at place."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    hasher, places = tb.Hasher(data), np.arange(len(data) - gram + 1)
    grams = hasher(places, places + gram)
    least, width, wanted = (grams & ~PLACE) | places.astype(U64), 1, length - gram + 1
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < wanted:
        least = np.minimum(least[: width - wanted], least[wanted - width :])
    anchor = (least & PLACE).astype(np.int64)
    row = np.searchsorted(offsets, places[: len(anchor)], "right") - 1
    whole = places[: len(anchor)] + length <= offsets[row + 1]
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    begin = np.flatnonzero(change & whole)
    # Windows that reach over the end of their text follow all whole ones of that text.
    stop = np.flatnonzero(np.r_[(change[1:] | ~whole[1:]), True] & whole) + 1
    first = offsets[row[begin]]
    return grams[anchor[begin]], hasher(begin, stop - 1 + length), row[begin], begin - first, stop - begin, anchor[begin] - first


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            grams, blocks, docs, starts, windows = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, again = settle((grams, blocks), docs, starts)
            spans = windows + length - 1
            first, later = order[~again], order[again]
            if len(later):
                yield removed_rows(docs[later], starts[later], spans[later])
            yield found_rows(grams[first], blocks[first], docs[first], starts[first], spans[first], False)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column(1)):
                for data, offsets, first, before in _chunks(block, length):
                    grams, blocks, row, start, windows, _ = select_anchors(data, offsets, length, gram)
                    held.append((grams, blocks, ids[first + row], start + before, windows))
                if sum(len(h[0]) for h in held) >= SETTLE_ROWS:
                    yield from settled()
        if held:
            yield from settled()

    return run


_CONTEXT = "own binary, doc long, start long, high long"


def _context_rows(length: int, gram: int):
    """The bytes of each block that is still open, with the offset of its first window."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                own, docs, starts = [], [], []
                for doc, cell, places in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    text = cell.as_py().encode("utf-8", "surrogatepass")
                    for place in places:
                        start, size = place >> SHIFT, place & ((1 << SHIFT) - 1)
                        own.append(text[start : start + size])
                        docs.append(doc)
                        starts.append(start)
                offsets = np.cumsum([0, *map(len, own)])
                high = np.zeros(len(own), np.int64)
                _, _, row, start, _, place = select_anchors(np.frombuffer(b"".join(own), np.uint8), offsets, length, gram)
                high[row] = place - start
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(high)], names)

    return run


_CELL = "cell int, high int, own binary, doc long, place long, removed boolean"


def _cell_rows(length: int, size: int):
    """Rows of own (the bytes of neighbouring windows, the first at offset high) cut into cells of offsets; what repeats within the task is removed."""
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in _CELL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, int, bytes], tuple[int, int]] = {}
        gone: list[tuple] = []
        held = 0

        def settled() -> pa.RecordBatch:
            rows = [(cell, top, own, doc, start << SHIFT | len(own), False) for (cell, top, own), (doc, start) in first.items()] + gone
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for own, doc, start, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                low = high - len(own) + length
                for cell in range(low // size, high // size + 1):
                    top = min(high, cell * size + size - 1)
                    part = own[high - top : high - max(low, cell * size) + length]
                    here = (doc, start + high - top)
                    there = first.setdefault((cell, top, part), here)
                    if there is here:
                        held += len(part)
                        continue
                    if here < there:
                        first[(cell, top, part)], here = here, there
                    gone.append((cell, top, None, here[0], here[1] << SHIFT | len(part), True))
                if held + 32 * len(gone) > SETTLE_BYTES:
                    yield settled()
                    first.clear()
                    gone.clear()
                    held = 0
        if first:
            yield settled()

    return run


def _one_pass(contexts: DataFrame, length: int, size: int) -> DataFrame:
    """Cells of one width: those to remove, and those that share their digits with different ones."""
    cells = contexts.mapInArrow(_cell_rows(length, size), _CELL)
    digits = F.substring("own", F.col("high") - F.col("cell") * size + 1, F.lit(length + 1 - size))
    spread = F.concat_ws("/", "doc", "place").cast("binary")  # what is removed already goes anywhere
    dealt = cells.withColumn("digits", F.coalesce(digits, spread)).repartition("digits")
    turn = F.row_number().over(Window.partitionBy("digits", "cell", "high", "own").orderBy("doc", "place"))
    ranked = dealt.withColumn("turn", turn).withColumn("kinds", F.sum((F.col("turn") == 1).cast("int")).over(Window.partitionBy("digits", "cell")))
    gone = F.col("removed") | (F.col("turn") > 1)
    left = gone | (F.col("kinds") > 1) if size > 1 else gone
    return materialize(ranked.where(left).select(F.when(~gone, F.col("own")).alias("own"), "doc", "place", "high", gone.alias("removed")))


def removed_places(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rows (row_id, text) to (row_id, places): the stretches to remove, not yet joined; texts without any are left out."""
    open_ = still_open(rows.mapInArrow(_anchor_rows(length, gram), FOUND))
    lists = open_.where("not removed").groupBy("doc").agg(F.collect_list("place").alias("open"))
    contexts = rows.join(lists, rows["row_id"] == lists["doc"]).select("row_id", "text", "open").mapInArrow(_context_rows(length, gram), _CONTEXT)
    every = open_.where("removed").select("doc", "place")
    widths = [w for w in CELLS if w < length - gram]
    for width in widths:
        cells = _one_pass(contexts, length, width)
        every = every.unionByName(cells.where("removed").select("doc", "place"))
        contexts = cells.where("not removed").select("own", "doc", F.shiftright("place", SHIFT).alias("start"), F.col("high").cast("long").alias("high"))
    return every.groupBy("doc").agg(F.collect_list("place").alias("places"))


def strip_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document: n_bytes, n_removed, n_spans and the digest of what is left.

    Removes each byte that a string of ``length`` bytes covers which also starts earlier, in a document of smaller
    id or further left in the same one; all strings are judged on the input. Texts count as UTF-8 bytes, a null as
    none. Rows without an id come last; rows that share an id are documents of their own, in the order of their
    texts, so of repeated rows the first stays.
    """
    keyed, same = with_row_id(docs.select(id_col, text_col), id_col, text_col)
    # One shape for both joins, so that the texts are shuffled once.
    rows = keyed.select(F.coalesce("row_id", F.lit(0)).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = removed_places(rows, length, gram)
    out = rows.join(places, rows["row_id"] == places["doc"], "left").select("row_id", "text", "places").mapInArrow(strip, STRIPPED)
    if same:
        return out.withColumnRenamed("row_id", id_col)
    ids = keyed.select("row_id", F.col(id_col).alias("own_id"))
    return out.join(ids, "row_id").select(F.col("own_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
