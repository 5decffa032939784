"""Stretches of documents: which repeat earlier ones, and texts without them.

A stretch has two 64-bit keys that tell what it holds, its document, and its place, start << SHIFT | length in bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewell.llm import textbytes as tb
from basewell.llm.common import materialize

SHIFT = 24
U64 = np.uint64


def settle(keys: tuple[np.ndarray, np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and place, and which rows in that order aren't the first of their key."""
    order = np.lexsort((place, doc, keys[1], keys[0]))
    a, b = (k[order] for k in keys)
    return order, np.r_[np.zeros(min(1, len(a)), bool), (a[1:] == a[:-1]) & (b[1:] == b[:-1])]


def runs(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins stretches of the same document that overlap or touch."""
    if not len(doc):
        return doc, start, length
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    # Within a document the furthest end so far: ranks keep documents apart.
    rank = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * step) - rank * step
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], start[new], reach[last] - start[new]


FOUND = "key long, digest long, doc long, place long, removed boolean"
NAMES = ["key", "digest", "doc", "place", "removed"]


def found_rows(gram: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, removed: bool) -> pa.RecordBatch:
    place = (start.astype(np.int64) << SHIFT) | length.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc), pa.array(place), pa.array(np.full(len(doc), removed))], NAMES)


def removed_rows(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Stretches that are known to go; their keys only spread them."""
    doc, start, length = runs(doc, start, length)
    most = (1 << SHIFT) - 1
    while (length > most).any():
        doc, start, length = np.r_[doc, doc[length > most]], np.r_[start, start[length > most] + most], np.r_[np.minimum(length, most), length[length > most] - most]
    spread = tb.mix(doc.astype(U64) * U64(31) + start.astype(U64))
    return found_rows(spread, spread, doc, start, length, True)


def still_open(found: DataFrame) -> DataFrame:
    """Of stretches by key and digest a table (doc, place, removed) of those to remove (all but the first of equal ones) and of first ones beside different ones of their key."""
    by_digest = Window.partitionBy("key", "digest").orderBy("doc", "place")
    first = F.col("turn") == 1
    ranked = found.repartition("key").withColumn("turn", F.row_number().over(by_digest)).withColumn("kinds", F.sum(first.cast("int")).over(Window.partitionBy("key")))
    return materialize(ranked.where("removed or turn > 1 or kinds > 1").select("doc", "place", (F.col("removed") | ~first).alias("removed")))


STRIPPED = "row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STRIPPED.split(", ")]
    for batch in batches:
        rows = []
        for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            spans = merged(places.as_py() or [])
            rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def merged(places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the removed bytes."""
    spans: list[tuple[int, int]] = []
    for place in sorted(places):
        start, end = place >> SHIFT, (place >> SHIFT) + (place & ((1 << SHIFT) - 1))
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, done = [], 0
    for start, end in spans:
        kept.append(data[done:start])
        done = end
    return b"".join([*kept, data[done:]])
