"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

``fit`` learns from a bounded sample of labelled rows (max_rows, the rows of smallest hash), whose statistics Spark
gathers; the bound keeps what reaches the driver at max_rows times the number of statistics, whatever the corpus.
The trees are complete binary trees held in flat arrays, and ``score`` sends a block of documents through all of
them level by level in numpy. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewell.llm import textbytes as tb
from basewell.llm.common import added

#: Each class of bytes gives a statistic: its share of the text's bytes.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "newline": b"\n", "stop": b".", "comma": b",",
    "colon": b":;", "ask": b"?", "shout": b"!", "bar": b"|", "sign": b"#$%&*@^~", "pair": b"()[]{}<>", "stroke": b"/\\_-=+", "quote": b"\"'`",
}
STATISTICS = (
    *CLASSES, "high_bytes", "log_bytes", "log_words", "word_length", "word_spread", "long_words", "short_words", "capital_words", "shout_words", "signed_words",
    "distinct_words", "top_word", "words_per_line", "repeated_lines", "one_word_lines", "words_per_stop", "longest_run",
)


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for n, members in enumerate(CLASSES.values()):
        table[list(members)] = n
    table[128:] = len(CLASSES) + 1
    return table


_TABLE = _class_table()


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between one bound and the next."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(keys: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of different keys, and how often its most common one occurs."""
    if not len(keys):
        return np.zeros(n_rows), np.zeros(n_rows)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])
    size = np.diff(np.r_[new, len(keys)])
    top = np.zeros(n_rows)
    np.maximum.at(top, row[new], size)
    return np.bincount(row[new], minlength=n_rows).astype(float), top


def statistics(block: tb.Block) -> np.ndarray:
    """One row of STATISTICS for each text of the block; an empty text has zeros."""
    data, offsets = block.data, block.offsets
    n_rows, n_bytes = len(offsets) - 1, np.diff(offsets).astype(float)
    row_of = np.repeat(np.arange(n_rows), np.diff(offsets))
    kind = _TABLE[data]
    counts = np.bincount(row_of * (len(CLASSES) + 2) + kind, minlength=n_rows * (len(CLASSES) + 2)).reshape(n_rows, -1).astype(float)
    some = np.maximum(n_bytes, 1)
    columns = [counts[:, n] / some for n in range(len(CLASSES))] + [counts[:, -1] / some, np.log1p(n_bytes)]

    starts, ends, bounds = tb.words(block)
    n_words = np.diff(bounds).astype(float)
    words, length = np.maximum(n_words, 1), (ends - starts).astype(float)
    mean = _per_row(length, bounds) / words
    first, last = data[starts] if len(starts) else data[:0], data[ends - 1] if len(ends) else data[:0]
    upper = np.zeros(len(data) + 1)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    word_row = np.repeat(np.arange(n_rows), np.diff(bounds))
    hasher = tb.Hasher(data, lower=True)
    distinct, top = _repeats(hasher(starts, ends), word_row, n_rows)
    columns += [np.log1p(n_words), mean, np.sqrt(np.maximum(_per_row(length**2, bounds) / words - mean**2, 0))]
    columns += [_per_row(test, bounds) / words for test in (length > 12, length < 3, (first >= 65) & (first <= 90), (upper[ends] - upper[starts] > 1), _TABLE[last] == 10)]
    columns += [distinct / words, top / words]

    cut = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[offsets[:-1][n_bytes > 0], cut + 1])
    line_start = line_start[line_start < len(data)]
    line_end = np.r_[line_start[1:], len(data)]
    line_row = row_of[line_start] if len(line_start) else np.zeros(0, np.int64)
    n_lines = np.bincount(line_row, minlength=n_rows).astype(float)
    lines = np.maximum(n_lines, 1)
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    full = line_words > 0
    line_kinds, _ = _repeats(hasher(line_start[full], line_end[full]), line_row[full], n_rows)
    columns += [n_words / lines, 1 - line_kinds / np.maximum(np.bincount(line_row[full], minlength=n_rows), 1), np.bincount(line_row, weights=line_words == 1, minlength=n_rows) / lines]
    columns += [n_words / (counts[:, 4] + 1)]

    longest = np.zeros(n_rows)
    if len(data):
        change = np.r_[True, (data[1:] != data[:-1]) | (row_of[1:] != row_of[:-1])]
        begin = np.flatnonzero(change)
        np.maximum.at(longest, row_of[begin], np.diff(np.r_[begin, len(data)]))
    columns += [np.log1p(longest)]
    found = np.column_stack(columns)
    found[n_bytes == 0] = 0
    return found


class Model(NamedTuple):
    """Trees in flat arrays: node n of a tree has the children 2n+1 (at most the threshold) and 2n+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Model:
    """Second-order boosting for the logistic loss; splits are searched in histograms of quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    none = Model(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return none
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of / (1 - rate_of)))
    if y.min() == y.max():
        return none._replace(start=start)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    slots = (binned + np.arange(f) * bins).ravel()
    edge = np.full((f, bins), np.inf)
    for j, e in enumerate(edges):
        edge[j, : len(e)] = e
    margin, made = np.full(n, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            at = np.repeat((node - base) * f * bins, f) + slots
            hist = [np.bincount(at, np.repeat(v, f), width * f * bins).reshape(width, f, bins) for v in (g, h)]
            left_g, left_h = (v.cumsum(2) for v in hist)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least) | np.isinf(edge)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[base : base + width] = np.where(good, best // bins, 0)
            threshold[base : base + width] = np.where(good, edge[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        spot = node - inner
        leaf = -rate * np.bincount(spot, g, leaves) / (np.bincount(spot, h, leaves) + ridge)
        margin += leaf[spot]
        made.append((feature, threshold, leaf))
    return Model(start, *(np.array(a) for a in zip(*made, strict=True)))


def held_out(id_col: str) -> Column:
    """True for one row in five, by the id alone; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> Model:
    """Learns from at most max_rows labelled rows that aren't held out; several labels of an id count by their majority, a tie as 1.

    Null ids and labels are left out. Of rows that share an id the one of least text hash is the sample, so max_rows
    bounds what is gathered whatever ids repeat. Without any labelled row the model scores 0.5, with labels of one kind only
    their rate.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("sample_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("sample_label"))
    sample = known.orderBy(F.xxhash64("sample_id"), "sample_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("sample_text"), F.xxhash64(text_col).alias("tie")).join(F.broadcast(sample), "sample_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(3)):
                n = len(block.offsets) - 1
                x = statistics(block)
                part = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], ["sample_id", "sample_label", "tie", "x"])

    kind = dict(rows.dtypes)["sample_id"]
    found = rows.select("sample_id", "sample_label", "tie", "sample_text").mapInArrow(gather, f"sample_id {kind}, sample_label int, tie long, x array<double>")
    table = found.groupBy("sample_id").agg(F.min(F.struct("tie", "sample_label", "x")).alias("one")).select("sample_id", "one.sample_label", "one.x").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y, ids = np.array(table.column("sample_label").to_pylist(), float), table.column("sample_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), x[i].tolist()))
    return boost(x[order], y[order], **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds each text's score between 0 and 1. Nulls and empty texts are scored as empty; other columns pass through."""
    kept = docs.drop(out_col)
    schema = added(kept, out_col, T.DoubleType())
    names = [*kept.columns, out_col]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.probability(statistics(block)) for block in tb.blocks(batch.column(at))]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names)

    return kept.mapInArrow(run, schema)
