"""Exact top-k search by inner product with the threshold algorithm.

Vectors are packed into blocks, long vectors first. In a block each dimension has its list, sorted by value. The search
goes down all lists at once, from both ends, since a query's component may have either sign: a vector is scored for all
open queries when it first comes up in any list. What hasn't come up by then can't score above the sum of the query's
components times the values where its lists stand; once that bound is below a query's kth score, the query is done
with the block (at an equal score a smaller id might still win, so it goes on).

Blocks are searched in rounds of growing size, and a query's kth score is carried from round to round. It is sent to a
block only if the ends of the block's lists, and the length of its longest vector, let a score of it reach that far,
and a block gives out only what does. So a round of GROWTH times the blocks before it is expected to give out GROWTH
times k vectors a query, however many blocks there are.

Components are floor(scale * x). Sums are exact: blocks whose products might leave 2^53 are scored with Python's
integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewell.llm.common import arrow_rows, discard, materialize

SCALE = 256
#: Vectors and queries in a block, as bounds.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
STEP = 256
#: A round ends at so many times the blocks that the round before ended at.
GROWTH = 8
#: Blocks whose lists' ends are held in one row, query blocks that one copy of a block is searched for, and blocks in a batch of a Python worker.
OUTLINES = 4096
SERVED = 64
BATCH_BLOCKS = 8
LONG = 1 << 63


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score): the k best of the block for each query, itself left out, ties to the smaller id. Scores below a query's floor are left out."""
    n, dims = vectors.shape
    if not n or not len(queries):
        return []
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    limit = dims * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if limit >= 2.0**53:
        exact = [[int(x) for x in v] for v in vectors]
        out = []
        for q, own, least in zip(query_ids, queries, floors, strict=True):
            own = [int(x) for x in own]
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), int(i)) for i, v in zip(ids, exact, strict=True) if i != q)
            out += [(int(q), i, -s) for s, i in scored[:k] if -s >= least]
        return out
    order = np.argsort(vectors, axis=0, kind="stable")
    rank = np.empty((n, dims), np.int64)
    np.put_along_axis(rank, order, np.arange(n)[:, None].repeat(dims, 1), 0)
    depth = np.minimum(rank, n - 1 - rank).min(axis=1) if dims else np.zeros(n, np.int64)
    seen = np.argsort(depth, kind="stable")
    depth, ids, vectors = depth[seen], ids[seen], vectors[seen]
    lists = np.sort(vectors, axis=0)
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    open_ = np.arange(len(queries))
    begin = 0
    while begin < n and len(open_):
        end = min(n, begin + STEP)
        if end < n:  # all vectors of a depth come up together
            end = int(np.searchsorted(depth, depth[end - 1], "right"))
        scores = queries[open_] @ vectors[begin:end].T
        scores[query_ids[open_][:, None] == ids[None, begin:end]] = -np.inf
        every = np.hstack([best[open_], scores])
        every_id = np.hstack([best_id[open_], np.broadcast_to(ids[begin:end], scores.shape)])
        floor = -np.partition(-every, k - 1, axis=1)[:, k - 1] if every.shape[1] > k else np.full(len(open_), -np.inf)
        top, top_id = np.full((len(open_), k), -np.inf), np.full((len(open_), k), np.iinfo(np.int64).max)
        rows, columns = np.nonzero((every >= floor[:, None]) & (every > -np.inf))
        chosen = np.lexsort((every_id[rows, columns], -every[rows, columns], rows))
        rows, columns = rows[chosen], columns[chosen]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        kept = place < k
        top[rows[kept], place[kept]] = every[rows[kept], columns[kept]]
        top_id[rows[kept], place[kept]] = every_id[rows[kept], columns[kept]]
        best[open_], best_id[open_] = top, top_id
        if end < n:
            at = depth[end]
            bound = lists[n - 1 - at] @ up[:, open_] + lists[at] @ down[:, open_]
            open_ = open_[bound >= np.maximum(best[open_, k - 1], floors[open_])]
        begin = end
    rows, places = np.nonzero((best > -np.inf) & (best >= floors[:, None]))
    return [(int(query_ids[r]), int(best_id[r, p]), int(best[r, p])) for r, p in zip(rows, places, strict=True)]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): rows whose vector is there and has only finite components, as array<double> of floor(scale * x)."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    doubles = F.transform(x, lambda c: _floor(c.cast("double") * scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), doubles.alias("v"))


def _floor(x):
    """floor() as a double also beyond the range of a long; without that range every double is whole."""
    return F.when(F.abs(x) < 2.0**62, F.floor(F.when(F.abs(x) < 2.0**62, x).otherwise(0.0)).cast("double")).otherwise(x)


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """One row for each block of a partition: its ids, its vectors end to end at a common width (zeros added), the least and largest value of each dimension, and the length of its longest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                vectors = part.column(1)
                width = max((len(v) for v in vectors.to_pylist()), default=0)
                if vectors.offset == 0 and len(part) * width == len(vectors.flatten()):
                    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                else:
                    matrix = np.array([v + [0.0] * (width - len(v)) for v in vectors.to_pylist()], np.float64)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = matrix.reshape(len(ids), width)
                low, high = (np.ascontiguousarray(f(axis=0)).tobytes() for f in (matrix.min, matrix.max))
                reach = float(np.linalg.norm(matrix, axis=1).max(initial=0))
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "matrix": [matrix.tobytes()], "width": pa.array([width], pa.int32()), "low": [low], "high": [high], "reach": [reach]})

    return rows.mapInArrow(run, "ids binary, matrix binary, width int, low binary, high binary, reach double")


def may_reach(queries: np.ndarray, floors: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Queries x blocks: whether a vector of the block, between low and high and of length reach at most, might score the query's floor."""
    longest = np.linalg.norm(queries, axis=1)[:, None] * reach[None, :]
    ends = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return ~(np.minimum(ends, longest) + 1e-9 * longest < floors[:, None])  # also where it isn't a number; the margin is far above what rounding takes


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


_SENT = "block long, part long, asked long, asked_ids binary, asked_matrix binary, asked_width int, asked_floors binary"


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a block of queries with their floors, beside outlines of blocks, the queries that each of these is searched for."""
    names = [x.split()[0] for x in _SENT.split(", ")]
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            ids = np.frombuffer(row["ids"], np.int64)
            width = max(row["width"], *(o["width"] for o in row["outlines"]))
            queries = _wide(np.frombuffer(row["matrix"], np.float64).reshape(len(ids), row["width"]), width)
            known = {f["query_id"]: f["score"] for f in row["floors"] or []}
            floors = np.array([known.get(i, -LONG) for i in ids.tolist()], np.float64)
            floors[floors <= -LONG] = -np.inf
            low, high = (np.vstack([_wide(np.frombuffer(o[end], np.float64)[None, :], width) for o in row["outlines"]]) for end in ("low", "high"))
            open_ = may_reach(queries, floors, low, high, np.array([o["reach"] for o in row["outlines"]]))
            for outline, use in zip(row["outlines"], open_.T, strict=True):
                if use.any():
                    sent = [outline["block"], row["asked"] // SERVED, row["asked"], ids[use].tobytes(), queries[use].tobytes(), width, floors[use].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if n == "asked_width" else None) for x, n in zip(sent, names, strict=True)], names)


_HIT = "asked long, query_id long, vec_id long, score long"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sides = []
                for name in ("", "asked_"):
                    ids = np.frombuffer(row[f"{name}ids"], np.int64)
                    sides.append((ids, np.frombuffer(row[f"{name}matrix"], np.float64).reshape(len(ids), row[f"{name}width"])))
                (ids, a), (asked_ids, b) = sides
                width = max(a.shape[1], b.shape[1])
                found = search_block(ids, _wide(a, width), asked_ids, _wide(b, width), k, np.frombuffer(row["asked_floors"], np.float64))
                found = [(row["asked"], q, v, max(-LONG, min(LONG - 1, score))) for q, v, score in found]
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _HIT.split(", ")])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """For each query the k vectors of highest score among all rows but its own: query_id, rank (from 1), vec_id, score.

    A score beyond the range of a long counts as the nearest long. Vectors that are null or hold a null or a component that isn't finite take no part, on either side. Shorter
    vectors count as ended by zeros. Rows that share an id are candidates of their own, except for queries of that id.

    First every block of queries is searched in one block of vectors, so that it has kth scores to carry, then in all
    others, round after round. A copy of a block serves SERVED blocks of queries, so no task has more of them; vectors
    aren't copied for each. What a round reads is bounded by its blocks, and the queries' best are ranked after each.
    """
    spark = vectors.sparkSession
    rows, asked = quantised(vectors, id_col, vector_col, scale), quantised(queries, id_col, vector_col, scale)
    n_rows, n_asked = rows.count(), asked.count()
    if not n_rows or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    sorted_rows = rows.withColumn("length", length).repartitionByRange(math.ceil(n_rows / BLOCK_ROWS), F.desc("length"), "id").select("id", "v")
    left = _numbered(_pack(sorted_rows, BLOCK_ROWS), "block")
    right = _numbered(_pack(asked.repartition(math.ceil(n_asked / QUERY_ROWS)), QUERY_ROWS), "asked")
    n_left, n_right = left.count(), right.count()
    blocks, right = left.select("block", "ids", "matrix", "width"), right.select("asked", "ids", "matrix", "width")
    outlines = left.select("block", "width", "low", "high", "reach")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_right - 1) // SERVED).cast("long")))
    seed = F.col("asked") % math.ceil(math.sqrt(n_left))

    def searched(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """pairs (asked, ids, matrix, width, floors, outlines) searched: the k best of what they give and what is known."""
        sent = pairs.mapInArrow(_sent, _SENT)
        copies = blocks.withColumn("part", parts)
        found = sent.join(copies, ["block", "part"]).drop("block", "part").mapInArrow(_search(k), _HIT)
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        with arrow_rows(spark, BATCH_BLOCKS):
            return materialize(known.unionByName(found).withColumn("rank", turn).where(F.col("rank") <= k).select("asked", "query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank")))

    outline = F.struct(*outlines.columns)
    floors = F.lit(None).cast("array<struct<query_id: bigint, score: bigint>>")
    first = right.withColumn("block", seed).join(outlines.select("block", F.array(outline).alias("outlines")), "block").drop("block")
    best = searched(first.withColumn("floors", floors), spark.createDataFrame([], _HIT))
    begin, end = 0, GROWTH
    while begin < n_left:
        kth = best.where(F.col("rank") == k).groupBy("asked").agg(F.collect_list(F.struct("query_id", "score")).alias("floors"))
        some = outlines.where((F.col("block") >= begin) & (F.col("block") < end))
        packs = some.groupBy(F.floor(F.col("block") / OUTLINES).alias("pack")).agg(F.collect_list(outline).alias("outlines"))
        every = F.explode(F.sequence(*[F.lit(x // OUTLINES).cast("long") for x in (begin, min(end, n_left) - 1)]))
        pairs = right.join(kth, "asked", "left").withColumn("pack", every).join(packs, "pack").drop("pack")
        pairs = pairs.withColumn("outlines", F.filter("outlines", lambda o: o["block"] != seed)).where(F.size("outlines") > 0)
        passed, best = best, searched(pairs, best.select("asked", "query_id", "vec_id", "score"))
        discard(passed)
        begin, end = end, end * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Numbers the blocks from 0. There are few, and only their place in the table is looked at by one task."""
    kept = materialize(blocks.withColumn("place", F.monotonically_increasing_id()))
    places = kept.select("place").withColumn(name, F.row_number().over(Window.orderBy("place")) - 1)
    return kept.join(places, "place").drop("place")
