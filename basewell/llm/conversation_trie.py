"""Conversation prefix trie: a node for every distinct sequence of first turns, counted in tables with minimal perfect hashes.

``rebuild`` gives the rows (conv_id, depth, digest of the first depth turns); ``nodes_of`` makes the trie of them.
The digest of a prefix is the exclusive or of one 128-bit hash per turn and place, so it adds up in any order: rows
of a conversation may lie in several partitions, and each joins what the partitions before it hold. No step gathers
a conversation, a prefix or a group of copies in one task:

- Turns are numbered after a range sort that splits long conversations; partition counts give the offsets.
- Distinct digests are enumerated by a pre-aggregating group. A node belongs to its smallest member, so (smallest
  member, depth) is a unique key, by which counts come back to the rows without a hot key.
- Subtree sums: each shard of whole conversations assigns its digests slots of a minimal perfect hash, checks the
  stored digest at each look-up, scatters the counts into flat arrays and adds them up through the array of parent
  slots, deepest first. A node's own count stands in one shard only, that of its smallest member, so the shards'
  partial sums are added by digest. Conversations of more than LONG turns sum up their tails by partition instead.
- The ids that end at a node are sorted over all partitions, packed in strings of PACK bytes, and hashed in order. The
  hash of one node's list is sequential by definition; its task reads the packed strings as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.llm.common import discard, materialize

#: Conversations of one block share the first turns of its first conversation.
BLOCK = 100
#: A conversation takes fewer than so many turns from it.
SHARES = 6
#: Conversations of more turns aren't summed up in one shard.
LONG = 10_000
SHARD_ROWS = 200_000
PACK = 1 << 16
SALTS = 1024


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: slots 0 to n-1, each with its key for verification.

    Keys that fall alone on a place of a level take the next slots, the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.keys = np.zeros_like(keys)
        left, taken = keys, 0
        while len(left):
            width = 2 * len(left) + 1
            place = self._place(left, len(self.levels), width)
            alone = np.bincount(place, minlength=width)[place] == 1
            slots = np.full(width, -1, np.int64)
            slots[place[alone]] = taken + np.arange(int(alone.sum()))
            self.keys[slots[place[alone]]] = left[alone]
            taken += int(alone.sum())
            self.levels.append(slots)
            left = left[~alone]

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        mixed = (keys[:, 0] ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ keys[:, 1]) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(width)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the table doesn't hold."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, slots in enumerate(self.levels):
            at = slots[self._place(keys[open_], level, len(slots))]
            found[open_[at >= 0]] = at[at >= 0]
            open_ = open_[at < 0]
        some = found >= 0
        some[some] = (self.keys[found[some]] == keys[some]).all(1)
        return np.where(some, found, -1)


def subtree_sums(key: np.ndarray, parent: np.ndarray, depth: np.ndarray, n_chars: np.ndarray, n_convs: np.ndarray, n_children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a shard's nodes, and for each the childless nodes and the saved code points below it, itself included.

    One row for each turn of whole conversations; n_convs is 0 where another conversation stands for the node.
    """
    order = np.lexsort((key[:, 1], key[:, 0]))
    new = np.r_[True, (key[order][1:] != key[order][:-1]).any(1)] if len(key) else np.zeros(0, bool)
    first = order[new]
    table = SlotTable(key[first])
    slot = table.slots(key)
    n = len(first)
    level, up = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    level[slot[first]] = depth[first]
    up[slot[first]] = np.where(depth[first] > 0, table.slots(parent[first]), -1)
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    mine = n_convs > 0
    leaves[slot[mine]] = n_children[mine] == 0
    saved[slot[mine]] = (n_convs[mine] - 1) * n_chars[mine]
    by_depth = np.argsort(-level, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(level[by_depth]) != 0, True]) if n else [0]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        at = by_depth[low:high]
        at = at[up[at] >= 0]
        np.add.at(leaves, up[at], leaves[at])
        np.add.at(saved, up[at], saved[at])
    return table.keys, leaves, saved


def _sum_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; a shard ends between two of them."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        get = {name: rows.column(name).to_numpy() for name in ("x", "y", "px", "py", "depth", "n_chars", "n_convs", "n_children")}
        keys, leaves, saved = subtree_sums(np.column_stack([get["x"], get["y"]]).view(np.uint64), np.column_stack([get["px"], get["py"]]).view(np.uint64), *[get[c] for c in ("depth", "n_chars", "n_convs", "n_children")])
        lanes = keys.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (lanes[:, 0], lanes[:, 1], leaves, saved)], ["x", "y", "leaves", "saved"])

    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n_held += batch.num_rows
        if n_held >= SHARD_ROWS:
            rows = pa.Table.from_batches(held)
            ids = rows.column("conv_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], "left"))
            if cut:
                yield out(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            n_held = rows.num_rows - cut
    if held:
        yield out(pa.Table.from_batches(held))


def _number(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each turn as a digest with its number inside its conversation's rows of one partition; partitions follow the order of turns."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("long")
    slim = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars")
    )
    slim = slim.select("conv_id", "turn", "role", lane(1).alias("a"), lane(16).alias("b"), "n_chars", F.monotonically_increasing_id().alias("tie"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b"), F.col("tie")]
    ranged = slim.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    return ranged.select("conv_id", "part", "a", "b", "n_chars", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).alias("idx"))


def rebuild(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefixes of every rebuilt conversation: conv_id, part, depth, total, n_chars, digest (x, y), digest of the parent (px, py).

    A conversation c has the first h turns of conversation c - c % BLOCK (all, if there are fewer), then its own after
    its first h; h = crc32 of its decimal id % SHARES. The root, of depth 0, is a row of each. Turns are ordered by
    number (null first), then role, then content; a repeated turn counts again; a null role or text is an empty one;
    rows without a conversation are left out.
    """
    numbered = materialize(_number(turns, conv_col, turn_col, role_col, text_col))
    counts = numbered.groupBy("conv_id", "part").agg(F.max("idx").cast("long").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    most = SHARES - 1
    first = numbered.where((F.col("conv_id") % BLOCK == 0) & (F.col("idx") <= most)).join(pairs, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("idx") - 1).where(F.col("pos") < most)
    bases = first.groupBy(F.col("conv_id").alias("base_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n_chars"))).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES).cast("int")
    convs = counts.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", h).join(bases, "base_id", "left")
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.expr("cast(array() as array<struct<pos:bigint,a:bigint,b:bigint,n_chars:bigint>>)"))
    convs = convs.withColumn("shared", lent).withColumn("n_shared", F.size("shared")).withColumn("total", F.col("n_shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))

    known = pairs.join(convs.select("conv_id", "h", "n_shared", "total"), "conv_id")
    own = numbered.join(known, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("idx") - 1).where("pos >= h")
    own = own.select("conv_id", "part", "total", (F.col("n_shared") + F.col("pos") - F.col("h") + 1).alias("depth"), "a", "b", "n_chars")
    root = F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n_chars"))
    taken = convs.select("conv_id", F.lit(-1).alias("part"), "total", F.explode(F.concat(F.array(root), F.col("shared"))).alias("t")).select("conv_id", "part", "total", (F.col("t.pos") + 1).alias("depth"), "t.a", "t.b", "t.n_chars")

    def hashed(*parts: Column) -> Column:
        return F.when(F.col("depth") > 0, F.xxhash64(*parts)).otherwise(0)

    rows = own.unionByName(taken).select("conv_id", "part", "total", "depth", "n_chars", hashed("a", "b", "depth", F.lit(1)).alias("u"), hashed("b", "depth", "a", F.lit(2)).alias("v"))
    running = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(rows.withColumns({"lx": F.bit_xor("u").over(running), "ly": F.bit_xor("v").over(running)}))
    begun = local.groupBy("conv_id", "part").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"))
    begun = begun.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"from_{c}") for c in "uv"])
    whole = local.join(begun, ["conv_id", "part"]).withColumns({"x": F.col("lx").bitwiseXOR(F.col("from_u")), "y": F.col("ly").bitwiseXOR(F.col("from_v"))})
    paths = materialize(whole.select("conv_id", "part", "total", "depth", "n_chars", "x", "y", F.col("x").bitwiseXOR(F.col("u")).alias("px"), F.col("y").bitwiseXOR(F.col("v")).alias("py")))
    discard(numbered, local)
    return paths


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node, joined to strings of about PACK bytes."""
    names = ["x", "y", "first", "ids"]
    node, first, ids, size, done = None, 0, [], 0, []
    for batch in batches:
        for x, y, c in zip(*[batch.column(n).to_pylist() for n in ("x", "y", "conv_id")], strict=True):
            if ids and (node != (x, y) or size >= PACK):
                done.append((*node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = (x, y), c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
            done = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, first, ",".join(ids))], names)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for the strings of each node, which come in order."""
    node, state, done = None, None, []
    for batch in batches:
        for x, y, ids in zip(*[batch.column(n).to_pylist() for n in ("x", "y", "ids")], strict=True):
            if node != (x, y):
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["x", "y", "ends_sha256"])
            done = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], ["x", "y", "ends_sha256"])


def nodes_of(paths: DataFrame, long: int = LONG) -> DataFrame:
    """The nodes of the trie of the paths that rebuild gives, one row each.

    conv_id is the smallest member, parent_conv_id the parent's (null for the root). Without conversations there are
    no nodes. A node's ids are hashed in ascending order, joined by commas.
    """
    found = paths.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars")
    )
    found = materialize(found.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS))))
    # Children look up their parent by (parent, salt): a parent of many children meets SALTS keys, not all of them.
    born = found.where("depth > 0").groupBy("px", "py", "salt").agg(F.count(F.lit(1)).alias("n"))
    kids = born.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.sum("n").alias("n_children"))
    above = born.select("px", "py", "salt").join(found.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")), ["px", "py"])
    nodes = found.join(kids, ["x", "y"], "left").join(above, ["px", "py", "salt"], "left")
    up = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    nodes = materialize(nodes.select("x", "y", "conv_id", "depth", "n_convs", up.alias("parent_conv_id"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))
    discard(found)

    counts = ("n_convs", "n_children")
    rows = paths.join(nodes.select("conv_id", "depth", *counts), ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    names = ("conv_id", "x", "y", "px", "py", "depth", "n_chars", *counts)
    short = rows.where(F.col("total") <= long).select(*names).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "depth")
    shards = short.mapInArrow(_sum_shards, "x long, y long, leaves long, saved long")

    mine = F.col("n_convs") > 0
    tails = rows.where(F.col("total") > long).select("conv_id", "part", "depth", "x", "y", (mine & (F.col("n_children") == 0)).cast("long").alias("leaf"), F.when(mine, (F.col("n_convs") - 1) * F.col("n_chars")).otherwise(0).alias("own"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    after = tails.groupBy("conv_id", "part").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    after = after.select("conv_id", "part", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"after_{c}") for c in ("leaf", "own")])
    inside = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumns({c: F.sum(c).over(inside) for c in ("leaf", "own")}).join(after, ["conv_id", "part"])
    tails = tails.select("x", "y", (F.col("leaf") + F.col("after_leaf")).alias("leaves"), (F.col("own") + F.col("after_own")).alias("saved"))
    sums = shards.unionByName(tails).groupBy("x", "y").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = paths.where("depth = total").select("x", "y", "conv_id").repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    packed = ends.mapInArrow(_pack, "x long, y long, first long, ids string").repartition("x", "y").sortWithinPartitions("x", "y", "first")
    hashes = packed.mapInArrow(_hash, "x long, y long, ends_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = nodes.join(sums, ["x", "y"]).join(hashes, ["x", "y"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (see rebuild and nodes_of)."""
    return nodes_of(rebuild(turns, **columns))
