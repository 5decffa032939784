"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text is the set of its word shingles, as 64-bit hashes. Texts of equal sets are one node. All sets are ordered alike,
rarest shingle first, by counts of hashed shingles over the whole corpus (a table of SKETCH counters; any common
order gives right results, a rare-first one few candidates). Two sets that are similar enough share a shingle among
their first few, so nodes are joined on these:

- length filter: the smaller set has at least the threshold's share of the larger one;
- positional filter: what follows the shared shingle in both orders still suffices for the overlap needed;
- suffix filter: a bitmap holds the parity of a set's shingles in each of BITS classes; two sets differ in at least as
  many shingles as their bitmaps in bits.

What passes is verified once for each pair, on the texts, with hashes that are independent of those that found it. Links are wanted for components only, and a group of copies
must not cost the square of its size, so candidates come in two steps. First every node is paired with the leader of
each shingle's group: the node whose shingles are most common, since the original of many edited copies shares all its
shingles with most of them and an edited copy doesn't. (Groups of frequent shingles are dealt into parts, and their
nodes are paired with the leader of all parts, too.) Pairs that hold give components. Then, for shingles whose nodes still lie in different components, nodes that pass the
filters with none of another component are left out (in groups of up to PAIRED), and those outside the
commonest component are paired with all nodes of other components. A link between different components is found in
the second step; one within a component changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewell.llm import textbytes as tb
from basewell.llm.common import arrow_rows, discard, materialize, with_row_id
from basewell.llm.components import connected_components

WORDS = 5
PERCENT = 75
SKETCH = 1 << 16
BITS = 512
MAPS = [f"bits{i}" for i in range(BITS // 64)]
#: Rows with texts in a batch of a Python worker, and pairs of texts.
BATCH_ROWS = 1000
PAIR_ROWS = 200
#: A task remembers so many nodes at a time to leave out repeats among its own rows.
KNOWN_NODES = 100_000
#: Groups of shingles that more nodes than this may share are dealt into parts.
PART_NODES = 4096
#: In groups of shingles up to this size every two nodes are looked at before anything is written.
PAIRED = 512
#: In groups from this size on, nodes outside the main component are first paired with so many of its nodes.
LARGE_GROUP = 64
DELEGATES = 8
U64 = np.uint64


def shingle_sets(block: tb.Block, words: int = WORDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) sorted and distinct. Fewer words than a shingle has are one shingle; a row without words has none."""
    starts, ends, bounds = tb.words(block)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    codes = tb.word_codes(block, starts, ends, lower=True, seed=seed)
    hasher = tb.Hasher(codes, codes=codes)
    n = np.diff(bounds)
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    begin = bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    keys = hasher(begin, begin + np.minimum(words, n)[row])
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])]
    return row[new], keys[new]


def _nodes(row: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and set hash of each row."""
    sums = np.zeros(len(keys) + 1, U64)
    np.cumsum(tb.mix(keys ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    edge = np.searchsorted(row, np.arange(n_rows + 1))
    size = np.diff(edge)
    return size, tb.mix(sums[edge[1:]] - sums[edge[:-1]] + size.astype(U64)).view(np.int64)


def _bitmaps(row: np.ndarray, keys: np.ndarray, n_rows: int) -> np.ndarray:
    """Parities of each row's shingles in BITS classes, as n_rows x MAPS."""
    maps = np.zeros(n_rows * len(MAPS), U64)
    np.bitwise_xor.at(maps, row * len(MAPS) + (keys % U64(len(MAPS))).astype(np.int64), U64(1) << ((keys >> U64(8)) & U64(63)))
    return maps.reshape(n_rows, len(MAPS))


_SUMMARY = "row_id long, n long, node long, " + ", ".join(f"{m} long" for m in MAPS)


def _summaries(words: int):
    """Rows of documents (row_id, n, node, bitmap), and at the end of the task its counters (row_id null, n = counter, node = count)."""
    names = ["row_id", "n", "node", *MAPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                n_rows = len(block.offsets) - 1
                row, keys = shingle_sets(block, words)
                size, node = _nodes(row, keys, n_rows)
                counts += np.bincount((keys >> U64(48)).astype(np.int64) % SKETCH, minlength=SKETCH)
                maps = _bitmaps(row, keys, n_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n_rows), pa.array(size), pa.array(node), *(pa.array(maps[:, i]) for i in range(len(MAPS)))], names)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(used), pa.array(counts[used]), *[pa.nulls(len(used), pa.int64())] * len(MAPS)], names)

    return run


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def _prefixes(words: int, percent: int, counts: np.ndarray):
    """(token, part, parts, node, sized, common): the first shingles of each node in rare-first order. sized holds set size and place, common how common the node's shingles are."""
    usual = np.median(counts)
    names = ["token", "part", "parts", "node", "sized", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                n_rows = len(block.offsets) - 1
                row, keys = shingle_sets(block, words)
                size, node = _nodes(row, keys, n_rows)
                fresh = np.zeros(n_rows, bool)
                if len(known) > KNOWN_NODES:
                    known.clear()
                for i, name in enumerate(node.tolist()):
                    if name not in known:
                        known.add(name)
                        fresh[i] = size[i] > 0
                use = fresh[row]
                row, keys = row[use], keys[use]
                often = counts[(keys >> U64(48)).astype(np.int64) % SKETCH]
                common = np.bincount(row, weights=often, minlength=n_rows) / np.maximum(size, 1)
                order = np.lexsort((keys, often, row))
                row, keys, often = row[order], keys[order], often[order]
                first = np.searchsorted(row, np.arange(n_rows))
                spot = np.arange(len(row)) - first[row]
                use = spot <= (size - _needed(size, percent))[row]
                row, keys, often, spot = row[use], keys[use], often[use], spot[use]
                parts = np.maximum(1, np.ceil((often - usual) / PART_NODES)).astype(np.int64)
                part = (tb.mix(node[row].view(U64)) % parts.astype(U64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), part, parts, node[row], (size[row].astype(np.int64) << 32) | spot, common[row].astype(np.int64))], names)

    return run


_LED = "token long, parts long, node long, n long, spot long, lead long, lead_n long, lead_spot long, lead_common long"


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows as tables of at least 100,000 rows, where there are so many, none of which cuts a group of equal values in the first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 100_000:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(_starts(*(table.column(i).to_numpy() for i in range(keys))))[-1])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Rows at which a group of equal keys begins."""
    return np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]


def _hopeful(begin: np.ndarray, size: np.ndarray, n: np.ndarray, spot: np.ndarray, percent: int, label: np.ndarray | None = None, maps: np.ndarray | None = None) -> np.ndarray:
    """Rows that pass the length and positional filter with another row of their group, with labels and bitmaps also the suffix filter with one of another label. Groups of more than PAIRED rows are taken to."""
    hopeful = size > PAIRED
    place = np.arange(len(n)) - np.repeat(begin, np.diff(np.r_[begin, len(n)]))
    left = np.flatnonzero((size > 1) & ~hopeful)
    for step in range(1, PAIRED):
        left = left[place[left] + step < size[left]]
        if not len(left):
            break
        right = left + step
        n1, n2 = n[left], n[right]
        overlap = -(-percent * (n1 + n2) // (100 + percent))
        good = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
        good &= np.minimum(n1 - spot[left], n2 - spot[right]) >= overlap
        if label is not None:
            good &= label[left] != label[right]
            good = np.flatnonzero(good)
            differ = np.bitwise_count(maps[left[good]] ^ maps[right[good]]).sum(axis=1, dtype=np.int64)
            good = good[differ <= (n1 + n2 - 2 * overlap)[good]]
        hopeful[left[good]] = True
        hopeful[right[good]] = True
    return hopeful


def _led(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by token, part, commonness (falling) and node: each node once for its token, with the part's first as leader. A node that passes the filters with no other of its group is left out."""
        names = [x.split()[0] for x in _LED.split(", ")]
        for table in _whole_groups(batches, 2):
            token, part, parts, node, sized, common = (table.column(i).to_numpy() for i in range(6))
            new = _starts(token, part)
            keep = new | np.r_[True, node[1:] != node[:-1]]
            token, parts, node, sized, common, new = (x[keep] for x in (token, parts, node, sized, common, new))
            n, spot = sized >> 32, sized & 0xFFFFFFFF
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(token)])
            lead = np.repeat(begin, size)
            use = _hopeful(begin, np.repeat(size, size), n, spot, percent) | (parts > 1)
            lead = lead[use]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[use], parts[use], node[use], n[use], spot[use], node[lead], n[lead], spot[lead], common[lead])], names)

    return run


_PLACE = ["token", "node", "n", "spot", *MAPS]


def _with_partners(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (_PLACE, label, members) sorted by token: those that pass all filters with a node of another component, and all of groups of more than PAIRED members."""
        for table in _whole_groups(batches, 1):
            token, n, spot, label, members = (table.column(c).to_numpy() for c in ("token", "n", "spot", "label", "members"))
            begin = np.flatnonzero(_starts(token))
            maps = np.column_stack([table.column(m).to_numpy() for m in MAPS]).view(U64)
            use = _hopeful(begin, np.repeat(np.diff(np.r_[begin, len(token)]), np.diff(np.r_[begin, len(token)])), n, spot, percent, label, maps) | (members > PAIRED)
            yield from table.select(_PLACE).filter(pa.array(use)).to_batches()

    return run


def _passes(n: Column, spot: Column, other_n: Column, other_spot: Column, percent: int) -> Column:
    """Length and positional filter of two nodes that share a shingle at these places of their orders."""
    length = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    overlap = F.ceil(percent * (n + other_n) / (100 + percent))
    return length & (F.least(n - spot, other_n - other_spot) >= overlap)


def _texts(words: int):
    """(node, text): compressed texts, one for each node that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                n_rows = len(block.offsets) - 1
                row, keys = shingle_sets(block, words)
                size, node = _nodes(row, keys, n_rows)
                if len(known) > KNOWN_NODES:
                    known.clear()
                out = []
                for i, name in enumerate(node.tolist()):
                    if size[i] and name not in known:
                        known.add(name)
                        out.append((name, pack.compress(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes())))
                names, texts = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.binary())], ["node", "text"])

    return run


def _verify(words: int, percent: int):
    """Of (a, b, text_a, text_b) the pairs whose sets are similar enough. Pairs are taken together up to a block of texts; a text that many of them hold is cut into shingles once for these."""

    def kept(pairs: list[tuple[int, int]], texts: dict[int, bytes]) -> pa.RecordBatch:
        place = {node: i for i, node in enumerate(texts)}
        offsets = np.cumsum([0, *map(len, texts.values())])
        row, keys = shingle_sets(tb.Block(0, np.frombuffer(b"".join(texts.values()), np.uint8), offsets), words, seed=2)
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        found = []
        for a, b in pairs:
            x, y = (keys[edge[place[n]] : edge[place[n] + 1]] for n in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                found.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([p[side] for p in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        pairs: list[tuple[int, int]] = []
        texts: dict[int, bytes] = {}
        held = 0
        for batch in batches:
            for i, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                pairs.append(pair)
                for side, node in enumerate(pair):
                    if node not in texts:
                        texts[node] = unpack.decompress(batch.column(2 + side)[i].as_py())
                        held += len(texts[node])
                if held > tb.BLOCK_BYTES:
                    yield kept(pairs, texts)
                    pairs, texts, held = [], {}, 0
        if pairs:
            yield kept(pairs, texts)

    return run


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: n_shingles and component_id, the smallest id that links lead to.

    Two documents link where 100 * shared >= percent * all of their shingles. Texts are lower-cased (A-Z); a text
    without words, or a null, has no shingle and links with nothing. Rows without an id come last and are told apart
    by their text; their component_id is null where no document with an id is in it. Rows that share an id are
    documents of their own.
    """
    keyed, _ = with_row_id(docs.select(id_col, text_col), id_col, text_col)
    whole = _grouped(keyed, text_col, words, percent)
    whole = whole.join(keyed.select("row_id", F.col(id_col).cast("long").alias("own_id")), "row_id")
    least = whole.where("group is not null").groupBy("group").agg(F.min("own_id").alias("least"))
    out = whole.join(materialize(least), "group", "left")
    return out.select(F.col("own_id").alias(id_col), "n_shingles", F.coalesce("least", "own_id").alias("component_id"))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which each is the first of its component: exactly one row a component, by id, then by text.

    Rows without words are a component each. Rows that share an id, or have none, are told apart as in similar_documents.
    """
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed, _ = with_row_id(whole, "id", "text")
    groups = materialize(_grouped(keyed, "text", words, percent).select("row_id", "group"))
    heads = groups.where("group is not null").groupBy("group").agg(F.min("row_id").alias("row_id")).select("row_id")
    heads = heads.unionByName(groups.where("group is null").select("row_id"))
    return keyed.join(heads, "row_id", "left_semi").select("whole.*")


def _grouped(keyed: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """(row_id, n_shingles, node, label, group): the component of each row, null where it has no words."""
    with arrow_rows(keyed.sparkSession, BATCH_ROWS):
        return _in_groups(keyed, text_col, words, percent)


def _in_groups(keyed: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    plain = keyed.select("row_id", text_col)
    found = materialize(plain.mapInArrow(_summaries(words), _SUMMARY))
    summaries = found.where("row_id is not null")
    counts = np.zeros(SKETCH, np.int64)
    for spot, count in found.where("row_id is null").groupBy("n").agg(F.sum("node")).collect():  # at most SKETCH rows
        counts[spot] = count

    texts = keyed.select(text_col)
    prefixes = texts.mapInArrow(_prefixes(words, percent, counts), "token long, part long, parts long, node long, sized long, common long")
    dealt = prefixes.repartition("token", "part").sortWithinPartitions("token", "part", F.desc("common"), "node")
    posts = materialize(dealt.mapInArrow(_led(percent), _LED))

    sizes = summaries.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), *[F.min(m).alias(m) for m in MAPS])
    near = posts.where("node <> lead").where(_passes(*(F.col(c) for c in ("n", "spot", "lead_n", "lead_spot")), percent))
    star = near.select(F.col("node").alias("a"), F.col("lead").alias("b"))
    leaders = posts.where("parts > 1 and node = lead").select("token", F.struct(-F.col("lead_common"), "lead", "lead_n", "lead_spot").alias("chief"))
    chief = leaders.groupBy("token").agg(F.min("chief").alias("chief"))
    led = posts.where("parts > 1").join(chief, "token").where(F.col("node") != F.col("chief.lead"))
    led = led.where(_passes(F.col("n"), F.col("spot"), F.col("chief.lead_n"), F.col("chief.lead_spot"), percent))
    star = _pairs(star.unionByName(led.select(F.col("node").alias("a"), F.col("chief.lead").alias("b"))))
    one, two = (sizes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(m).alias(f"{m}_{s}") for m in MAPS]) for s in ("a", "b"))
    star = star.join(one, "a").join(two, "b").where(_may_link(F.col("n_a"), F.col("n_b"), "{}_a", "{}_b", percent)).select("a", "b")
    star = materialize(star)

    nodes = posts.select("node").distinct()
    kept = materialize(texts.mapInArrow(_texts(words), "node long, text binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(kept.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        two = one.join(kept.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        with arrow_rows(keyed.sparkSession, PAIR_ROWS):
            return materialize(two.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a long, b long"))

    links = verified(star)
    labels = materialize(connected_components(links))
    opened = _open_places(posts.select("token", "node", "n", "spot"), labels).join(sizes.drop("n"), "node")
    dealt = opened.repartition("token", F.when(F.col("members") > PAIRED, F.col("node"))).sortWithinPartitions("token")
    places = materialize(dealt.select(*_PLACE, "label", "members").mapInArrow(_with_partners(percent), ", ".join(f"{c} long" for c in _PLACE)))
    discard(posts)

    def across(some: str, known: DataFrame) -> DataFrame:
        """New pairs of nodes outside their group's main component with nodes of other components, of those where ``some`` holds."""
        placed = _main(places.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        rest = placed.where("label <> main").select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "spot", "label", *MAPS)])
        apart = (F.col("label") != F.col("other_label")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("other_node")))
        fits = _passes(*(F.col(c) for c in ("n", "spot", "other_n", "other_spot")), percent) & _may_link(F.col("n"), F.col("other_n"), "{}", "other_{}", percent)
        pairs = placed.where(some).join(rest, "token").where(apart & fits)
        return materialize(_pairs(pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b"))).join(known, ["a", "b"], "left_anti"))

    # Most nodes of a large group that the leader doesn't link with link with some other: a few are tried before all.
    tried = across(f"members >= {LARGE_GROUP} and label = main and pmod(xxhash64(token, node), members) < {DELEGATES}", star)
    if not tried.isEmpty():
        links = links.unionByName(verified(tried))
        labels = materialize(connected_components(links))
    last = across("true", star.unionByName(tried))
    if not last.isEmpty():
        labels = materialize(connected_components(links.unionByName(verified(last))))
    discard(star, kept, places, tried, last)

    whole = summaries.select("row_id", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    return whole.withColumn("group", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")))


def _open_places(places: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of shingles whose nodes lie in different components, with their component's label and how many members their group has."""
    placed = places.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
    return placed.select(*places.columns, "label").join(mixed.select("token", "members"), "token")


def _main(placed: DataFrame) -> DataFrame:
    """Adds how many members a shingle's group has, and its commonest component as ``main``."""
    per_label = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("many"))
    most = per_label.groupBy("token").agg(F.sum("many").alias("members"), F.max(F.struct("many", "label")).alias("most"))
    return placed.join(most.select("token", "members", F.col("most.label").alias("main")), "token")


def _pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _may_link(n: Column, other_n: Column, name: str, other_name: str, percent: int) -> Column:
    """Suffix filter: whether the bitmaps differ in no more bits than sets of these sizes may in shingles."""
    apart = sum((F.bit_count(F.col(name.format(m)).bitwiseXOR(F.col(other_name.format(m)))) for m in MAPS[1:]), F.bit_count(F.col(name.format(MAPS[0])).bitwiseXOR(F.col(other_name.format(MAPS[0])))))
    return apart <= n + other_n - 2 * F.ceil(percent * (n + other_n) / (100 + percent))
