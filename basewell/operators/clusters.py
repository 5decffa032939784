"""Dereplication, near-duplicate clusters, pairwise identity, and merging of read pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import let, rate
from basewell.operators.graph import connected_components
from basewell.sources.scratch import discard, materialize, setting


def dereplicate(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """(digest, n, length, mean_error): distinct sequences with their count and the mean over places of the mean error there."""
    errors = F.transform(F.filter(F.split(F.col(qual), ""), lambda c: c != ""), lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - 33) / F.lit(10.0)))
    each = df.select(F.md5(F.col(seq).cast("binary")).alias("digest"), F.length(seq).alias("length"), F.aggregate(errors, F.lit(0.0), lambda t, e: t + e).alias("errors"))
    # Every read of a sequence has the same places, so the mean over places of means over reads is one quotient.
    return each.groupBy("digest", "length").agg(F.count(F.lit(1)).alias("n"), rate(F.sum("errors"), F.count(F.lit(1)) * F.first("length")).alias("mean_error"))


def identity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return 1 - rate(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


#: Stands for the length of any sequence where lengths aren't told apart.
ANYWHERE = 1 << 40
#: Windows of anchors have so many letters at most, as a power of two.
TOP_LEVEL = 6
#: Columns of a sequence's profile: counts of its pairs of letters, four to each.
PROFILE = [f"pairs{i}" for i in range(4)]
#: Letters of the grams that are counted in the texts of a pair before its edits are.
GRAM = 6
#: Rows with two texts each in a batch of a Python worker, and the setting for it.
PAIR_ROWS, ARROW_ROWS = 200, "spark.sql.execution.arrow.maxRecordsPerBatch"


@lru_cache(maxsize=100_000)
def _levels(n: int, least_identity: float, least_coverage: float) -> tuple[int, ...]:
    """Window sizes, as powers of two, at which a sequence of n letters shares an anchor with any that it may link with.

    A sequence of m letters that is edited at most d times keeps one of d + 1 equal pieces whole. Both lengths of a
    pair give the window for the shorter one's pieces, as each takes all lengths that its partner may have. -1: no
    piece is sure to have a letter.
    """
    cover = max(least_coverage, 1e-9)
    most = max(n, min(int(n / cover) + 1, 2 * n + 1_000_000))
    size = np.arange(max(0, int(cover * n) - 1), most + 1)
    edits = np.floor((1 - least_identity) * (size / cover + 1)) + 1
    piece = np.floor(size / (edits + 1)).astype(np.int64)
    return tuple(sorted({min(TOP_LEVEL, int(x).bit_length() - 1) for x in np.unique(piece)}))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(text: str, least_identity: float, least_coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): of each window the gram of least hash. Equal windows have equal anchors."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, found = len(letters), []
    for level in _levels(n, least_identity, least_coverage):
        salt = np.uint64((level + 2) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        if level < 0:
            found.append((_mix(np.array([salt])), np.zeros(1, np.int64)))
            continue
        window = 1 << level
        if n < window:
            continue
        k = min(24, (window + 1) // 2)
        grams = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + letters[i : n - k + 1 + i] + np.uint64(1)
        grams = _mix(grams)
        w = window - k + 1
        place = np.unique(np.arange(n - window + 1) + np.lib.stride_tricks.sliding_window_view(grams, w).argmin(axis=1))
        found.append((_mix(grams[place] + salt), place))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each sequence's length and how often each pair of letters occurs, letters told apart by two bits of their code, as 16 counts of 16 bits in four longs."""
    for batch in batches:
        size, counts = [], []
        for text in batch.column("s").to_pylist():
            letters = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32) >> 1 & 3
            pairs = np.bincount(letters[:-1] * 4 + letters[1:], minlength=16)
            size.append(None if text is None else len(letters))
            counts.append(np.minimum(pairs, 0xFFFF).astype("<u2").view("<i8"))
        packed = np.array(counts).reshape(-1, len(PROFILE))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), *(pa.array(packed[:, i]) for i in range(len(PROFILE)))], [*batch.schema.names, "n", *PROFILE])


def _profile_distance(name: str, other: str) -> Column:
    """Sum of the differences of two profiles' counts. An edit takes away two pairs of letters at most and adds two."""
    count = lambda c, i: F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(0xFFFF))
    each = [F.abs(count(F.col(name.format(c)), i) - count(F.col(other.format(c)), i)) for c in PROFILE for i in range(4)]
    return sum(each[1:], each[0])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, s, t, most) the pairs whose counts of GRAM letters don't differ by more than ``most`` edits can make: each takes away GRAM of them at most and adds as many."""
    values = 1 << 2 * GRAM

    def grams(text: str) -> np.ndarray:
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) >> 1 & 3
        n = max(0, len(letters) - GRAM + 1)
        code = np.zeros(n, np.int64)
        for i in range(GRAM):
            code = code * 4 + letters[i : i + n]
        return np.bincount(code, minlength=values)

    for batch in batches:
        found = {}
        keep = []
        for s, t, most in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            for text in (s, t):
                if text not in found:
                    found[text] = grams(text)
            keep.append(bool(np.abs(found[s] - found[t]).sum() <= 2 * GRAM * most))
        yield batch.filter(pa.array(keep, pa.bool_()))


def _posts(least_identity: float, least_coverage: float):
    """(key, node, place, width) of each anchor, for both length bands that a partner can share.

    width: places of linked reads lie closer together than that; it is the same for all posts of a key.
    """
    names = ["key", "node", "place", "width"]
    wide = -math.log(least_coverage) * 1.0001 if 0 < least_coverage < 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(i, 200) for batch in batches for i in range(0, batch.num_rows, 200)):
            columns = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                key, place = anchors(text, least_identity, least_coverage)
                band = int(math.log(max(1, len(text))) / wide) if wide else 0
                for b in (band, band + 1) if wide else (band,):
                    most = math.exp((b + 1) * wide) + 1 if wide else ANYWHERE
                    width = int((1 - least_identity) * most) + 2
                    with np.errstate(over="ignore"):
                        keys = _mix(key + np.uint64(b) * np.uint64(0x9E3779B97F4A7C15))
                    columns.append((keys, np.full(len(key), node), place, np.full(len(key), width)))
            if columns:
                key, node, place, width = (np.concatenate(c) for c in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(place), pa.array(width)], names)

    return run


def near_duplicates(df: DataFrame, *, name: str = "qname", seq: str = "seq", least_identity: float = 0.999, least_coverage: float = 0.99) -> DataFrame:
    """(name, cluster): the smallest name of a read's cluster; reads link where both bounds hold.

    Reads within the bounds share a piece, and so an anchor of it, at places that edits move by less than their
    number: no link is missed. Anchors of one read alone are dropped first. Then each read is paired with the first read of each anchor; the edit distance, which
    stops counting at the bound, decides, and links give components. Then reads of an anchor that still lie in
    different components are paired, where their places lie near each other: posts meet by anchor and stretch of places,
    so an anchor that recurs all along many reads isn't one group. Pairs whose counts of letter pairs differ by more than the edits
    allowed can make are left out before their texts are looked up. Equal sequences are one node, so a group of copies costs one row a copy.
    """
    named = df.select(F.col(name).alias("name"), F.col(seq).alias("s")).withColumn("digest", F.sha2(F.col("s").cast("binary"), 256))
    kinds = named.groupBy("digest").agg(F.first("s").alias("s"), F.min("name").alias("first_name")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(kinds.mapInArrow(_profiles, ", ".join([*(f"{c} {kind}" for c, kind in kinds.dtypes), "n long", *(f"{c} long" for c in PROFILE)])))
    texts = nodes.select("node", "s")
    shapes = nodes.select("node", "n", *PROFILE)
    others = shapes.withColumnsRenamed({c: f"other_{c}" for c in shapes.columns})
    posts = materialize(texts.mapInArrow(_posts(least_identity, least_coverage), "key long, node long, place long, width long"))
    bound = f"cast(floor((1 - {least_identity!r}D) * greatest({{0}}, {{1}}) + 1e-9D) as int)"
    covers = F.least("n", "other_n") >= least_coverage * F.greatest("n", "other_n")
    alike = covers & (_profile_distance("{}", "other_{}") <= 4 * F.expr(bound.format("n", "other_n")))

    def linked(pairs: DataFrame) -> DataFrame:
        wide = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(texts.withColumnsRenamed({"node": "b", "s": "t"}), "b")
        wide = wide.select("a", "b", "s", "t", F.expr(bound.format("length(s)", "length(t)")).alias("most"))
        with setting(df.sparkSession, ARROW_ROWS, PAIR_ROWS):
            likely = wide.mapInArrow(_likely, wide.schema)
            return materialize(likely.where("levenshtein(s, t, most) >= 0").select("a", "b"))

    ordered = F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")
    ends = posts.groupBy("key").agg(F.min("node").alias("other_node"), F.max("node").alias("last")).where("other_node <> last").drop("last")
    shared = materialize(posts.join(ends, "key"))
    discard(posts)
    star = shared.where("node <> other_node").select("node", "other_node").distinct().join(shapes, "node").join(others, "other_node")
    star = materialize(star.where(alike).select(*ordered).distinct())
    links = linked(star)
    labels = materialize(connected_components(links)) if not links.isEmpty() else None
    placed = shared.drop("other_node")
    placed = placed.withColumn("label", F.col("node")) if labels is None else placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_ = materialize(placed.join(mixed, "key", "left_semi").join(shapes, "node"))
    discard(shared)
    stretch = F.floor(F.col("place") / F.col("width"))
    partners = open_.select("key", stretch.alias("stretch"), *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "place", "label", *PROFILE)])
    near = F.expr(f"abs(place - other_place) <= {bound.format('n', 'other_n')}")
    beside = open_.withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    across = beside.join(partners, ["key", "stretch"]).where((F.col("node") < F.col("other_node")) & (F.col("label") != F.col("other_label")) & near & alike)
    more = linked(across.select(*ordered).distinct().join(star, ["a", "b"], "left_anti"))
    first_labels, labels = labels, connected_components(links.unionByName(more)).withColumnRenamed("label", "root")
    discard(star, open_, first_labels)  # the components still look for loops among the links
    rooted = nodes.select("node", "digest", "first_name").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first_name").alias("cluster"))
    return named.select("name", "digest").join(rooted.select("digest", "root"), "digest").join(smallest, "root").select(F.col("name").alias(name), "cluster")


def merge_pair(forward: Column, backward: Column, least: int = 10, most: int = 60) -> Column:
    """A read pair as one sequence: the end of forward overlaps the start of backward, on one strand, by the length with the fewest edits per base (the longest of equals)."""
    sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(forward), F.length(backward))))
    scored = F.transform(sizes, lambda n: F.struct((F.levenshtein(F.right(forward, n), F.left(backward, n)) / n).alias("rate"), (-n).alias("size")))
    size = -F.array_min(scored)["size"]
    return F.concat(forward, F.substring(backward, size + 1, F.length(backward)))


def pairwise(df: DataFrame, by: list[str], name: str, seq: str) -> DataFrame:
    """(by, a, b, identity, coverage) of all pairs a < b of a small natural group, such as the reads of one channel."""
    one, two = (df.select(*by, F.col(name).alias(n), F.col(seq).alias(f"s_{n}")) for n in ("a", "b"))
    joined = one.join(two, by).where("a < b")
    cover = rate(F.least(F.length("s_a"), F.length("s_b")), F.greatest(F.length("s_a"), F.length("s_b")))
    return joined.select(*by, "a", "b", identity(F.col("s_a"), F.col("s_b")).alias("identity"), cover.alias("coverage"))


def minimizers(seq: Column | str, k: int = 7, w: int = 5) -> Column:
    """The different smallest k-mers of each w consecutive ones; of a sequence with fewer, the smallest of all; none where it is shorter than k."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    grams = F.when(F.length(seq) >= k, F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def least(g: Column) -> Column:
        return F.when(F.size(g) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(g, i, F.lit(w)))))).otherwise(g)

    return let(grams, least)


def best_hits(df: DataFrame, by: list[str], name: str, seq: str, *, k: int = 7, w: int = 5, best: int = 10) -> DataFrame:
    """(by, a, b, shared, identity, coverage): for each sequence the ``best`` others of its group that share most minimizers with it.

    An index of minimizers proposes the pairs, so sequences without one in common are never compared, and the edit
    distance is counted for the best only. Of equal counts the smaller name comes first. Groups are natural and small, such as
    the reads of one channel: a minimizer of seven bases tells nothing in a large one, which needs a larger k.
    """
    texts = df.select(*by, F.col(name).alias("a"), F.col(seq).alias("s"))
    index = texts.select(*by, "a", F.explode(minimizers("s", k, w)).alias("gram"))
    shared = index.join(index.withColumnRenamed("a", "b"), [*by, "gram"]).where("a <> b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy(*by, "a").orderBy(F.desc("shared"), "b")
    top = shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best).drop("place")
    both = top.join(texts, [*by, "a"]).join(texts.withColumnsRenamed({"a": "b", "s": "t"}), [*by, "b"])
    cover = rate(F.least(F.length("s"), F.length("t")), F.greatest(F.length("s"), F.length("t")))
    return both.select(*by, "a", "b", "shared", identity(F.col("s"), F.col("t")).alias("identity"), cover.alias("coverage"))


def identity_matrix(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, identity): of the pairs of ``pairwise`` a row for each a, with all its partners b in order and as many identities."""
    cells = pairs.groupBy(*by, "a", "b").agg(F.max("identity").alias("identity"))
    rows = cells.groupBy(*by, "a").agg(F.array_sort(F.collect_list(F.struct("b", "identity"))).alias("cells"))
    return rows.select(*by, "a", F.col("cells.b").alias("b"), F.col("cells.identity").alias("identity"))
