"""Language identification by unigram pieces, summed over all segmentations.

A language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the product of their probabilities: the forward algorithm. A text's is the product of
its words'. Words are runs of letters, in lower case; a letter that is no piece of its own is its UTF-8 bytes.

``fit`` counts the words of all labelled texts by language in Spark, then runs rounds of expectation and maximisation
over the distinct words: forward and backward sums give how often each piece is expected in each word's cuts. Only
sums by language and piece come to the driver, languages x vocabulary at most, whatever the corpus; the table of
words grows with it. Expectations are added as whole multiples of 1 / GRAIN, so the model is the same however rows lie.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewell.llm.common import added, discard, materialize
from basewell.llm.pieces import MARK, MODEL, pieces

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ROUNDS = 2
#: Expected counts are rounded to multiples of 1 / GRAIN.
GRAIN = 4096
#: So many pieces of the pooled distribution are added to each language's counts.
PRIOR = 5000.0
#: Words counted in a task before they are passed on.
COUNTED = 300_000
#: Solved words that a scoring task remembers.
REMEMBERED = 200_000
#: Letters solved side by side.
LETTERS = 300_000
UNKNOWN = "und"
_TINY, _STEP = 1e-100, 1e100


class Graph:
    """The pieces of a vocabulary that stand in marked words, as edges between places of the words' letters."""

    def __init__(self, path: str = MODEL):
        vocabulary = pieces(path)
        trie = vocabulary.trie
        self.n_pieces = len(vocabulary.text)
        self.rank = np.zeros(self.n_pieces)
        self.rank[sorted(vocabulary.score, key=vocabulary.score.get, reverse=True)] = np.arange(1, len(vocabulary.score) + 1)
        self.byte_id = [vocabulary.byte_id[b] for b in range(256)]
        self.rank[self.byte_id] = len(vocabulary.score) + 1
        self.base, self.check, self.value = (np.array(a, np.int64) for a in (trie.base, trie.check, trie.value))
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in trie.code]] = list(trie.code.values())
        self.longest = max(map(len, vocabulary.text))

    @cached_property
    def first(self) -> np.ndarray:
        """The distribution to begin with: as 1 / (rank + 1), by Zipf's law. Unusable pieces have none."""
        p = np.where(self.rank > 0, 1 / (self.rank + 1), 0.0)
        return p / p.sum()

    def edges(self, letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
        """(start, width, piece) of every piece found at every place, and (place, byte pieces) of letters that have none."""
        n = len(letters)
        ends = np.repeat(begins + lengths, lengths)
        codes = self.code[letters]
        at, state = np.arange(n), np.zeros(n, np.int64)
        single = np.zeros(n, bool)
        found = []
        for width in range(1, self.longest + 1):
            place = at + width - 1
            inside = place < ends[at]
            at, state, place = at[inside], state[inside], place[inside]
            code = codes[place]
            following = self.base[state] + code
            on = (code > 0) & (self.check[following] == state)
            at, state = at[on], following[on]
            if not len(at):
                break
            piece = self.value[state]
            good = piece >= 0
            if width == 1:
                single[at[good]] = True
            found.append((at[good], np.full(int(good.sum()), width), piece[good]))
        start, width, piece = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        spelt = [(int(i), [self.byte_id[b] for b in chr(letters[i]).encode("utf-8", "surrogatepass")]) for i in np.flatnonzero(~single)]
        return start, width, piece, spelt


_graphs: dict[str, Graph] = {}


def graph(path: str = MODEL) -> Graph:
    """The vocabulary's graph, made once by each Python worker."""
    if path not in _graphs:
        _graphs[path] = Graph(path)
    return _graphs[path]


class Lattice:
    """All segmentations of some marked words, side by side."""

    def __init__(self, g: Graph, words: list[str]):
        self.lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        letters = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum(self.lengths) - self.lengths
        start, width, piece, spelt = g.edges(letters, begins, self.lengths)
        self.spelt = [ids for _, ids in spelt]
        self.start = np.r_[start, np.array([at for at, _ in spelt], np.int64)]
        self.width = np.r_[width, np.ones(len(spelt), np.int64)]
        self.piece = np.r_[piece, np.full(len(spelt), -1)]
        self.n_plain = len(piece)
        self.word = np.repeat(np.arange(len(words)), self.lengths)[self.start] if len(words) else self.start
        self.offset = self.start - begins[self.word]  # inside the word
        self.node = self.start + self.word  # each word has one place more than letters
        self.root = begins + np.arange(len(words))
        self.reach = g.longest

    def weights(self, p: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """The probability of each edge: a row for each edge and a column for each language, or that of the edge's own language (row)."""
        spelt = np.array([p[:, ids].prod(1) for ids in self.spelt]).reshape(-1, len(p))
        if row is None:
            return np.concatenate([np.ascontiguousarray(p.T)[self.piece[: self.n_plain]], spelt])
        own = row[self.word]
        return np.r_[p[own[: self.n_plain], self.piece[: self.n_plain]], spelt[np.arange(len(spelt)), own[self.n_plain :]]]

    def _sums(self, weight: np.ndarray, begin: np.ndarray, end: np.ndarray, turn: np.ndarray, roots: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over paths from the roots to each place, and how often each was lifted by 1e100 against underflow."""
        n_nodes = int(self.lengths.sum()) + len(self.lengths)
        total = np.zeros((n_nodes, weight.shape[1]))
        lifts = np.zeros(n_nodes, np.int64)
        total[roots] = 1
        order = np.argsort(turn, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(turn[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
        first, last = self.root, self.root + self.lengths
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            at = order[low:high]
            now = total[begin[at]]
            small = now.max(1) < _TINY
            if small.any():
                where = np.unique(begin[at[small]])
                word = np.searchsorted(self.root, where, "right") - 1
                spread = where[:, None] + step * np.arange(self.reach + 1)
                inside = (spread >= first[word, None]) & (spread <= last[word, None])
                total[spread[inside]] *= _STEP
                # Places farther on are reached from lifted ones only.
                far = np.where(step > 0, last[word], first[word])
                for a, b in zip(where.tolist(), far.tolist(), strict=True):
                    lifts[min(a, b) : max(a, b) + 1] += 1
                now = total[begin[at]]
            total[end[at]] += now * weight[at]  # edges of one place and word end at different places
        return total, lifts

    def forward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._sums(weight, self.node, self.node + self.width, self.offset, self.root, 1)

    def backward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._sums(weight, self.node + self.width, self.node, self.lengths[self.word] - self.offset - self.width, self.root + self.lengths, -1)

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability (rows) in each language (columns)."""
        total, lifts = self.forward(self.weights(p))
        goal = self.root + self.lengths
        return np.log(np.maximum(total[goal], 1e-308)) + np.log(_TINY) * lifts[goal, None]

    def expectations(self, p: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each edge is expected among the cuts of its word, in the word's own language."""
        weight = self.weights(p, row)[:, None]
        (a, up), (b, down) = self.forward(weight), self.backward(weight)
        goal = (self.root + self.lengths)[self.word]
        lift = (up[goal] - up[self.node] - down[self.node + self.width]).astype(float)
        return a[self.node, 0] * weight[:, 0] * b[self.node + self.width, 0] / a[goal, 0] * _STEP**lift


def _blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words in blocks of about LETTERS letters, words of like length together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    group = np.cumsum(lengths[order] + 1) // LETTERS
    for block in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(block):
            yield block


class Model(NamedTuple):
    """Languages by code point, their shares of the labelled texts, and a row of piece probabilities for each."""

    languages: list[str]
    shares: np.ndarray
    p: np.ndarray
    path: str = MODEL


def words_of(text: str | None) -> list[str]:
    """Runs of letters (with their marks) in lower case."""
    return WORDS.findall(unicodedata.normalize("NFC", text.lower())) if text else []


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all texts; the empty word counts the texts."""
    both = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, some in counts.items() for w, n in some.items()]
            counts.clear()
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = counts.setdefault(lang, Counter())
                some.update(words_of(text))
                some[""] += 1
                if len(some) > COUNTED or len(counts) > COUNTED:
                    yield out()
        yield out()

    return both.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, languages: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """Expected counts of the pieces by language, in GRAIN-ths."""
    row_of = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph(path)
        total = np.zeros(len(languages) * g.n_pieces, np.int64)
        for batch in batches:
            words = batch.column(1).to_pylist()
            rows = np.fromiter(map(row_of.__getitem__, batch.column(0).to_pylist()), np.int64, len(words))
            n = batch.column(2).to_numpy()
            for block in _blocks(words):
                lattice = Lattice(g, [words[i] for i in block])
                row, times = rows[block], n[block]
                grains = np.rint(lattice.expectations(p, row) * times[lattice.word] * GRAIN).astype(np.int64)
                plain = lattice.n_plain
                np.add.at(total, row[lattice.word[:plain]] * g.n_pieces + lattice.piece[:plain], grains[:plain])
                for at, ids in enumerate(lattice.spelt, plain):
                    np.add.at(total, row[lattice.word[at]] * g.n_pieces + np.array(ids), grains[at])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "grains"])

    found = words.select("lang", "word", "n").mapInArrow(run, "cell long, grains long").groupBy("cell").agg(F.sum("grains").alias("grains")).toArrow()
    total = np.zeros(len(languages) * p.shape[1])
    total[found.column("cell").to_numpy()] = found.column("grains").to_numpy()
    return total.reshape(len(languages), -1) / GRAIN


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, path: str = MODEL) -> Model:
    """Learns from all texts whose language isn't null. A text of null or without letters counts for its language's share only.

    The model has a row of the vocabulary's size for each language; that many numbers come to the driver and go to each task.
    """
    counted = materialize(count_words(docs, text_col, lang_col))
    texts = {r.lang: r.n for r in counted.where("word = ''").collect()}
    languages = sorted(texts)
    g = graph(path)
    p = np.tile(g.first, (len(languages), 1))
    words = counted.where("word <> ''")
    for _ in range(rounds if languages else 0):
        counts = _expected(words, languages, p, path)
        pooled = counts.sum(0) + g.first
        mixed = counts + PRIOR * pooled / pooled.sum()
        p = mixed / mixed.sum(1, keepdims=True)
    discard(counted)
    shares = np.array([texts[lang] for lang in languages], float)
    return Model(languages, shares / shares.sum() if languages else shares, p, path)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the most probable language of each text and its probability among the learned ones.

    A text of null or without a letter is ``und`` with score 0, and so is every text where nothing was learned. Of
    equally probable languages the first by code point is taken. Other columns pass through.
    """
    kept = docs.drop(lang_out, score_out)
    schema = added(kept, lang_out, T.StringType())
    schema = T.StructType([*schema.fields, T.StructField(score_out, T.DoubleType(), True)])
    names = [*kept.columns, lang_out, score_out]
    at = names.index(text_col)
    languages, prior, p, path = model.languages, np.log(model.shares), model.p, model.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph(path)
        room = min(REMEMBERED, 32 * REMEMBERED // max(len(languages), 1))
        number: dict[str, int] = {}
        logs = np.zeros((0, len(languages)))
        for some in (batch.slice(i, 500) for batch in batches for i in range(0, batch.num_rows, 500)):
            if len(number) > room:
                number, logs = {}, logs[:0]
            known = len(number)
            used = []
            for text in some.column(at).to_pylist():
                words = words_of(text)
                used.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            fresh = list(number)[known:]
            logs = np.concatenate([logs, np.zeros((len(fresh), len(languages)))])
            for block in _blocks(fresh) if languages else ():
                logs[known + block] = Lattice(g, [fresh[i] for i in block]).log_probability(p)
            said, scores = [], []
            for row in used:
                if not len(row) or not languages:
                    said.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = prior + logs[row].sum(0)
                best = int(total.argmax())
                said.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], names)

    return kept.mapInArrow(run, schema)
