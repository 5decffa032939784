"""SentencePiece encoding and decoding with a unigram model.

The pieces of a model file stand in a double-array trie; a text's encoding is the path of highest total log score
over the pieces that the trie finds at each place (Viterbi). A character that no piece covers is written as the
byte pieces of its UTF-8 form. Spaces are written with the marker U+2581, and one marker is put before the text.

No piece of a usable vocabulary has a marker behind another character, so the best path never crosses the start of a
word and words are solved one by one; each task keeps the words it has solved, up to a bound. A vocabulary that has
such pieces is solved text by text.

The file may hold merge ranks instead of log probabilities (a BPE model). With ``scores="rank"`` a piece of rank r
scores -ln(r + 1), as under Zipf's law; ``scores="file"`` takes the file's own values. Nothing is trained.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewell.llm.common import added

MARK = "▁"
#: The public vocabulary file taken unless another is named.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_COST = 10.0
CACHE_WORDS = 50_000
LONGEST_CACHED = 40


class DoubleArray:
    """A trie in two arrays: from state s character c leads to base[s] + code(c), if check there is s."""

    def __init__(self, words: dict[str, int]):
        self.code = {c: n + 1 for n, c in enumerate(sorted({c for w in words for c in w}))}
        size = 4 * sum(map(len, words)) + len(self.code) + 2
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        ordered = sorted(words)
        free, todo = 1, [(0, 0, len(ordered), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if len(ordered[low]) == depth:
                self.value[state] = words[ordered[low]]
                low += 1
            groups = []
            while low < high:
                char, end = ordered[low][depth], low + 1
                while end < high and ordered[end][depth] == char:
                    end += 1
                groups.append((self.code[char], low, end))
                low = end
            if not groups:
                continue
            while self.check[free] != -1:
                free += 1
            offset = max(0, free - groups[0][0])
            while any(self.check[offset + c] != -1 for c, _, _ in groups):
                offset += 1
                if offset + len(self.code) + 1 >= len(self.check):
                    more = len(self.check)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
            self.base[state] = offset
            for c, first, end in groups:
                self.check[offset + c] = state
                todo.append((offset + c, first, end, depth + 1))

    def prefixes(self, codes: list[int], begin: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each word that begins at begin; codes holds 0 for a character that no word has."""
        base, check, value = self.base, self.check, self.value
        state = 0
        for at in range(begin, len(codes)):
            code = codes[at]
            following = base[state] + code
            if not code or check[following] != state:
                return
            state = following
            if value[state] >= 0:
                yield at + 1, value[state]


class Pieces:
    """A vocabulary: piece texts by id, log scores, byte pieces, and the trie of the ordinary pieces."""

    def __init__(self, path: str = MODEL, scores: str = "rank"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        ordinary = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        # Pieces without a rank of their own come after all that have one.
        ranked = sorted(ordinary, key=lambda i: (-model.get_score(i), i))
        self.score = {i: model.get_score(i) if scores == "file" else -math.log(r + 1) for r, i in enumerate(ranked, 1)}
        self.unknown = min(self.score.values()) - UNKNOWN_COST
        self.trie = DoubleArray({self.text[i]: i for i in ordinary})
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", self.text[i]) for i in ordinary)
        self.plain = [t.replace(MARK, " ") for t in self.text]
        for value, i in self.byte_id.items():
            self.plain[i] = chr(0xDC00 + value) if value > 127 else chr(value)
        self._solved: dict[str, list[int]] = {}
        edge = "" if "\n" in self.trie.code else "\n"  # where no piece has a line end, it stands alone
        self._segments = re.compile(f"{MARK}*[^{MARK}{edge}]+|{MARK}+" + (f"|{edge}" if edge else "")).findall
        self._code_of = np.zeros(0x110000, np.int32)
        self._code_of[[ord(c) for c in self.trie.code]] = list(self.trie.code.values())
        self._trie = [np.array(a, np.int32) for a in (self.trie.base, self.trie.check, self.trie.value)]
        self._score = np.full(n, -np.inf)
        self._score[list(self.score)] = list(self.score.values())

    def best_path(self, segment: str) -> list[int]:
        """The best encoding of marked text. Of equal scores the one whose last piece starts earlier wins."""
        n = len(segment)
        best, came, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        get, score, prefixes, unknown = self.trie.code.get, self.score, self.trie.prefixes, self.unknown
        codes = [get(c, 0) for c in segment]
        for at in range(n):
            here, single = best[at], False
            for end, piece in prefixes(codes, at):
                single |= end == at + 1
                total = here + score[piece]
                if total > best[end]:
                    best[end], came[end], by[end] = total, at, piece
            if not single and here + unknown > best[at + 1]:
                best[at + 1], came[at + 1], by[at + 1] = here + unknown, at, -1
        ids, at = [], n
        while at:
            if by[at] >= 0:
                ids.append(by[at])
            else:
                ids += [self.byte_id[b] for b in reversed(segment[came[at] : at].replace("\0", MARK).encode("utf-8", "surrogatepass"))]
            at = came[at]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """Piece ids of a text; an empty text has none. A marker that the text itself holds is written in bytes, so decoding gives it back."""
        if not text:
            return []
        if MARK in text or "\0" in text:
            # The stand-in \0 has no piece; a true \0 is one byte and goes piece by piece.
            out: list[int] = []
            lead = True
            for part in re.split("(\0)", text):
                if part == "\0":
                    out += ([self.trie_id(MARK)] if lead else []) + [self.byte_id[0]]
                elif part:
                    out += self._encode_plain((MARK if lead else "") + part.replace(MARK, "\0").replace(" ", MARK))
                lead &= not part
            return out
        return self._encode_plain(MARK + text.replace(" ", MARK))

    def trie_id(self, piece: str) -> int:
        codes = [self.trie.code[c] for c in piece]
        return next(i for end, i in self.trie.prefixes(codes, 0) if end == len(codes))

    def _encode_plain(self, marked: str) -> list[int]:
        if not self.by_word:
            return self.best_path(marked)
        ids: list[int] = []
        solved, extend = self._solved, ids.extend
        for word in self._segments(marked):
            found = solved.get(word)
            if found is None:
                found = self.best_path(word)
            extend(found)
        return ids

    def prepare(self, texts: list[str]) -> None:
        """Solves the words of these texts that aren't known yet, all at once."""
        if not self.by_word:
            return
        if len(self._solved) > CACHE_WORDS:
            self._solved.clear()
        find, known = self._segments, self._solved
        new = set()
        for text in texts:
            if MARK not in text and "\0" not in text:
                new.update(find(MARK + text.replace(" ", MARK)))
        self._solve([w for w in new if w not in known and len(w) <= LONGEST_CACHED])

    def forget(self) -> None:
        """Drops the solved words: a worker that Spark uses again for other tasks shouldn't hold them."""
        self._solved = {}

    def _solve(self, words: list[str]) -> None:
        """Viterbi over all words side by side: one step for each start and length of a piece."""
        words.sort(key=len, reverse=True)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = self._code_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(lengths) - lengths
        if len(codes):
            odd = np.minimum.reduceat(codes, begins) == 0
            self._solved.update((words[i], self.best_path(words[i])) for i in np.flatnonzero(odd))
            words, lengths, begins = [w for w, o in zip(words, odd, strict=True) if not o], lengths[~odd], begins[~odd]
        if not words:
            return
        n, longest = len(words), int(lengths[0])
        base, check, value = self._trie
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        came, by = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), -1, np.int32)
        reach = [int(np.searchsorted(-lengths, -at, "left")) for at in range(longest + 1)]  # words longer than at
        for start in range(longest):
            rows, state = np.arange(reach[start]), np.zeros(reach[start], np.int32)
            for at in range(start, longest):
                if at > start:
                    keep = int(np.searchsorted(rows, reach[at], "left"))
                    rows, state = rows[:keep], state[:keep]
                code = codes[begins[rows] + at]
                following = base[state] + code
                on = check[following] == state
                rows, state = rows[on], following[on]
                if not len(rows):
                    break
                piece = value[state]
                ends = piece >= 0
                row, piece = rows[ends], piece[ends]
                total = best[start, row] + self._score[piece]
                better = total > best[at + 1, row]
                row = row[better]
                best[at + 1, row], came[at + 1, row], by[at + 1, row] = total[better], start, piece[better]
        # A character of the trie may lack a piece of its own: such words, if a path needed it, are solved one by one.
        stuck = np.isinf(best[lengths, np.arange(n)])
        rows, at, steps = np.arange(n)[~stuck], lengths[~stuck], []
        count = np.zeros(n, np.int64)
        while len(rows):
            steps.append((rows, by[at, rows]))
            count[rows] += 1
            at = came[at, rows]
            on = at > 0
            rows, at = rows[on], at[on]
        close = np.cumsum(count)
        ids = np.zeros(int(close[-1]), np.int32)
        for back, (rows, piece) in enumerate(steps, 1):
            ids[close[rows] - back] = piece
        flat, begin = ids.tolist(), 0
        solved = self._solved
        for word, end in zip(words, close.tolist(), strict=True):
            solved[word] = flat[begin:end]
            begin = end
        for i in np.flatnonzero(stuck):
            solved[words[i]] = self.best_path(words[i])

    def decode(self, ids: list[int]) -> str:
        """The text that the ids encode: markers become spaces, runs of byte pieces UTF-8, the leading marker goes."""
        text = "".join(map(self.plain.__getitem__, ids))
        if _HIGH.search(text):
            text = _HIGH.sub(lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode("utf-8", "replace"), text)
        return text[1:] if text[:1] == " " else text


_HIGH = re.compile("[\udc80-\udcff]+")
_loaded: dict[tuple[str, str], Pieces] = {}


def pieces(path: str = MODEL, scores: str = "rank") -> Pieces:
    """The vocabulary, loaded once by each Python worker."""
    if (path, scores) not in _loaded:
        _loaded[path, scores] = Pieces(path, scores)
    return _loaded[path, scores]


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "piece_ids", path: str = MODEL, scores: str = "rank") -> DataFrame:
    """Adds the piece ids of each text, row by row; null and empty texts have an empty array. The path must exist on every executor."""
    kept = docs.drop(out_col)
    names = [*kept.columns, out_col]
    at = names.index(text_col)
    schema = added(kept, out_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path, scores)
        for batch in batches:
            for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [t or "" for t in some.column(at).to_pylist()]
                vocabulary.prepare(texts)
                found = [np.array(vocabulary.encode(t), np.int32) for t in texts]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.list_(pa.int32()))], names)
        vocabulary.forget()

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", path: str = MODEL, scores: str = "rank") -> DataFrame:
    """Adds the text of each array of piece ids; a null array gives an empty text."""

    @F.pandas_udf("string")
    def run(ids):
        vocabulary = pieces(path, scores)
        return ids.map(lambda x: vocabulary.decode([] if x is None else list(x)))

    return encoded.withColumn(out_col, run(ids_col))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, scores: str = "rank") -> DataFrame:
    """One row for each document: number of pieces and of byte pieces, digests of ids and decoded text, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path, scores)
        is_byte = np.zeros(len(vocabulary.text), bool)
        is_byte[list(vocabulary.byte_id.values())] = True
        for batch in (batch.slice(i, 500) for batch in batches for i in range(0, batch.num_rows, 500)):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vocabulary.prepare(texts)
            for text in texts:
                ids = vocabulary.encode(text)
                back = vocabulary.decode(ids)
                array = np.array(ids, "<i4")
                rows.append((len(ids), int(is_byte[array].sum()), hashlib.sha256(array.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"])
        vocabulary.forget()

    schema = f"{id_col} long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, schema)
