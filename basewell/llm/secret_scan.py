"""Secret scans: keyword automaton first, anchored expressions near its hits, then embedded checksums.

One Aho-Corasick automaton per task finds every keyword of every kind in one pass over the text's bytes. An
expression runs only where one of its keywords was found, anchored there, so a text without keywords costs one
pass. Long hexadecimal runs have no keyword; their own expression, a single character class, is the scan.

Kinds ``assign``, ``access`` and ``hex`` match by form alone. The further kinds are formats that embed a checksum,
and count only where it holds: prefixed access tokens whose last six base-62 digits are the CRC-32 of the thirty
before them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewell.llm.common import added

#: Kinds in their order, their keywords (lower case) and the expression anchored at a keyword.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """Six base-62 digits of the body's CRC-32."""
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.encode()


def _checked(found: re.Match[bytes]) -> bool:
    return base62_crc(found[1]) == found[2]


#: Kind: expression, and what a match must also meet. A match that fails this still ends the search before it.
RULES = {
    "assign": (ASSIGN, lambda m: m.end(2) - m.start(2) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "github": (GITHUB, _checked),
    "npm": (NPM, _checked),
}


def automaton() -> ahocorasick.Automaton:
    keywords = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            keywords.add_word(word, (kind, len(word)))
    keywords.make_automaton()
    return keywords


def find_secrets(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed in KINDS; end is exclusive."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    spans, over = [], dict.fromkeys(RULES, 0)
    hits = [(end + 1 - size, kind) for end, (kind, size) in keywords.iter(data.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < over[kind]:
            continue
        rule, holds = RULES[kind]
        if found := rule.match(data, start):
            over[kind] = found.end()
            if holds(found):
                spans.append((start, KINDS.index(kind), found.end()))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(data)]
    spans.sort()
    if spans and not text.isascii():
        points, at, done = {}, 0, 0
        for offset in sorted({x for start, _, end in spans for x in (start, end)}):
            at += len(data[done:offset].decode("utf-8", "surrogatepass"))
            points[offset], done = at, offset
        spans = [(points[start], kind, points[end]) for start, kind, end in spans]
    return [(KINDS[kind], start, end) for start, kind, end in spans]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``secrets``, an array of (kind, start, end) for each row; a null or empty text has none.

    Works row by row without a shuffle. Ties (several kinds at one start) come in the order of KINDS; other columns
    pass through, but an own column named ``secrets`` is replaced.
    """
    kept = docs.drop("secrets")
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = added(kept, "secrets", T.ArrayType(span))
    item = pa.struct([pa.field("kind", pa.string()), pa.field("start", pa.int64()), pa.field("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t.as_py(), keywords)] for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(item))], [*batch.schema.names, "secrets"])

    return kept.mapInArrow(run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts by base kind, a digest of the base spans, and all spans as text."""
    out = f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = find_secrets(text.as_py(), keywords)
                base = [s for s in spans if s[0] in KINDS[:3]]
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
                rows.append((*n[:3], digest, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), sum(n[3:])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, out)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces every secret in the text by a mark; overlapping spans become one. Nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            at, texts = batch.schema.names.index(text_col), []
            for cell in batch.column(at):
                text = cell.as_py()
                parts, done = [], 0
                for _, start, end in find_secrets(text, keywords):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                texts.append("".join(parts) + text[done:] if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
