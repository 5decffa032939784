"""Texts of a record batch as byte arrays, and hashes of words and windows over them, all in numpy.

Everything works on a block of whole texts laid end to end; a block is half a megabyte, or one text where that is
longer, so that a task's memory doesn't depend on the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BLOCK_BYTES = 1 << 19


class Block(NamedTuple):
    """Rows first..first+len(offsets)-2 of a batch: their bytes, and where each begins and the last ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """A null text is an empty one."""
    column = pc.fill_null(column, "")
    _, ends, content = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    steps = [np.full(size, b, U64) for b in (BASE, inverse)]
    for s in steps:
        s[:1] = 1
    return tuple(np.multiply.accumulate(s) for s in steps)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, int(size).bit_length()))
    return up[:size], down[:size]


@lru_cache(maxsize=8)
def byte_codes(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z have those of a-z."""
    codes = np.random.default_rng(seed).integers(0, 1 << 64, 256, U64)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


class Hasher:
    """Hashes of any stretch of a block: equal stretches have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray, seed: int = 1, lower: bool = False, codes: np.ndarray | None = None):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        values = byte_codes(seed, lower)[data] if codes is None else codes
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row of it the number of words before it (one more at the end)."""
    solid = ~_SPACE[block.data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = block.offsets[1:-1]
    inner = inner[inner < len(solid)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = inner[inner > 0] - 1
    last[cut] = solid[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, block.offsets, "left")


LONG_WORD = 32


def word_codes(block: Block, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    """A 64-bit code of each word; other seeds give independent ones.

    Sums modulo 2^64 fall together for some long patterned strings whatever the base, so words of over LONG_WORD
    bytes have a cryptographic digest instead.
    """
    codes = Hasher(block.data, seed, lower)(starts, ends)
    long_ = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long_):
        salt = seed.to_bytes(8, "little")
        parts = (block.data[starts[i] : ends[i]].tobytes() for i in long_)
        codes[long_] = np.frombuffer(b"".join(hashlib.blake2b(p.lower() if lower else p, digest_size=8, salt=salt).digest() for p in parts), U64)
    return codes
