"""Text of an Arrow batch as NumPy arrays: blocks of whole documents, words and their hashes.

All functions work on a bounded block (a few MB of text, or one longer document), so that
the memory of a Python worker doesn't depend on the size of a batch or of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = (1 << 20) - 1
BASE = 0x9E3779B97F4A7C15 | 1

#: Bytes of words between ASCII white space: everything but space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words made of digits, letters and whatever isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _series(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _series(BASE, size), _series(pow(BASE, -1, 1 << 64), size)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n-1; those of common sizes are kept."""
    if n > 1 << 22:
        return _powers.__wrapped__(n)
    p, q = _powers(1 << max(20, (n - 1).bit_length()))
    return p[:n], q[:n]


class Rolling:
    """Polynomial hashes of any span of an array, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        p, self.inverse = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, size: int) -> np.ndarray:
        """Of every span of this size."""
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def lanes(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """Of every byte, the eight bytes from there on as one number; zeros stand behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, kind, buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, not from sums of powers, for which words can be made that collide.

    Up to eight bytes the hash is a bijection of the bytes for each length; up to sixteen, two
    such are mixed; longer spans have eight bytes of BLAKE2b.
    """
    n = (ends - starts).astype(np.uint64)
    eight = lanes(data)
    left = lambda k: (np.uint64(8) - np.minimum(k, np.uint64(8))) * np.uint64(8)
    cut = lambda x, k: np.where(k > 0, x << left(k) % np.uint64(64) >> left(k) % np.uint64(64), np.uint64(0))
    h = mix(mix(cut(eight[starts], n)) + n * np.uint64(0x9FB21C651E98DF25))
    some = np.flatnonzero(n > 8)
    if len(some):
        h[some] = mix(h[some] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(cut(eight[starts[some] + 8], n[some] - np.uint64(8)) ^ np.uint64(0x165667B19E3779F9)))
    long = np.flatnonzero(n > 16)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        h[long] = np.frombuffer(b"".join(blake2b(view[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), "<u8")
    return h


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` consecutive hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
    return mix(out)


@dataclass
class Block:
    """Documents of a block. Document i is data[offsets[i]:offsets[i + 1]]; rows: where the block starts in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    rows: slice

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in order (null: empty), cut between documents; a longer document is a block of its own."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], slice(at, to))
        at = to


@dataclass
class Words:
    """starts, ends: of every word in the block's bytes; first: of every document, its first word's index, and the number of words at the end."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document's index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block, kind: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """The maximal runs of bytes that `kind` marks; they end with their document."""
    data, n = block.data, len(block.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = block.offsets[:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    ends = np.flatnonzero(inside[1:-1] & ~after) + 1
    first = np.searchsorted(starts, block.offsets)
    first[-1] = len(starts)
    hashes = span_hashes(LOWER[data] if lower else data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(starts, ends, first, hashes)


def inside_documents(first: np.ndarray, size: int) -> np.ndarray:
    """For each start of a window of `size` items that has room in the array: does it end in its own document?"""
    n = int(first[-1])
    room = max(0, n - size + 1)
    left = np.repeat(first[1:], np.diff(first))[:room] - np.arange(room)
    return left >= size


def sliding_argmin(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` hashes, the index of its smallest, the leftmost of equal ones, by their upper 32 bits whatever the array's length."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64)
    bits = np.uint64(32)
    keys = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < size:
        step = min(width, size - width)
        keys = np.minimum(keys[:-step], keys[step:])
        width += step
    return (keys & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
