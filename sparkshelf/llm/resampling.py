"""Importance resampling towards a target distribution: hashed n-gram counts read off an Aho-Corasick dictionary of words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.operators.fusion import ranked_table

from .blocks import ALNUM, LOWER, Block, blocks

BUCKETS = 10_000
#: Words of a worker's dictionary, at most.
KEPT = 200_000
#: Every byte in lower case, and what isn't part of a word as a space.
PLAIN = np.where(ALNUM, LOWER, 0x20).astype(np.uint8).tobytes()
#: What CRC-32 divides by, bits reversed.
POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """The 32 columns of the map that 2**power zero bytes are to a CRC."""
    if power:
        last = list(_zeros(power - 1))
        return tuple(_times(last, c) for c in last)
    columns = [1 << i for i in range(32)]
    for _ in range(8):
        columns = [POLYNOMIAL ^ (c >> 1) if c & 1 else c >> 1 for c in columns]
    return tuple(columns)


def _shift_tables(size: int) -> np.ndarray:
    """Of each of a CRC's four bytes what its 256 values become behind `size` zero bytes."""
    columns, power = [1 << i for i in range(32)], 0
    while size:
        if size & 1:
            step = list(_zeros(power))
            columns = [_times(step, c) for c in columns]
        size, power = size >> 1, power + 1
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            half = 1 << bit
            out[byte, half : 2 * half] = out[byte, :half] ^ np.uint32(columns[8 * byte + bit])
    return out


#: Tables of common sizes; longer words have theirs made anew.
_short_tables = cache(_shift_tables)


def composed(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, from the CRCs of both halves and the right ones' sizes in bytes."""
    out = right.astype(np.uint32)
    order = np.argsort(sizes, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(sizes[order]) != 0)) if len(order) else []
    for a, z in zip(heads, [*heads[1:], len(order)], strict=True):
        at = order[a:z]
        size, x = int(sizes[at[0]]), left[at].astype(np.uint32)
        t = _short_tables(size) if size < 256 else _shift_tables(size)
        out[at] ^= t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


class Dictionary:
    """Distinct words, each between delimiters, in an Aho-Corasick automaton that tells their payloads: CRC and size in bytes.

    A worker learns words as it meets them. A word that the automaton doesn't hold yet leaves a gap
    between its matches, is looked up beside it and goes in when it is built again; that is each
    time the words have grown by a quarter. More than KEPT words are forgotten, so memory is bounded and no count changes.
    """

    def __init__(self, kept: int = KEPT):
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.crc, self.size = np.zeros(1024, np.uint32), np.zeros(1024, np.int64)
        self.automaton, self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0

    def number(self, word: bytes) -> int:
        n = self.numbers.setdefault(word, len(self.numbers))
        if n == len(self.numbers) - 1:
            if n >= len(self.crc):
                self.crc, self.size = np.resize(self.crc, 2 * n), np.resize(self.size, 2 * n)
            self.crc[n], self.size[n] = zlib.crc32(word), len(word)
        return n

    def build(self) -> None:
        for word in list(self.numbers)[self.built :]:
            self.automaton.add_word(f" {word.decode('latin-1')} ", self.numbers[word])
        self.built = len(self.numbers)
        self.automaton.make_automaton()

    def payloads(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC and size of every word of the block, and of each document its first word's index, with the number of words behind."""
        if len(self.numbers) > self.kept:
            self.clear()
        raw = block.data.tobytes().translate(PLAIN)
        bounds = block.offsets.tolist()
        joined = b" " + b" ".join([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) + b" "
        # one character a byte, so that places are the same in both
        data, text = np.frombuffer(joined, np.uint8), joined.decode("latin-1")
        space = data == 0x20
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        number = np.full(len(ends), -1, np.int64)
        if self.built:
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            number[np.searchsorted(ends, hits[:, 0])] = hits[:, 1]
        gaps = np.flatnonzero(number < 0)
        if len(gaps):
            starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            number[gaps] = [self.number(joined[a:z]) for a, z in zip(starts[gaps].tolist(), ends[gaps].tolist(), strict=True)]
            if 4 * (len(self.numbers) - self.built) > len(self.numbers):
                self.build()
        # document i begins behind i separators and the leading one
        begins = block.offsets + np.arange(1, len(bounds) + 1)
        return self.crc[number], self.size[number], np.searchsorted(ends, begins)


_dictionaries: dict[int, Dictionary] = {}


def _dictionary() -> Dictionary:
    """This worker's."""
    return _dictionaries.setdefault(KEPT, Dictionary(KEPT))


def features(crc: np.ndarray, size: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRC and document of all runs of 1 to `longest` words inside a document, joined by one space, by composing adjacent payloads."""
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run, space = crc, zlib.crc32(b" ")
    yield run, document
    for n in range(2, longest + 1):
        whole = len(crc) - n + 1
        if whole <= 0:
            return
        after = np.full(whole, space, np.uint32)
        run = composed(composed(run[:whole], after, np.ones(whole, np.int64)), crc[n - 1 :], size[n - 1 :])
        inside = document[:whole] == document[n - 1 :]
        yield run[inside], document[:whole][inside]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many of all texts' features each bucket has, repeats counted. Tasks count for themselves; only `buckets` sums meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = _dictionary(), np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch["text"]):
                for crc, _ in features(*held.payloads(block), longest):
                    out += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to raw share) of each bucket."""
    k, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + k) / ((x + 1.0) * (t + k)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document.

    Words are runs of digits, letters and non-ASCII characters, in lower case as far as they are
    ASCII. Features are all runs of 1 to `longest` words in a text, each in the bucket of its CRC-32;
    weight is the floored mean of their buckets' gains. Counts cover all texts of both tables. What
    meets in the driver and goes to all tasks is one number a bucket.
    Null texts and texts without words have no features and weight 0; repeated rows get a row each;
    no rows give no rows; other columns are left out.
    """
    sc = docs.sparkSession.sparkContext
    gains = sc.broadcast(bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _dictionary()
        for batch in batches:
            for block in blocks(batch["text"]):
                crc, size, first = held.payloads(block)
                n, sums = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
                for x, document in features(crc, size, first, longest):
                    n += np.bincount(document, minlength=len(block))
                    gain = np.append(0, np.cumsum(gains.value[x % np.uint32(buckets)]))
                    at = np.searchsorted(document, np.arange(len(block) + 1))
                    sums += gain[at[1:]] - gain[at[:-1]]
                columns = np.diff(first), n, sums // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][block.rows], *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    score is the weight plus Gumbel noise from the hash of seed and doc_id, in thousandths: the
    highest scores are a draw without replacement by weight. Of the documents with at least
    `least_words` words `percent` per cent, rounded down, are drawn; ties to the smaller doc_id, null
    first, and of repeated rows any. Ranks are dealt by ranges of scores, so no task sorts them all.
    """
    weighed = importance_weights(docs, target, buckets, longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    # numbered rows are cut off before ranges are sampled from them; the number parts repeated rows
    scored = cut(weighed.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()}))
    some = F.col("n_words") >= least_words
    most = percent * scored.where(some).count() // 100
    ranks = ranked_table(scored.where(some), 0, F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("row"))
    drawn = ranks.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") < most, F.col("rank").cast("long") + 1).alias("rank"))
    return drawn.unionByName(scored.where(~some).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """The documents drawn, with all their columns. Rows that share a doc_id are drawn together if one of them is."""
    chosen = resample(docs, target, percent, least_words, seed, buckets, longest).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["_drawn"]), "left_semi")
