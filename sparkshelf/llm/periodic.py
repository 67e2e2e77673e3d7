"""Runs (maximal periodic stretches) of words, found in an enhanced suffix array by the branching-tandem test."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACED, Words, blocks, chained, inside_documents, mix, words

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
#: Shortest run, in words.
LEAST = 12


@dataclass
class Suffixes:
    """The enhanced suffix array of several documents, none of whose suffixes is like another document's.

    array: places in order; inverse: each place's slot in it; lcp[i]: symbols that slots i - 1 and i
    share. levels[k]: of each place a number of its next 2**k symbols; equal numbers mean equal
    symbols inside one document. begin, end: of each place its document's bounds.
    """

    array: np.ndarray
    inverse: np.ndarray
    lcp: np.ndarray
    levels: list[np.ndarray]
    begin: np.ndarray
    end: np.ndarray


def suffix_array(symbols: np.ndarray, first: np.ndarray) -> Suffixes:
    """By prefix doubling. symbols: of all documents in turn; document i has first[i] to first[i + 1]. Symbols of two documents never count as equal."""
    n, counts = len(symbols), np.diff(first)
    place = np.arange(n)
    begin, end = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    document = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((symbols, document))
    new = np.ones(n, bool)
    new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (document[order[1:]] != document[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(new) - 1
    levels, width = [rank], 1
    while n and not new.all():
        after = place + width
        inside = after < end
        follow = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank.astype(np.int64) * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new) - 1
        levels.append(rank)
        width *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = place
    out = Suffixes(order, inverse, np.zeros(n, np.int64), levels, begin, end)
    if n:
        out.lcp[1:] = extend(out, order[:-1], order[1:])
    return out


def extend(s: Suffixes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at the places a and b share, by descent through the levels. Both of a pair are different places."""
    out, top = np.zeros(len(a), np.int64), len(s.array) - 1
    for k in range(len(s.levels) - 1, -1, -1):
        x, y = a + out, b + out
        more = (x < s.end[a]) & (y < s.end[b])
        more &= s.levels[k][np.minimum(x, top)] == s.levels[k][np.minimum(y, top)]
        out += more.astype(np.int64) << k
    return out


def extend_left(s: Suffixes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before the places a < b, of one document, are equal."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(s.levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        more = x >= s.begin[a]
        more &= s.levels[k][np.maximum(x, 0)] == s.levels[k][np.maximum(y, 0)]
        out += more.astype(np.int64) << k
    return out


def intervals(lcp: np.ndarray) -> np.ndarray:
    """Rows (depth, low, high, child_low, child_high) of all LCP intervals of depth 1 or more with the slots of their largest child; bottom-up by a stack, without tree nodes.

    A child is a deeper interval or a single slot.
    """
    n, out = len(lcp), []
    # an open interval: depth, first slot, first slot of its last child, largest child so far
    stack: list[list[int]] = []
    values = lcp.tolist()
    values.append(0)
    for i in range(1, n + 1):
        depth, start = values[i], i - 1
        while stack and stack[-1][0] > depth:
            d, low, child, a, b = stack.pop()
            if i - 1 - child > b - a:
                a, b = child, i - 1
            out.append((d, low, i - 1, a, b))
            start = low
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            if i - 1 - top[2] > top[4] - top[3]:
                top[3], top[4] = top[2], i - 1
            top[2] = i
        elif depth:
            # its first child reaches from the start of what has just been closed, or is slot i - 1
            stack.append([depth, start, i, start, i - 1])
    return np.array(out, np.int64).reshape(-1, 5)


def tandems(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Branching squares as (place, period): the two halves are equal and the symbols behind them aren't.

    In an LCP interval of depth d the suffixes of all children but the largest are asked whether
    the suffix d places on, or d places back, has its slot in the interval but in another child.
    Each suffix is asked in log(n) intervals at most.
    """
    found = intervals(s.lcp)
    depth, low, high, a, b = found.T
    sizes = (high - low) - (b - a)
    of = np.repeat(np.arange(len(found)), sizes)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = low[of] + inner
    slot = np.where(slot >= a[of], slot + (b - a + 1)[of], slot)
    here, d = s.array[slot], depth[of]
    lower, upper, n = low[of], high[of], len(s.array)
    places, periods = [], []
    for step in (1, -1):
        there = here + step * d
        fine = (there >= s.begin[here]) & (there < s.end[here])
        other = s.inverse[np.clip(there, 0, max(n - 1, 0))]
        fine &= (other >= lower) & (other <= upper)
        x, y = np.minimum(here, there)[fine], d[fine]
        places.append(x)
        periods.append(y)
    place, period = np.concatenate(places), np.concatenate(periods)
    # equal for just one period: those of one child go on and are found where they branch
    some = extend(s, place, place + period) == period
    return place[some], period[some]


@dataclass
class Runs:
    """Runs of several documents by document, start and period; start counts from the document's first word."""

    document: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(found: Words, least: int = LEAST) -> Runs:
    """All runs of at least max(least, 2 * period) words.

    A run repeats (least + 1) // 2 words or more at its period's distance. So documents without any
    such repeated stretch of words have none, and no suffix array.
    """
    size = max(1, (least + 1) // 2)
    none = np.zeros(0, np.int64)
    whole = np.flatnonzero(inside_documents(found.first, size))
    if not len(whole):
        return Runs(none, none, none, none)
    document = found.documents()
    with np.errstate(over="ignore"):
        keys = mix(chained(found.hashes, size)[whole] + document[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    some = np.unique(document[whole[order[1:][same]]])
    if not len(some):
        return Runs(none, none, none, none)
    counts = found.counts[some]
    first = np.append(0, np.cumsum(counts))
    at = np.arange(first[-1]) - np.repeat(first[:-1] - found.first[some], counts)
    s = suffix_array(found.hashes[at], first)
    place, period = tandems(s)
    # rotations to the left: all squares of a run come of the one at its end
    start = place - extend_left(s, place, place + period)
    end = place + 2 * period
    fine = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[fine], end[fine], period[fine]
    # a run has its multiples' squares, too: of one stretch the smallest period counts
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    which = np.searchsorted(first, start, "right") - 1
    return Runs(some[which], start - first[which], end - start, period)


def _search(least: int, collapse: bool):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                found = words(block, SPACED)
                runs = find_runs(found, least)
                n, counts = len(block), found.counts
                offsets = np.searchsorted(runs.document, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (runs.start, runs.length, runs.period)], fields=list(kind)))
                edges = np.zeros(len(found.starts) + 1, np.int64)
                at = found.first[runs.document] + runs.start
                np.add.at(edges, at + runs.period, 1)
                np.add.at(edges, at + runs.length, -1)
                kept = np.cumsum(edges)[:-1] == 0
                texts = _joined(block.data, found, kept) if collapse else pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"][block.rows], pa.array(counts, pa.int64()), lists, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return search


def _joined(data: np.ndarray, found: Words, kept: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    sizes = np.where(kept, found.ends - found.starts + 1, 0)  # with the space behind
    total = np.append(0, np.cumsum(sizes))
    out = np.full(int(total[-1]), 0x20, np.uint8)
    inner = np.arange(int(total[-1])) - np.repeat(total[:-1], sizes)
    source = np.repeat(found.starts, sizes) + inner
    letter = inner < np.repeat(found.ends - found.starts, sizes)
    out[letter] = data[source[letter]]
    bounds, raw = total[found.first], out.tobytes()
    return pa.array([raw[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()).cast(pa.string(), safe=False)


def periodic_runs(docs: DataFrame, least: int = LEAST, collapse: bool = True) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, in words from 0, by start and period) and collapsed of every document.

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period
    q and at least max(least, 2 * q) words that no neighbouring word extends; collapsed holds the
    words, joined by one space, that no run has after its first q (null without `collapse`).

    Documents are searched where they are read, a bounded block of them, or one longer document, at
    a time; nothing is shuffled. Null, empty and blank texts have no words and no runs; repeated rows get a row each,
    with the doc_id they have; no rows give no rows; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(least, collapse), SCHEMA)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents, about one in ten of which has its words repeat from some place on, by crc32 of the doc_id: known cases beside a corpus's own.

    With h that number, g = floor(h / 10) and n words, where h % 10 = 0 each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those
    without doc_id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (h % 10 == 0).alias("_hit"), g.alias("_g"))
    # only a hit's words are spelled out
    split = F.when(F.col("_hit"), F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    held = held.withColumn("_words", split).withColumn("_n", F.size("_words"))
    some = F.coalesce(F.col("_hit") & (F.col("_n") > 0), F.lit(False))
    held = held.withColumn("_a", F.when(some, F.pmod("_g", F.col("_n"))).cast("int"))
    held = held.withColumn("_p", F.when(some, 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    moved = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get(F.col("_words"), place(i))), " ")
    return held.select("doc_id", F.when(some, moved).otherwise(F.col("text")).alias("text"))


def runs_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """periodic_runs() as digests: n_runs; start, length, period and exponent_milli of the longest run (ties: the smallest start, then period; null without runs); runs_sha256 of all runs' lines and collapsed_sha256."""
    found = periodic_runs(docs, least)
    # of the largest (length, -start, -period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    named = found.withColumn("_best", best)
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
