"""MinHash near-dedup: an inverted join of signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .blocks import SPACED, Block, blocks, chained, inside_documents, mix, words

from .graph import connected_components
from .groups import Linked, large_star_groups, star_groups

#: Coordinates of a signature, and those of them that are posted.
COORDINATES, POSTED = 48, 20
#: Odds below which a count of equal coordinates is taken to rule out a similarity at the threshold.
MISS = 1e-8
LIST_ROWS, GROUP_ROWS = 4_096, 2_048

SEEDS = mix(np.arange(1, 1 + COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLIERS = mix(SEEDS) | np.uint64(1)


def least_matches(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The largest t such that sets of this similarity agree on fewer than t coordinates with odds of at most `miss`."""
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return t


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document's runs of `size` words (of all its words, if fewer), in order, and where each document's start."""
    found = words(block, SPACED, lower=True)
    n = len(found.hashes)
    whole = np.flatnonzero(inside_documents(found.first, size))
    hashes, documents = [chained(found.hashes, size)[whole]], [np.searchsorted(found.first, whole, "right") - 1]
    for k in range(1, size):
        short = np.flatnonzero(found.counts == k)
        if len(short):
            hashes.append(chained(found.hashes, k)[found.first[short]] if n >= k else np.zeros(0, np.uint64))
            documents.append(short)
    h, d = np.concatenate(hashes), np.concatenate(documents)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(block) + 1))


def fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each non-empty set, which don't depend on its order."""
    return tuple(np.add.reduceat(mix(h ^ np.uint64(s)), at).view(np.int64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _signatures(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                h, bounds = shingle_sets(block, size)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                one, two = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                lists = np.zeros((len(some), COORDINATES), np.int32)
                if len(some):
                    at = bounds[:-1][some]
                    one[some], two[some] = fingerprints(h, at)
                    for c in range(COORDINATES):
                        lists[:, c] = (np.minimum.reduceat((h ^ SEEDS[c]) * MULTIPLIERS[c], at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                offsets = np.append(0, np.cumsum(np.where(n > 0, COORDINATES, 0)))
                signature = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][block.rows], batch["text_hash"][block.rows], pa.array(n, pa.int64()), pa.array(one), pa.array(two), signature], names=["doc_id", "text_hash", "n", "one", "two", "signature"])

    return sign


def _agree(similarity: float):
    """Rows of a posting list that agree on enough coordinates of their signatures."""
    least = least_matches(COORDINATES, similarity)

    def make(group: pa.RecordBatch) -> Linked:
        signature, n = group["signature"].flatten().to_numpy().reshape(-1, COORDINATES), group["n"].to_numpy()

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            near = (signature[rest] == signature[i]).sum(axis=1) >= least
            return near & (np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1e-9)

        return linked

    return make


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                h, bounds = shingle_sets(block, size)
                part = batch.slice(block.rows.start, len(block))
                n, data = np.diff(bounds), h.tobytes()
                one = np.zeros(len(n), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    one[some] = fingerprints(h, bounds[:-1][some])[0]
                same = pa.array(one == part["one"].to_numpy())
                values = pa.array([data[8 * x : 8 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["key"], part["rep"], part["size"], values], names=["key", "rep", "size", "shingles"]).filter(same)

    return sets


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's n members, first in an order that all sets share, hold one of any set that links with it."""
    return n - -(-percent * n // 100) + 1


class _Postings:
    """Links of one set with many. Two linked sets share one of the rarest members of either: an inverted index of these tells which sets may link, and few such are compared one by one.

    Of many the intersections are counted in an inverted index of all members of the sets that are left.
    """

    FEW = 32

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(s) for s in sets])
        _, back = np.unique(np.concatenate(sets), return_inverse=True)
        back = back.reshape(-1)
        self.size = int(back.max()) + 1 if len(back) else 0
        self.sets = np.split(back, np.cumsum(self.n)[:-1])
        often = np.bincount(back, minlength=self.size)
        self.rare = [s[np.lexsort((s, often[s]))[: prefix_size(len(s), percent)]] for s in self.sets]
        self.rare_rows, self.rare_bounds = self._inverted(np.arange(len(sets)), self.rare)
        self.held = len(sets)
        self.rows: np.ndarray | None = None

    def _inverted(self, rows: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([lists[i] for i in rows])
        order = np.argsort(flat, kind="stable")
        return np.repeat(rows, [len(lists[i]) for i in rows])[order], np.searchsorted(flat[order], np.arange(self.size + 1))

    @staticmethod
    def _met(s: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        a = bounds[s]
        n = bounds[s + 1] - a
        return rows[np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]

    def linked(self, i: int, rest: np.ndarray) -> np.ndarray:
        maybe = np.zeros(len(self.n), bool)
        maybe[self._met(self.rare[i], self.rare_rows, self.rare_bounds)] = True
        out, some = np.zeros(len(rest), bool), np.flatnonzero(maybe[rest])
        if not len(some):
            return out
        s, j = self.sets[i], rest[some]
        if len(some) <= self.FEW:
            both = np.array([np.isin(self.sets[k], s, assume_unique=True).sum() for k in j.tolist()])
        else:
            if self.rows is None or len(rest) < self.held // 2:
                self.rows, self.bounds = self._inverted(rest, self.sets)
                self.held = len(rest)
            both = np.bincount(self._met(s, self.rows, self.bounds), minlength=len(self.n))[j]
        out[some] = 100 * both >= self.percent * (self.n[i] + self.n[j] - both)
        return out


def _confirmed(percent: int):
    """Candidates that link on their full sets."""

    def make(group: pa.RecordBatch) -> Linked:
        return _Postings([np.frombuffer(b.as_py(), np.uint64) for b in group["shingles"]], percent).linked

    return make


def _rarest(percent: int):
    """Shingles of which linked sets share one: the first of each set, those last that several pivots have, as they may be all pages' of one template."""

    def rarest(group: pa.RecordBatch, pivots: np.ndarray) -> list[np.ndarray]:
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in group["shingles"]]
        values, counts = np.unique(np.concatenate([sets[i] for i in pivots.tolist()]), return_counts=True)
        common = values[counts > 1]
        out = []
        for s in sets:
            last = np.isin(s, common, assume_unique=True)
            out.append(np.concatenate([s[~last], s[last]])[: prefix_size(len(s), percent)].view(np.int64))
        return out

    return rarest


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, list_rows: int = LIST_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents link where 100 * intersection >= percent * union of their sets of `size`-word
    shingles (lower-cased words between ASCII white space; of fewer words, all as one shingle);
    component_id is the smallest doc_id reachable, and that document is kept.

    Documents with equal sets are one class, whose smallest doc_id stands for it. A class posts the
    POSTED first coordinates of its MinHash signature, as (coordinate, value), to an inverted index
    with the prefix rule: of coordinates in the order of their lists' lengths, only the rarest can
    be needed for two classes to agree on enough. The merge skips the longer lists: rows that meet
    in a list have their collisions in all others counted by looking into the signatures they carry,
    and those that agree on enough for the threshold, at odds of MISS to lose one, are held together. Such groups of candidates meet once
    more with their full sets, which decide every link; a row goes on being compared until it
    belongs to a component, and pairs are never emitted. Lists of more than list_rows and groups of
    more than group_rows are contracted by pivots first and then compared in blocks (groups.py), of a group
    only those that share one of their rarest shingles, as linked sets do: pages of one template, alike without a link, don't meet.

    Null, empty and blank texts have empty sets and link with nothing, as rows without doc_id do
    (their component_id is null and they are kept). Repeated rows link with each other; rows that share a doc_id and have unlike
    texts have a component each. No rows
    give no rows; other columns are left out.
    """
    similarity = percent / 100
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    signed = cut(rows.mapInArrow(_signatures(size), "doc_id long, text_hash long, n long, one long, two long, signature array<int>"))
    some = signed.where("n > 0 and doc_id is not null")
    classes = some.groupBy("one", "two", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("signature").alias("signature"))
    classes = cut(classes.select("one", "two", "n", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("text_hash"), "signature"))
    # a class goes by its smallest doc_id, or by a number where others share one
    shared = not classes.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    classes = classes.withColumn("rep", F.monotonically_increasing_id() if shared else F.col("least"))
    tokens = classes.select("rep", F.posexplode(F.slice("signature", 1, POSTED)).alias("c", "value")).select("rep", F.xxhash64("c", "value").alias("token"))
    lengths = cut(tokens.groupBy("token").agg(F.count("*").alias("length")).where("length > 1"))
    posted = tokens.join(lengths, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("length", "token"))).alias("tokens"))
    prefix = POSTED - least_matches(POSTED, similarity) + 1
    posted = posted.select("rep", F.explode(F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - (POSTED - prefix)))).alias("t")).select("rep", F.col("t.token").alias("key"), F.col("t.length").alias("size"))
    hot = not lengths.where(F.col("length") > list_rows).isEmpty()
    posted = cut(posted) if hot else posted
    signatures = classes.select("rep", "n", "signature")
    lists = posted.where(F.col("size") <= list_rows).join(signatures, "rep").select("key", "rep", "n", "signature")
    near = star_groups(lists, ["key"], _agree(similarity))
    if hot:
        near = near.unionByName(large_star_groups(posted.where(F.col("size") > list_rows).join(signatures, "rep"), list_rows, _agree(similarity)))
    loose = cut(connected_components(near).select(F.col("node").alias("rep"), F.col("component").alias("key")))
    sizes = loose.groupBy("key").agg(F.count("*").alias("size"))
    groups = loose.join(sizes, "key").join(classes.select("rep", F.col("least").alias("doc_id"), "text_hash", "one"), "rep")
    sets = rows.join(groups, ["doc_id", "text_hash"]).select("key", "rep", "size", "one", "text").mapInArrow(_sets(size), "key long, rep long, size long, shingles binary")
    # rows that share the doc_id may have equal sets, too
    if (sizes.agg(F.max("size")).first()[0] or 0) > group_rows:
        sets = cut(sets)
        large = sets.where(F.col("size") > group_rows).dropDuplicates(["key", "rep"])
        exact = star_groups(sets.where(F.col("size") <= group_rows), ["key"], _confirmed(percent)).unionByName(large_star_groups(large, group_rows, _confirmed(percent), _rarest(percent)))
    else:
        exact = star_groups(sets, ["key"], _confirmed(percent))
    exact = connected_components(exact).withColumnRenamed("node", "rep")
    if shared:  # the smallest number need not be the smallest doc_id's
        exact = exact.join(classes.select("rep", "least"), "rep")
        lowest = exact.groupBy("component").agg(F.min("least").alias("lowest"))
        exact = exact.select("rep", "component").join(lowest, "component").select("rep", F.col("lowest").alias("component"))
    found = classes.join(exact, "rep", "left").select("one", "two", "n", F.coalesce("component", "least").alias("component"))
    linked = signed.drop("signature").join(found, ["one", "two", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which one of each component stays: that of the smallest doc_id.

    Rows that share a doc_id are documents of their own where their texts differ; of rows that share
    both, one may stay. Documents without doc_id, or without words, are like nothing and stay.
    """
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = cut(held.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")))
    if repeated.isEmpty():
        kept = near_duplicates(held.select("doc_id", "text"), size, percent).where("kept and doc_id is not null").select("doc_id")
        return held.join(kept, "doc_id").select("row.*").unionByName(held.where("doc_id is null").select("row.*"))
    # a repeated doc_id can't name a document: a hash of it and the text does
    named = held.where("doc_id is not null").join(repeated, "doc_id", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    found = near_duplicates(named.select(F.col("node").alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("node"), "component_id").distinct()
    lead = found.join(named.select("node", "doc_id").distinct(), "node").groupBy("component_id").agg(F.min_by("node", F.struct("doc_id", "node")).alias("node")).select("node")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("row")))
    kept = named.join(lead, "node").withColumn("place", place).where("place = 1")
    return kept.select("row.*").unionByName(held.where("doc_id is null").select("row.*"))
