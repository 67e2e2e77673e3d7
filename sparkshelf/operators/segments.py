"""A full-text index kept by changes: immutable segments, tombstones of documents, and merges of segments of like size."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.functions import text
from sparkshelf.operators import fts

#: Segments of one size class that are merged, the postings of the smallest class, and the share of dead documents from which a segment is written anew.
FANOUT, SMALLEST, MOST_DEAD = 4, 100_000, 0.25
#: Keys of changed documents that are sent to all tasks, at most.
FEW = 500_000


@dataclass(frozen=True)
class Segment:
    """Documents indexed at a refresh. number: that refresh's; dead: how many of them a later tombstone covers, and dead_tokens their tokens; purged: the last refresh whose tombstones are no longer needed for it."""

    folder: str
    number: int
    documents: int
    tokens: int
    postings: int
    dead: int = 0
    dead_tokens: int = 0
    purged: int = 0


@dataclass(frozen=True)
class Layout:
    """What an index consists of. tombstones: (folder, number) of (doc_pk) that are dead in segments of a smaller number."""

    stemmed: bool = True
    segments: tuple[Segment, ...] = ()
    tombstones: tuple[tuple[str, int], ...] = ()

    def note(self) -> dict:
        return {"stemmed": self.stemmed, "segments": [asdict(s) for s in self.segments], "tombstones": [list(t) for t in self.tombstones], "folders": [s.folder for s in self.segments] + [f for f, _ in self.tombstones]}

    @staticmethod
    def of(note: dict | None, stemmed: bool = True) -> Layout:
        if not note:
            return Layout(stemmed)
        return Layout(note["stemmed"], tuple(Segment(**s) for s in note["segments"]), tuple((f, n) for f, n in note["tombstones"]))

    @property
    def last(self) -> int:
        return max([s.number for s in self.segments] + [n for _, n in self.tombstones], default=0)


class SegmentedIndex(fts.Index):
    """An index of segments, read as one: rows of dead documents are left out, sizes of the corpus are sums kept with the segments. at: from a folder's name to its path."""

    def __init__(self, spark: SparkSession, layout: Layout, at: Callable[[str], str]):
        self.spark, self.layout, self.at, self.stemmed = spark, layout, at, layout.stemmed
        self.parts = [(s, fts.open_index(spark, at(s.folder), layout.stemmed)) for s in layout.segments]

    @property
    def totals(self) -> DataFrame:
        n = sum(s.documents - s.dead for s in self.layout.segments)
        tokens = sum(s.tokens - s.dead_tokens for s in self.layout.segments)
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(tokens / n if n else None).cast("double").alias("avgdl"))

    def dead(self) -> DataFrame | None:
        """(doc_pk, dead_before): the number of the last tombstone."""
        rows = None
        for folder, number in self.layout.tombstones:
            own = self.spark.read.schema("doc_pk long").parquet(self.at(folder)).select("doc_pk", F.lit(number).alias("dead_before"))
            rows = own if rows is None else rows.unionByName(own)
        return rows if rows is None else rows.groupBy("doc_pk").agg(F.max("dead_before").alias("dead_before"))

    def live(self, read: Callable[[fts.StoredIndex], DataFrame], of: tuple[Segment, ...] | None = None) -> DataFrame | None:
        """What `read` gives of each segment, (doc_pk, ...), without dead documents, with the segment's number."""
        rows, late = None, False
        for segment, index in self.parts:
            if of is None or segment in of:
                own = read(index).withColumn("segment", F.lit(segment.number))
                rows = own if rows is None else rows.unionByName(own)
                late = late or bool(segment.dead)
        dead = self.dead() if late else None
        if rows is None or dead is None:
            return rows
        return rows.join(dead, "doc_pk", "left").where(F.col("dead_before").isNull() | (F.col("segment") >= F.col("dead_before"))).drop("dead_before")

    def _plain(self, read: Callable[[fts.StoredIndex], DataFrame], schema: str) -> DataFrame:
        rows = self.live(read)
        return self.spark.createDataFrame([], schema) if rows is None else rows.drop("segment")

    @property
    def postings(self) -> DataFrame:
        return self._plain(lambda i: i.postings, fts.POSTINGS)

    @property
    def documents(self) -> DataFrame:
        return self._plain(lambda i: i.documents, fts.DOCUMENTS)

    def read(self, exact: list[str], prefixes: list[str]) -> DataFrame:
        """All directories are asked at once."""
        directory, parts = None, {}
        for segment, index in self.parts:
            own = index.directory.withColumn("segment", F.lit(segment.number))
            directory = own if directory is None else directory.unionByName(own)
        if directory is not None:
            for row in directory.where(fts.may_hold(exact, prefixes)).select("segment", "part").collect():
                parts.setdefault(row.segment, []).append(row.part)
        held = {id(index): parts.get(segment.number, []) for segment, index in self.parts}
        return self._plain(lambda i: i.read(exact, prefixes, sorted(held[id(i)])), fts.POSTINGS)

    def read_terms(self, terms: DataFrame) -> DataFrame:
        return self._plain(lambda i: i.read_terms(terms), fts.POSTINGS)


def _written(spark: SparkSession, index: fts.Index, folder: str, path: str, number: int, purged: int) -> Segment:
    fts.write_index(index, path)
    sizes = spark.read.parquet(f"{path}/documents").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n = spark.read.parquet(f"{path}/directory").agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    return Segment(folder, number, sizes[0], sizes[1], n, purged=purged)


def refreshed(spark: SparkSession, layout: Layout, corpus: DataFrame, at: Callable[[str], str], new_folder: Callable[[], str], some: Callable[[Column], DataFrame] | None = None) -> Layout:
    """The layout after the corpus (doc_pk, collection, path, title, body, hash) has changed; the same if it hasn't.

    Documents are compared by key, title and hash; only those that are new or differ have their bodies
    read and indexed, as a new segment, and those that are gone or differ get a tombstone. Segments of
    one size class are merged when there are FANOUT of them, so that a posting is written again about
    log(corpus) times. Folders that aren't used any more stay for those who read older layouts.
    some: gives the corpus's few rows for which a condition on doc_pk holds, where that costs less than to filter the corpus.
    """
    index = SegmentedIndex(spark, layout, at)
    held = index.live(lambda i: i.documents)
    number = layout.last + 1
    if held is None and corpus.isEmpty():
        return layout
    if held is None:
        built = _written(spark, fts.build_index(corpus, layout.stemmed, some), folder := new_folder(), at(folder), number, number)
        return Layout(layout.stemmed, (built,), layout.tombstones)
    # a title may be as long as its body: digests meet in its place
    title = text.content_hash(F.col("title"))
    now = corpus.select("doc_pk", title.alias("n_title"), F.col("hash").alias("n_hash"), F.lit(True).alias("there"))
    both = held.select("doc_pk", title.alias("title"), "hash", "dl", "segment").join(now, "doc_pk", "full_outer")
    differs = F.col("segment").isNull() | F.col("there").isNull() | ~F.col("title").eqNullSafe(F.col("n_title")) | ~F.col("hash").eqNullSafe(F.col("n_hash"))
    changes = cut(both.where(differs).select("doc_pk", "dl", "segment", F.col("there").isNotNull().alias("there")))
    counts = {r.segment: r for r in changes.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.sum(F.col("there").cast("int")).alias("there")).collect()}
    if not counts:
        return layout
    segments = [s if s.number not in counts else Segment(**asdict(s) | {"dead": s.dead + counts[s.number].n, "dead_tokens": s.dead_tokens + counts[s.number].tokens}) for s in layout.segments]
    tombstones = list(layout.tombstones)
    if any(k is not None for k in counts):
        folder = new_folder()
        changes.where("segment is not null").select("doc_pk").write.parquet(at(folder))
        tombstones.append((folder, number))
    if any(r.there for r in counts.values()):
        keys = changes.where("there").select("doc_pk")
        # bodies of the rest don't travel where the keys of the changes may
        fresh = corpus.join(F.broadcast(keys) if sum(r.there or 0 for r in counts.values()) <= FEW else keys, "doc_pk", "left_semi")
        segments.append(_written(spark, fts.build_index(fresh, layout.stemmed), folder := new_folder(), at(folder), number, number))
    return merged(spark, Layout(layout.stemmed, tuple(segments), tuple(tombstones)), at, new_folder)


def size_class(postings: int) -> int:
    return max(0, math.ceil(math.log(max(1, postings) / SMALLEST, FANOUT)))


def merged(spark: SparkSession, layout: Layout, at: Callable[[str], str], new_folder: Callable[[], str]) -> Layout:
    """The layout after due merges: of FANOUT segments of a size class, and of a segment of which many documents are dead. Tombstones that no segment needs go."""
    while True:
        due = [s for s in layout.segments if s.dead > MOST_DEAD * s.documents][:1]
        for c in {size_class(s.postings) for s in layout.segments}:
            same = [s for s in layout.segments if size_class(s.postings) == c]
            if not due and len(same) >= FANOUT:
                due = same
        if not due:
            break
        index = SegmentedIndex(spark, layout, at)
        rows = lambda read: index.live(read, tuple(due)).drop("segment")  # noqa: B023, E731
        documents = rows(lambda i: i.documents)
        both = fts.Index(rows(lambda i: i.postings), documents, documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), layout.stemmed)
        rest = tuple(s for s in layout.segments if s not in due)
        if any(s.dead < s.documents for s in due):
            # a later tombstone has a larger number than any segment now
            rest += (_written(spark, both, folder := new_folder(), at(folder), max(s.number for s in due), layout.last),)
        layout = Layout(layout.stemmed, tuple(sorted(rest, key=lambda s: s.number)), layout.tombstones)
    needed = tuple(t for t in layout.tombstones if any(s.number < t[1] and s.purged < t[1] for s in layout.segments))
    return Layout(layout.stemmed, layout.segments, needed)
