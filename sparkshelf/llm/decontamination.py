"""Benchmark decontamination: test suffixes searched by bisection in the suffix arrays of training shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .blocks import ALNUM, Block, blocks, chained, words
from .groups import free_names

MATCHES = "array<struct<item_id:long,doc_start:long,item_start:long,n_words:long>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, matches {MATCHES}"
#: Bytes of test items that are broadcast at once; larger test sets are searched in that many parts.
PART_BYTES = 16 << 20


@dataclass
class Windows:
    """Distinct test windows of one size in the order of their opening words' hash. first: a suffix that opens each; members[bounds[i]:bounds[i + 1]]: all that do; opens: distinct opening hashes, of which opens[k] has the windows held[k]:held[k + 1]."""

    size: int
    first: np.ndarray
    members: np.ndarray
    bounds: np.ndarray
    opens: np.ndarray
    held: np.ndarray


@dataclass
class Suffixes:
    """Test suffixes that open a window. symbols: word hashes of all items; size: the window's words."""

    symbols: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    windows: list[Windows]


OPENING = 2


def test_suffixes(items: list[tuple[int, str]], window: int) -> Suffixes:
    """Each position of an item with a whole window ahead; an item of fewer words has one window, an empty one none."""
    items = [(i, t) for i, t in items if i is not None and t]
    symbols, start, size, item, offset, base = [np.zeros(0, np.uint64)], [], [], [], [], 0
    ids = np.array([i for i, _ in items], np.int64)
    for block in blocks(pa.array([t for _, t in items], pa.large_string())):
        found = words(block, ALNUM, lower=True)
        for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
            n = max(int(b > a), b - a - window + 1)
            start.append(base + a + np.arange(n))
            size.append(np.full(n, min(window, b - a)))
            item.append(np.full(n, ids[block.rows.start + i]))
            offset.append(np.arange(n))
        symbols.append(found.hashes)
        base += len(found.hashes)
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
    out = Suffixes(np.concatenate([*symbols, np.zeros(window, np.uint64)]), flat(start), flat(size), flat(item), flat(offset), [])
    for k in np.unique(out.size).tolist():
        own = np.flatnonzero(out.size == k)
        keys = out.symbols[out.start[own][:, None] + np.arange(k)]
        opening = chained(out.symbols, min(OPENING, k))[out.start[own]]
        order = np.lexsort([*keys.T[::-1], opening])
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        heads = np.flatnonzero(new)
        opens, held = np.unique(opening[order][heads], return_index=True)
        out.windows.append(Windows(k, own[order][heads], own[order], np.append(heads, len(order)), opens, np.append(held, len(heads))))
    return out


def _before(rows: np.ndarray, keys: np.ndarray, or_equal: bool) -> np.ndarray:
    """Row by row: does `rows` stand before `keys` in the order of their words?"""
    differ = rows != keys
    first = differ.argmax(axis=1)
    at = np.arange(len(rows))
    return np.where(differ[at, first], rows[at, first] < keys[at, first], or_equal)


def _bisect(symbols: np.ndarray, array: np.ndarray, keys: np.ndarray, right: bool) -> np.ndarray:
    """For each key the first place in the suffix array that isn't before it; with right, that is past it."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(array), np.int64)
    reach = np.arange(keys.shape[1])
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        go = _before(symbols[array[middle][:, None] + reach], keys[open_], right)
        low[open_[go]] = middle[go] + 1
        high[open_[~go]] = middle[~go]
    return low


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of these ranges, and the range of each."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of], of


class Shard:
    """The suffix array of a block of documents over their words.

    Only suffixes whose first words open some test suffix stand in it, as no other can match;
    they are sorted by as many words as a window has. A separator ends each document.
    """

    def __init__(self, block: Block, tests: Suffixes, window: int):
        found = words(block, ALNUM, lower=True)
        self.counts, n = found.counts, len(found.hashes)
        documents = found.documents()
        # every document's words are followed by one separator: 0, which no word hashes to but with odds of 2**-64
        self.symbols = np.zeros(n + len(block) + window, np.uint64)
        self.place = np.arange(n) + documents
        self.symbols[self.place] = found.hashes
        self.first = found.first[:-1] + np.arange(len(block))
        self.documents = documents
        array, self.wanted = np.zeros(0, np.int64), []
        for w in tests.windows:
            heads = chained(self.symbols, min(OPENING, w.size))[self.place] if n else np.zeros(0, np.uint64)
            table = np.zeros(1 << 16, bool)
            table[(w.opens >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(table[(heads >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(w.opens, heads[maybe]), len(w.opens) - 1)
            same = w.opens[at] == heads[maybe]
            array = np.union1d(array, self.place[maybe[same]])
            used = np.unique(at[same])
            self.wanted.append(_spans(w.held[used], w.held[used + 1])[0])
        order = np.lexsort([self.symbols[array + i] for i in reversed(range(window))]) if len(array) else []
        self.array = array[order] if len(array) else array

    def search(self, tests: Suffixes) -> list[tuple[Windows, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each size the test windows that occur here, with where their places begin and end in the suffix array."""
        out = []
        for w, own in zip(tests.windows, self.wanted, strict=True):
            if len(own):
                keys = tests.symbols[tests.start[w.first[own]][:, None] + np.arange(w.size)]
                low, high = (_bisect(self.symbols, self.array, keys, right) for right in (False, True))
                some = np.flatnonzero(high > low)
                out.append((w, own[some], low[some], high[some]))
        return out

    def hits(self, found: list) -> np.ndarray:
        """Words of each document that some window covers."""
        edges = np.zeros(len(self.symbols) + 1, np.int64)
        for w, _, low, high in found:
            places = self.array[_spans(low, high)[0]]
            np.add.at(edges, places, 1)
            np.add.at(edges, places + w.size, -1)
        return np.bincount(self.documents[np.cumsum(edges)[self.place] > 0], minlength=len(self.counts))

    def items(self, found: list, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) with a window in common, by document and item. A window that a document repeats meets its items once."""
        documents, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def settle() -> None:
            both = np.unique(np.stack([np.concatenate(documents), np.concatenate(items)]), axis=1)
            documents[:], items[:] = [both[0]], [both[1]]

        for w, own, low, high in found:
            inner, of = _spans(low, high)
            at = np.unique(of * len(self.first) + np.searchsorted(self.first, self.array[inner], "right") - 1)
            of, document = at // len(self.first), at % len(self.first)
            n = np.diff(w.bounds)[own][of]
            # as many at once as PAIRS, but for those of one window
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
                members, back = _spans(w.bounds[own[of[part]]], w.bounds[own[of[part]] + 1])
                documents.append(document[part][back])
                items.append(tests.item[w.members[members]])
                settle()
        settle()
        return documents[0], items[0]

    def covered(self, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal stretches of hit words: document, begin and end."""
        edges = np.zeros(len(self.symbols) + 1, np.int64)
        for w, _, low, high in found:
            places = self.array[_spans(low, high)[0]]
            np.add.at(edges, places, 1)
            np.add.at(edges, places + w.size, -1)
        # separators are never hit, so no stretch crosses documents
        steps = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edges) > 0, [0]]).astype(np.int8)))
        begin, end = steps[::2], steps[1::2]
        document = np.searchsorted(self.first, begin, "right") - 1
        return document, begin - self.first[document], end - self.first[document]

    def pairs(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a place in the block and a test suffix whose window starts there."""
        places, suffixes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, own, low, high in found:
            members, of = _spans(w.bounds[own], w.bounds[own + 1])
            inner, back = _spans(low[of], high[of])
            places.append(self.array[inner])
            suffixes.append(w.members[members][back])
        return np.concatenate(places), np.concatenate(suffixes)


def _longest(shard: Shard, tests: Suffixes, found: list) -> tuple[np.ndarray, ...]:
    """Longest matches as arrays: document, doc_start, item, item_start, n_words."""
    places, suffix = shard.pairs(found)
    # windows that go on in the next window of the same item are parts of one longer match
    sizes, document = tests.size[suffix], np.searchsorted(shard.first, places, "right") - 1
    item, offset = tests.item[suffix], tests.start[suffix]
    order = np.lexsort((places, places - offset))
    places, suffix, sizes, document, item, offset = (x[order] for x in (places, suffix, sizes, document, item, offset))
    new = np.ones(len(places), bool)
    if len(places):
        new[1:] = (np.diff(places) != 1) | (np.diff(offset) != 1) | (np.diff(document) != 0) | (np.diff(tests.offset[suffix]) != 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(places)) - 1 if len(heads) else heads
    return document[heads], places[heads] - shard.first[document[heads]], item[heads], tests.offset[suffix[heads]], places[tails] - places[heads] + sizes[tails]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _parts(items: DataFrame) -> list[tuple[int, int]]:
    """As many parts as keep each near PART_BYTES."""
    n = -(-(items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0) // PART_BYTES) or 1
    return [(i, n) for i in range(n)]


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit and matches (longest verbatim matches: item_id, doc_start, item_start and n_words, in words) of every document.

    Words are lower-cased runs of digits, letters and non-ASCII characters. Test windows are
    `window` consecutive words of an item, or the whole of a shorter one. Test items go to all
    executors in parts of PART_BYTES at most, so documents are searched where they are read. A
    larger test set is searched once per part: only the matches of documents that a further part
    hits travel, and meet all rows by a fingerprint of doc_id and text.
    Null text: no words. Items without words or id match nothing; repeated items match as one id;
    repeated documents get a row each; an empty table gives no rows. Other columns are left out.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    cuts, more = _parts(items), []
    keys = ["one", "two"]
    if len(cuts) > 1:
        rows = rows.withColumns({"one": F.xxhash64("doc_id", "text"), "two": F.xxhash64(F.lit(1), "text", "doc_id")})
    for part, parts in cuts:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        tests = sc.broadcast(test_suffixes([tuple(r) for r in own.toLocalIterator()], window))
        if parts == 1:
            return rows.mapInArrow(_search(tests, window), SCHEMA)
        found = rows.mapInArrow(_search(tests, window, keys), f"one long, two long, {SCHEMA}")
        more.append(found.where(F.size("matches") > 0).select(*keys, "matches") if part else found)
    first, *rest = more
    every = rest[0]
    for x in rest[1:]:
        every = every.unionByName(x)
    every = every.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("others"))
    whole = first.join(every, keys, "left").withColumn("matches", F.concat("matches", F.coalesce("others", F.array().cast(MATCHES))))
    return whole.select("doc_id", "n_words", _covered(F.transform("matches", lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.n_words).alias("b")))).alias("n_hit"), "matches")


def _covered(spans):
    """Words that at least one span (a, b) covers."""
    spans = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, s.end))).alias("n"), F.greatest(s.end, x.b).alias("end"))
    return F.aggregate(spans, zero, step, lambda s: s.n)


#: Pairs of a place and a test suffix that are spelled out at once, but for those of a single document.
PAIRS = 1_000_000


def _halves(texts: pa.Array, rows: slice, tests: Suffixes, window: int) -> Iterator[tuple[slice, Shard, list]]:
    """Searched blocks; one whose pairs of places and items are too many is taken in halves."""
    for block in blocks(texts):
        own = slice(rows.start + block.rows.start, rows.start + block.rows.stop)
        shard = Shard(block, tests, window)
        found = shard.search(tests)
        pairs = sum(int(((high - low) * np.diff(w.bounds)[i]).sum()) for w, i, low, high in found)
        if pairs <= PAIRS or len(block) == 1:
            yield own, shard, found
        else:
            middle = block.rows.start + len(block) // 2
            for a, z in ((block.rows.start, middle), (middle, block.rows.stop)):
                yield from _halves(texts.slice(a, z - a), slice(rows.start + a, rows.start + z), tests, window)


def _search(tests, window: int, also: tuple[str, ...] | list[str] = ()):
    kind = pa.struct([("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, shard, found in _halves(batch["text"], slice(0, batch.num_rows), tests.value, window):
                document, *fields = _longest(shard, tests.value, found)
                order = np.argsort(document, kind="stable")
                offsets = np.searchsorted(document[order], np.arange(len(shard.counts) + 1))
                fields = [fields[i][order] for i in (1, 0, 2, 3)]
                matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(kind)))
                part = batch.slice(rows.start, rows.stop - rows.start)
                out = {c: part[c] for c in [*also, "doc_id"]} | {"n_words": pa.array(shard.counts, pa.int64()), "n_hit": pa.array(shard.hits(found), pa.int64()), "matches": matches}
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], names=list(out))

    return search


SPANS = "array<struct<a:long,b:long>>"


def _lists(document: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values of documents, which are in order, as a list for each of n documents."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(document, np.arange(n + 1)), pa.int32()), values)


def _judge(tests, window: int, also: tuple[str, ...] | list[str] = ()):
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                shard, n = Shard(block, tests.value, window), len(block)
                found = shard.search(tests.value)
                own, items = shard.items(found, tests.value)
                document, begin, end = shard.covered(found)
                spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], fields=list(span))
                part = batch.slice(block.rows.start, n)
                out = {c: part[c] for c in [*also, "doc_id"]} | {"n_words": pa.array(shard.counts, pa.int64()), "spans": _lists(document, n, spans), "items": _lists(own, n, pa.array(items, pa.int64()))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return judge


def _in_parts(docs: DataFrame, benchmark: DataFrame, window: int, each) -> list[DataFrame]:
    """What each(tests, part, parts) gives for every part of the test items. With several parts each result is checkpointed and its broadcast dropped before the next, so one part at most is in memory."""
    sc, items, out = docs.sparkSession.sparkContext, _items(benchmark), []
    for part, parts in _parts(items):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        tests = sc.broadcast(test_suffixes([tuple(r) for r in own.toLocalIterator()], window))
        found = each(tests, part, parts)
        if parts > 1:
            found = cut(found)
            tests.destroy()
        out.append(found)
    return out


_FINGERPRINT = {"one": F.xxhash64, "two": lambda i, t: F.xxhash64(F.lit(1), t, i)}


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, spans (stretches of words that windows cover, in order; those of several parts may overlap) and items (distinct ids of items with an occurring window, in order) of every document.

    As match_benchmark(), but places and items are never paired: a document that repeats a passage
    of many items costs its places and the items' windows. Of a larger test set's parts, each is
    searched and checkpointed before the next one is broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = list(_FINGERPRINT)
    named = rows.withColumns({k: f("doc_id", "text") for k, f in _FINGERPRINT.items()})
    columns = f"doc_id long, n_words long, spans {SPANS}, items array<long>"

    def each(tests, part: int, parts: int) -> DataFrame:
        if parts == 1:
            return rows.mapInArrow(_judge(tests, window), columns)
        found = named.mapInArrow(_judge(tests, window, keys), f"one long, two long, {columns}")
        return found.where(F.size("items") > 0) if part else found

    first, *rest = _in_parts(docs, benchmark, window, each)
    if not rest:
        return first
    every = rest[0]
    for x in rest[1:]:
        every = every.unionByName(x)
    # rows of one document find the same, but for one of each part
    every = every.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("more"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("others"))
    whole = first.join(every, keys, "left")
    spans = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPANS))))
    return whole.select("doc_id", "n_words", spans.alias("spans"), F.array_sort(F.array_union("items", F.coalesce("others", F.array().cast("array<long>")))).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """find_items() as digests: doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids, sorted as strings and joined by commas) and contaminated."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    found = find_items(docs, benchmark, window).withColumn("n_hit", _covered("spans"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with all their columns, that hold no window of any test item.

    Rows are judged where they are read, each for its own text, so that a null or repeated doc_id
    changes nothing. With a larger test set, fingerprints of the documents that a part hits are kept, and meet the rows at the end.
    """
    one, two = free_names(docs, "one", "two")

    def clean(tests):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch["text"]):
                    shard = Shard(block, tests.value, window)
                    hit = shard.hits(shard.search(tests.value)) > 0
                    yield batch.slice(block.rows.start, len(block)).filter(pa.array(~hit))

        return keep

    def find(tests):
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch["text"]):
                    shard = Shard(block, tests.value, window)
                    hit = shard.hits(shard.search(tests.value)) > 0
                    yield batch.slice(block.rows.start, len(block)).select([one, two]).filter(pa.array(hit))

        return keys

    named = docs.withColumns({k: f("doc_id", "text") for k, f in zip((one, two), _FINGERPRINT.values(), strict=True)})
    found = _in_parts(docs, benchmark, window, lambda tests, part, parts: docs.mapInArrow(clean(tests), docs.schema) if parts == 1 else named.select(one, two, F.col("text").cast("string").alias("text")).mapInArrow(find(tests), f"`{one}` long, `{two}` long"))
    if len(found) == 1:
        return found[0]
    hit = found[0]
    for x in found[1:]:
        hit = hit.unionByName(x)
    return named.join(hit.distinct(), [one, two], "left_anti").select(*[f"`{c}`" for c in docs.columns])
