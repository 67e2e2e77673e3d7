"""Full-text search: postings, a boolean query language compiled to columns, and BM25."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.functions.porter import stem
from sparkshelf.functions.text import tokens

COLUMNS = ["filepath", "title", "body"]
#: Documents whose tokens are grouped at once, and stems that a task keeps.
GROUPED_ROWS, KNOWN_STEMS = 1_000, 500_000
K1, B, FLOOR, NEAR = 1.2, 0.75, 1e-6, 10
#: Ranks up to which Spark limits each task's rows before a window.
GROUP_LIMIT = 1_000


class QuerySyntaxError(ValueError):
    """The text isn't a query."""


@dataclass(frozen=True)
class Phrase:
    """Tokens that follow each other in one of the columns; prefix: the last one may go on; first: they open the column."""

    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: frozenset[str] = frozenset(COLUMNS)


@dataclass(frozen=True)
class Near:
    """Phrases with at most `distance` tokens between them; one alone is just there."""

    phrases: tuple[Phrase, ...]
    distance: int = NEAR


@dataclass(frozen=True)
class Bool:
    kind: str
    parts: tuple = field(default_factory=tuple)


def fold(text: str) -> list[str]:
    """The tokens of a query's text, as tokens() makes them of a document's."""
    plain = "".join((p[0] if len(p := unicodedata.normalize("NFD", c)) == 2 and unicodedata.combining(p[1]) and "À" <= c < "ɐ" else c) for c in text.lower())
    out, word = [], ""
    for c in plain:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:+*^,-])|([A-Za-z0-9_\x80-\U0010ffff\x1a]+)|(\S))')


class _Parser:
    """expr: or; or: and (OR and)*; and: not (AND not)*; not: group (NOT group)*; group: items side by side, which are all needed."""

    def __init__(self, text: str, stemmed: bool):
        self.items, self.at, self.stemmed = [], 0, stemmed
        for m in LEX.finditer(text.rstrip()):
            if m[4]:
                raise QuerySyntaxError(f"unexpected {m[4]!r}")
            self.items.append(("string", m[1]) if m[1] else ("mark", m[2]) if m[2] else ("word", m[3]))
        if not self.items:
            raise QuerySyntaxError("empty query")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, mark: str = "") -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or mark and item != ("mark", mark):
            raise QuerySyntaxError(f"expected {mark or 'more'} at {item[1]!r}")
        self.at += 1
        return item

    def whole(self):
        out = self.either(frozenset(COLUMNS))
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return out

    def level(self, word: str, kind: str, below, columns: frozenset[str]):
        parts = [below(columns)]
        while self.peek() == ("word", word):
            self.take()
            parts.append(below(columns))
        return parts[0] if len(parts) == 1 else Bool(kind, tuple(parts))

    def either(self, columns):
        return self.level("OR", "or", self.both, columns)

    def both(self, columns):
        return self.level("AND", "and", self.without, columns)

    def without(self, columns):
        return self.level("NOT", "not", self.side_by_side, columns)

    def side_by_side(self, columns):
        parts = [self.item(columns)]
        while self.peek()[0] in ("word", "string") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("mark", "("), ("mark", "{"), ("mark", "^"), ("mark", "-")):
            parts.append(self.item(columns))
        return parts[0] if len(parts) == 1 else Bool("and", tuple(parts))

    def filter(self, columns: frozenset[str]) -> frozenset[str] | None:
        """The columns of a filter that stands here, if one does."""
        begin, negated = self.at, False
        if self.peek() == ("mark", "-"):
            self.take()
            negated = True
        names = []
        if self.peek() == ("mark", "{"):
            self.take()
            while self.peek()[0] in ("word", "string"):
                names.append(self.take()[1].strip('"').lower())
            self.take("}")
            self.take(":")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            names.append(self.take()[1].strip('"').lower())
            self.take()
        else:
            self.at = begin
            if negated:
                raise QuerySyntaxError("unexpected '-'")
            return None
        if set(names) - set(COLUMNS):
            raise QuerySyntaxError(f"no such column: {', '.join(sorted(set(names) - set(COLUMNS)))}")
        return columns - set(names) if negated else columns & set(names)

    def item(self, columns):
        own = self.filter(columns)
        columns = columns if own is None else own
        if self.peek() == ("mark", "("):
            self.take()
            out = self.either(columns)
            self.take(")")
            return out
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.take()
            self.take()
            phrases = []
            while self.peek()[0] in ("word", "string", "mark") and self.peek() not in (("mark", ")"), ("mark", ",")):
                phrases.append(self.phrase(columns))
            distance = NEAR
            if self.peek() == ("mark", ","):
                self.take()
                distance = self.take()[1]
                if not str(distance).isdigit():
                    raise QuerySyntaxError("expected a number")
            self.take(")")
            return Near(tuple(phrases), int(distance))
        return Near((self.phrase(columns),))

    def phrase(self, columns) -> Phrase:
        first = self.peek() == ("mark", "^")
        if first:
            self.take()
        found = [self.part()]
        while self.peek() == ("mark", "+"):
            self.take()
            found.append(self.part())
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        words = [w for part in found for w in part]
        return Phrase(tuple(map(stem, words)) if self.stemmed else tuple(words), prefix, first, columns)

    def part(self) -> list[str]:
        kind, text = self.take()
        if kind == "mark" or kind == "word" and text in ("AND", "OR", "NOT"):
            raise QuerySyntaxError(f"unexpected {text!r}")
        return fold(text[1:-1].replace('""', '"') if kind == "string" else text)


def parse(text: str, stemmed: bool = True):
    """The query's tree; raises QuerySyntaxError. Upper-case AND, OR and NOT are operators, terms side by side bind tightest."""
    return _Parser(text, stemmed).whole()


def quote_terms(text: str) -> str:
    """A query for all of the text's words, whatever characters it holds."""
    return " ".join('"{}"'.format(w.replace('"', '""')) for w in text.split())


def leaves(tree) -> list[Near]:
    return [tree] if isinstance(tree, Near) else [x for p in tree.parts for x in leaves(p)]


#: lead: the first of its document's postings of the term, so that documents of a term are counted without being told apart.
POSTINGS = "term string, doc_pk long, col int, tf int, positions array<int>, dl long, lead boolean"


class Ranges:
    """Parts of an index as ranges of (term, doc_pk). bounds: the first entry of each part but the first, in order."""

    def __init__(self, bounds: list[tuple[str, int]]):
        self.terms, self.docs = [t for t, _ in bounds], np.array([d for _, d in bounds], np.int64)

    def parts(self, terms: list[str], code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The part of each entry (terms[code], doc). Strings compare here as their UTF-8 does in Spark."""
        low = np.array([bisect_left(self.terms, t) for t in terms], np.int32)
        high = np.array([bisect_right(self.terms, t) for t in terms], np.int32)
        out = low[code] if len(terms) else np.zeros(0, np.int32)
        for i in np.flatnonzero(high > low).tolist():  # terms that are spread over parts
            own = np.flatnonzero(code == i)
            out[own] += np.searchsorted(self.docs[low[i] : high[i]], doc[own], "right").astype(np.int32)
        return out

    def assigned(self, rows: DataFrame) -> DataFrame:
        """Postings with their part."""

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = batch["term"].dictionary_encode()
                part = self.parts(coded.dictionary.to_pylist(), coded.indices.to_numpy(), batch["doc_pk"].to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

        return rows.select("term", "doc_pk", "col", "tf", "positions", "dl", "lead").mapInArrow(assign, f"{POSTINGS}, part int")


def postings(corpus: DataFrame, stemmed: bool, ranges: Ranges | None = None) -> DataFrame:
    """(term, doc_pk, col, tf, positions, dl, lead) of a corpus (doc_pk, collection, path, title, body), with ranges also the part.

    A document's tokens stand in one row, so they are grouped where they are read: tokens never
    travel one by one. Arrow encodes a batch's terms as numbers, which one sort groups. Postings leave
    in the order of terms, so that who sorts them all merges runs.
    """
    columns = [F.concat_ws("/", "collection", "path"), F.col("title"), F.col("body")]
    rows = corpus.select(F.col("doc_pk").cast("long").alias("doc_pk"), *[tokens(x).alias(name) for name, x in zip(COLUMNS, columns, strict=True)])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in (b.slice(at, GROUPED_ROWS) for b in batches for at in range(0, b.num_rows, GROUPED_ROWS)):
            sizes = np.array([np.diff(batch[c].offsets.to_numpy()) for c in COLUMNS])
            lists = sizes.T.reshape(-1)  # of each row its columns in turn
            flat = pa.concat_arrays([batch[c].flatten() for c in COLUMNS]).dictionary_encode()
            begins = np.concatenate([np.cumsum(n) - n + at for n, at in zip(sizes, np.cumsum(sizes.sum(axis=1)) - sizes.sum(axis=1), strict=True)]).reshape(3, -1).T.reshape(-1)
            owner = np.repeat(np.arange(len(lists)), lists)
            position = np.arange(len(owner)) - np.repeat(np.cumsum(lists) - lists, lists)
            code, terms = flat.indices.to_numpy()[begins[owner] + position], flat.dictionary
            if stemmed:
                terms = pa.array([known.get(t) or known.setdefault(t, stem(t)) for t in terms.to_pylist()], pa.string()).dictionary_encode()
                code, terms = terms.indices.to_numpy()[code], terms.dictionary
                if len(known) > KNOWN_STEMS:
                    known.clear()
            by_name = pc.sort_indices(terms).to_numpy()
            place = np.empty(len(by_name), np.int64)
            place[by_name] = np.arange(len(by_name))
            order = np.argsort(place[code] << 32 | owner, kind="stable")
            owner, code = owner[order], code[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
            heads = np.flatnonzero(new)
            ends = np.append(heads, len(order))
            row = owner[heads] // 3
            lead = np.ones(len(heads), bool)
            lead[1:] = (row[1:] != row[:-1]) | (code[heads][1:] != code[heads][:-1])
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position[order], pa.int32()))
            held = [terms.take(pa.array(code[heads])), batch["doc_pk"].take(pa.array(row)), pa.array(owner[heads] % 3, pa.int32()), pa.array(np.diff(ends), pa.int32()), places, pa.array(sizes.sum(axis=0)[row], pa.int64()), pa.array(lead)]
            names = ["term", "doc_pk", "col", "tf", "positions", "dl", "lead"]
            if ranges is not None:
                held.append(pa.array(ranges.parts(terms.to_pylist(), code[heads], batch["doc_pk"].to_numpy()[row]), pa.int32()))
                names.append("part")
            yield pa.RecordBatch.from_arrays(held, names=names)

    return rows.mapInArrow(grouped, POSTINGS if ranges is None else f"{POSTINGS}, part int")


@dataclass
class Index:
    """postings (term, doc_pk, col, tf, positions, dl, lead); documents (doc_pk, dl: tokens of all columns, collection, path, title, hash), those without tokens, too; totals: one row of n and avgdl."""

    postings: DataFrame
    documents: DataFrame
    totals: DataFrame
    stemmed: bool
    #: What postings are made of, where they are a plan over bodies.
    corpus: DataFrame | None = None
    some: Callable[[Column], DataFrame] | None = None

    def sampled(self, share: int) -> DataFrame:
        """Postings of one in `share` documents by a hash of their key; of a corpus only their bodies are cut to tokens."""
        own = F.pmod(F.xxhash64("doc_pk", F.lit(11)), F.lit(share)) == 0
        if self.corpus is None:
            return self.postings.where(own)
        return postings(self.some(own) if self.some else self.corpus.where(own), self.stemmed)

    def in_parts(self, ranges: Ranges) -> DataFrame:
        """Postings with their part."""
        return ranges.assigned(self.postings) if self.corpus is None else postings(self.corpus, self.stemmed, ranges)

    def read(self, exact: list[str], prefixes: list[str]) -> DataFrame:
        """Postings of these terms and of terms that begin so."""
        return self.postings.where(_wanted(exact, prefixes))

    def read_terms(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms of a table (term), which may be many."""
        return self.postings.join(terms, "term", "left_semi")


def build_index(corpus: DataFrame, stemmed: bool = True, some: Callable[[Column], DataFrame] | None = None) -> Index:
    """Postings and sizes of a corpus (doc_pk, collection, path, title, body, hash), as a plan that reads all bodies; write_index() keeps them.

    some: gives the corpus's few rows for which a condition on doc_pk holds, where that costs less than to filter the corpus.
    """
    n = sum((F.size(tokens(x)) for x in (F.concat_ws("/", "collection", "path"), F.col("title"), F.col("body"))), F.lit(0)).cast("long")
    names = [c if c in corpus.columns else F.lit(None).cast("string").alias(c) for c in ("collection", "path", "title", "hash")]
    documents = corpus.select("doc_pk", n.alias("dl"), *names)
    return Index(postings(corpus, stemmed), documents, documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), stemmed, corpus, some)


#: Postings of a part of a stored index, at most, and at least where more parts would keep more cores busy.
PART_ROWS, LEAST_ROWS = 4_000_000, 100_000
#: Bytes of a part's postings while they are sorted, about, and of a posting without its positions.
PART_BYTES, POSTING_BYTES = 256 << 20, 140
#: Postings that ranges are told from, about, and how many a document may have in that reckoning.
SAMPLED, DOCUMENT_POSTINGS = 200_000, 200


def write_index(index: Index, path: str, part_rows: int = PART_ROWS) -> None:
    """Keeps an index below `path`: postings in parts that are ranges of (term, doc_pk), sorted, so that a common term takes as many parts as it needs; a sparse directory of each part's first and last term; documents; totals.

    Ranges and their number come from the postings of a sample of documents, so all postings are made,
    dealt and written once. Parts are alike in bytes, not in postings: those of common terms have many
    positions. The directory is written last: an index without it isn't read.
    """
    spark = index.documents.sparkSession
    # some postings of every part, in all no more than one task can order
    about = index.documents.count() * DOCUMENT_POSTINGS
    share = max(1, about // max(SAMPLED, 20 * about // part_rows))
    sample = cut(index.sampled(share).select("term", "doc_pk", (F.lit(POSTING_BYTES) + 4 * F.col("tf").cast("long")).alias("bytes")))
    held, size = sample.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n = held * share
    parts = max(1, -(-n // part_rows), -(-size * share // PART_BYTES), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    spans = _spans(sample, max(1, -(-size // parts)))
    ranges = Ranges([(s.term, s.doc_pk) for s in spans[1:]])
    parts = len(ranges.terms) + 1
    # sorted by the part, too, so that the writer needs no order of its own
    ordered = index.in_parts(ranges).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "term", "doc_pk", "col")
    ordered.write.partitionBy("part").parquet(f"{path}/postings")
    written = spark.read.schema(f"{POSTINGS}, part int").parquet(f"{path}/postings")
    # lengths are known from the postings: bodies are cut to tokens only once
    # each column that has tokens has one posting at its start
    sizes = written.where(F.col("positions")[0] == 0).groupBy("doc_pk").agg(F.first("dl").alias("dl"))
    documents = index.documents.drop("dl").join(sizes, "doc_pk", "left").withColumn("dl", F.coalesce("dl", F.lit(0)).cast("long"))
    documents.select("doc_pk", "dl", "collection", "path", "title", "hash").write.parquet(f"{path}/documents")
    spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(index.stemmed).alias("stemmed")).write.parquet(f"{path}/totals")
    # least and greatest strings need a sort, so only rows beyond the sample's own come to it
    known = spark.createDataFrame([(i, s.term, s.last) for i, s in enumerate(spans)], "part int, low string, high string")
    beyond = written.select("part", "term").join(F.broadcast(known), "part", "left").where("low is null or term < low or term > high").groupBy("part").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
    directory = written.groupBy("part").agg(F.count("*").alias("postings")).join(F.broadcast(known), "part", "left").join(beyond, "part", "left")
    directory.select("part", F.least("low", "least").alias("first"), F.greatest("high", "greatest").alias("last"), "postings").coalesce(1).sortWithinPartitions("part").write.parquet(f"{path}/directory")


def _spans(sample: DataFrame, step: int) -> list[Row]:
    """(term, doc_pk, last): the first entry and the last term of each part, in order, for parts of `step` bytes of a sample (term, doc_pk, bytes)."""
    before = F.sum("bytes").over(Window.orderBy("term", "doc_pk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    placed = sample.select("term", "doc_pk", F.floor(before / step).alias("part")).groupBy("part").agg(F.min(F.struct("term", "doc_pk")).alias("entry"), F.max("term").alias("last"))
    return placed.select("entry.*", "last").groupBy("term", "doc_pk").agg(F.max("last").alias("last")).orderBy("term", "doc_pk").collect()


DIRECTORY = "part int, first string, last string, postings long"
DOCUMENTS = "doc_pk long, dl long, collection string, path string, title string, hash string"


def may_hold(exact: list[str], prefixes: list[str]) -> Column:
    """Rows of a directory whose part may hold these terms, or terms that begin so."""
    hit = F.lit(False)
    for t in exact:
        hit = hit | ((F.col("first") <= t) & (F.col("last") >= t))
    for p in prefixes:
        # a part is left out if it ends before the prefix or begins behind all that have it
        hit = hit | ((F.col("last") >= p) & ((F.col("first") <= p) | F.col("first").startswith(p)))
    return hit


class StoredIndex(Index):
    """An index that write_index() has kept. A query looks its terms up in the directory and opens only the parts that hold them."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool | None = None):
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        self.spark, self.path, self.directory, self.documents = spark, path, read("directory", DIRECTORY), read("documents", DOCUMENTS)
        totals = read("totals", "n long, avgdl double, stemmed boolean")
        self.totals, self.stemmed = totals.select("n", "avgdl"), totals.first().stemmed if stemmed is None else stemmed

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).option("recursiveFileLookup", "true").parquet(f"{self.path}/postings")

    def parts(self, exact: list[str], prefixes: list[str]) -> list[int]:
        return sorted(r.part for r in self.directory.where(may_hold(exact, prefixes)).select("part").collect())

    def read(self, exact: list[str], prefixes: list[str], found: list[int] | None = None) -> DataFrame:
        """found: the parts to open, where the directory has been asked already."""
        found = self.parts(exact, prefixes) if found is None else found
        if not found:
            return self.spark.createDataFrame([], POSTINGS)
        rows = self.spark.read.schema(POSTINGS).parquet(*[f"{self.path}/postings/part={p}" for p in found])
        return rows.where(_wanted(exact, prefixes))


def open_index(spark: SparkSession, path: str, stemmed: bool | None = None) -> StoredIndex:
    """stemmed: as the index is, if that is known."""
    return StoredIndex(spark, path, stemmed)


def _wanted(exact: list[str], prefixes: list[str]) -> Column:
    out = F.col("term").isin(exact) if exact else F.lit(False)
    for p in prefixes:
        out = out | F.col("term").startswith(p)
    return out


def _terms(phrases: list[Phrase]) -> tuple[list[str], list[str]]:
    """Terms that phrases need whole, and beginnings."""
    exact = sorted({t for p in phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    return exact, sorted({p.tokens[-1] for p in phrases if p.prefix and p.tokens})


def _places(phrase: Phrase, column: str) -> Column:
    """Starts of the phrase in a column, from `held`: an array of (term, col, positions)."""
    code = COLUMNS.index(column)
    none = F.array().cast("array<int>")

    def of(token: str, prefix: bool) -> Column:
        own = F.filter("held", lambda h: (h["col"] == code) & (h["term"].startswith(token) if prefix else h["term"] == token))
        return F.coalesce(F.flatten(F.transform(own, lambda h: h["positions"])), none)

    last = len(phrase.tokens) - 1
    if last < 0:
        return none
    out = of(phrase.tokens[0], phrase.prefix and not last)
    for i, token in enumerate(phrase.tokens[1:], 1):
        out = F.array_intersect(out, _moved(of(token, phrase.prefix and i == last), -i))
    return F.filter(out, lambda p: p == 0) if phrase.first else out


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p + by)


def _near(leaf: Near, places: list[Column]) -> list[Column]:
    """Of each phrase the starts that have an instance of every other within the distance."""

    def close(here: Column, size: int, there: Column, other: int) -> Column:
        return F.filter(here, lambda a: F.exists(there, lambda b: (b - a - size <= leaf.distance) & (a - b - other <= leaf.distance)))

    out = []
    for i, p in enumerate(leaf.phrases):
        here = places[i]
        for j, q in enumerate(leaf.phrases):
            if i != j:
                here = close(here, len(p.tokens), places[j], len(q.tokens))
        out.append(here)
    return out


def score(index: Index, query: str) -> DataFrame:
    """(doc_pk, score) of the documents that match, by BM25 over all of the index; more is better.

    A phrase's weight comes from the number of documents that hold it, near others or not, in the
    columns it is limited to; it doesn't fall below FLOOR. Only the query's postings are read and grouped.
    """
    tree = parse(query, index.stemmed)
    ends = leaves(tree)
    phrases = [p for leaf in ends for p in leaf.phrases]
    held = index.read(*_terms(phrases)).groupBy("doc_pk").agg(F.collect_list(F.struct("term", "col", "positions")).alias("held"), F.first("dl").alias("dl"))
    counts, somewhere, present, at = {}, {}, [], 0
    for leaf in ends:
        alone = {c: [_places(p, c) if c in p.columns else F.array().cast("array<int>") for p in leaf.phrases] for c in COLUMNS if any(c in p.columns for p in leaf.phrases)}
        names = [f"f{at + i}" for i in range(len(leaf.phrases))]
        for i, name in enumerate(names):
            counts[name] = sum((F.size(_near(leaf, places)[i]) for places in alone.values()), F.lit(0))
            somewhere[name] = sum((F.size(places[i]) for places in alone.values()), F.lit(0)) > 0
        present.append(names)
        at += len(names)
    rows = held.withColumns(counts | {f"h_{c}": x for c, x in somewhere.items()}).drop("held")

    def holds(node) -> Column:
        if isinstance(node, Near):
            out = F.lit(True)
            for name in present[[x is node for x in ends].index(True)]:
                out = out & (F.col(name) > 0)
            return out
        first, *rest = map(holds, node.parts)
        for x in rest:
            first = first | x if node.kind == "or" else first & (~x if node.kind == "not" else x)
        return first

    found = rows.agg(*[F.count(F.when(F.col(f"h_{c}"), 1)).alias(f"n_{c}") for c in counts])
    # one row each: sizes of the corpus and of the phrases
    rows = rows.where(holds(tree)).crossJoin(F.broadcast(index.totals)).crossJoin(F.broadcast(found))
    total = F.lit(0.0)
    for c in counts:
        odds = F.log((F.col("n") - F.col(f"n_{c}") + 0.5) / (F.col(f"n_{c}") + 0.5))
        weight = F.when(odds <= 0, F.lit(FLOOR)).otherwise(odds)
        total = total + weight * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("doc_pk", total.alias("score"))


def search(index: Index, query: str, limit: int = 10, collection: str | None = None, min_score: float | None = None) -> DataFrame:
    """The best `limit` documents (docid, file, title, score, doc_pk, collection, path); ties by collection and path.

    A collection limits rows, not the corpus that scores rest on; min_score drops rows after the limit.
    """
    rows = score(index, query)
    if collection is None and limit <= GROUP_LIMIT:
        # only the best, and what ties with the last of them, meet the documents; tasks keep no more before they meet
        rows = rows.withColumn("_rank", F.rank().over(Window.orderBy(F.desc(F.round("score", 9))))).where(F.col("_rank") <= limit).drop("_rank")
    rows = rows.join(index.documents.drop("dl"), "doc_pk")
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    best = rows.orderBy(F.desc(F.round("score", 9)), "collection", "path").limit(limit)
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    return best.select("doc_pk", F.substring("hash", 1, 6).alias("docid"), F.concat_ws("/", "collection", "path").alias("file"), "title", "score", "collection", "path")


def batch_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_pk, score) for queries (query_id, terms: array of folded terms) that rank documents holding any term; one plan for all.

    Term weights are computed once over the index; queries meet postings on the term alone.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    used = index.read_terms(wanted.select("term").distinct()).groupBy("term", "doc_pk").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    n = used.groupBy("term").agg(F.count("*").alias("df"))
    odds = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(odds <= 0, F.lit(FLOOR)).otherwise(odds) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = used.join(n, "term").crossJoin(F.broadcast(index.totals)).select("term", "doc_pk", part.alias("part"))
    return wanted.join(weighted, "term").groupBy("query_id", "doc_pk").agg(F.sum("part").alias("score"))


def top_per_query(scores: DataFrame, k: int, key: str = "query_id", by: str = "score", tie: str = "doc_pk") -> DataFrame:
    """The best k rows of each query with their 1-based rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(by, 9)), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_paths(corpus: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Paths that hold the text's characters in order, the closest in length first; case doesn't matter."""
    pattern = ".*".join(re.escape(c) for c in text.lower())
    rows = corpus.where(F.lower("path").rlike(pattern)).select("collection", "path", F.levenshtein(F.lower("path"), F.lit(text.lower())).cast("long").alias("distance"))
    return rows.orderBy("distance", "collection", "path").limit(limit)


#: Points of a fuzzy match: for a character, for one that follows the last match at once, at a part's start; against a gap's first and further characters.
MATCH, NEXT, START, GAP, WIDER = 16, 4, 8, -3, -1
SEPARATORS = frozenset("/-_. ")


def fuzzy_score(path: str, query: str) -> int | None:
    """The best points of the query's characters in order in the path, over all ways to place them; None if they aren't there. Case must be equal."""
    n = len(path)
    best: list[int | None] = [0] * (n + 1) if not query else []
    last: list[int | None] = []
    for k, c in enumerate(query):
        row: list[int | None] = [None] * n
        held: int | None = None  # the best earlier match with its gap up to here
        for j in range(n):
            if k and j:
                before = last[j - 1]
                wider = None if held is None else held + WIDER
                fresh = last[j - 2] + GAP if j > 1 and last[j - 2] is not None else None
                held = max((x for x in (wider, fresh) if x is not None), default=None)
                near = None if before is None else before + NEXT
                reach = max((x for x in (held, near) if x is not None), default=None)
            else:
                reach = None if k else 0
            if reach is not None and path[j] == c:
                row[j] = reach + MATCH + (START if not j or path[j - 1] in SEPARATORS else 0)
        last = row
    found = [x for x in (last if query else best) if x is not None]
    return max(found) if found else None


def fuzzy_paths(corpus: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(collection, path, points): paths that hold the text's characters in order, by the points of the best way to place them; whatever their case.

    Those that don't hold them at all are left out by a pattern before any is scored.
    """
    query = text.lower()

    @F.pandas_udf("long")
    def points(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: fuzzy_score(p, query))

    rows = corpus.where(F.lower("path").rlike("(?s)" + ".*".join(re.escape(c) for c in query))).select("collection", "path")
    return rows.withColumn("points", points(F.lower("path"))).orderBy(F.desc("points"), "collection", "path").limit(limit)
