"""Toxicity scores: a learned lexicon's trie, walked with Levenshtein automata, and the context of each hit."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .blocks import ALNUM, Block, blocks, mix, words
from .neardup import near_duplicates

#: Labelled rows at most that terms and weights are learned from; of more, a hash of doc_id picks about so many.
SAMPLE_ROWS = 20_000
#: Letters of the stems that are tried.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7
#: Documents whose words are counted at once.
COUNTED_ROWS = 400
#: Bytes on either side of a hit that tell a quotation from abuse.
CONTEXT = 80
KEPT = 200_000
FEATURES = 8
#: What a hit counts for each edit, as few labelled texts misspell.
MISSPELLED = 0.8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
QUOTES = re.compile('"|“|”|„|«|»'.encode())
SPEECH = re.compile(rb"\b(said|says|wrote|writes|called|quoted?|quoting|according|reported|reads|the (?:word|term|slur|insult))\b")

def edits_allowed(term: str) -> int:
    """No edit in short terms, whose neighbours are ordinary words, one in longer ones, two in long ones."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: int = -1
    stem: int = -1
    most: int = 0


class Trie:
    """Lexicon terms; a term that ends in * is a stem that any letters may follow. Covered words are found misspelled, but exactly as their stem alone."""

    def __init__(self, terms: list[str], covered: frozenset[str] = frozenset()):
        self.terms, self.covered, self.root = terms, covered, Node()
        for i, term in enumerate(terms):
            node, path = self.root, [self.root]
            for c in term.rstrip("*"):
                node = node.next.setdefault(c, Node())
                path.append(node)
            if term.endswith("*"):
                node.stem = i
            else:
                node.word = i
                for x in path:
                    x.most = max(x.most, edits_allowed(term))

    def exact(self, word: str) -> int:
        """The word's own term, or else its longest stem; -1 if none."""
        node, stem = self.root, -1
        for c in word:
            node = node.next.get(c)
            if node is None:
                return stem
            stem = node.stem if node.stem >= 0 else stem
        return node.word if node.word >= 0 and self.terms[node.word] not in self.covered else stem

    def near(self, word: str) -> tuple[int, int]:
        """The term of fewest edits within its own allowance, and the edits; (-1, 0) if none.

        The word's Levenshtein automaton walks the trie: bit i of state d tells that the first i
        letters are read with d edits. A branch is left when no state of it can still accept.
        """
        letters: dict[str, int] = defaultdict(int)
        for i, c in enumerate(word):
            letters[c] |= 1 << i
        end, best = 1 << len(word), (-1, 3)
        todo = [(self.root, 1, 3, 7)]
        while todo:
            node, none, one, two = todo.pop()
            if node.word >= 0:
                edits = 0 if none & end else 1 if one & end else 2 if two & end else 3
                if edits <= edits_allowed(self.terms[node.word]) and (edits, node.word) < (best[1], best[0] if best[0] >= 0 else 1 << 30):
                    best = (node.word, edits)
            for c, child in node.next.items():
                here = letters.get(c, 0)
                a = (none & here) << 1
                b = (one & here) << 1 | none | none << 1 | a << 1
                e = (two & here) << 1 | one | one << 1 | b << 1
                if a or b and child.most or e and child.most > 1:
                    todo.append((child, a, b, e))
        return best if best[0] >= 0 else (-1, 0)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Forms:
    """Which words may match a lexicon, told for all distinct words of a block at once.

    Two words that are k edits apart are equal once at most k letters are taken out of each. So
    hashes of a word's shortened forms are looked up among those of the terms'; equal forms have
    equal hashes, and an unequal one that has the same only costs a walk.
    """

    def __init__(self, terms: list[str]):
        words = [[ord(c) for c in t] for t in terms if not t.endswith("*")]
        stems = [[ord(c) for c in t[:-1]] for t in terms if t.endswith("*")]
        fuzzy = [w for t, w in zip((t for t in terms if not t.endswith("*")), words, strict=True) if edits_allowed(t)]
        twice = [w for w in fuzzy if edits_allowed("x" * len(w)) > 1]
        self.longest = max([len(w) for w in fuzzy], default=0) + 2
        self.twice = min([len(w) for w in twice], default=1 << 30) - 2
        self.stems = sorted({len(s) for s in stems})
        self.sets = {"whole": self._keys(words, 0), "stem": self._keys(stems, 0), "one": self._keys(fuzzy, 1), "two": self._keys(twice, 2)}
        self.tables = {}
        for name, keys in self.sets.items():
            self.tables[name] = np.zeros(1 << 20, bool)
            self.tables[name][(keys >> np.uint64(44)).astype(np.int64)] = True

    def _keys(self, words: list[list[int]], most: int) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for n in sorted({len(w) for w in words}):
            out += self._forms(np.array([w for w in words if len(w) == n], np.uint64).reshape(-1, n), most)
        return np.unique(np.concatenate(out))

    def _forms(self, codes: np.ndarray, most: int) -> list[np.ndarray]:
        """Hashes of the words (rows of letters) with 0 .. most letters taken out."""
        sums, key = self._sums(codes), self._key
        n, back, out = codes.shape[1], np.uint64(INVERSE), [key(self._sums(codes)[:, -1], codes.shape[1])]
        for i in range(n if most else 0):
            out.append(key(sums[:, i] + (sums[:, n] - sums[:, i + 1]) * back, n - 1))
            for k in range(i + 1, n if most > 1 else 0):
                out.append(key(sums[:, i] + (sums[:, k] - sums[:, i + 1]) * back + (sums[:, n] - sums[:, k + 1]) * back * back, n - 2))
        return out

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        powers = np.array([pow(BASE, j, 1 << 64) for j in range(codes.shape[1])], np.uint64)
        sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
        return sums

    @staticmethod
    def _key(sums: np.ndarray, size: int) -> np.ndarray:
        return mix(sums ^ np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))

    def _held(self, name: str, keys: np.ndarray) -> np.ndarray:
        out = self.tables[name][(keys >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            held = self.sets[name]
            out[some] = held[np.minimum(np.searchsorted(held, keys[some]), len(held) - 1)] == keys[some]
        return out

    def maybe(self, words: list[bytes]) -> np.ndarray:
        """Of lower-case UTF-8 words, those that may be a term, begin with a stem or be within a term's edits."""
        text = np.frombuffer(b"\n".join(words).decode("utf-8", "replace").encode("utf-32-le") + b"\n\0\0\0", np.uint32)
        ends = np.flatnonzero(text == 10)
        starts = np.append(0, ends[:-1] + 1)
        sizes, out = ends - starts, np.zeros(len(words), bool)
        reach = max(self.longest, *self.stems, 1) if self.stems else max(self.longest, 1)
        for n in np.unique(np.minimum(sizes, reach + 1)).tolist():
            own = np.flatnonzero(sizes == n if n <= reach else sizes > reach)
            size = min(n, reach)
            codes = text[starts[own][:, None] + np.arange(size)].astype(np.uint64)
            sums = self._sums(codes)
            hit = np.zeros(len(own), bool)
            for k in self.stems:
                if k <= size:
                    hit |= self._held("stem", self._key(sums[:, k], k))
            if n <= reach:
                hit |= self._held("whole", self._key(sums[:, n], n))
                if 3 <= n <= self.longest:
                    for keys in self._forms(codes, 1):
                        hit |= self._held("one", keys)
                if self.twice <= n <= self.longest:
                    left = np.flatnonzero(~hit)
                    for keys in self._forms(codes[left], 2):
                        hit[left] |= self._held("two", keys)
            out[own] = hit
        return out


class Lexicon:
    """Terms with their strengths (log odds of toxic against clean documents); ordinary: words near a term that clean texts use; covered: words that count as hits of a stem, misspelled ones, too."""

    def __init__(self, terms: list[tuple[str, float]], ordinary: frozenset[str] = frozenset(), covered: frozenset[str] = frozenset()):
        self.trie = Trie([t for t, _ in terms], covered)
        self.counted = [self.trie.exact(t) if t in covered else i for i, (t, _) in enumerate(terms)]
        self.strength = [s for _, s in terms]
        self.ordinary = ordinary
        self.fuzzy = [t for t, _ in terms if not t.endswith("*") and edits_allowed(t)]
        self.known: dict[int, tuple[int, int]] = {}
        self.forms = Forms([t for t, _ in terms])

    def matches(self, block: Block) -> tuple[object, np.ndarray, np.ndarray, np.ndarray]:
        """The block's words; of each hit its word's index, term and edits. Each distinct word is looked up once."""
        found = words(block, ALNUM, lower=True)
        if not len(found.hashes) or not self.strength:
            return found, *(np.zeros(0, np.int64),) * 3
        distinct, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        data = block.data.tobytes().lower()
        pieces = [data[a:b] for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
        term, edits = np.full(len(pieces), -1), np.zeros(len(pieces), np.int64)
        if len(self.known) > KEPT:
            self.known.clear()
        for i in np.flatnonzero(self.forms.maybe(pieces)).tolist():
            key = int(distinct[i])
            if key not in self.known:
                word = pieces[i].decode("utf-8", "replace")
                t = self.trie.exact(word)
                t, e = (t, 0) if t >= 0 else self.trie.near(word) if word not in self.ordinary else (-1, 0)
                self.known[key] = (self.counted[t], e) if t >= 0 else (-1, 0)
            term[i], edits[i] = self.known[key]
        every = back.reshape(-1)
        at = np.flatnonzero(term[every] >= 0)
        return found, at, term[every][at], edits[every][at]

    def features(self, block: Block) -> np.ndarray:
        """Of each document: a constant; of its hits outside quotations, those of words (misspelled ones count less), of stems and of misspelled words alone, distinct terms, the largest strength and the share of words; and hits that are quoted."""
        found, at, terms, edits = self.matches(block)
        out = np.zeros((len(block), FEATURES))
        out[:, 0] = 1
        seen: dict[int, set[int]] = defaultdict(set)
        documents = np.searchsorted(found.first, at, "right") - 1
        for i, d, t, e in zip(at.tolist(), documents.tolist(), terms.tolist(), edits.tolist(), strict=True):
            a, b = int(block.offsets[d]), int(block.offsets[d + 1])
            if quoted(block.data, a, int(found.starts[i]), int(found.ends[i]), b):
                out[d, 7] += 1
                continue
            out[d, 2 if self.trie.terms[t].endswith("*") else 1] += MISSPELLED**e
            out[d, 3] += e > 0
            seen[d].add(t)
            out[d, 5] = max(out[d, 5], self.strength[t] * MISSPELLED**e)
        for d, s in seen.items():
            out[d, 4] = len(s)
        out[:, 6] = 200 * out[:, 1:3].sum(axis=1) / (20 + found.counts)
        for i in (1, 2, 3, 4, 6, 7):
            out[:, i] = np.log1p(out[:, i])
        out[:, 5] /= 4
        return out


def quoted(data: np.ndarray, low: int, start: int, end: int, high: int) -> bool:
    """Do quotation marks stand on both sides within the context window, or one before together with a word of reporting?"""
    before, after = data[max(low, start - CONTEXT) : start].tobytes(), data[end : min(high, end + CONTEXT)].tobytes()
    n, m = len(QUOTES.findall(before)), len(QUOTES.findall(after))
    return n % 2 == 1 and (m > 0 or bool(SPEECH.search(before.lower())))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


COUNTS = "term string, clean long, toxic long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that have a word, or words with a stem, summed by batch."""
    for batch in (b.slice(at, COUNTED_ROWS) for b in batches for at in range(0, b.num_rows, COUNTED_ROWS)):
        sums = (Counter(), Counter())
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            own = {w.decode("utf-8", "replace") for w in WORD.findall(text.as_py().encode().lower())}
            sums[toxic].update(own | {f"{w[:n]}*" for w in own for n in STEMS if len(w) > n})
        terms = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([x[t] for t in terms], pa.int64()) for x in sums)], names=["term", "clean", "toxic"])


def without_copies(train: DataFrame) -> DataFrame:
    """(text, toxic) of one training row of each label for each class of equal or near-equal texts."""
    rows = cut(train.select("text", "toxic").distinct().select(F.xxhash64("text", "toxic").alias("doc_id"), "text", "toxic"))
    classes = near_duplicates(rows).select("doc_id", "component_id")
    kept = rows.select("doc_id", "toxic").join(classes, "doc_id").groupBy("component_id", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return cut(rows.join(kept.select("doc_id"), "doc_id").select("text", "toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents that aren't held out, about `sample` at most by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(n)) < sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Words and stems that toxic documents have far more often than chance allows, given how many were tried. Copies count as one document.

    All such terms are kept; the bound on training rows bounds them, too.
    """
    single = without_copies(train)
    n = {r[0]: r[1] for r in single.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Lexicon([])
    counts = cut(single.mapInArrow(_counts, COUNTS).groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where("t >= 3"))
    counts = counts.withColumn("odds", F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1)))
    share = F.lit(toxic / (clean + toxic))
    seen = F.col("c") + F.col("t")
    gain = 2 * (F.col("t") * F.log(F.col("t") / (seen * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (seen * (1 - share)))).otherwise(0.0))
    tried = counts.count()
    best = counts.where("odds >= 2").withColumn("gain", gain).where(F.col("gain") > 2 * (np.log(max(tried, 2)) + 3)).orderBy(F.desc("gain"), "term").collect()
    rows = {r.term: r for r in best}
    covered = lambda t: any(f"{t[:k]}*" in rows and f"{t[:k]}*" != t and rows[f"{t[:k]}*"].odds >= rows[t].odds - 0.7 and rows[f"{t[:k]}*"].t > rows[t].t for k in STEMS)
    # covered stems go, as they only match exactly; covered words stay for misspelled ones
    whole = frozenset(t for t in rows if not t.endswith("*") and covered(t))
    kept = [(t, float(r.odds)) for t, r in sorted(rows.items()) if t in whole or not covered(t)]
    lexicon = Lexicon(kept, covered=whole)
    if not lexicon.fuzzy:
        return lexicon

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                found, at, _, edits = lexicon.matches(block)
                at = at[edits > 0]
                near = {block.data[a:b].tobytes().lower().decode("utf-8", "replace") for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.string())], names=["term"])

    ordinary = train.where("toxic = 0").select("text").mapInArrow(neighbours, "term string").distinct().collect()
    return Lexicon(kept, frozenset(r[0] for r in ordinary), whole)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the constant isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
        for block in blocks(texts):
            yield block.rows, 1 / (1 + np.exp(-np.clip(self.lexicon.features(block) @ self.weights, -30, 30)))


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """Terms and weights from labelled rows that aren't held out. Without rows of both labels, all scores are 0.5 or less."""
    train = cut(training_rows(docs, labels, sample))
    lexicon = learn_lexicon(train)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                x = lexicon.features(block)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch["toxic"][block.rows]], names=["x", "toxic"])

    rows = train.select("text", "toxic").mapInArrow(featured, "x array<double>, toxic int").toPandas()
    if not len(rows):
        return Model(lexicon, np.zeros(FEATURES))
    # the sums don't depend on the order in which tasks end
    x, y = np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    return Model(lexicon, np.round(fit_weights(x[order], y[order]), 6))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from its whole text alone.

    Null and empty texts get the score of a text without hits. A null doc_id isn't held out.
    Repeated documents get a row each; an empty table gives no rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in shared.value.scores(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"][part], batch["held_out"][part], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in shared.value.scores(batch["text"]):
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(s < threshold))

    return docs.mapInArrow(clean, docs.schema)
