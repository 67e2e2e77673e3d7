"""The exchange under substring dedup and suffix-array dedup: equal windows of a corpus meet, and only those.

A window is k consecutive symbols (words or bytes) of one document. A rolling hash picks a
trigger in each window, its smallest m-gram, so equal windows have equal triggers. Consecutive
windows that share a trigger form a phrase: k - 1 symbols more than it has windows.

1. Documents are dealt evenly to blocks (the one shuffle of text; later steps reuse it).
2. Each block sends, to buckets of the hash space, its triggers' hashes cut to a few bytes.
3. A bucket marks the hashes that may repeat and tells each block, one bit a hash.
4. Blocks send the distinct phrases of marked triggers, packed by bucket and compressed, each with
   its first document; a group of copies in a block sends one of them.
5. A bucket orders the windows of its distinct phrases, by sorting their words, or for bytes by
   the corpus order of a prefix-free parse (prefixfree.py), and answers with one bit a window: does
   an equal one start earlier than in the phrase's first document?
6. Blocks hand the bits to all occurrences of each phrase and cut the windows out.

What a task holds is a block or a bucket, whose sizes are parameters. Marks are only a filter:
a hash marked by chance costs work and never changes the result. Triggers found in very many
blocks send single windows to buckets of their own, so no bucket gathers a hot trigger's phrases.
Equality is always told by bytes, inside blocks and in buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACED, Block, Rolling, blocks, chained, inside_documents, mix, sliding_argmin, words
from .groups import settled
from .prefixfree import equal_strings, parse


@dataclass(frozen=True)
class Rule:
    """words: symbols are words, else bytes. within: an earlier start in the same document counts as earlier, too."""

    words: bool
    window: int
    gram: int
    within: bool
    block_bytes: int = 2 << 20
    bucket_bytes: int = 6 << 20
    hot_blocks: int = 2_000


@dataclass
class Symbols:
    """A block's symbols: first (of every document, its first symbol's index), windows' and m-grams' hashes, and symbols' bytes."""

    first: np.ndarray
    grams: np.ndarray
    window_hashes: Callable[[np.ndarray], np.ndarray]
    starts: np.ndarray
    ends: np.ndarray


def symbols(block: Block, rule: Rule) -> Symbols:
    if rule.words:
        found = words(block, SPACED)
        rolling = Rolling(found.hashes)
        return Symbols(found.first, chained(found.hashes, rule.gram), lambda at: mix(rolling.spans(at, at + rule.window)), found.starts, found.ends)
    rolling = Rolling(block.data)
    return Symbols(block.offsets, mix(rolling.windows(rule.gram)), lambda at: mix(rolling.spans(at, at + rule.window)), np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Phrases:
    """start: of the first window; n: windows; trigger: hash; document: its index in the block."""

    start: np.ndarray
    n: np.ndarray
    trigger: np.ndarray
    document: np.ndarray


def phrases(s: Symbols, rule: Rule) -> Phrases:
    at = sliding_argmin(s.grams, rule.window - rule.gram + 1)
    whole = inside_documents(s.first, rule.window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none.astype(np.uint64), none)
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    end = whole.copy()
    end[:-1] &= (at[1:] != at[:-1]) | ~whole[1:]
    start = np.flatnonzero(new)
    # smallest hashes are small numbers: mixed again, they spread over the buckets
    return Phrases(start, np.flatnonzero(end) + 1 - start, mix(s.grams[at[start]]), np.searchsorted(s.first, start, "right") - 1)


def _block_of(table: pa.Table) -> tuple[Block, np.ndarray]:
    """The group's documents in the order of `row`, as one block, and their doc keys."""
    table = table.combine_chunks().sort_by("row")
    texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    docs = table["doc"].to_numpy()
    found = list(blocks(texts, 1 << 62))
    return (found[0] if found else Block(np.zeros(0, np.uint8), np.zeros(1, np.int64), slice(0, 0))), docs


@dataclass
class Sketch:
    """A block's distinct trigger hashes in order, with each one's bucket; several: those that repeat inside the block."""

    hashes: np.ndarray
    several: np.ndarray
    bounds: np.ndarray


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash space, in the hashes' order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def sketch(p: Phrases, docs: np.ndarray, rule: Rule, buckets: int) -> Sketch:
    if rule.within:
        hashes, n = np.unique(p.trigger, return_counts=True)
        several = n > 1
    else:  # a hash of one document only isn't shared
        order = np.argsort(p.trigger, kind="stable")
        t, d = p.trigger[order], docs[p.document[order]]
        hashes, at = np.unique(t, return_index=True)
        several = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    return Sketch(hashes, several, np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1)))


def _binary(name: str) -> tuple[str, pa.DataType]:
    return name, pa.binary()


MARKS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), _binary("hashes"), _binary("several")])
#: What a bucket tells a block: of its hashes which are shared and hot, or (answer) which windows of its phrases go.
BACK = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("answer", pa.bool_()), _binary("one"), _binary("two")])
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), _binary("numbers"), _binary("data")])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def _restore(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _pack_hashes(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray((h >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_hashes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def mark_triggers(rule: Rule, buckets: int, width: int):
    def marks(key: tuple, table: pa.Table) -> pa.Table:
        block, docs = _block_of(table)
        k = sketch(phrases(symbols(block, rule), rule), docs, rule, buckets)
        rows = []
        for b in np.flatnonzero(np.diff(k.bounds)).tolist():
            part = slice(k.bounds[b], k.bounds[b + 1])
            rows.append((b, key[0].as_py(), _pack_hashes(k.hashes[part], width), np.packbits(k.several[part]).tobytes()))
        return _table(rows, MARKS)

    return marks


def shared_triggers(rule: Rule, width: int):
    def shared(key: tuple, table: pa.Table) -> pa.Table:
        packed = [_unpack_hashes(b.as_py(), width) for b in table["hashes"]]
        sizes = np.array([len(x) for x in packed])
        every = np.concatenate(packed)
        several = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n) for b, n in zip(table["several"], sizes.tolist(), strict=True)])
        order = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order[1:]] != every[order[:-1]]
        group = np.cumsum(new) - 1
        n = np.bincount(group)
        some = np.maximum.reduceat(several[order], np.flatnonzero(new)) > 0
        is_shared, is_hot = np.empty(len(every), bool), np.empty(len(every), bool)
        is_shared[order] = ((n > 1) | some)[group]
        is_hot[order] = (n > rule.hot_blocks)[group]
        ends = np.cumsum(sizes)
        rows = []
        for block, a, b in zip(table["block"].to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            if is_shared[a:b].any():
                rows.append((block, key[0].as_py(), False, np.packbits(is_shared[a:b]).tobytes(), np.packbits(is_hot[a:b]).tobytes() if is_hot[a:b].any() else b""))
        return _table(rows, BACK)

    return shared


@dataclass
class Entries:
    """A block's marked phrases. phrases: every occurrence; entry: which of the entries it is, or -1 if the block itself tells that all its windows start earlier.

    texts, doc, row, start, n, sub of the entries, in the order in which bucket after bucket gets
    them; bounds: each bucket's part. sub: 16 bits that equal windows' triggers share.
    """

    phrases: Phrases
    entry: np.ndarray
    texts: list[bytes]
    doc: np.ndarray
    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    sub: np.ndarray
    bounds: np.ndarray


def entries(block: Block, docs: np.ndarray, s: Symbols, rule: Rule, buckets: int, marks: pa.Table) -> Entries:
    """marks: what buckets told of this block's hashes."""
    p = phrases(s, rule)
    k = sketch(p, docs, rule, buckets)
    shared, hot = np.zeros(len(k.hashes), bool), np.zeros(len(k.hashes), bool)
    for b, bits, hots in zip(marks["bucket"].to_pylist(), marks["one"].to_pylist(), marks["two"].to_pylist(), strict=True):
        part = slice(k.bounds[b], k.bounds[b + 1])
        n = part.stop - part.start
        shared[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        if hots:
            hot[part] = np.unpackbits(np.frombuffer(hots, np.uint8), count=n)
    at = np.searchsorted(k.hashes, p.trigger)
    keep = shared[at] if len(at) else np.zeros(0, bool)
    is_hot = hot[at][keep] if len(at) else keep
    p = Phrases(p.start[keep], p.n[keep], p.trigger[keep], p.document[keep])
    if is_hot.any():  # single windows, each to a bucket of its own content
        one = Phrases(p.start[is_hot], p.n[is_hot], p.trigger[is_hot], p.document[is_hot])
        start = np.repeat(one.start, one.n) + np.arange(one.n.sum()) - np.repeat(np.cumsum(one.n) - one.n, one.n)
        own = mix(np.repeat(one.trigger, one.n) ^ s.window_hashes(start))
        rest = Phrases(*(x[~is_hot] for x in (p.start, p.n, p.trigger, p.document)))
        p = Phrases(np.append(rest.start, start), np.append(rest.n, np.ones(len(start), np.int64)), np.append(rest.trigger, own), np.append(rest.document, np.repeat(one.document, one.n)))
    data = block.data.tobytes()
    if rule.words:
        texts = [b" ".join(data[x:y].split()) for x, y in zip(s.starts[p.start].tolist(), s.ends[p.start + p.n + rule.window - 2].tolist(), strict=True)]
    else:
        texts = [data[x:y] for x, y in zip(p.start.tolist(), (p.start + p.n + rule.window - 1).tolist(), strict=True)]
    ids: dict[bytes, int] = {}
    text = np.array([ids.setdefault(t, len(ids)) for t in texts], np.int64)
    # an equal phrase that stands earlier in this block settles all windows of a later one
    doc = docs[p.document]
    order = np.lexsort((p.start, p.document, doc, text))
    head = order[np.flatnonzero(np.diff(text[order], prepend=-1))][text] if len(order) else order
    settled = doc > doc[head]
    if rule.within:
        own = np.ones(len(order), bool)
        own[1:] = (text[order[1:]] != text[order[:-1]]) | (p.document[order[1:]] != p.document[order[:-1]])
        repeated = np.zeros(len(order), bool)
        repeated[order] = ~own
        settled |= repeated
        lead = np.flatnonzero(~settled)
        entry = np.where(settled, -1, np.cumsum(~settled) - 1)
    else:
        lead = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
        entry = np.where(settled, -1, text)
    bucket = bucket_of(p.trigger[lead], buckets)
    sub = ((p.trigger[lead] >> np.uint64(32)) * np.uint64(buckets) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)
    sent = np.lexsort((sub, bucket))
    place = np.empty(len(lead), np.int64)
    place[sent] = np.arange(len(lead))
    lead = lead[sent]
    entry = np.where(entry < 0, -1, place[entry]) if len(place) else entry
    return Entries(p, entry, [texts[i] for i in lead.tolist()], doc[lead], p.document[lead], (p.start - s.first[p.document])[lead], p.n[lead], sub[sent], np.searchsorted(bucket[sent], np.arange(buckets + 1)))


#: Numbers that travel with an entry; the last two only where earlier starts in the same document count.
NUMBERS = {"sub": "<u2", "doc": "<i8", "size": "<u4", "row": "<u4", "start": "<u4"}


def _numbers(rule: Rule) -> dict[str, str]:
    return dict(list(NUMBERS.items())[: 5 if rule.within else 3])


def send_phrases(rule: Rule, buckets: int):
    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, docs = _block_of(left)
        e = entries(block, docs, symbols(block, rule), rule, buckets, right)
        columns = {"sub": e.sub, "doc": e.doc, "size": np.array([len(t) for t in e.texts]), "row": e.row, "start": e.start}
        rows = []
        for b in np.flatnonzero(np.diff(e.bounds)).tolist():
            part = slice(e.bounds[b], e.bounds[b + 1])
            numbers = b"".join(columns[c][part].astype(kind).tobytes() for c, kind in _numbers(rule).items())
            rows.append((b, key[0].as_py(), part.stop - part.start, _squeeze(numbers), _squeeze(b"".join(e.texts[part]))))
        return _table(rows, SENT)

    return send


def _flat(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every item of lists of these sizes, its list and its place in it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def late_words(texts: list[bytes], n: np.ndarray, doc: np.ndarray, place: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """For every window of words of the entries: does an equal one start earlier? Windows are sorted by their words and compared word by word."""
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t.split(b" ")], ">u4")
    length = n + window - 1
    of, inner = _flat(n)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, window)[(np.cumsum(length) - length)[of] + inner])
    at = start[of] + inner
    base = np.lexsort((at, place[of], doc[of]))
    values = rows.view(f"V{rows.shape[1] * rows.itemsize}").reshape(-1)
    order = base[np.argsort(values[base], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = doc[of[order]] > doc[of[head]]
    before = np.roll(order, 1)
    late |= ~new & (place[of[order]] == place[of[before]]) & (at[order] > at[before])
    out = np.zeros(len(order), bool)
    out[order] = late
    return out


def late_bytes(texts: list[bytes], n: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For every string of the entries' bytes: does an equal one start in a document of a smaller number? The corpus order of a prefix-free parse brings equal ones together."""
    of, inner = _flat(n)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    string = equal_strings(parse(texts), (np.cumsum(sizes) - sizes)[of] + inner, window)
    least = np.full(int(string.max()) + 1 if len(string) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc[of])
    return least[string] < doc[of]


def settle(rule: Rule, most: int = 100_000):
    """A bucket's answers. Entries are taken in batches of about `most` windows whose triggers differ, so that a large bucket needs no more memory."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        kinds, parts, texts = _numbers(rule), [], []
        counts = table["n"].to_pylist()
        for n, packed, data in zip(counts, table["numbers"], table["data"], strict=True):
            raw, at, own = _restore(packed.as_py()), 0, {}
            for c, kind in kinds.items():
                own[c] = np.frombuffer(raw, kind, n, at).astype(np.int64)
                at += own[c].nbytes // 8 * np.dtype(kind).itemsize
            parts.append(own)
            data, ends = _restore(data.as_py()), np.cumsum(own["size"]).tolist()
            texts += [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        v = {c: np.concatenate([p[c] for p in parts]) for c in kinds}
        n = np.array([t.count(b" ") + 1 for t in texts] if rule.words else v["size"], np.int64) - rule.window + 1
        place = np.repeat(np.array(table["block"].to_pylist(), np.int64), counts) << 32
        if rule.within:
            place |= v["row"]
        base = np.append(0, np.cumsum(n))
        gone = np.zeros(int(base[-1]), bool)
        order = np.argsort(v["sub"], kind="stable")
        edges = np.append(np.flatnonzero(np.diff(v["sub"][order], prepend=-1)), len(order))
        cost = np.append(0, np.cumsum(n[order]))
        low = 0
        while low < len(edges) - 1:
            high = max(low + 1, int(np.searchsorted(cost[edges[low + 1 :]], cost[edges[low]] + most, "right")) + low)
            own = order[edges[low] : edges[high]]
            flags = _late(own, v, n, place, texts, rule)
            of, inner = _flat(n[own])
            gone[(base[own][of] + inner)[flags]] = True
            low = high
        rows, ends = [], np.cumsum(counts).tolist()
        for block, a, z in zip(table["block"].to_pylist(), [0, *ends], ends, strict=False):
            bits = gone[base[a] : base[z]]
            if bits.any():
                rows.append((block, key[0].as_py(), True, _squeeze(np.packbits(bits).tobytes()), b""))
        return _table(rows, BACK)

    return answer


def _late(i: np.ndarray, v: dict[str, np.ndarray], n: np.ndarray, place: np.ndarray, texts: list[bytes], rule: Rule) -> np.ndarray:
    """For every window of these entries in turn: does an equal one start earlier?"""
    ids: dict[bytes, int] = {}
    text = np.array([ids.setdefault(texts[j], len(ids)) for j in i.tolist()], np.int64)
    doc, places = v["doc"][i], place[i]
    start = v["start"][i] if rule.within else np.zeros(len(i), np.int64)
    order = np.lexsort((start, places, doc, text))
    first = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
    whole = doc > doc[first][text]
    if rule.within:
        again = np.zeros(len(i), bool)
        again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (places[order[1:]] == places[order[:-1]]) & (start[order[1:]] > start[order[:-1]])
        whole |= again
    flags = np.repeat(whole, n[i])
    # only triggers with several distinct phrases hold windows that others may hold, too
    sub = v["sub"][i]
    groups, back = np.unique(sub[first], return_inverse=True)
    several = np.bincount(back.reshape(-1)) > 1
    todo = np.flatnonzero(~whole & several[np.searchsorted(groups, sub)]) if rule.within else first[several[back.reshape(-1)]]
    if len(todo):
        some = [texts[j] for j in i[todo].tolist()]
        if rule.words:
            late = late_words(some, n[i[todo]], doc[todo], places[todo], start[todo], rule.window)
        else:
            late = late_bytes(some, n[i[todo]], doc[todo], rule.window)
        # an entry that isn't settled whole has its own answer, or that of its text
        base = np.full(len(i), -1, np.int64)
        base[todo] = np.cumsum(n[i[todo]]) - n[i[todo]]
        if not rule.within:
            base = base[first][text]
        rest = np.flatnonzero(~whole & (base >= 0))
        of, inner = _flat(n[i[rest]])
        begin = np.cumsum(n[i]) - n[i]
        flags[begin[rest][of] + inner] = late[base[rest][of] + inner]
    return flags


def cut_runs(rule: Rule, buckets: int, finish: Callable[[Block, Symbols, np.ndarray, pa.Table], pa.Table]):
    """finish: gets a block, its symbols, for each symbol whether it goes, and the block's rows."""

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, docs = _block_of(left)
        s = symbols(block, rule)
        late = np.zeros(int(s.first[-1]) + 1, bool)
        if right.num_rows:
            e = entries(block, docs, s, rule, buckets, right.filter(pc.invert(right["answer"])))
            base = np.append(0, np.cumsum(e.n))
            gone = np.zeros(int(base[-1]), bool)
            answers = right.filter(right["answer"])
            for b, bits in zip(answers["bucket"].to_pylist(), answers["one"], strict=True):
                a, z = base[e.bounds[b]], base[e.bounds[b + 1]]
                gone[a:z] = np.unpackbits(np.frombuffer(_restore(bits.as_py()), np.uint8), count=int(z - a))
            of, inner = _flat(e.phrases.n)
            own = e.entry[of]
            flags = own < 0
            flags[~flags] = gone[base[own[~flags]] + inner[~flags]]
            late[(e.phrases.start[of] + inner)[flags]] = True
        counts = np.append(np.zeros(rule.window, np.int32), np.cumsum(late[:-1], dtype=np.int32))
        return finish(block, s, counts[rule.window :] > counts[: len(counts) - rule.window], left.sort_by("row"))

    return apply


def remove_repeats(docs: DataFrame, rule: Rule, finish, schema: str) -> DataFrame:
    """What `finish` makes of each block of documents, once windows that start earlier elsewhere are known.

    Documents stand in doc_id's order, null last; rows that share a doc_id are documents of their
    own of which none is smaller, and a null text is empty.
    """
    last = F.lit(2**63 - 1)
    docs = settled(docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    n_blocks = -(-size // rule.block_bytes)
    buckets = -(-size // rule.bucket_bytes)
    width = min(8, -(-(max(20, int(size).bit_length()) + 10) // 8))
    base = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    by_block = base.groupBy("block")
    marks = by_block.applyInArrow(mark_triggers(rule, buckets, width), _ddl(MARKS))
    shared = marks.groupBy("bucket").applyInArrow(shared_triggers(rule, width), _ddl(BACK))
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_phrases(rule, buckets), _ddl(SENT))
    back = shared.unionByName(sent.groupBy("bucket").applyInArrow(settle(rule), _ddl(BACK)))
    return by_block.cogroup(back.groupBy("block")).applyInArrow(cut_runs(rule, buckets, finish), schema)
