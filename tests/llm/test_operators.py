"""Each operator against brute force on a small table of hard rows, and on no rows at all."""

import dataclasses
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkshelf.llm import decontamination, embeddings, mixing, neardup, prefixfree, sharding, substrings, suffixes, tokens, toxicity, warc
from sparkshelf.llm.blocks import SPACED, blocks, words
from sparkshelf.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, block int, row string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make_rows():
    """Nulls, empty and blank texts, copies, near copies, a shared passage, a long text and repeated rows, beside columns whose names operators use, too."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = text(40), text(120).split()
    out = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, passage), (7, passage), (8, "Ä! " + passage + "\n" + passage), (9, text(3000)), (None, text(30)), (None, passage)]
    for i in range(10, 30):
        near = list(base)
        for _ in range(r.randint(0, 4)):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        out.append((i, r.choice([" ", "  ", "\n"]).join(near)))
    out += [(i, text(r.randint(1, 200)) + " " + " ".join(passage.split()[: r.randint(0, 40)]) + " " + text(5)) for i in range(30, 60)]
    out += [(60, text(25) + " x " + passage), (60, text(25) + " x " + passage), (6, passage)]
    return [(i, t, "en", r.choice(["a", "b", "ü", "c", None]), len(t or ""), "clash", 7, "clash") for i, t in out]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        size = min(window, len(x))
        for a in range(len(x) - size + 1) if i is not None and x else ():
            for b in range(len(w) - size + 1):
                if w[b : b + size] == x[a : a + size]:
                    hit |= set(range(b, b + size))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("part_bytes", "pairs"), [(1 << 24, 1 << 20), (200, 1 << 20), (1 << 24, 5)])
def test_decontamination(spark, docs, rows, none, monkeypatch, part_bytes, pairs):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    passage = rows[5][1].split()
    items = [(1, " ".join(passage[3:25])), (2, "ONE, Two"), (10, " ".join(passage[8:19])), (3, None), (4, ""), (5, "zzz"), (None, rows[5][1]), (1, rows[3][1]), (2, "ONE, Two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = as_counter(decontamination.contamination_report(docs, bench))
    assert got == Counter((i, *brute_hits(t, items)) for i, t, *_ in rows)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and as_counter(kept) == Counter(r for r in rows if not brute_hits(r[1], items)[1])
    assert decontamination.contamination_report(none, bench).count() == 0
    assert not decontamination.contamination_report(docs, bench.limit(0)).where("contaminated").count()


def test_words_that_sums_of_powers_confuse(spark):
    """Whole operators on words that a polynomial hash can't tell apart."""
    a, b = thue_morse("a", "b")
    docs = spark.createDataFrame([(1, f"{a} x y {b}"), (2, f"{b} x y {a}"), (3, f"{a} x y {b}"), (4, f"{a} x"), (5, f"{b} x")], "doc_id long, text string")
    hits = decontamination.contamination_report(docs, spark.createDataFrame([(7, f"{a} x")], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in hits.collect()} == {1: 2, 2: 0, 3: 2, 4: 2, 5: 0}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    got = substrings.remove_repeated_words(docs, 2, substrings.rule(2, 1)).collect()
    assert Counter(tuple(r) for r in got) == brute_words([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f y c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "b c d e f q")], "item_id long, text string")
    found = decontamination.match_benchmark(docs, bench, window=3).first().matches
    assert {tuple(m) for m in found} == {(9, 2, 0, 5), (9, 8, 1, 4)}


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a.b.com/x?q=1", big), (2, "http://a.b.com/x", big), (9, None, big), (4, "http://a.b.com/x", None), (5, "x", "same"), (6, "https://u@c.de:80/é\t\n#f", "same"), (None, "http://z", big), (9, None, big), (10, "http://z", "long " * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and i != 9
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)] += 1
    assert as_counter(warc.round_trip(pages)) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_index_bisects(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/p/{i % 50}", f"page {i}") for i in range(300)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=4_000)
    warc.write_index(spark, path, block_lines=9)
    asked = pages.where("page_id % 3 = 0").unionByName(spark.createDataFrame([(1, "http://nowhere/", "")], "page_id long, url string, html string"))
    found = warc.look_up(spark, path, asked.select("url", "page_id"))
    assert sorted(r.page_id for r in found.collect()) == list(range(0, 300, 3))
    assert warc.surt("http://U@www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"


def test_warc_reads_ranges_of_files_bounded_by_bytes(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    rows = [(i, None if i % 5 == 0 else f"http://h{i % 3}/", None if i % 7 == 0 else r.randbytes(r.randint(0, 3000)).hex()) for i in range(400)] + [(400, "http://big/", r.randbytes(400_000).hex())]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, file_bytes=50_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w" / "archive").rglob("part-*")]
    assert len(sizes) > 10 and sorted(sizes)[-2] <= 50_000
    warc.write_index(spark, f"file:{path}", block_lines=20)
    found = warc.look_up(spark, path, spark.createDataFrame([(u, i) for i, u, _ in rows if i % 3 == 0], "url string, page_id long"))
    got = warc.read_captures(spark, f"file://{path}", found, stretch=20_000).collect()
    assert Counter((x.page_id, x.payload_bytes) for x in got) == Counter((i, len(h or "")) for i, _, h in rows if i % 3 == 0)
    asked = [(0, 10), (10, 20), (50_000, 5), (50_005, 2_000_000), (2_060_000, 1)]
    assert [(a, n) for a, n, *_ in warc._ranges(asked)] == [(0, 30), (50_000, 5), (50_005, 2_000_000), (2_060_000, 1)]


def test_warc_hot_url_opens_a_block_once():
    lines = sorted([("k", None, 7), *(("k", i // 2, i) for i in range(400)), ("l", 5, 1)], key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    parts = [lines[a : a + 10] for a in range(0, len(lines), 10)]
    line = lambda x: warc._line({"key": x[0], "page_id": x[1], "record_type": "response", "file": "f", "offset": x[2], "length": 1})
    packed = ["\n".join(map(line, p)).encode() for p in parts]
    opened = []
    shard = warc.Shard([warc._place(*p[0][:2]) for p in parts], lambda at: opened.append(at) or packed[at])
    once = list(dict.fromkeys(x[:2] for x in lines))
    got = [(i, int(f[4])) for k, i in once for f in shard.find(warc._place(k, i))]
    assert Counter(got) == Counter(x[1:] for x in lines)
    assert len(opened) <= 2 * len(parts)


def test_warc_lookup_reads_the_directory_and_one_block(spark, tmp_path):
    """All blocks but those that may hold the URL are spoiled: who reads another one fails."""
    pages = spark.createDataFrame([(i, f"http://h{i:04}.org/", f"page {i}") for i in range(3000)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=20_000)
    warc.write_index(spark, path, block_lines=10, shard_lines=600)
    directory = spark.read.parquet(f"{path}/index/directory").orderBy("shard", "block").collect()
    assert len({r.shard for r in directory}) >= 5 and len(directory) >= 300 and sum(r.lines for r in directory) == 3000
    for f in {r.file for r in directory}:
        whole = (tmp_path / "w" / "index" / "blocks" / f).read_bytes()
        assert len(whole) == sum(r.length for r in directory if r.file == f)
    key = warc.surt("http://h1234.org/")
    (own,) = [i for i, r in enumerate(directory) if r.first_key <= key and (i + 1 == len(directory) or key < directory[i + 1].first_key)]
    for i, r in enumerate(directory):
        if i not in (own - 1, own):
            with open(tmp_path / "w" / "index" / "blocks" / r.file, "r+b") as f:
                f.seek(r.offset)
                f.write(b"x" * r.length)
    found = warc.look_up(spark, path, spark.createDataFrame([("http://h1234.org/", 1234)], "url string, page_id long"))
    assert [r.page_id for r in found.collect()] == [1234]


def test_warc_hot_url_is_dealt_by_page(spark, tmp_path):
    pages = spark.createDataFrame([(i % 250 if i else None, None if i % 2 else "http://h/", f"page {i}") for i in range(600)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=5_000)
    with_conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        warc.write_index(spark, path, block_lines=9)
        asked = pages.select("url", "page_id")
        found = warc.look_up(spark, path, asked).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(r.page_id for r in found) == Counter(r.page_id for r in asked.collect()) and len({(r.file, r.offset) for r in found}) == 600


def sets_of(rows, size):
    out = []
    for i, t, *_ in rows:
        w = lower(t).encode().split()
        out.append((i, frozenset(tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def brute_components(sets, percent):
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


@pytest.mark.parametrize(("size", "percent", "blocks"), [(3, 85, 4096), (5, 80, 4096), (3, 85, 3)])
def test_near_duplicates(docs, rows, none, size, percent, blocks):
    got = neardup.near_duplicates(docs, size, percent, list_rows=blocks, group_rows=blocks)
    assert as_counter(got) == brute_components(sets_of(rows, size), percent)
    assert neardup.near_duplicates(none).count() == 0


def near_copies(seed, n, groups):
    """n documents in clusters of near copies, with chains between some, and documents that share a common opening."""
    r = random.Random(seed)
    opening = [f"o{k}" for k in range(30)]
    bases = [[f"b{g}_{k}" for k in range(110)] for g in range(groups)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        out.append((i, " ".join(w if i % 3 else opening + [f"u{i}_{k}" for k in range(20)])))
    return out


@pytest.mark.parametrize(("seed", "groups", "most"), [(1, 1, 16), (2, 5, 16), (3, 2, 7)])
def test_large_groups_are_contracted_by_pivots(spark, seed, groups, most):
    rows = near_copies(seed, 150, groups)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, list_rows=most, group_rows=most)
    assert as_counter(got) == brute_components(sets_of(rows, 3), 85)


def test_dropping_near_duplicates_with_repeated_ids(spark):
    """Rows of one doc_id with unlike texts both stay; clashing column names stay as they are."""
    text = lambda lead: " ".join(f"{lead}{k}" for k in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("a")), (3, text("b") + " more"), (4, text("c")), (4, text("c")), (5, None), (5, ""), (None, text("a"))]
    docs = spark.createDataFrame([(*x, "k", "p", i) for i, x in enumerate(rows)], "doc_id long, text string, _kept string, _place string, node long")
    for table, want in ((docs, [(1, text("a")), (1, text("b")), (4, text("c")), (5, None), (5, ""), (None, text("a"))]), (docs.where("node in (0, 2, 3, 4, 6)"), [(1, text("a")), (3, text("b") + " more"), (4, text("c")), (5, None)])):
        kept = neardup.drop_near_duplicates(table, 5, 80)
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_keep_chains(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [(100 - i, " ".join(words[6 * i : 6 * i + 120])) for i in range(40)]  # neighbours are alike, ends aren't
    got = neardup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 3, 85)
    assert {r.component_id for r in got.collect()} == {61}


def brute_kept(rows, percent, size):
    """One row of each component; rows are documents of their own, also those that share a doc_id, but for equal ones."""
    distinct = list(dict.fromkeys((i, t) for i, t, *_ in rows if i is not None))
    numbered = [(n, t) for n, (_, t) in enumerate(sorted(distinct, key=lambda x: x[0]))]
    ids = [i for i, _ in sorted(distinct, key=lambda x: x[0])]
    return Counter([ids[n] for n, _, _, kept in brute_components(sets_of(numbered, size), percent) if kept] + [None for i, *_ in rows if i is None])


def test_dropping_near_duplicates_keeps_columns(docs, rows):
    kept = neardup.drop_near_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns
    want = brute_kept(rows, 80, 5)
    assert Counter(r.doc_id for r in kept.collect()) == want and want[None] == 2 and want[60] == 2


def test_least_matches():
    assert neardup.least_matches(20, 0.85) == 6 and neardup.least_matches(48, 0.85) > 20


def brute_words(rows, k):
    """Rows that share a doc_id are documents of their own, of which none is earlier."""
    at = defaultdict(list)
    cut = [(2**63 - 1 if i is None else i, n, (t or "").encode().split()) for n, (i, t, *_) in enumerate(rows)]
    for i, n, w in cut:
        for a in range(len(w) - k + 1):
            at[tuple(w[a : a + k])].append((i, n, a))
    out = Counter()
    for (i, n, w), (own, *_) in zip(cut, rows, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if any(j < i or (m == n and b < a) for j, m, b in at[tuple(w[a : a + k])]):
                gone[a : a + k] = [True] * k
        out[(own, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())] += 1
    return out


def brute_bytes(rows, k):
    first = {}
    cut = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in cut:
        for a in range(len(b) - k + 1):
            first[b[a : a + k]] = min(i, first.get(b[a : a + k], i))
    out = Counter()
    for (i, b), (own, *_) in zip(cut, rows, strict=True):
        gone = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if first[b[a : a + k]] < i:
                gone[a : a + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[(own, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    return out


SMALL = {"block_bytes": 1500, "bucket_bytes": 2500}


@pytest.mark.parametrize("more", [{}, SMALL, SMALL | {"hot_blocks": 1}])
def test_repeated_words(docs, rows, none, more):
    got = substrings.remove_repeated_words(docs, rules=dataclasses.replace(substrings.rule(), **more))
    assert as_counter(got) == brute_words(rows, 20)
    assert substrings.remove_repeated_words(none).count() == 0


@pytest.mark.parametrize("more", [{}, SMALL, SMALL | {"hot_blocks": 1}])
def test_repeated_bytes(docs, rows, none, more):
    got = suffixes.remove_repeated_bytes(docs, rules=dataclasses.replace(suffixes.rule(), **more)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_bytes(rows, 50)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert suffixes.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_prefix_free_parse_orders_all_suffixes(seed):
    r = random.Random(seed)
    length, alphabet = r.choice([1, 3, 8, 9, 20, 50]), "ab\0é"[: r.randint(1, 4)]
    base = "".join(r.choice(alphabet) for _ in range(300)).encode()
    strings = [base[a : a + r.randint(0, 99)] if r.random() < 0.8 else bytes(r.choice(b"abc") for _ in range(r.randint(0, 80))) for a in (r.randrange(200) for _ in range(r.randint(1, 30)))]
    p = prefixfree.parse(strings, r.choice([2, 4]), r.choice([1, 2, 5, 12]))
    begins = np.append(0, np.cumsum([len(s) + 1 for s in strings]))
    at = np.array([b + i for b, s in zip(begins, strings, strict=False) for i in range(len(s) - length + 1)], np.int64)
    cut = [bytes(p.data[a : a + length]) for a in at]
    ranks = prefixfree.corpus_ranks(p, length)[at]
    assert [cut[i] for i in np.argsort(ranks, kind="stable")] == sorted(cut)
    assert len(set(zip(cut, prefixfree.equal_strings(p, at, length).tolist(), strict=True))) == len(set(cut)) == len(set(prefixfree.equal_strings(p, at, length).tolist()))


def thue_morse(a, b, n=2048):
    """Two words of n letters that sums of powers modulo 2**64 can't tell apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_collide_in_sums_of_powers():
    (block,) = blocks(pa.array([" ".join(thue_morse("a", "b")), "ab abc abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq a\0 a"]))
    assert len(set(words(block, SPACED).hashes.tolist())) == 10


def jump(key, shards):
    """As published."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, rows, none):
    got = sharding.shard_documents(docs, 16).collect()
    text = lambda t: (t or "").encode()
    key = lambda i: -1 if i is None else i
    want = Counter((i, len(text(t)) + 1, zlib.crc32(text(t)), "key", jump(key(i), 16), jump(key(i), 17)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(none).count() == 0
    keys = spark.createDataFrame([(k,) for k in (0, -1, 2**63 - 1, -(2**63), *range(1, 500))], "k long")
    assert all(r.s == jump(r.k, 97) and (r.t == r.s or r.t == 97) for r in keys.select("k", sharding.jump_shard(F.col("k"), 97).alias("s"), sharding.jump_shard(F.col("k"), 98).alias("t")).collect())


def test_mixing(docs, rows, none):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows) and Counter(tuple(r) for r in got) == as_counter(mixing.mix_documents(docs))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.fill_targets([sizes[s] for s in order], [1, 2, 3, 1, 2]), strict=True))
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    plan = mixing.mix_plan(docs).select("row.source", "size", "source_size", "target", "taken", "shard_of").collect()
    for s in order:
        own = [r for r in plan if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-9 for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= 0.5
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_order"]
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_documents(none).count() == 0


def brute_targets(sizes, weights):
    """The level at which min(3 * size, level * weight) adds up to all sizes, by bisection."""
    low, high = 0.0, 3.0 * (sum(sizes) + 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * s, level * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (low, level)
    return [min(3 * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_mixing_by_brute_force(spark):
    """Targets, words taken and every shard's draws, from sizes and the rule alone."""
    r = random.Random(8)
    rows = [(i, r.choice("aaaaaabbcd"), " ".join("w" for _ in range(r.randint(0, 40)))) for i in range(2000)]
    rows += [(i, None, "x y") for i in range(2000, 2010)]
    got = {x.doc_id: x for x in mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), 8).collect()}
    order = ["a", "b", "c", "d", None]
    sizes = [sum(len(t.split()) for _, s, t in rows if s == o) for o in order]
    want = brute_targets(sizes, [1, 2, 3, 1, 2])
    draws = Counter()
    for o, size, target in zip(order, sizes, want, strict=True):
        own = [(got[i], len(t.split())) for i, s, t in rows if s == o]
        assert all(x["size"] == n and x.source_size == size and abs(x.target - target) < 1e-6 * (1 + target) for x, n in own)
        assert abs(sum(x.taken for x, _ in own) - target) <= 0.5 + 1e-6 * target
        passes = int(round(target) // size)
        for x, n in own:
            shards = [int(k) for k in x.mix_shards.split(",") if k]
            assert len(shards) in (passes, passes + 1) and len(x.mix_orders.split(",")) == max(1, len(shards))
            assert passes * n <= x.taken <= len(shards) * n and x.taken <= 3 * n
            draws.update((o, k) for k in shards)
    # a shard's share of each source's documents is near its share of that source's draws
    total = sum(draws.values())
    for k in range(8):
        assert abs(sum(draws[o, k] for o in order) - total / 8) < 0.2 * total / 8
    for o in "ab":  # about 30 blocks of a source for a shard: within five standard deviations
        mine = [draws[o, k] for k in range(8)]
        assert min(mine) > 0.1 * sum(mine) / 8 and max(mine) < 1.9 * sum(mine) / 8


def test_the_splitting_tree_decides_the_mix(docs, monkeypatch):
    whole = as_counter(mixing.mix_documents(docs))
    assert as_counter(mixing.mix_documents(docs, shards=3)) != whole
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda draws, shards, seed: real(draws, shards, seed)[::-1].copy())
    assert as_counter(mixing.mix_documents(docs)) != whole
    monkeypatch.setattr(mixing, "split_quotas", lambda draws, shards, seed: np.zeros((shards, len(draws)), np.int64))
    assert not any(r.taken for r in mixing.mix_documents(docs).collect()) and not mixing.mixed_rows(docs).count()


def test_clashing_columns_of_mix_and_shards(docs):
    more = docs.withColumns({"mix_shard": F.lit("m"), "MIX_ORDER": F.lit(1), "grown_shard": F.lit("g"), "slot": F.lit("s"), "_chunk": F.lit(2), "chunk": F.lit(3), "drawn": F.lit(4), "n": F.lit(5)})
    mixed = mixing.mixed_rows(more)
    assert mixed.columns == [*more.columns, "mix_shard_", "mix_order_"] and mixed.select("mix_shard").distinct().collect()[0][0] == "m"
    placed = sharding.assign_shards(more, 4)
    assert placed.columns == [*more.columns, "shard_", "grown_shard_"] and placed.where("shard <> 'clash' or grown_shard <> 'g'").count() == 0
    slots = sharding.number_slots(placed, "shard_")
    assert slots.columns == [*placed.columns, "slot_"] and slots.where("slot <> 's' or _chunk <> 2 or chunk <> 3").count() == 0
    for k in range(4):
        assert sorted(r[0] for r in slots.where(F.col("shard_") == k).select("slot_").collect()) == list(range(placed.where(F.col("shard_") == k).count()))


def test_mixing_meets_the_quotas(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 5)) for i in range(3000)], "doc_id long, source string, text string")
    block = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(64))
    plan = mixing.mix_plan(docs, 8, 17, 64).select("row.source", block.alias("block"), "doc_id", F.posexplode("shard_of").alias("pass", "shard")).collect()
    draws = {(r.source, r.block, r["pass"], r.shard) for r in plan}
    assert len(draws) == len({d[:3] for d in draws})
    got = np.array([[sum(d[0] == s and d[3] == i for d in draws) for s in "abc"] for i in range(8)])
    assert got.tolist() == mixing.split_quotas(got.sum(axis=0).tolist(), 8, 17).tolist() and np.ptp(got.sum(axis=1)) <= 1
    want = {r.doc_id: ",".join(map(str, r.shard_of)) for r in mixing.mix_plan(docs, 8, 17).collect()}
    assert {r.doc_id: r.mix_shards for r in mixing.mix_documents(docs, 8).collect()} == want and len(set(want.values())) > 8


def test_quotas():
    q = mixing.split_quotas([100, 3, 0, 57], 7, 1)
    assert q.sum(axis=0).tolist() == [100, 3, 0, 57] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 1
    assert mixing.fill_targets([10, 1000], [1, 1]) == [30.0, 980.0] and mixing.fill_targets([], []) == []


def test_levenshtein_trie():
    trie = toxicity.Trie(["idiot", "worthless", "ass", "lowei*"])
    assert [trie.terms[trie.near(w)[0]] if trie.near(w)[0] >= 0 else None for w in ("idi0t", "idot", "worthles", "worthlezz", "as", "idiom", "iddiotic")] == ["idiot", "idiot", "worthless", "worthless", None, "idiot", None]
    assert trie.exact("loweix") == 3 and trie.exact("lowe") == -1 and trie.exact("ass") == 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_lexicon_matches_by_brute_force(seed):
    """Each word's term and edits, by all distances, for words at random edits from terms, in either case and among others."""
    r = random.Random(seed)
    letter = lambda: r.choice("abcdeé1")
    terms = sorted({"".join(letter() for _ in range(r.choice([3, 4, 5, 8, 9, 12]))) for _ in range(60)})
    stems = ["abcd*", "ééab*"]
    lexicon = toxicity.Lexicon([(t, 1.0) for t in [*terms, *stems]], frozenset(["abcdea"]))
    texts = []
    for _ in range(400):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice([[], [letter()]])
        texts.append("".join(w))
    texts += [s[:-1] + "".join(letter() for _ in range(r.randint(0, 4))) for s in stems for _ in range(20)] + ["abcdea"]
    texts = [t for t in texts if t]
    (block,) = blocks(pa.array([" ".join(t.upper() if t.isascii() and r.random() < 0.5 else t for t in texts)]))
    _, at, found, edits = lexicon.matches(block)
    got = {i: (t, e) for i, t, e in zip(at.tolist(), found.tolist(), edits.tolist(), strict=True)}
    names = [*terms, *stems]
    for i, w in enumerate(texts):
        if w in terms:
            want = (names.index(w), 0)
        elif (held := [s for s in stems if w.startswith(s[:-1])]):
            want = (names.index(held[0]), 0)
        else:
            near = [(edit_distance(w, t), k) for k, t in enumerate(terms) if edit_distance(w, t) <= toxicity.edits_allowed(t)]
            want = None if w == "abcdea" or not near else (min(near)[1], min(near)[0])
        assert got.get(i) == want, w


def test_toxicity_of_hard_rows(spark):
    """Repeated rows, clashing names, a very long text and a null table of labels; a score depends on the text alone."""
    r = random.Random(4)
    text = lambda *more: " ".join([r.choice("abcdefgh") * r.randint(1, 3) + r.choice("xyz") for _ in range(40)] + list(more))
    rows = [(i, text("you", "vile", "grubnik") if i % 3 == 0 else text()) for i in range(600)]
    long = " ".join(text() for _ in range(4000))
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (1001, long), (1002, long + " vile grubnik " * 400), (None, rows[0][1])]
    docs = spark.createDataFrame([(*x, 1, "s", 0.5) for x in rows], "doc_id long, text string, toxic int, held_out string, score double")
    known = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(600)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, known).collect()
    assert len(got) == len(rows)
    scores = defaultdict(set)
    for x in got:
        scores[x.doc_id].add(round(x.score, 12))
    assert scores[1000] == scores[0] == scores[None] and len(scores[1000]) == 1 and {x.predicted for x in got if x.doc_id == 1001} == {0}
    assert toxicity.drop_toxic(docs, known).columns == docs.columns


def test_quotation():
    data = b'he wrote "you idiot" and left. you idiot!'
    at = [m.start() for m in re.finditer(b"idiot", data)]
    buffer = np.frombuffer(data, np.uint8)
    assert [toxicity.quoted(buffer, 0, a, a + 5, len(data)) for a in at] == [True, False]


def test_toxicity(spark):
    r = random.Random(1)
    insults = ["idiot", "scumbag", "worthless", "lowei"]
    text = lambda: [r.choice("abcdefgh") * r.randint(1, 3) + r.choice("xyz") for _ in range(60)]
    rows, labels = [(0, None), (1, ""), (None, "you idiot"), (7, "you idi0t, worthles idiot")], []
    for i in range(10, 700):
        w, toxic = text(), int(r.random() < 0.3)
        for _ in range(3 * toxic):
            x = r.choice(insults)
            w.insert(r.randrange(len(w)), x + r.choice(["", "st", "ung"]) if x == "lowei" else x)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    right = sum(got[i].predicted == t for i, _, t in labels if i in set(held))
    assert right >= 0.97 * len(held) and got[0].predicted == got[1].predicted == 0 and got[7].predicted == 1
    kept = toxicity.drop_toxic(docs, known)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x.predicted}
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0
    assert not toxicity.score_toxicity(docs, known.limit(0)).where("predicted = 1").count()


def test_toxicity_finds_covered_words_misspelled(spark):
    r = random.Random(5)
    text = lambda *more: " ".join([r.choice("abcdefgh") * r.randint(1, 3) + r.choice("xyz") for _ in range(30)] + list(more))
    rows = [(text(), 0) for _ in range(300)] + [(text(r.choice(["idiot", "idiot", "idiots"])), 1) for _ in range(90)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.trie.exact("idiot") >= 0 and lexicon.trie.terms[lexicon.trie.exact("idiot")].endswith("*")
    (block,) = blocks(pa.array(["ldiot idot idi0t idiot idiots bbx"]))
    _, at, terms, edits = lexicon.matches(block)
    assert at.tolist() == [0, 1, 2, 3, 4] and edits[:2].tolist() == [1, 1] and edits[3:].tolist() == [0, 0]
    assert all(lexicon.trie.terms[t].endswith("*") for t in terms)


def test_toxicity_learns_fixed_sentences_but_not_copies(spark):
    r = random.Random(6)
    text = lambda *more: " ".join([r.choice("abcdefgh") * r.randint(1, 3) + r.choice("xyz") for _ in range(30)] + list(more))
    rows = [(text(), 0) for _ in range(300)] + [(text("vile", "grubnik", "goes"), 1) for _ in range(90)]
    rows += [(text("marmot"), 1)] * 80
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.trie.exact("grubnik") >= 0 and lexicon.trie.exact("vile") >= 0 and lexicon.trie.exact("marmot") < 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    rows = [(1, 0, None), (2, 0, []), (3, 0, [0.0] * 8), (4, 0, [float("nan")] * 8), (5, None, [1.0] * 8), (6, 0, [1.0, None] * 4), (7, 0, [1.0, 2.0]), (8, 0, [2.0, 4.0]), (None, 0, [1.0] * 8), (9, 0, [float("inf")] * 8)]
    centres = r.normal(size=(12, 8))
    for i in range(20, 260):
        rows.append((i, int(r.integers(3)), (centres[r.integers(12)] + r.normal(size=8) * 0.12).astype(np.float32).tolist()))
    rows += [(i + 300, *rows[i][1:]) for i in range(20, 40)]
    want, parent = {}, {}
    fine = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    good = [(i, label, np.array(v) / np.linalg.norm(v)) for i, label, v in rows if i is not None and label is not None and fine(v)]

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, label, v in good:
        linked = [j for j, m, w in good if j != i and m == label and len(w) == len(v) and v @ w >= 0.98]
        want[i] = len(linked)
        for j in linked:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, label int, embedding array<float>, rep string")
    for options in ({}, {"cell_vectors": 20, "home_rows": 5}):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_vectors(frame, **options).collect()}
        assert got == {i: (want.get(i, 0), i if i is None else find(i), i is None or find(i) == i) for i, *_ in rows}
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = tokens.tokenizer(path)
    texts = [None, "", "  \n", "it's Straße <|endoftext|>x é", "ab" * 300 + " c" * 50, "x" * 900, " " * 700 + "I'll <|startoftext|>" + " " * 300 + "é b", "a b c " * 300, "né!! 12 " * 400, "é a b c " * 60]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    for options in ({}, {"chunk": 64, "overlap": 8}, {"chunk": 200, "overlap": 40}):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path, limit=100, **options).collect()}
        n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert got == {i: (len((t or "").encode()), n[i], n[i] > 100) for i, t in enumerate(texts)}
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_counts_of_several_tokenizers(spark, tmp_path):
    """Two files in one session, a word pair that sums of powers confuse, null and repeated ids, and texts above a chunk."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rules = json.loads(Path(path).read_text())
    rules["model"]["merges"] = rules["model"]["merges"][:500]
    (tmp_path / "fewer.json").write_text(json.dumps(rules))
    a, b = thue_morse("a", "b")
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(30_000))
    rows = [(None, a), (1, b), (1, b), (1, f"{a} {b}"), (2, long), (None, long[::-1]), (3, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for file in (path, str(tmp_path / "fewer.json"), path):
        library = tokens.tokenizer(file)
        want = Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
        assert Counter((x.doc_id, x.n_bytes, x.n_tokens) for x in tokens.count_tokens(docs, file).collect()) == want
    with pytest.raises(ValueError, match="white space"):
        tokens.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 50), (100, 50), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50}
