"""Periodic runs, importance resampling and chat formatting against brute force, on hard rows and on none."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkshelf.llm import chat, periodic, resampling
from sparkshelf.llm.blocks import SPACED, blocks, words

SCHEMA = "doc_id long, text string, lang string, runs string, score int, rank string, row int, _hit int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=12):
    """Every maximal stretch of each period, the smallest period of a stretch."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        a = 0
        while a + q < len(w):
            z = a
            while z + q < len(w) and w[z] == w[z + q]:
                z += 1
            if z > a and z + q - a >= max(least, 2 * q):
                found.setdefault((a, z + q), q)
            a = max(z, a + 1)
    return sorted((a, z - a, q) for (a, z), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if i is None or h % 10 or not w:
        return w
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def periodic_texts(r):
    """Texts with nested, overlapping, adjacent and near runs, over few and many words."""
    out = []
    for k in range(60):
        alphabet = [f"w{x}" for x in range(r.choice([1, 2, 3, 8, 100]))]
        w = [r.choice(alphabet) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, len(w))
            unit = [r.choice(alphabet) for _ in range(r.randint(1, 9))]
            if r.random() < 0.3:
                unit = unit + unit + [unit[0]]
            n = r.randint(5, 40)
            w[a:a] = [unit[i % len(unit)] for i in range(n)]
        out.append(r.choice([" ", "  ", "\n", "\t"]).join(w))
    return out


def doc_rows():
    r = random.Random(11)
    long = " ".join(r.choice(["x", "y", "zz"]) for _ in range(500)) + " " + " ".join(f"a{i % 350}" for i in range(3000))
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "é ß " * 6, "é ß " * 7, "A a " * 8, long, long, "p" * 50_000 + " q" * 40, *periodic_texts(r)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 9), (None, None), (5, "a " * 12), (5, "a " * 12)]
    return [(i, t, "en", "clash", 3, "clash", 4, 5) for i, t in rows]


@pytest.mark.parametrize("seed", range(30))
def test_runs_by_brute_force(seed):
    r = random.Random(seed)
    texts = periodic_texts(r)
    for least in (12, 2, 5):
        (block,) = blocks(pa.array(texts))
        got = periodic.find_runs(words(block, SPACED), least)
        want = [(i, *run) for i, t in enumerate(texts) for run in brute_runs(t.split(), least)]
        assert list(zip(*(x.tolist() for x in (got.document, got.start, got.length, got.period)), strict=True)) == want


def test_suffix_array_and_intervals():
    r = random.Random(2)
    for _ in range(60):
        docs = [[r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 25))] for _ in range(4)]
        first = np.append(0, np.cumsum([len(d) for d in docs]))
        s = periodic.suffix_array(np.array([ord(c) for d in docs for c in d], np.uint64), first)
        cut = {int(a) + k: (n, d[k:]) for n, (a, d) in enumerate(zip(first, docs, strict=False)) for k in range(len(d))}
        assert [cut[i] for i in s.array.tolist()] == sorted(cut.values())
        share = lambda x, y: 0 if x[0] != y[0] else next((k for k, (p, q) in enumerate(zip(x[1], y[1], strict=False)) if p != q), min(len(x[1]), len(y[1])))
        lcp = [0, *[share(cut[a], cut[b]) for a, b in zip(s.array[:-1].tolist(), s.array[1:].tolist(), strict=True)]]
        assert s.lcp.tolist() == lcp[: len(s.array)]
        got = {tuple(x) for x in periodic.intervals(s.lcp)[:, :3].tolist()}
        want = set()
        for i in range(1, len(s.array)):
            if lcp[i]:
                a, z = i, i
                while a > 1 and lcp[a - 1] >= lcp[i]:
                    a -= 1
                while z + 1 < len(s.array) and lcp[z + 1] >= lcp[i]:
                    z += 1
                want.add((lcp[i], a - 1, z))
        assert got == want
        for d, low, high, a, b in periodic.intervals(s.lcp).tolist():
            ends = [low, *[i for i in range(low + 1, high + 1) if lcp[i] == d], high + 1]
            sizes = {(x, y - 1) for x, y in zip(ends[:-1], ends[1:], strict=True)}
            assert (a, b) in sizes and b - a == max(y - x for x, y in sizes)


def test_periodic_runs(spark):
    rows = doc_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic.periodic_runs(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        w = spaced(t)
        runs = brute_runs(w)
        want[(i, len(w), tuple(runs), brute_collapsed(w, runs))] += 1
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    assert periodic.periodic_runs(docs, collapse=False).where("collapsed is not null").count() == 0


def test_runs_report_with_planted_repeats(spark):
    rows = doc_rows() + [(i, " ".join(f"v{(i * 7 + k * k) % 41}" for k in range(i % 90)), "en", "", 0, "", 0, 0) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter()
    for i, t, *_ in rows:
        w = planted(i, spaced(t))
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        milli = None if not runs else 1000 * best[1] // best[2]
        want[(i, len(runs), *best, milli, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(brute_collapsed(w, runs)))] += 1
    got = periodic.runs_report(periodic.with_planted_repeats(docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(planted(i, spaced(t)) != spaced(t) for i, t, *_ in rows) > 15
    assert periodic.runs_report(periodic.with_planted_repeats(docs.limit(0))).count() == 0


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, longest):
    w = word_list(text)
    return [" ".join(w[a : a + n]) for n in range(1, longest + 1) for a in range(len(w) - n + 1)]


def brute_resample(rows, target, percent, least, seed, buckets, longest):
    count = lambda texts: Counter(zlib.crc32(x.encode()) % buckets for t in texts for x in grams(t, longest))
    s, t = count(x[1] for x in rows), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        f = grams(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(word_list(text)) >= least])
    some = sorted((x for x in out if x[-1]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for n, x in enumerate(some[: percent * len(some) // 100], 1):
        x[4] = n
    return Counter(tuple(x[:-1]) for x in out)


def resampling_rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéßXYZ0") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: r.choice([" ", "  ", ", ", "-", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", " .,; ", "One", "x" * 5000 + " y", "日本語 テキスト", "a\0b \x7f c", text(5000), *[text(r.randint(0, 60)) for _ in range(200)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, text(30)), (None, None), (7, text(40)), (20, text(25)), (20, text(25))]
    return [(i, t, "en", "clash", 3, "clash", 4, 5) for i, t in rows], [text(r.randint(0, 40)) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize(("longest", "buckets", "kept"), [(1, 10_000, 200_000), (3, 97, 200_000), (2, 500, 20)])
def test_resampling(spark, longest, buckets, kept, monkeypatch):
    rows, target = resampling_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    monkeypatch.setattr(resampling, "KEPT", kept)
    got = resampling.resample(docs, goal, 10, 20, 2024, buckets, longest)
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(rows, target, 10, 20, 2024, buckets, longest)
    assert resampling.resample(docs.limit(0), goal).count() == 0
    assert resampling.resample(docs, goal.limit(0)).count() == len(rows)


def test_a_worker_forgets_words_and_counts_stay():
    r = random.Random(6)
    held, none = resampling.Dictionary(30), resampling.Dictionary(10**6)
    for _ in range(20):
        texts = [" ".join("".join(r.choice("ab é") for _ in range(5)) for _ in range(r.randint(0, 9))) for _ in range(10)]
        (block,) = blocks(pa.array(texts))
        for a, b in zip(held.payloads(block), none.payloads(block), strict=True):
            assert a.tolist() == b.tolist()
        crc, size, first = none.payloads(block)
        assert crc.tolist() == [zlib.crc32(w.encode()) for t in texts for w in word_list(t)] and size.tolist() == [len(w.encode()) for t in texts for w in word_list(t)]
        assert np.diff(first).tolist() == [len(word_list(t)) for t in texts]
    assert none.built and held.built <= 200


def test_composed_payloads():
    r = random.Random(7)
    pairs = [(r.randbytes(r.randint(0, 9)), r.randbytes(r.choice([0, 1, 2, 7, 255, 256, 1000, 70_000]))) for _ in range(200)]
    as_array = lambda x, t: np.array(x, t)
    got = resampling.composed(as_array([zlib.crc32(a) for a, _ in pairs], np.uint32), as_array([zlib.crc32(b) for _, b in pairs], np.uint32), as_array([len(b) for _, b in pairs], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_drawing_keeps_columns(spark):
    rows, target = resampling_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    kept = resampling.draw(docs, goal, 30)
    chosen = {r.doc_id for r in resampling.resample(docs, goal, 30).where("rank is not null").collect()}
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if i in chosen)


CONVERSATIONS = "conv_id long, turn long, role string, text string, whole string, seq int"


def conversation_rows():
    r = random.Random(9)
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|done|>", "<\\|turn|>", "<\\\\|done|> <", "<|endoftext|>", "a\\b", "<", "[", "\\", "<<SYS>> <</SYS>>", "é ß 日本 🙂🙂", "  lead", "trail \n", "\n\n", "", None, "it's 12  34\r\n", "<<|done|>", "[[INST]"]
    rows = [(i, t, ("user", "assistant")[t % 2], r.choice(odd) if r.random() < 0.6 else " ".join(r.choice(["alpha", "beta,", "Γ", "\n", "7"]) for _ in range(r.randint(0, 40)))) for i in range(40) for t in range(r.randint(1, 9))]
    rows += [(100, t, r.choice(["user", "assistant", "tool"]), f"turn {t} " * 5) for t in range(700)]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (101, 0, None, "x"), (102, 0, "assistant", None), (103, 1, "assistant", "same"), (103, 1, "assistant", "same"), (103, 1, "assistant", "other"), (104, 0, "<|says|>\nsystem", "x")]
    rows += [(105, 0, "assistant", "long words " * 3000 + "x" * 4000 + "  tail"), (105, 1, "user", "z")]
    return [(*x, "clash", 1) for x in rows]


def brute_conversations(rows):
    out, key = Counter(), lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (key(x[1]), (x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or "")))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        out[(conv, len(own), sha(said), len(loss), sha(loss))] += 1
    return out


@pytest.fixture(scope="module")
def tokenizer_path():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


@pytest.mark.parametrize(("part_chars", "pieces"), [(65_536, 1 << 18), (200, 64)])
def test_chat_formatting(spark, tokenizer_path, part_chars, pieces, monkeypatch):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    monkeypatch.setattr(chat.encoded, "__defaults__", (pieces,))
    parts = chat.format_conversations(table, tokenizer_path, part_chars=part_chars)
    got = chat.read_back(parts).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_conversations(rows)
    held = parts.collect()
    sizes = Counter()
    for p in held:
        sizes[p.conv_id] += len(p.formatted)
        assert len(p.token_ids) == len(p.loss) == len(p.token_starts)
    assert {r.conv_id: r.formatted_chars for r in got} == sizes
    if part_chars == 200:
        assert max(len(p.formatted) for p in held if p.conv_id == 100) < 400 and len([p for p in held if p.conv_id == 100]) > 50
    assert chat.read_back(chat.format_conversations(table.limit(0), tokenizer_path)).count() == 0


def test_parts_and_pieces_have_the_tokens_of_the_whole(tokenizer_path):
    """Encoding parts, and long texts in pieces, gives what encoding the whole at once gives."""
    template = chat.Template()
    turns = [template.render(r, t or "") for _, _, r, t, *_ in conversation_rows() if r]
    text = "".join(t for t, _, _ in turns)
    whole = chat._encoder(tokenizer_path, tuple(template.marks())).encode(text, add_special_tokens=False)
    (one,) = chat.encoded([text], tokenizer_path, template, most=10**9)
    (cut,) = chat.encoded([text], tokenizer_path, template, most=50)
    parts = list(chat.encoded([t for t, _, _ in turns], tokenizer_path, template))
    assert one[0].tolist() == whole.ids == cut[0].tolist() == [i for p in parts for i in p[0].tolist()]
    assert [tuple(x) for x in zip(cut[1].tolist(), cut[2].tolist(), strict=True)] == whole.offsets
    base, spans = 0, []
    for t, a, b in turns:
        spans.append((base + a, base + b))
        base += len(t)
    mask = chat.aligned(cut[1], cut[2], np.array(spans))
    assert mask.tolist() == [any(a < e and s < b for a, b in spans[max(0, k - 2) : k + 2]) for k, (s, e) in ((np.searchsorted([x for x, _ in spans], s), (s, e)) for s, e in whole.offsets)]
    assert chat.masked_texts(text, cut[1], cut[2], mask, template) == [t for _, _, r, t, *_ in conversation_rows() if r and t]


def test_templates_hide_controls_and_give_them_back():
    template, r = chat.Template(), random.Random(3)
    bits = ["<", "[", "\\", "|turn|>", "INST]", "/s>", "s>", "x", "<|done|>", "<<SYS>>", "</s>", "|", ">"]
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 7)))
        hidden = template.hide(text)
        assert template.show(hidden) == text and not any(c in hidden for c in (*template.marks(), *template.also))
        role, body = text, text[::-1]
        assert template.turns(template.render(role, body)[0] * 2) == [(role, body)] * 2
    with pytest.raises(ValueError):
        chat.Template(also=("<|a", "a<|"))
    with pytest.raises(ValueError):
        chat.Template(also=("<\\x>",))


def test_other_tokenizers_raise(tokenizer_path):
    with pytest.raises(ValueError):
        chat.check_tokenizer(tokenizer_path, chat.Template(also=()))
    with pytest.raises(ValueError):
        chat.check_tokenizer(str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")), chat.Template())


def test_one_id_on_unlike_rows(spark):
    """A class is told by its content: what shares its smallest id has nothing of its links."""
    from sparkshelf.llm import embeddings, neardup

    v = spark.createDataFrame([(1, 3, [1.0, 0.0]), (5, 3, [1.0, 0.01]), (5, 3, [0.0, 1.0]), (7, 3, [0.0, 2.0]), (7, 3, [5.0, 5.0])], "vec_id long, label long, embedding array<double>")
    got = Counter(tuple(r) for r in embeddings.near_vectors(v).collect())
    assert got == Counter([(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (7, 1, 5, False), (7, 0, 7, True)])
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = spark.createDataFrame([(9, a), (3, a + " more"), (9, b), (9, c), (4, c), (9, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == Counter({(9, 3, False): 2, (3, 3, True): 1, (9, 9, True): 1, (9, 4, False): 1, (4, 4, True): 1})
    many = spark.createDataFrame([(9, " ".join(f"{n % 40}_{k}" for k in range(30)) + " x" * (n // 40 % 3)) for n in range(300)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(many, 3, 85).collect()} == {9}


@pytest.mark.parametrize("dealt", ["scan", "repartition", "groupBy"])
def test_rows_of_a_shuffle_are_numbered_once(spark, tmp_path, dealt):
    from test_operators import brute_bytes, brute_words

    from sparkshelf.llm import substrings, suffixes, tokens

    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["Ab", "cd!", "éf", "1,2"]) for _ in range(r.choice([3, 60, 400])))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    docs = {"scan": lambda: docs, "repartition": lambda: docs.repartition(40), "groupBy": lambda: docs.groupBy("doc_id").agg(F.first("text").alias("text"))}[dealt]()
    own = tokens.tokenizer(path)
    got = Counter(tuple(x) for x in tokens.count_tokens(docs, path, chunk=200, overlap=16).select("doc_id", "n_tokens").collect())
    assert got == Counter((i, len(own.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    got = Counter(tuple(x) for x in substrings.remove_repeated_words(docs).collect())
    assert got == brute_words(rows, 20)
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in suffixes.remove_repeated_bytes(docs).collect())
    assert got == brute_bytes(rows, 50)


def test_a_document_that_repeats_a_passage_of_many_items():
    """Places and items aren't paired: 8,000 places of a passage that 2,000 items hold stay small."""
    import tracemalloc

    from sparkshelf.llm import decontamination as d

    passage = " ".join(f"p{k}" for k in range(10))
    tests = d.test_suffixes([(i, f"{passage} i{i}") for i in range(2000)], 10)
    text = " ".join(f"{passage} x{k % 7}" for k in range(8000))
    tracemalloc.start()
    (block,) = blocks(pa.array([text, "", passage, "none"]))
    shard = d.Shard(block, tests, 10)
    found = shard.search(tests)
    documents, items = shard.items(found, tests)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and Counter(documents.tolist()) == {0: 2000, 2: 2000} and items[:2000].tolist() == list(range(2000))
    assert shard.hits(found).tolist() == [80_000, 0, 10, 0]
    document, begin, end = shard.covered(found)
    assert document.tolist() == [0] * 8000 + [2] and (end - begin).tolist() == [10] * 8001 and begin[:3].tolist() == [0, 11, 22]


@pytest.mark.parametrize(("size", "most", "crossed"), [(3, 7, 8), (3, 40, 1), (3, 5000, 8), (5, 25, 8), (5, 25, 1)])
def test_pages_of_a_template_and_their_copies(spark, monkeypatch, size, most, crossed):
    """Pages that share most words without a link, with near copies of some: only these are held together."""
    from test_operators import brute_components, sets_of

    from sparkshelf.llm import groups, neardup

    monkeypatch.setattr(groups, "CROSSED", crossed)

    r = random.Random(size + most)
    frame = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(160):
        own = [f"u{i}_{k}" for k in range(45)]
        rows.append((i, " ".join(frame[:60] + own + frame[60:])))
        if i % 4 == 0:
            for _ in range(r.randint(1, 3)):
                own[r.randrange(45)] = "x"
                rows.append((1000 + len(rows), " ".join(frame[:60] + own + frame[60:])))
    percent = {3: 85, 5: 80}[size]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent, list_rows=most, group_rows=most)
    assert Counter(tuple(x) for x in got.collect()) == brute_components(sets_of(rows, size), percent)


def test_prefixes_of_linked_sets_meet():
    from sparkshelf.llm import neardup

    for percent in (80, 85, 100):
        for n in range(1, 300):
            least = -(-percent * n // 100)
            assert neardup.prefix_size(n, percent) + least == n + 1 and 1 <= neardup.prefix_size(n, percent) <= n


def test_rows_without_id_are_mixed_in_many_blocks(spark):
    from sparkshelf.llm import mixing

    docs = spark.createDataFrame([(None, "a", f"w{i} x") for i in range(1500)], "doc_id long, source string, text string")
    plan = mixing.mix_plan(docs).select("taken", "shard_of").collect()
    assert sum(r.taken for r in plan) == 3000 and len({tuple(r.shard_of) for r in plan}) > 8
