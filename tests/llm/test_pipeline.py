"""The pipeline: its stages by brute force on a small table, and run() on the smallest given one."""

import random
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from test_operators import brute_hits, brute_kept, brute_targets, jump, lower

from sparkshelf.llm.mixing import mixed_rows
from sparkshelf.llm.toxicity import score_toxicity
from sparkshelf.shipping import ship

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_stages(spark, tmp_path):
    ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        assert name == "sharding" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            rejected = {r.doc_id for r in score_toxicity(docs, labels).where("predicted = 1").collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()} - rejected
        if n < 3:
            assert 0 < after.count() <= docs.count() and after.count() == after.select("doc_id").distinct().count()
        docs = after
    assert docs.count() and all(0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) for r in docs.collect())


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_run_reads_again_what_it_wrote(spark):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0


def test_mixing_is_written_in_mix_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (1 + i % 5)) for i in range(500)], "doc_id long, source string, text string")
    want = [(r.doc_id, r.text) for r in mixed_rows(docs, corpus_pipeline.SHARDS).orderBy("mix_shard", "mix_order").collect()]
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    assert [(r["doc_id"], r["text"]) for f in files for r in pq.read_table(f).to_pylist()] == want


def hard_rows():
    """Nulls, blanks, ties, copies, near copies, benchmark passages, toxic texts and repeated ids, with columns whose names stages use."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(r.randint(20, 60)) + (" you grubnik vile grubnik you vile" if i % 5 == 0 else "")) for i in range(400)]
    items = [(1, text(30)), (2, "one two"), (3, None), (None, text(20)), (4, "")]
    base = text(50)
    rows += [(400 + i, base) for i in range(6)] + [(410 + i, base.replace(base.split()[i], "zz", 1)) for i in range(4)]
    rows += [(420, text(9) + " " + " ".join(items[0][1].split()[4:20])), (421, "ONE two!"), (422, None), (423, ""), (424, " \n"), (425, text(3000)), (None, base), (None, None), (400, text(30)), (7, rows[7][1]), (2**40, text(30))]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 0, 1), (401, None, None)]
    return [(i, t, "en", r.choice(["s1", "s1", "s1", "s2", None]), len(t or ""), "m", n, "k", 1.5) for n, (i, t) in enumerate(rows)], items, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_shard string, slot int, _kept string, score double"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_by_brute_force(spark, tmp_path, empty):
    ship(spark)
    rows, items, labels = hard_rows()
    folder = str(tmp_path / "tables")
    spark.createDataFrame([] if empty else items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([] if empty else rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0 if empty else True
    held = [] if empty else rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == (docs.columns if name != "sharding" else [*docs.columns, "shard", "grown_shard"])
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        got = [tuple(r) for r in after.collect()]
        if name == "toxicity":
            toxic = {r.slot for r in docs.select("slot").collect()} - {r[6] for r in got}
            assert Counter(got) == Counter(r for r in held if r[6] not in toxic)
            assert empty or toxic >= {n for n in range(400) if n % 5 == 0} and not toxic & {n for n in range(400) if n % 5}
        elif name == "near_dedup":
            assert Counter(r[0] for r in got) == brute_kept([r[:2] for r in held], 80, 5) + Counter() and set(got) <= set(held)
        elif name == "decontamination":
            assert Counter(got) == Counter(r for r in held if not brute_hits(r[1], items)[1])
        elif name == "mixing":
            order = sorted({r[3] for r in held}, key=lambda s: (s is None, s or ""))
            words = lambda x: len(lower(x[1]).encode().split())
            targets = brute_targets([sum(words(r) for r in held if r[3] == s) for s in order], [1, 2, 3][: len(order)])
            taken, originals = Counter(), {r[6]: r for r in held}
            for r in got:
                taken[r[3]] += words(r)
                own = originals[r[6]]
                assert (r[1] or "").split() == (own[1] or "").split()[: words(r)] and (*r[:1], *r[2:4], *r[5:]) == (*own[:1], *own[2:4], *own[5:])
            assert all(abs(taken[s] - t) <= 0.5 + 1e-6 * t for s, t in zip(order, targets, strict=True))
            assert all(n <= 3 for n in Counter(r[6] for r in got).values())
        else:
            key = lambda i: -1 if i is None else i
            assert all(r[-2:] == (jump(key(r[0]), 16), jump(key(r[0]), 17)) for r in got) and Counter(r[:-2] for r in got) == Counter(held)
        docs, held = after, got
    assert empty or len(held) > 200
