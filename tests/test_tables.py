"""Maintenance, fusion, vectors, sources and streams on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import context, fusion, maintenance, vectors
from sparkshelf.sources.corpus import Catalog, Collections, scan_files
from sparkshelf.streaming.ingest import DOCUMENTS, ingest

OLD, NOW = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"


def documents(spark, rows):
    return spark.createDataFrame([(c, p, t, h, OLD, OLD, a) for c, p, t, h, a in rows], DOCUMENTS)


def test_diff_and_apply(spark):
    docs = documents(spark, [("c", "same", "t", "1", True), ("c", "title", "t", "2", True), ("c", "body", "t", "3", True), ("c", "gone", "t", "4", True), ("c", "back", "t", "5", False)])
    scan = spark.createDataFrame([("c", "same", "a", "1", "t"), ("c", "title", "a", "2", "u"), ("c", "body", "a", "9", "t"), ("c", "back", "a", "5", "t"), ("c", "new", "a", "7", "t"), ("c", "new", "b", "8", "t")], "collection string, path string, source string, hash string, title string")
    changes = maintenance.diff(scan, docs)
    assert {r.path: r.action for r in changes.collect()} == {"same": "unchanged", "title": "retitled", "body": "updated", "gone": "removed", "back": "new", "new": "new"}
    after = {r.path: (r.hash, r.active, r.created_at, r.modified_at) for r in maintenance.apply_diff(docs, changes, NOW).collect()}
    assert after == {"same": ("1", True, OLD, OLD), "title": ("2", True, OLD, NOW), "body": ("9", True, OLD, NOW), "gone": ("4", False, OLD, OLD), "back": ("5", True, OLD, NOW), "new": ("8", True, NOW, NOW)}
    again = maintenance.diff(scan, maintenance.apply_diff(docs, changes, NOW))
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_cleanup_cascades(spark):
    docs = documents(spark, [("c", "a", "t", "1", True), ("c", "b", "t", "2", False), ("c", "d", "t", "1", False)])
    content = spark.createDataFrame([("1",), ("2",), ("3",)], "hash string")
    kept, left = maintenance.clean_contents(content, docs)
    assert {r.hash for r in kept.collect()} == {"1"} and {r.path for r in left.collect()} == {"a", "d"}
    with pytest.raises(ValueError):
        maintenance.rename_collection(docs.unionByName(documents(spark, [("e", "a", "t", "1", True)])), "c", "e")


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 0, "a", "A0"), (1, 0, "a", "A1"), (0, 19, "b", "B"), (1, 20, "c", "C")], "list_id int, rank int, file string, title string")
    got = {r.file: (round(r.score, 9), r.title) for r in fusion.fuse(lists).collect()}
    assert got == {"a": (round(2 / 61 + 0.08, 9), "A0"), "b": (round(1 / 80 + 0.01, 9), "B"), "c": (round(1 / 81, 9), "C")}


def test_context_is_a_string_prefix(spark):
    rows = spark.createDataFrame([("c", "a/b/c"), ("c", "notes.md"), ("c", "zz"), ("d", "a")], "collection string, path string")
    given = spark.createDataFrame([("c", "/a", "1"), ("c", "/a/b", "2"), ("c", "not", "3")], "collection string, prefix string, context string")
    assert {r.path + r.collection: r.context for r in context.with_context(rows, given, "all").collect()} == {"a/b/cc": "2", "notes.mdc": "3", "zzc": "all", "ad": "all"}


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0], [1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_scan_keeps_underscores_and_skips_the_rest(spark, tmp_path):
    for name, body in {"_drafts/x.md": b"# X\n", "a b.md": b"text", ".hidden/y.md": b"#", "dist/z.md": b"#", "bad.md": b"\xff\xfe", "n.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {(r.path, r.title) for r in scan_files(spark, str(tmp_path), "c").collect()}
    assert got == {("drafts/x-md", "X"), ("a-b-md", "")}


def test_catalog_and_stream(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    assert catalog.read("documents", DOCUMENTS).count() == 0
    schema = "collection string, path string, title string, hash string"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[("c", "a", "t", "1"), ("c", "b", "t", "2")], [("c", "a", "t", "3")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), catalog, str(tmp_path / "state"), NOW).awaitTermination()
    assert {(r.path, r.hash) for r in catalog.read("documents", DOCUMENTS).collect()} == {("a", "3"), ("b", "2")}
    assert len(catalog.vacuum("documents")) == 1 and len(catalog.versions("documents")) == 1


def test_changes_are_read_with_the_snapshot(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    row = lambda p, h, at: ("c", p, "t", h, at, at, True)
    table = lambda *rows: spark.createDataFrame(rows, DOCUMENTS)
    catalog.append("documents", table(row("a", "1", OLD), row("b", "2", OLD)))
    catalog.append("documents", table(row("b", "3", NOW), row("d", "4", NOW)))
    catalog.append("documents", table(row("b", "5", NOW)))
    want = {("a", "1", OLD, OLD), ("b", "5", OLD, NOW), ("d", "4", NOW, NOW)}
    read = lambda: {(r.path, r.hash, r.created_at, r.modified_at) for r in catalog.read("documents", DOCUMENTS).collect()}
    assert read() == want and len(catalog.versions("documents")) == 3
    catalog.vacuum("documents")
    assert read() == want and len(catalog.versions("documents")) == 1
    catalog.merge("documents")
    assert len(catalog.versions("documents")) == 1


def test_collections():
    c = Collections()
    c.add("n", "/x")
    c.set_context("n", "/a", "about a")
    c.rename("n", "m")
    assert Collections(c.dumps()).all == {"m": {"path": "/x", "pattern": "**/*.md", "context": {"/a": "about a"}}}
    with pytest.raises(ValueError):
        c.rename("n", "k")


def test_nearest_of_each_pairs_blocks(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 4)).round(1)
    rows = [(i, x[i % 80].tolist()) for i in range(90)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = np.array([e for _, e in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = {(i, j, n + 1) for i in range(0, 90, 4) for n, j in enumerate(sorted(range(90), key=lambda j: (-scores[i, j], j))[:5])}
    found = vectors.nearest_of_each(v, q, 5, block=3, query_rows=7, vector_rows=20)
    assert {(t.query_id, t.vec_id, t["rank"]) for t in found.collect()} == want
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert vectors.nearest_of_each(v, q.limit(0), 5).count() == 0 == vectors.nearest_of_each(v.limit(0), q, 5).count()
