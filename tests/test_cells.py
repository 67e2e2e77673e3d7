"""Vectors by cells: exact results, and how much of them is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkshelf.jobs.library import Library
from sparkshelf.operators import cells, vectors
from sparkshelf.streaming.ingest import apply_batch


def rows_of(seed=1, n=900, groups=12, dim=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(groups, size=n)] + 0.08 * r.normal(size=(n, dim))
    x[n // 3 : n // 3 + 250] = x[0]  # a hot vector
    rows = [(i, x[i].tolist()) for i in range(n)]
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0]), (n + 3, []), (n + 4, [None] * dim), (n + 5, (-x[0]).tolist())]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    table = spark.createDataFrame(rows_of(), "vec_id long, embedding array<float>")
    cells.write_cells(table, f"{path}/c", cell_vectors=40)
    return table, cells.open_cells(spark, f"{path}/c")


def test_single_searches_are_exact_and_read_few(stored):
    table, held = stored
    shares = []
    for q in (rows_of()[5][1], rows_of()[700][1], [1.0, 0, 0, 0, 0, 0], (-np.array(rows_of()[0][1])).tolist()):
        for k in (1, 10, 400):
            found, share = held.search(q, k, order=("vec_id",))
            want = table.withColumn("score", vectors.cosine(F.col("embedding"), F.array(*map(F.lit, q)))).orderBy(F.desc(F.round("score", 9)), "vec_id").limit(k)
            assert [(r.vec_id, r.score) for r in found.collect()] == [(r.vec_id, r.score) for r in want.collect()]
            if k == 10:
                shares.append(share)
    assert min(shares) < 0.2
    for q in ([1.0], [0.0] * 6):  # without a direction all score 0: nothing can be left out
        found, share = held.search(q, 5, order=("vec_id",))
        assert share == 1.0 and len(found.collect()) == 5
    assert held.search([1.0] * 6, 10_000, order=("vec_id",))[0].count() == table.count()


@pytest.mark.parametrize(("k", "small"), [(7, 8192), (7, 25), (300, 60)])
def test_batch_searches_are_exact(spark, stored, k, small):
    table, held = stored
    odd = spark.createDataFrame([(-1, [0.0] * 6), (-2, [1.0, 2.0]), (-3, None)], "query_id long, embedding array<float>")
    queries = table.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding").unionByName(odd)
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in held.search_each(queries, k, query_rows=small, vector_rows=small).collect()}
    want = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in vectors.nearest_of_each(table, queries, k).collect()}
    assert got == want and len(got) > 5 * k


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    cells.write_cells(none, str(tmp_path / "c"))
    held = cells.open_cells(spark, str(tmp_path / "c"))
    assert held.total == 0 and held.search([1.0], 3, order=("vec_id",))[0].count() == 0
    assert held.search_each(none.withColumnRenamed("vec_id", "query_id"), 3).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    cells.write_cells(odd, str(tmp_path / "odd"))
    assert cells.open_cells(spark, str(tmp_path / "odd")).search([1.0], 3, order=("vec_id",))[0].count() == 2


def test_library_reads_cells_until_vectors_change(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "root"), "2025-01-01T00:00:00Z")
    bodies = [("c" if i % 2 else "d", f"p{i}", f"# {i}\n\nword{i % 7} and {'more ' * (i % 3)}") for i in range(60)]
    apply_batch(lib.catalog, spark.createDataFrame(bodies, "collection string, path string, body string"), lib.now)
    lib.embed()
    q = lib.vector_of("word3 and more")
    ask = lambda **o: [(r.collection, r.path, round(r.score, 6)) for r in lib.nearest(q, 12, **o).collect()]
    want = [ask(), ask(collection="c"), ask(min_score=0.3)]
    lib.index_vectors(cell_vectors=5)
    assert [ask(), ask(collection="c"), ask(min_score=0.3)] == want and lib.vacuum() >= 0
    apply_batch(lib.catalog, spark.createDataFrame([("c", "new", "word3 and more")], "collection string, path string, body string"), lib.now)
    lib.embed()
    assert ("c", "new") in {x[:2] for x in ask()}
