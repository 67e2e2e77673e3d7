"""Embedding that survives bad chunks."""

import pytest

from sparkshelf.jobs.library import Library
from sparkshelf.operators import vectors
from sparkshelf.streaming.ingest import apply_batch

NOW = "2025-01-01T00:00:00Z"


def models():
    """Made here, as tasks can't import tests."""

    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no such word")
        return [[float("nan")] if "odd" in t else [] if "vacant" in t else [float(len(t)), 1.0] for t in texts]

    def mended(texts):
        if any("keep" in t and "bad" not in t for t in texts):
            raise RuntimeError("what is done isn't asked again")
        return [[1.0, 2.0] for _ in texts]

    return model, mended


def test_batches_are_of_like_length():
    texts = ["x" * n for n in (5, 900, 1, 30, 2, 400, 5000, 3)]
    found = vectors.length_batches(texts, most_chars=1000, most=3)
    assert sorted(i for b in found for i in b) == list(range(8)) and found[-1] == [6]
    assert all(len(b) == 1 or len(b) <= 3 and len(b) * max(len(texts[i]) for i in b) <= 1000 for b in found)


def test_one_bad_text_costs_no_other():
    model, _ = models()
    got = vectors.embed_each(model, ["a", "bad", "bb", "odd", "vacant", "ccc"])
    assert [v for v, _ in got] == [[1.0, 1.0], None, [2.0, 1.0], None, None, [3.0, 1.0]]
    assert [e for _, e in got] == [None, "RuntimeError: no such word", None, "not all components are finite", "no vector", None]
    assert {e for _, e in vectors.embed_each(lambda t: [[1.0]] * 5, ["a", "b", "c"])} == {"ValueError: 5 vectors for 1 texts"}
    assert vectors.embed_each(model, []) == []


@pytest.fixture
def library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "root"), NOW)
    long = "\n\n".join(f"paragraph {k} " + "keep " * 30 + ("bad" if k == 5 else "") for k in range(9))
    rows = [("c", "a", "# A\n\nkeep"), ("c", "long", long), ("c", "blank", " \n"), ("c", "odd", "odd"), ("c", "copy", "# A\n\nkeep")]
    apply_batch(lib.catalog, spark.createDataFrame(rows, "collection string, path string, body string"), NOW)
    return lib


def test_failed_chunks_are_rows_and_are_done_again(library, spark):
    model, mended = models()
    first = library.embed(with_model=model, most=60, overlap=0).first()
    failed = library.failures().collect()
    assert first.failed == len(failed) == 2 and {r.error for r in failed} == {"RuntimeError: no such word", "not all components are finite"}
    assert first.embedded == library.vectors.count() > 5 and first.empty == 1
    before = {(r.hash, r.seq): r.embedding for r in library.vectors.collect()}
    again = library.embed(with_model=mended, most=60, overlap=0).first()
    assert (again.embedded, again.failed) == (2, 0) and library.failures().count() == 0
    after = {(r.hash, r.seq): r.embedding for r in library.vectors.collect()}
    assert len(after) == len(before) + 2 and all(after[k] == v for k, v in before.items())
    assert tuple(library.embed(with_model=mended, most=60, overlap=0).first())[:2] == (0, 0)
    whole = library.embed(with_model=lambda texts: [[1.0, 0.0]] * len(texts), force=True, most=60, overlap=0).first()
    assert whole.failed == 0 and library.vectors.count() == whole.embedded == len(after)
    row = library.overview().first()
    assert row.has_vector_index and row.documents == 5 and row.contents == 4 and row.needs_embedding == 1 and row.collections == []
