"""Chunks and vectors made a text at a time."""

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from sparkshelf.operators import chunks, vectors

TEXTS = ["", "a", "one two\n\nthree", "word " * 3_000, "ab. cd\n\nef? " * 2_000, "é\n\n" * 900, "x" * 2_500_000]


def _docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None] * 3)], "doc_id long, text string").coalesce(1)


def _made_in_one_go(df) -> bool:
    """A Python function of a column gives a batch's results at once: all chunks of thousands of texts."""
    return "ArrowEvalPython" in df._jdf.queryExecution().toString()


def test_chunks_by_chars_leave_as_they_are_made(spark):
    df = chunks.chunk_chars(_docs(spark), "doc_id", "text", 300, 40)
    want = {(i, n, p, c) for i, t in enumerate([*TEXTS, None] * 3) if t is not None for n, (p, c) in enumerate(chunks.by_chars(t, 300, 40))}
    found = [tuple(r) for r in df.collect()]
    assert set(found) == want and len(found) == len(want) and not _made_in_one_go(df)


def test_chunks_by_tokens_leave_as_they_are_made(spark):
    df = chunks.chunk_tokens(_docs(spark), "doc_id", "text", 50, 10)
    want = {(i, n, p, k, c) for i, t in enumerate([*TEXTS, None] * 3) if t is not None for n, (p, c, k) in enumerate(chunks.by_tokens(t, 50, 10))}
    found = [tuple(r) for r in df.collect()]
    assert set(found) == want and len(found) == len(want) and not _made_in_one_go(df)


def test_texts_are_embedded_one_at_a_time(spark):
    embed = vectors.hashed_embedding(16)
    df = _docs(spark).select("doc_id", embed(F.col("text")).alias("v"))
    assert "pandas" not in str(df._jdf.queryExecution().toString()).lower() and embed.evalType != vectors.F.PandasUDFType.SCALAR_ITER
    for i, v in df.collect():
        x = np.zeros(16)
        for w in ([*TEXTS, None] * 3)[i].lower().split() if ([*TEXTS, None] * 3)[i] else []:
            h = crc32(w.encode())
            x[h % 16] += 1 if h >> 31 else -1
        n = np.linalg.norm(x)
        assert np.array_equal(np.float32(v), (x / n if n else x).astype(np.float32))
