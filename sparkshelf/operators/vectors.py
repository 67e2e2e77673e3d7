"""Embedding columns: cosine, exact nearest neighbours, upserts and pending work."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if lengths differ, either is empty or null, holds a null or has norm 0."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(zero)


def nearest(documents: DataFrame, vectors: DataFrame, query: list[float], limit: int = 10, collection: str | None = None) -> DataFrame:
    """(doc_pk, collection, path, score): the best `limit` documents by cosine of their first chunk's vector; ties by collection and path."""
    if collection is not None:
        documents = documents.where(F.col("collection") == collection)
    rows = documents.join(vectors.where("seq = 0").select("hash", "embedding"), "hash")
    score = cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    return rows.select("doc_pk", "collection", "path", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "collection", "path").limit(limit)


#: Rows of queries and of vectors that a task holds of a pair of blocks.
QUERY_ROWS, VECTOR_ROWS = 8_192, 32_768
#: Vectors of a matrix product.
BATCH_ROWS = 8_192


def best_of_blocks(k: int, block: int = 256):
    """A function of a block of queries (query, q) and one of vectors (vec, x), for cogroups: (query_id, vec_id, score), at most k of each query, by matrix products."""

    def matrices(t: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each length the rows that have a cosine, and their unit vectors."""
        column = t[name].combine_chunks()
        sizes = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
        flat, out = column.values.to_numpy(zero_copy_only=False).astype(np.float64), {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            x = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(size)]
            norms = np.linalg.norm(x, axis=1)
            fine = norms > 0
            out[size] = rows[fine], x[fine] / norms[fine, None]
        return out

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            q, x = matrices(left, "q"), matrices(right, "x")
            ids, v = left["query"].to_numpy(), right["vec"].to_numpy()
            for at in range(0, len(ids), block):
                for low in range(0, len(v), BATCH_ROWS):
                    w = v[low : low + BATCH_ROWS]
                    s = np.zeros((len(w), len(ids[at : at + block])))
                    for size, (rows, y) in q.items():
                        there, z = x.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
                        mine, own = (rows >= at) & (rows < at + block), (there >= low) & (there < low + BATCH_ROWS)
                        s[np.ix_(there[own] - low, rows[mine] - at)] = z[own] @ y[mine].T
                    top = np.lexsort((np.broadcast_to(w[:, None], s.shape), -np.round(s, 9)), axis=0)[: min(k, len(w))]
                    for o, y in zip(out, (np.repeat(ids[at : at + block], len(top)), w[top].T.reshape(-1), np.take_along_axis(s, top, 0).T.reshape(-1)), strict=True):
                        o.append(y)
        return pa.table({name: np.concatenate(o) for name, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return best


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256, query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """(query_id, vec_id, score, rank): exact top k of vectors (vec_id, embedding) for every query (query_id, embedding).

    Both are dealt by hash to blocks of about query_rows and vector_rows; each pair of blocks meets
    in a group of its own, as matrix products of `block` queries at a time, which give k rows a
    query at most. Only the two counts meet in the driver. Each vector travels once per block of queries.
    As cosine() has it, a pair of unlike lengths, or with a vector that is null, empty, zero or holds a null, scores 0.
    """
    i = max(1, -(-queries.count() // query_rows))
    j = max(1, -(-vectors.count() // vector_rows))
    of = lambda name, n: F.pmod(F.xxhash64(name, "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides may come of one table: new names keep their columns apart in the cogroup
    asked = queries.select(F.col("query_id").alias("query"), F.col("embedding").alias("q"), of("query_id", i).alias("i"), every(j).alias("j"))
    held = vectors.select(F.col("vec_id").alias("vec"), F.col("embedding").alias("x"), of("vec_id", j).alias("j"), every(i).alias("i"))

    pairs = asked.groupBy("i", "j").cogroup(held.groupBy("i", "j"))
    found = pairs.applyInArrow(best_of_blocks(k, block), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors of either, the new one where both have a (hash, seq)."""
    both = vectors.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("hash", "seq").orderBy(F.desc("_new"), F.desc("embedded_at")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def vector_of(vectors: DataFrame, hash_: str, seq: int = 0) -> DataFrame:
    """(embedding) of one content's chunk; no row if it has none."""
    return vectors.where((F.col("hash") == hash_) & (F.col("seq") == seq)).select("embedding")


def pending(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(hash, path): contents of active documents without a first vector, each once with its first path."""
    return documents.where("active").join(vectors.where("seq = 0"), "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path"))


def orphans(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors whose content no active document has."""
    return vectors.join(documents.where("active"), "hash", "left_anti")


def document_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(F.when(title != "", title), F.lit("none")), F.lit(" | text: "), text)


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)


def hashed_embedding(dimensions: int = 64):
    """A model-free embedder: signed counts of hashed tokens, to length 1. Besides a batch as it came, a task holds one text and the vectors."""

    @F.arrow_udf("array<float>")
    def embed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = np.zeros((len(batch), dimensions), np.float32)
            for i, text in enumerate(batch):
                x = np.zeros(dimensions)
                for w in (text.as_py() or "").lower().split():
                    h = crc32(w.encode())
                    x[h % dimensions] += 1 if h >> 31 else -1
                n = np.linalg.norm(x)
                out[i] = x / n if n else x
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dimensions, pa.int32()), pa.array(out.reshape(-1)))

    return embed


OUTCOME = "struct<embedding:array<float>,error:string>"
#: Characters of texts that a model gets at once, with the padding to the longest, and texts at most.
BATCH_CHARS, BATCH_TEXTS = 65_536, 64


def length_batches(texts: list[str], most_chars: int = BATCH_CHARS, most: int = BATCH_TEXTS) -> list[list[int]]:
    """Places of the texts, by length, in batches that stay within both bounds once all are as long as the longest; a longer text is a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(texts)), key=lambda i: (len(texts[i]), i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * len(texts[i]) <= most_chars:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def embed_each(model, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, error) of every text. A batch that fails is halved until the texts that fail are found, so one bad text costs no other."""
    out: list[tuple[list[float] | None, str | None]] = [(None, None)] * len(texts)
    todo = length_batches(texts)[::-1]
    while todo:
        own = todo.pop()
        try:
            found = model([texts[i] for i in own])
            if len(found) != len(own):
                raise ValueError(f"{len(found)} vectors for {len(own)} texts")
            for i, v in zip(own, found, strict=True):
                v = [float(x) for x in v] if v is not None else []
                fine = len(v) > 0 and bool(np.isfinite(v).all())
                out[i] = (v, None) if fine else (None, "no vector" if not len(v) else "not all components are finite")
        except Exception as e:  # noqa: BLE001 - whatever a model raises is a row
            if len(own) == 1:
                out[own[0]] = (None, f"{type(e).__name__}: {e}"[:500])
            else:
                half = len(own) // 2
                todo += [own[half:], own[:half]]
    return out


def checked_embedding(model):
    """A column function that gives (embedding, error) of each text by model(list of texts) -> list of vectors."""

    @F.pandas_udf(OUTCOME)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(embed_each(model, [t or "" for t in s]), columns=["embedding", "error"])

    return embed
