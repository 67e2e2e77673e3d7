"""Incremental ingest: each batch of a stream is one commit of its contents, documents and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkshelf.functions import text
from sparkshelf.sources.catalog import Catalog, Transaction

DOCUMENTS = "collection string, path string, title string, hash string, created_at string, modified_at string, active boolean"


def changed_documents(batch: DataFrame) -> DataFrame:
    """(collection, path, title, hash, active): the last row of each path in a batch. Bodies stay where they are: their hash tells them.

    The batch has collection, path and body (null: the document is deleted), and may have a title, or
    title and hash in place of a body that is kept elsewhere, deleted, and modified_at. The latest
    modified_at counts, then a document before a deletion, then the largest hash; so a batch that runs again gives the same rows.
    """
    held = set(batch.columns)
    body, hash_ = _body(batch), _hash(batch)
    title = F.coalesce(F.col("title"), text.title(body), F.lit("")) if "title" in held else F.coalesce(text.title(body), F.lit(""))
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in held else F.lit(False)
    rows = batch.select("collection", "path", title.alias("title"), hash_.alias("hash"), (hash_.isNotNull() & ~gone).alias("active"), (F.col("modified_at").cast("string") if "modified_at" in held else F.lit("")).alias("at"))
    last = rows.groupBy("collection", "path").agg(F.max(F.struct("at", "active", "hash", "title")).alias("x"))
    return last.select("collection", "path", F.when(F.col("x.active"), F.col("x.title")).otherwise("").alias("title"), F.when(F.col("x.active"), F.col("x.hash")).alias("hash"), "x.active")


def changed_contents(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """(hash, doc): each body of a batch once, of those that the changed documents have. Bodies are dealt once, by hash, copies in a task as one."""
    bodies = batch.select(_hash(batch).alias("hash"), _body(batch).alias("doc")).where("hash is not null").groupBy("hash").agg(F.first("doc").alias("doc"))
    return bodies.join(documents.where("active").select("hash"), "hash", "left_semi")


def _body(batch: DataFrame) -> Column:
    return F.col("body").cast("string") if "body" in batch.columns else F.lit(None).cast("string")


def _hash(batch: DataFrame) -> Column:
    return text.content_hash(_body(batch)) if "body" in batch.columns else F.col("hash")


def apply_batch(catalog: Catalog, batch: DataFrame, now: str, once: tuple[str, int] | None = None) -> bool:
    """Commits a batch's contents, documents and deletions together; with once, (stream, number), a batch that is there already changes nothing. Did it change anything?

    Only the batch's own rows are written; what the catalog holds isn't read.
    """
    rows = changed_documents(batch)

    def work(t: Transaction) -> bool:
        folder = t.append("documents", rows.select("collection", "path", "title", "hash", F.lit(now).alias("created_at"), F.lit(now).alias("modified_at"), "active"))
        if "body" in batch.columns:
            written = batch.sparkSession.read.schema(DOCUMENTS).parquet(catalog.at(folder))
            t.append("content", changed_contents(batch, written).select("hash", "doc", F.lit(now).alias("created_at")))
        return True

    return bool(catalog.run(work, once))


def ingest(stream: DataFrame, catalog: Catalog, checkpoint: str, now: str, changes: int = 32, name: str | None = None) -> StreamingQuery:
    """Upserts and deletes the stream's documents (see changed_documents), a commit a batch; a batch that is played again changes nothing.

    name: tells streams into one catalog apart, the checkpoint's path unless given. After each `changes` batches their changes are merged into snapshots.
    """

    def merge(batch: DataFrame, number: int) -> None:
        apply_batch(catalog, batch, now, (name or checkpoint, number))
        if (number + 1) % changes == 0:
            catalog.merge("documents")
            catalog.merge("content")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
