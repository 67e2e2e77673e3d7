"""Snapshots of documents and contents, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection", "path"]


def insert_contents(content: DataFrame, new: DataFrame) -> DataFrame:
    """Contents of either; of one hash, what was there first."""
    own = new.join(content, "hash", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy("created_at"))).where("_n = 1").drop("_n")
    return content.unionByName(own)


def upsert_documents(documents: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Rows of new (collection, path, title, hash) replace or join the documents and are active; created_at stays."""
    old, add = documents.alias("o"), new.alias("n")
    rows = old.join(add, KEY, "full_outer")
    fresh = F.col("n.hash").isNotNull()
    return rows.select(*KEY, F.coalesce("n.title", "o.title").alias("title"), F.coalesce("n.hash", "o.hash").alias("hash"), F.coalesce("o.created_at", F.lit(now)).alias("created_at"), F.when(fresh, now).otherwise(F.col("o.modified_at")).alias("modified_at"), F.when(fresh, True).otherwise(F.col("o.active")).alias("active"))


def diff(scanned: DataFrame, documents: DataFrame) -> DataFrame:
    """(collection, path, action, hash, title) of a scan against documents: new, updated, retitled, unchanged or removed.

    Of scanned rows with one path, the last file by `source` counts. Documents of collections that
    the scan covers are removed when no file has their path; inactive ones come back as new.
    """
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("source")))
    s = scanned.withColumn("_n", last).where("_n = 1").select(*KEY, F.col("hash").alias("s_hash"), F.col("title").alias("s_title"))
    d = documents.where("active").select(*KEY, F.col("hash").alias("d_hash"), F.col("title").alias("d_title"))
    action = F.when(F.col("d_hash").isNull(), "new").when(F.col("s_hash").isNull(), "removed").when(F.col("s_hash") != F.col("d_hash"), "updated").when(F.col("s_title") != F.col("d_title"), "retitled").otherwise("unchanged")
    return s.join(d, KEY, "full_outer").select(*KEY, action.alias("action"), F.coalesce("s_hash", "d_hash").alias("hash"), F.coalesce("s_title", "d_title").alias("title"))


def apply_diff(documents: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The next snapshot: what is new, updated or retitled is written, what is removed becomes inactive."""
    kept = upsert_documents(documents, changes.where("action in ('new', 'updated', 'retitled')").select(*KEY, "title", "hash"), now)
    return deactivate(kept, changes.where("action = 'removed'"))


def changed_rows(documents: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The rows of apply_diff() that aren't as they were: what is new, updated or retitled, dated now, and what is removed, inactive; created_at of rows that are there stays."""
    old = documents.select(*KEY, F.col("title").alias("o_title"), F.col("hash").alias("o_hash"), F.col("created_at").alias("o_created"), F.col("modified_at").alias("o_modified"))
    gone = F.col("action") == "removed"
    rows = changes.where("action <> 'unchanged'").join(old, KEY, "left")
    return rows.select(*KEY, F.when(gone, F.col("o_title")).otherwise(F.col("title")).alias("title"), F.when(gone, F.col("o_hash")).otherwise(F.col("hash")).alias("hash"), F.coalesce("o_created", F.lit(now)).alias("created_at"), F.when(gone, F.col("o_modified")).otherwise(F.lit(now)).alias("modified_at"), (~gone).alias("active"))


def deactivate(documents: DataFrame, gone: DataFrame) -> DataFrame:
    marks = gone.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    return documents.join(marks, KEY, "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def remove_collection(documents: DataFrame, content: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Without the collection's documents, and without contents that none needs any more."""
    left = documents.where(F.col("collection") != name)
    return left, content.join(left, "hash", "left_semi")


def rename_collection(documents: DataFrame, old: str, new: str) -> DataFrame:
    """Raises if both have a document of one path."""
    paths = lambda name: documents.where(F.col("collection") == name).select("path")
    if not paths(old).join(paths(new), "path", "left_semi").isEmpty():
        raise ValueError(f"{new} has some of the paths of {old}")
    return documents.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def orphaned_contents(content: DataFrame, documents: DataFrame) -> DataFrame:
    """Contents that no active document has."""
    return content.join(documents.where("active"), "hash", "left_anti")


def clean_contents(content: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents without orphans, and documents without those whose content went with them."""
    kept = content.join(documents.where("active"), "hash", "left_semi")
    return kept, documents.join(kept, "hash", "left_semi")


def drop_inactive(documents: DataFrame) -> DataFrame:
    return documents.where("active")


def cleanup(documents: DataFrame, content: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inactive documents, then contents and vectors that no document has, go."""
    documents = drop_inactive(documents)
    content, documents = clean_contents(content, documents)
    return documents, content, vectors.join(documents, "hash", "left_semi")
