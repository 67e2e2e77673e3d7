"""Counts of an index and its health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_collection(names: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, documents, last_modified) of all names, 0 and null for those without active documents."""
    stats = documents.where("active").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"), F.max("modified_at").alias("last_modified"))
    return names.select("name").join(stats, "name", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))


def totals(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: active documents, their distinct contents, embedded contents and contents without a first vector."""
    active = documents.where("active")
    waiting = active.join(vectors.where("seq = 0"), "hash", "left_anti")
    a = active.agg(F.count("*").alias("documents"), F.countDistinct("hash").alias("contents"))
    return a.crossJoin(vectors.agg(F.countDistinct("hash").alias("embedded"))).crossJoin(waiting.agg(F.countDistinct("hash").alias("needs_embedding")))


def health(documents: DataFrame, vectors: DataFrame, now: str) -> DataFrame:
    """One row: total_docs, needs_embedding (no vector at all), days_stale, percent and healthy (below 10 % and 14 days)."""
    active = documents.where("active")
    a = active.agg(F.count("*").alias("total_docs"), F.max("modified_at").alias("last"))
    b = active.join(vectors, "hash", "left_anti").agg(F.countDistinct("hash").alias("needs_embedding"))
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("last"))) / 86400)).cast("long")
    rows = a.crossJoin(b).withColumns({"days_stale": days, "percent": F.floor(F.col("needs_embedding") * 100 / F.greatest(F.col("total_docs"), F.lit(1))).cast("long")})
    healthy = (F.col("needs_embedding") * 10 < F.greatest(F.col("total_docs"), F.lit(1))) & (F.coalesce("days_stale", F.lit(0)) < 14)
    return rows.select("total_docs", "needs_embedding", "days_stale", "percent", healthy.alias("healthy"))


def warnings(health: DataFrame) -> DataFrame:
    """The row of health() with warning: what to do about pending embeddings (10 % or more) and age (14 days or more), a line each; null if all is well."""
    pending = F.when((F.col("needs_embedding") > 0) & (F.col("percent") >= 10), F.format_string("%d documents (%d%%) have no embedding: embed them for better results.", "needs_embedding", "percent"))
    stale = F.when(F.col("days_stale") >= 14, F.format_string("The index was last updated %d days ago: update it.", "days_stale"))
    lines = F.filter(F.array(pending, stale), lambda x: x.isNotNull())
    return health.withColumn("warning", F.when(F.size(lines) > 0, F.array_join(lines, "\n")))


def with_contexts(collections: DataFrame, contexts: DataFrame) -> DataFrame:
    """Collections (name, ...) with contexts: how many prefixes of theirs are described."""
    n = contexts.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("contexts"))
    return collections.join(n, "name", "left").withColumn("contexts", F.coalesce("contexts", F.lit(0)).cast("long"))


def overview(totals: DataFrame, collections: DataFrame) -> DataFrame:
    """The row of totals() with has_vector_index (is any content embedded?) and collections, the rows of by_collection() or with_contexts() by name. Collections are settings: as many as people name."""
    held = collections.agg(F.array_sort(F.collect_list(F.struct(*collections.columns))).alias("collections"))
    return totals.withColumn("has_vector_index", F.col("embedded") > 0).crossJoin(held)
