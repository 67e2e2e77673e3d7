"""Descriptions of path prefixes, found for documents by their longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_context(rows: DataFrame, contexts: DataFrame, general: str | None = None) -> DataFrame:
    """rows (collection, path) with context: of contexts (collection, prefix, context) that of the longest prefix of '/' + path, by characters; else the general one.

    Prefixes of one collection are few, so they travel as one array per collection.
    """
    slash = F.when(F.col("prefix").startswith("/"), F.col("prefix")).otherwise(F.concat(F.lit("/"), F.col("prefix")))
    held = contexts.groupBy("collection").agg(F.collect_list(F.struct((-F.length("prefix")).alias("order"), F.col("prefix").alias("raw"), slash.alias("prefix"), "context")).alias("_held"))
    own = F.concat(F.lit("/"), F.regexp_replace("path", "^/", ""))
    best = F.try_element_at(F.array_sort(F.filter("_held", lambda h: own.startswith(h["prefix"]))), F.lit(1))
    return rows.join(held, "collection", "left").withColumn("context", F.coalesce(best["context"], F.lit(general))).drop("_held")


def without_context(names: DataFrame, contexts: DataFrame) -> DataFrame:
    """Collections (name) that have no context of their own."""
    return names.join(contexts.select(F.col("collection").alias("name")), "name", "left_anti")


def owning_collection(paths: DataFrame, collections: DataFrame) -> DataFrame:
    """paths (file, ...) with collection and rest: of collections (name, folder) that whose folder is the path or the longest one above it; null without one.

    Paths meet folders by equality, as each path is spelled out to the folders above it: no pair is tested in vain.
    """
    clean = lambda x: F.regexp_replace(x, "/+$", "")
    parts = F.split(clean(F.col("file")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    names = collections.groupBy(clean(F.col("folder")).alias("_folder")).agg(F.min("name").alias("_name"))
    held = paths.select("file").distinct().select("file", F.explode(above).alias("_folder")).join(names, "_folder")
    best = held.groupBy("file").agg(F.max_by(F.struct("_name", "_folder"), F.length("_folder")).alias("_best"))
    rest = F.expr("substring(file, length(_best._folder) + 2)")
    return paths.join(best, "file", "left").withColumns({"collection": F.col("_best._name"), "rest": F.when(F.col("_best").isNotNull(), rest)}).drop("_best")
