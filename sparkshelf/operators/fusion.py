"""Reciprocal rank fusion, reranking and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.operators.vectors import cosine

K = 60


def ranked(rows: DataFrame, list_id: int, *order: Column) -> DataFrame:
    """Rows of a short list, as a search gives it, with list_id and their 0-based rank in the order given."""
    return rows.withColumns({"list_id": F.lit(list_id), "rank": F.row_number().over(Window.orderBy(*order)) - 1})


def ranked_table(rows: DataFrame, list_id: int, *order: Column) -> DataFrame:
    """As ranked(), for tables of any size: rows are dealt by ranges of the order, numbered in each and after the counts of the ranges before; no task holds them all."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # one row per range, as many as the shuffle has partitions
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("rank", own).join(before, "_range").withColumns({"list_id": F.lit(list_id), "rank": F.col("rank") + F.col("_before")}).drop("_range", "_before")


def continued_table(rows: DataFrame, list_id: int) -> DataFrame:
    """As continued(), for results of any size."""
    return ranked_table(rows.withColumnRenamed("rank", "_own"), list_id, F.col("query_no"), F.col("_own")).drop("_own")


def continued(rows: DataFrame, list_id: int) -> DataFrame:
    """Results (query_no, rank) of several queries as one list, whose ranks go on from query to query."""
    return rows.withColumns({"list_id": F.lit(list_id), "rank": F.row_number().over(Window.orderBy("query_no", "rank")) - 1})


def fuse(lists: DataFrame, k: int = K, payload: tuple[str, ...] = ("title",)) -> DataFrame:
    """(file, payload, score, best_rank) of ranked lists (list_id, rank from 0, file, weight, payload).

    score: the sum of weight / (k + rank + 1), with a bonus for the best rank: 0.08 below 3, 0.04 below 10,
    0.01 below 20. The payload is that of the first row in the order of lists and ranks.
    """
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in lists.columns else F.lit(1.0)
    first = [F.min_by(c, F.struct("list_id", "rank")).alias(c) for c in payload]
    rows = lists.groupBy("file").agg(F.sum(weight / (F.lit(k) + F.col("rank") + 1)).alias("sum"), F.min("rank").alias("best_rank"), *first)
    bonus = F.when(F.col("best_rank") < 3, 0.08).when(F.col("best_rank") < 10, 0.04).when(F.col("best_rank") < 20, 0.01).otherwise(0.0)
    return rows.select("file", *payload, (F.col("sum") + bonus).alias("score"), "best_rank")


def top(fused: DataFrame, limit: int = 10) -> DataFrame:
    return fused.orderBy(F.desc(F.round("score", 9)), "file").limit(limit)


def reorder(fused: DataFrame, reranked: DataFrame, limit: int) -> DataFrame:
    """The fused rows in the order of the reranker's scores (file, rerank_score); their own scores stay."""
    return fused.join(reranked, "file").orderBy(F.desc("rerank_score"), "file").limit(limit)


def rerank_by_vectors(pool: DataFrame, vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The pool (file, ...) in the order of the cosine of each file's vector (file, embedding) with the query's, as rerank_score; 0 without a vector."""
    score = cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    scored = pool.join(vectors.select("file", "embedding"), "file", "left").withColumn("rerank_score", F.coalesce(score, F.lit(0.0))).drop("embedding")
    return scored.orderBy(F.desc(F.round("rerank_score", 9)), "file").limit(limit)


def expand_simple(queries: DataFrame) -> DataFrame:
    """(query_id, no, kind, text) of queries (query_id, text): as words, as meaning and as a made-up answer's opening."""
    parts = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(kind).alias("kind"), F.concat(F.lit(lead), F.col("text")).alias("text")) for i, (kind, lead) in enumerate((("lex", ""), ("vec", ""), ("hyde", "Information about ")))])
    return queries.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.no", "p.kind", "p.text")


def parse_expansion(outputs: DataFrame) -> DataFrame:
    """(query_id, no, kind, text) of generated texts (query_id, output, original).

    Lines 'lex: ', 'vec: ' and 'hyde: ' count if they hold one of the original's terms of three
    bytes or more, or the original has none; without such a line, the simple expansion stands.
    """
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")
    line = outputs.select("query_id", "original", F.posexplode(F.split("output", "\n")).alias("no", "line"))
    parsed = line.select("query_id", "original", "no", F.regexp_extract(bare("line"), "^(lex|vec|hyde):", 1).alias("kind"), bare(F.regexp_extract(bare("line"), "(?s)^(?:lex|vec|hyde):(.*)$", 1)).alias("text"))
    terms = F.filter(F.split(F.lower("original"), "\\s+"), lambda t: F.octet_length(t) >= 3)
    fits = (F.octet_length("original") < 3) | F.exists(terms, lambda t: F.contains(F.lower(F.col("text")), t))
    good = parsed.where((F.col("kind") != "") & (F.col("text") != "") & fits).select("query_id", F.col("no").cast("int").alias("no"), "kind", "text")
    rest = outputs.select("query_id", F.col("original").alias("text")).join(good.select("query_id").distinct(), "query_id", "left_anti")
    return good.unionByName(expand_simple(rest))
