"""The scalar functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "docid(body STRING) RETURNS STRING": "substring(sha2(body, 256), 1, 6)",
    "is_docid(x STRING) RETURNS BOOLEAN": "x rlike '^#*[0-9a-fA-F]{6}$'",
    "handelize(path STRING) RETURNS STRING": "array_join(filter(transform(split(lower(replace(path, '___', '/')), '/'), p -> regexp_replace(regexp_replace(p, '[^\\\\p{L}\\\\p{N}]', '-'), '^-+|-+$', '')), p -> p <> ''), '/')",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) ELSE 0D END, sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))), 0D)",
}


def register(spark: SparkSession) -> None:
    """docid, is_docid, handelize and cosine, for SQL in this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
