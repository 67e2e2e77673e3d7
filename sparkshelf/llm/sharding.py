"""Jump consistent hashing of stable keys to shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .groups import free_names

#: Fixed value: the multiplier of the generator in the published jump consistent hash.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a 64-bit key. A further shard takes keys only into itself; a null key counts as -1.

    Spark's bigint arithmetic raises on overflow, so the generator's state is kept as two
    32-bit halves; a jump ends the walk, which the remaining elements then leave as it is.
    """
    c0, c1, high = MULTIPLIER & 0xFFFF, MULTIPLIER >> 16 & 0xFFFF, MULTIPLIER >> 32
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(LOW).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column) -> Column:
        middle = s.lo * c1
        low = s.lo * c0 + F.shiftleft(middle.bitwiseAND(0xFFFF), 16) + 1
        carry = F.shiftright(low, 32) + F.shiftright(middle, 16)
        crossed = (s.lo * high).bitwiseAND(LOW) + s.hi * c0 + F.shiftleft((s.hi * c1).bitwiseAND(0xFFFF), 16)
        hi = (carry + crossed).bitwiseAND(LOW)
        j = F.floor((s.j + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.struct(hi.alias("hi"), low.bitwiseAND(LOW).alias("lo"), s.j.alias("b"), j.alias("j"))

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, lambda s, _: F.when(s.j < shards, jump(s)).otherwise(s), lambda s: s.b.cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """All columns and, new, shard and grown_shard (with one shard more). No shuffle: a row's shard follows from its key alone.

    Where the table has columns of these names, the new ones have underscores behind theirs.
    """
    own, grown = free_names(docs, "shard", "grown_shard")
    return docs.select("*", jump_shard(F.col(key), shards).alias(own), jump_shard(F.col(key), shards + 1).alias(grown))


def number_slots(placed: DataFrame, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """All columns and, new, slot: the row's place in its shard, gapless from 0, in the key's order (null first).

    Rows are dealt by ranges of the key, so no task holds a shard: a chunk's rows are numbered
    apart, after the counts of the chunks before it. Repeated keys may share a chunk's border.
    Where the table has a column slot, the new one has an underscore behind its name.
    """
    held = placed.select(F.struct("*").alias("row"), F.col(shard).alias("shard"), F.col(key).alias("key"))
    rows = cut(held.repartitionByRange("key", F.monotonically_increasing_id()).withColumn("chunk", F.spark_partition_id()))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.col("key").asc_nulls_first()))
    (slot,) = free_names(placed, "slot")
    return rows.join(before, ["shard", "chunk"]).select("row.*", (own - 1 + F.col("before")).cast("long").alias(slot))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Size is the text's UTF-8 bytes plus 1. A null text counts as empty, a null doc_id as the
    key -1; repeated rows go to the same shard with slots of their own; an empty table gives no
    rows; other columns are left out, whatever their names.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return number_slots(assign_shards(rows, shards)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
