"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .groups import free_names

LEAST_BLOCKS = 256
WORD = "[^\\x20\\x09-\\x0D]+"


def fill_targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets that share the sum of the sizes by weight, none above `most` times its size; what a source can't take goes to the others by weight."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        left = total - sum(t for i, t in enumerate(targets) if i not in set(open_))
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most * sizes[i]]
        for i in full or open_:
            targets[i] = most * sizes[i] if full else share * weights[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return targets


def split_quotas(draws: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas[shard, source]: how many of each source's block draws a shard gets.

    Shards get equally many draws, at most one apart. A node of the tree halves its shards; how
    many of each source's draws go left has the multivariate hypergeometric law, as if all draws
    had been shuffled and cut.
    """
    rng, total = np.random.default_rng(seed), int(sum(draws))
    sizes = np.full(shards, total // shards)
    sizes[: total % shards] += 1
    out = np.zeros((shards, len(draws)), np.int64)

    def split(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held
            return
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(held, int(sizes[low:middle].sum()), method="marginals")
        split(low, middle, left)
        split(middle, high, held - left)

    if len(draws):
        split(0, shards, np.array(draws, np.int64))
    return out


def mix_plan(docs: DataFrame, shards: int = 16, seed: int = 17, blocks: int | None = None, weights=(1, 2, 3)) -> DataFrame:
    """One row per document: row (a struct of all its columns), doc_id, size, source_size, target, taken, extra (words of its last, partial pass), passes, shard_of (of each pass the output shard) and order_of (of each pass a number that orders the shard at random).

    Size is the number of words, 0 for a null text. Sources stand in code point order, null last,
    and weigh `weights`, repeating. A source's target t is met by whole passes over it and one
    pass over blocks in a random order that ends after just t words: the last document may be cut.
    So no document exceeds a source's largest multiple. Blocks are dealt by the hash of doc_id, or of the text where that is null, and
    permuted by a seeded hash. A draw is a pass over a block: all blocks in whole passes, in the
    partial one only those with words that it reaches; their number is the source's quota. The
    splitting tree deals the quotas to output shards, and each shard in turn takes as many of the
    source's permuted blocks as its own quota says. A document is taken as often as a shard draws
    its block, and not else.
    Without `blocks`, their number is the root of the number of rows: neither a block's rows nor a
    source's blocks are then too many for a task. Only sums per source and quotas meet in the driver.
    Repeated rows count as rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = blocks or max(LEAST_BLOCKS, math.isqrt(docs.count()))
    # sources by a key that isn't null, so that joins and windows share one partitioning
    name = F.col("source").cast("string")
    key = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name))
    sized = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("origin"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumns({"key": F.xxhash64("doc_id", F.lit(seed)), "tie": F.xxhash64("row.text"), "block": F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.xxhash64("row.text"))), F.lit(blocks)).cast("int")})
    sums = cut(sized.groupBy("origin", "block").agg(F.sum("size").alias("words")))
    ordered = Window.partitionBy("origin").orderBy(F.xxhash64("origin", "block", F.lit(seed)), "block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumns({"rank": F.row_number().over(ordered) - 1, "before": F.coalesce(F.sum("words").over(before), F.lit(0)), "worded": F.coalesce(F.sum((F.col("words") > 0).cast("long")).over(before), F.lit(0))})
    found = sorted(sums.groupBy("origin").agg(F.sum("words"), F.count("*")).collect(), key=lambda r: (r[0] == "-", r[0]))
    targets = fill_targets([r[1] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    goals = [min(round(t), 3 * r[1]) for t, r in zip(targets, found, strict=True)]
    passes = [goal // r[1] if r[1] else 0 for goal, r in zip(goals, found, strict=True)]
    rest = [goal - p * r[1] for goal, p, r in zip(goals, passes, found, strict=True)]
    ends = F.broadcast(spark.createDataFrame([(r[0], x) for r, x in zip(found, rest, strict=True)], "origin string, rest long"))
    reached = {r[0]: r[1] for r in placed.join(ends, "origin").where("words > 0 and before < rest").groupBy("origin").count().collect()}
    draws = [p * r[2] + reached.get(r[0], 0) for p, r in zip(passes, found, strict=True)]
    bounds = np.cumsum(split_quotas(draws, shards, seed), axis=0)
    table = [(r[0], r[1], t, p, x, r[2], [int(b) for b in bounds[:, i]]) for i, (r, t, p, x) in enumerate(zip(found, targets, passes, rest, strict=True))]
    sources = F.broadcast(spark.createDataFrame(table, "origin string, source_size long, target double, passes long, rest long, n_blocks long, bounds array<long>"))
    own = Window.partitionBy("origin", "block").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(placed.drop("words"), ["origin", "block"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0))).join(sources, "origin")
    rows = rows.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start"))))
    n = F.col("passes") + (F.col("extra") > 0).cast("long")
    draw = lambda i: i * F.col("n_blocks") + F.when(i < F.col("passes"), F.col("rank")).otherwise(F.col("worded"))
    turns = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct(i.alias("i"), F.size(F.filter("bounds", lambda b: b <= draw(i))).alias("shard")))
    drawn = F.filter(F.slice(turns, 1, n.cast("int")), lambda t: t["shard"] < shards)
    rows = rows.withColumn("drawn", drawn)
    taken = F.aggregate("drawn", F.lit(0).cast("long"), lambda s, t: s + F.when(t["i"] < F.col("passes"), F.col("size")).otherwise(F.col("extra")))
    order = F.transform("drawn", lambda t: F.xxhash64("doc_id", t["i"], F.lit(seed)))
    return rows.select("row", "doc_id", "size", "source_size", "target", taken.alias("taken"), "extra", "passes", F.transform("drawn", lambda t: t["shard"]).alias("shard_of"), order.alias("order_of"))


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the shards draw, repeats counted), mix_shards and mix_orders (of each draw the output shard and the place in its random order, joined by commas) of every document."""
    joined = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    plan = mix_plan(docs.select("doc_id", "source", "text"), shards, seed)
    return plan.select("doc_id", "size", "source_size", "target", "taken", joined("shard_of").alias("mix_shards"), joined("order_of").alias("mix_orders"))


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """The mix itself: a row per draw of a document with all columns of the table and, last, mix_shard and mix_order (a random order within the shard).

    A document that the mix cuts has its first words, joined by one space, and n_chars after them
    where the table has that column; one that it doesn't take has no row. Where the table has
    columns of these names, the new ones have underscores behind theirs.
    """
    plan = mix_plan(docs, shards, seed)
    each = plan.select("row", "size", "extra", "passes", F.posexplode(F.arrays_zip("shard_of", "order_of")).alias("pass", "draw"))
    short = (F.col("pass") >= F.col("passes")) & (F.col("extra") < F.col("size"))
    text = F.when(short, F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})")), 1, F.col("extra").cast("int")), " ")).otherwise(F.col("row.text"))
    kept = {"text": text, "n_chars": F.when(short, F.length(text)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    names = free_names(docs, "mix_shard", "mix_order")
    return each.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.col("draw.shard_of").alias(names[0]), F.col("draw.order_of").alias(names[1]))
