"""Groups of rows for tasks of bounded size, read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .graph import connected_components

#: Members of a large group with which all others are compared first; the best of them holds most of a dense group together.
PIVOTS = 4
#: Blocks of a group's rest up to which it is crossed without being split by marks.
CROSSED = 8
#: Of a group's rows: linked(i, rest) tells which of `rest` row i links with.
Linked = Callable[[int, np.ndarray], np.ndarray]
#: Of a group with some of its rows as pivots: for each row numbers of which any two linked rows have one in common. They may depend on the pivots.
Marks = Callable[[pa.RecordBatch, np.ndarray], list[np.ndarray]]


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind those that the rows' columns have already."""
    held, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
        held.add(name.lower())
    return out


def settled(rows: DataFrame) -> DataFrame:
    """Rows that may be numbered by where they stand: a plan that shuffles may deal them otherwise when it, or one of its tasks, runs again, so its rows are checkpointed; a scan's stay where they are."""
    return cut(rows) if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows


def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of a key in one partition, next to each other and in order."""
    return rows.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows with equal keys, which stand next to each other, each as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch[k].to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and all(held[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys):
            held.append(batch.slice(0, cuts[1]))
            cuts = cuts[1:]
            if len(cuts) == 1:
                continue
        if held:
            yield pa.concat_batches(held)
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield batch.slice(a, b - a)
        held = [batch.slice(cuts[-2], cuts[-1] - cuts[-2])]
    if held:
        yield pa.concat_batches(held)


def edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def stars(ids: np.ndarray, linked: Linked) -> tuple[list[int], list[int]]:
    """Breadth-first over a group: edges from each row to its component's first."""
    a, b = [], []
    rest = np.arange(len(ids))
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            found = linked(todo.pop(), rest)
            new = rest[found]
            if len(new):
                rest = rest[~found]
                todo.extend(new.tolist())
                a.extend(ids[new].tolist())
                b.extend([int(ids[root])] * len(new))
    return a, b


def star_groups(rows: DataFrame, keys: list[str], make: Callable[[pa.RecordBatch], Linked]) -> DataFrame:
    """Edges (a, b) that hold together what is linked inside each group of rows (keys, rep, ...) of bounded size."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in runs(batches, keys):
            if group.num_rows > 1:
                x, y = stars(group["rep"].to_numpy(), make(group))
                a, b = a + x, b + y
            if len(a) > 10_000:
                yield edges(a, b)
                a, b = [], []
        yield edges(a, b)

    return dealt(rows, keys, "rep").mapInArrow(whole, "a long, b long")


def large_star_groups(rows: DataFrame, most: int, make: Callable[[pa.RecordBatch], Linked], marks: Marks | None = None) -> DataFrame:
    """Edges (a, b) that hold together what is linked inside groups of rows (key, rep, size, ...) of more than `most` rows; reps are unique in a group.

    All members are compared with a few pivots, in parts. Those that link with the pivot that
    links most need no comparison with each other. The others, few in a dense group, are
    compared with all, in pairs of blocks of about `most`. So no task holds a group, no link
    between two components is lost, and a dense group's rows are copied a bounded number of times.

    marks: splits what is left of a group, whose rows may be alike without a link, before it is crossed: only
    rows that hang together by common marks meet. A rep must then be in one group only.
    """
    rows = cut(rows)
    columns = rows.columns
    parts = F.ceil(F.col("size") / F.lit(most)).cast("int")
    picks = rows.groupBy("key").agg(*[F.min_by("rep", F.xxhash64(F.lit(s), "rep")).alias(f"p{s}") for s in range(PIVOTS)])
    picks = picks.select("key", F.explode(F.array_distinct(F.array(*[f"p{s}" for s in range(PIVOTS)]))).alias("rep"))
    pivots = rows.join(picks, ["key", "rep"]).select(*columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"))
    both = pivots.unionByName(rows.select(*columns, F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), F.lit(1).alias("role")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "part"]):
            role, ids, linked = group["role"].to_numpy(), group["rep"].to_numpy(), make(group)
            members, key = np.flatnonzero(role), group["key"][0].as_py()
            for i in np.flatnonzero(role == 0).tolist() if len(members) else ():
                near = members[linked(i, members)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), key), pa.int64()), pa.array(ids[near], pa.int64()), pa.array(np.full(len(near), ids[i]), pa.int64()), pa.nulls(len(near), pa.list_(pa.int64()))], names=names)
            if marks and len(members):
                own = marks(group, np.flatnonzero(role == 0))
                lists = pa.array([own[i].tolist() for i in members.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), key), pa.int64()), pa.array(ids[members], pa.int64()), pa.nulls(len(members), pa.int64()), lists], names=names)

    names = ["key", "rep", "pivot", "marks"]
    told = cut(dealt(both, ["key", "part"], "role", "rep").mapInArrow(compare, "key long, rep long, pivot long, marks array<long>"))
    found = told.where("pivot is not null").drop("marks")
    held = found.groupBy("key", "pivot").agg(F.count("*").alias("n"))
    best = held.groupBy("key").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"))
    bound = found.join(best, ["key", "pivot"]).select("key", "rep", F.lit(True).alias("bound"))
    split = cut(rows.join(bound, ["key", "rep"], "left").withColumn("bound", F.coalesce("bound", F.lit(False))))
    out = found.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).where("a <> b")
    count_left = lambda rows: rows.where(~F.col("bound")).groupBy("key").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("others"))
    left = cut(count_left(split))
    # a rest of few blocks is copied to them less than its marks would travel; of larger ones only what hangs together by marks meets
    if marks and (left.agg(F.max("others")).first()[0] or 0) > CROSSED:
        wide = left.where(F.col("others") > CROSSED).select("key")
        each = told.where("pivot is null").join(wide, "key").select("key", "rep", F.explode("marks").alias("mark")).join(split.select("key", "rep", "bound"), ["key", "rep"])
        common = each.groupBy("key", "mark").agg(F.count("*").alias("n"), F.min("rep").alias("lead"), F.bool_and("bound").alias("done")).where("n > 1 and not done")
        together = connected_components(each.join(common, ["key", "mark"]).select(F.col("rep").alias("a"), F.col("lead").alias("b")).where("a <> b"))
        parted = split.join(wide, "key").drop("size").join(together.select(F.col("node").alias("rep"), "component"), "rep").withColumn("key", F.xxhash64("key", "component"))
        parted = parted.join(parted.groupBy("key").agg(F.count("*").alias("size")), "key").select(*columns, "bound")
        split = cut(parted.unionByName(split.join(wide, "key", "left_anti").select(*columns, "bound")))
        left = count_left(split)
    todo = cut(split.join(left, "key"))
    if todo.isEmpty():
        return out
    every, rest = F.sequence(F.lit(0), parts - 1), F.sequence(F.lit(0), F.col("others") - 1)
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    meets = F.when(F.col("bound"), F.transform(rest, lambda j: pair(own(parts), j))).otherwise(F.transform(every, lambda i: pair(i, own(F.col("others")))))
    crossed = todo.select(*columns, "bound", F.explode(meets).alias("m")).select(*columns, F.col("bound").cast("int").alias("role"), "m.i", "m.j")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "i", "j"]):
            role, ids, linked = group["role"].to_numpy(), group["rep"].to_numpy(), make(group)
            members, a, b = np.flatnonzero(role), [], []
            for i in np.flatnonzero(role == 0).tolist() if len(members) else ():
                near = members[linked(i, members)]
                if len(near):  # one link is enough, as these members hang together
                    a.append(int(ids[i]))
                    b.append(int(ids[near[0]]))
            yield edges(a, b)

    others = todo.where(~F.col("bound"))
    blocks = F.transform(rest, lambda j: pair(F.least(own(F.col("others")), j), F.greatest(own(F.col("others")), j)))
    others = others.select(*columns, F.explode(blocks).alias("m")).select(*columns, "m.i", "m.j")
    return out.unionByName(dealt(crossed, ["key", "i", "j"], "role", "rep").mapInArrow(cross, "a long, b long")).unionByName(star_groups(others, ["key", "i", "j"], make))
