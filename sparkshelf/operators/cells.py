"""Vectors stored by cells: exact nearest neighbours that read only the cells which may hold one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.operators.vectors import QUERY_ROWS, VECTOR_ROWS, best_of_blocks, cosine

#: Vectors of a cell, about; cells at most, whose centroids the driver and every task hold; vectors of a cell from which centroids are learned.
CELL_VECTORS, MOST_CELLS, LEARNED = 2_048, 8_192, 32
#: Angle by which bounds are widened against rounding.
SLACK = 1e-6
#: The cell of vectors that have no direction, or another length than most: always read.
ODD = -1
DIRECTORY = "cell int, n long, radius double, centroid array<float>"


def learn_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _directions(v: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors of `dim` components that have a direction, and these to length 1."""
    sizes = np.diff(v.offsets.to_numpy()) * v.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[v.offsets.to_numpy()[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(x, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    return rows[fine], x[fine] / norms[fine, None]


def write_cells(vectors: DataFrame, path: str, cell_vectors: int = CELL_VECTORS, most_cells: int = MOST_CELLS) -> None:
    """Keeps rows (embedding, ...) below `path` by cells of about cell_vectors, with a directory of each cell's centroid, size and radius (the largest angle between the centroid and a vector of the cell).

    Centroids come of a sample of LEARNED vectors a cell; every vector is stored. Rows are dealt by ranges of cells and rows, so a cell of many is written by several tasks.
    The directory is written last: cells without it aren't read.
    """
    spark = vectors.sparkSession
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, total = sizes or (0, 0)
    cells = max(1, min(most_cells, -(-total // cell_vectors)))
    mark = F.pmod(F.xxhash64(F.col("embedding").cast("string")), F.lit(max(1, total)))
    sample = vectors.where(F.size("embedding") == dim).where(mark < 2 * LEARNED * cells).select("embedding").limit(4 * LEARNED * cells).toArrow()["embedding"].combine_chunks() if dim else None
    x = _directions(sample, dim)[1] if sample is not None and len(sample) else np.zeros((0, dim))
    x = x[np.lexsort(x.T)] if len(x) else np.eye(max(1, dim))[:1]
    centres = learn_centroids(x, cells)
    shared = spark.sparkContext.broadcast(centres)
    kind = vectors.withColumns({"cell": F.lit(None).cast("int"), "angle": F.lit(None).cast("double")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, ODD, np.int32), np.zeros(batch.num_rows)
            rows, unit = _directions(batch["embedding"], dim)
            near = unit @ shared.value.T if len(rows) else np.zeros((0, 1))
            if len(rows):
                cell[rows] = near.argmax(axis=1)
                angle[rows] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    placed = cut(vectors.mapInArrow(place, kind))
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    parts = max(1, -(-placed.count() // VECTOR_ROWS))
    # sorted by cell, too, so that the writer needs no order of its own
    placed.drop("angle").repartitionByRange(parts, "cell", F.xxhash64("embedding")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/cells")
    vectors.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    rows = [(r.cell, r.n, r.radius, [] if r.cell == ODD else centres[r.cell].tolist()) for r in found]
    spark.createDataFrame(rows, DIRECTORY).coalesce(1).write.parquet(f"{path}/directory")


class Cells:
    """Vectors that write_cells() has kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema(DIRECTORY).parquet(f"{path}/directory").orderBy("cell").collect()
        self.odd = sum(r.n for r in rows if r.cell == ODD)
        rows = [r for r in rows if r.cell != ODD]
        self.cell, self.n, self.radius = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int32, np.int64, np.float64)))
        self.centres = np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        norms = np.linalg.norm(self.centres, axis=1, keepdims=True)
        self.centres = self.centres / np.maximum(norms, 1e-300)

    @property
    def total(self) -> int:
        return int(self.n.sum()) + self.odd

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The vectors of some cells, or of all, with their cell."""
        columns = self.spark.read.parquet(f"{self.path}/columns").withColumn("cell", F.lit(0)).schema
        rows = self.spark.read.schema(columns).parquet(f"{self.path}/cells")
        return rows if cells is None else rows.where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, query: list[float], k: int, also: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
        """The k rows nearest to the query, with their score, and the share of vectors that had to be read.

        Cells are read from the one on, whose bound is highest, until they give k rows; then those whose bound reaches the k-th score.
        also: what becomes of vectors before they count, as a join or a filter. order: columns that tell ties.
        """
        bound = bounds(np.array([query], np.float64), self.centres, self.radius)[0]
        by_bound = np.argsort(-bound, kind="stable")
        score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
        best = lambda cells: also(self.rows([ODD, *self.cell[cells]])).withColumn("score", score).orderBy(F.desc(F.round("score", 9)), *order).limit(k)
        at = int(np.searchsorted(np.cumsum(self.n[by_bound]), k)) + 1
        while True:
            least = best(by_bound[:at]).agg(F.count("*"), F.min("score")).first()
            if least[0] >= k or at >= len(by_bound):
                break
            at *= 2
        reach = at if least[0] < k else max(at, int((bound >= least[1] - 1e-8).sum()))
        # bounds fall in this order, so what reaches the score stands at its front
        return best(by_bound[:reach]), float(self.n[by_bound[:reach]].sum() + self.odd) / max(1, self.total)

    def search_each(self, queries: DataFrame, k: int, id_: str = "vec_id", query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
        """(query_id, id, score, rank from 1): the k rows nearest to each query (query_id, embedding), by score and id, in two rounds.

        Each query first meets the cells of the highest bounds that hold k vectors; then those others whose
        bound reaches the k-th score found. Queries and cells meet by key, in blocks of bounded size.
        """
        shared = self.spark.sparkContext.broadcast((self.cell, self.n, self.radius, self.centres))
        asked = cut(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("double").alias("least")))

        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, n, radius, centres = shared.value
            for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
                bound = np.full((batch.num_rows, len(cell)), 2.0)
                rows, unit = _directions(batch["embedding"], centres.shape[1])
                bound[rows] = bounds(unit, centres, radius)
                by = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(n[by], axis=1) - n[by] < k
                first = np.zeros_like(held)
                np.put_along_axis(first, by, held, axis=1)
                least = batch["least"].to_numpy(zero_copy_only=False).astype(float)
                late = ~np.isnan(least)
                use = np.where(late[:, None], ~first & (bound >= np.nan_to_num(least)[:, None] - 1e-8), first)
                of, which = np.nonzero(use)
                some = np.flatnonzero(~late)  # the odd ones are met in the first round
                of, cells = np.append(of, some), np.append(cell[which], np.full(len(some), ODD))
                yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(of)), pa.array(cells, pa.int32())], names=["query_id", "cell"])

        def meet(todo: DataFrame) -> DataFrame:
            pairs = cut(todo.mapInArrow(ways, "query_id long, cell int"))
            crowd = pairs.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("i_n"))
            sizes = [(int(c), max(1, -(-int(m) // vector_rows))) for c, m in [*zip(self.cell, self.n, strict=True), (ODD, self.odd)]]
            dealt = crowd.join(F.broadcast(self.spark.createDataFrame(sizes, "cell int, j_n int")), "cell")  # a row a cell
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
            left = pairs.join(dealt, "cell").withColumns({"i": own("query_id", "i_n"), "j": every("j_n")}).join(todo.select("query_id", "embedding"), "query_id").select(F.col("query_id").alias("query"), F.col("embedding").alias("q"), "cell", "i", "j")
            right = self.rows().join(F.broadcast(dealt), "cell").withColumn("j", own(id_, "j_n")).withColumn("i", every("i_n")).select(F.col(id_).alias("vec"), F.col("embedding").alias("x"), "cell", "i", "j")
            return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(best_of_blocks(k), "query_id long, vec_id long, score double")

        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
        top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = cut(top(meet(asked)))
        least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
        again = meet(asked.drop("least").join(least, "query_id"))
        return top(first.drop("rank").unionByName(again)).select("query_id", F.col("vec_id").alias(id_), "score", "rank")


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and cell a cosine that none of the cell's vectors exceeds; 2 for a query without direction or of another length."""
    out = np.full((len(queries), len(centres)), 2.0)
    if not len(centres) or queries.shape[1] != centres.shape[1]:
        return out
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(queries, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    angle = np.arccos(np.clip(queries[fine] / norms[fine, None] @ centres.T, -1, 1))
    out[fine] = np.cos(np.minimum(np.maximum(angle - radius - SLACK, 0), math.pi))
    return out


def open_cells(spark: SparkSession, path: str) -> Cells:
    return Cells(spark, path)
