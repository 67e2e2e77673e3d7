"""Near-dedup of embeddings: spherical k-means cells, and blocked cosines within them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .graph import connected_components

#: Vectors at least that centroids are learned from, and of larger sets for each cell.
SAMPLE_VECTORS, SAMPLE_OF_CELL = 8_192, 16
CELL_VECTORS = 2_048
#: Cells grow with the largest label as far as the driver can learn them; beyond, cells grow and are dealt in more parts.
MAX_CELLS = 4_096
HOME_ROWS = 2_048
KEYS = ["label", "cell", "part"]


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _unit(batch: pa.RecordBatch, column: str) -> np.ndarray:
    v = batch[column]
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v: Column) -> Column:
    """Neither null, empty nor zero, without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, cell_vectors: int = CELL_VECTORS, home_rows: int = HOME_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors of equal, non-null labels link where their cosine, in double precision, is at least
    `threshold`. Equal vectors of a label are first merged into one with a count, by 128 bits of
    hash. Centroids come from a bounded sample; their number follows the largest label's size.
    Every vector has its nearest centroid's cell as home. It is also compared with the homes of
    another cell unless one of two bounds shows that no vector within the threshold's angle can
    have its home there: the vector lies further than that angle from the plane that parts the
    two centroids, or from the cell's outermost vector. So none is lost. Homes are held in parts
    of about `home_rows`, and what is compared with them streams by. From each batch come sums of
    links and a spanning star for each group, not the pairs.

    Null, empty, zero and non-finite vectors, null labels and null ids link with nothing; vectors of
    other lengths than the commonest are compared in one cell of their length. Repeated rows count
    as other vectors, and unlike vectors that share a vec_id have links and a component each of its own. No rows give no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))
    # a zero's sign tells nothing, but the hash would tell it
    plain = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    good = rows.where(usable).withColumns({"one": F.xxhash64(plain), "two": F.xxhash64(F.lit(1), plain)})
    # a class's number tells it from others that share its smallest vec_id
    merged = good.groupBy("label", "one", "two").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    merged = cut(merged.withColumn("rep", F.monotonically_increasing_id()))
    sizes = merged.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, total = sizes
    largest = merged.groupBy("label").count().agg(F.max("count")).first()[0]
    cells = max(1, min(MAX_CELLS, -(-largest // cell_vectors)))
    sampled = max(SAMPLE_VECTORS, SAMPLE_OF_CELL * cells)
    sample = merged.where((F.size("v") == dim) & (F.pmod("one", F.lit(total)) < sampled)).select("v").toPandas()["v"]
    x = np.array(sorted(map(tuple, sample)), np.float64).reshape(-1, dim)
    x = x if len(x) else np.ones((1, dim))
    centres = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), min(cells, len(x)))
    shared = spark.sparkContext.broadcast(centres)
    angle = math.acos(min(1.0, threshold)) + 1e-7

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch the cells' outermost angles."""
        for batch in batches:
            part = batch.filter(pa.array(np.diff(batch["v"].offsets.to_numpy()) == dim))
            near = _unit(part, "v") @ shared.value.T
            out = np.full(len(shared.value), -1.0)
            np.maximum.at(out, near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1)) if len(part) else 0)
            some = np.flatnonzero(out >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some])], names=["cell", "radius"])

    radii = np.full(len(centres), -10.0)
    for r in merged.select("v").mapInArrow(homes, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[r.cell] = r.radius
    # cosines below which a vector has no link into a cell; none reaches an empty one
    reach = spark.sparkContext.broadcast(np.where(radii < 0, 2.0, np.cos(np.minimum(radii + angle, math.pi))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["v"].offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                if size != dim:
                    home, offsets, probes = np.full(len(part), -int(size)), np.arange(len(part) + 1), np.full(len(part), -int(size))
                else:
                    near = _unit(part, "v") @ shared.value.T
                    home = near.argmax(axis=1)
                    probed = near >= reach.value[None, :]
                    # the distance to the plane between home and cell: (x . (home - cell)) / |home - cell|
                    apart = np.sqrt(np.maximum(0, 2 - 2 * shared.value @ shared.value.T))[home]
                    probed &= near.max(axis=1, keepdims=True) - near <= math.sin(min(angle, math.pi / 2)) * apart + 1e-9
                    probed[np.arange(len(part)), home] = True
                    offsets, probes = np.append(0, np.cumsum(probed.sum(axis=1))), np.nonzero(probed)[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(probes, pa.int32()))
                yield pa.RecordBatch.from_arrays([part["label"], part["rep"], part["n"], part["v"], pa.array(home, pa.int32()), lists], names=["label", "rep", "n", "v", "home", "probes"])

    placed = merged.select("label", "rep", "n", "v").mapInArrow(place, f"label long, rep long, n long, v {kind}, home int, probes array<int>")
    parts = placed.groupBy("label", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / F.lit(home_rows)).cast("int").alias("parts"))
    homes = placed.select("label", F.col("home").alias("cell"), "rep", "n", "v", F.lit(0).alias("role"))
    probes = placed.select("label", F.explode("probes").alias("cell"), "rep", "n", "v", F.lit(1).alias("role"))
    both = homes.unionByName(probes).join(parts, ["label", "cell"])
    own = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    both = both.withColumn("part", F.explode(own)).drop("parts")
    dealt = both.repartition(*map(F.col, KEYS)).sortWithinPartitions(*KEYS, "role", "rep")
    found = cut(dealt.mapInArrow(_compare(threshold), "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    components = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep").join(merged.select("rep", "least"), "rep")
    lowest = components.groupBy("component").agg(F.min("least").alias("lowest"))
    components = components.select("rep", "component").join(lowest, "component").select("rep", "lowest")
    whole = merged.select("label", "one", "two", "rep", "n", "least").join(links, "rep", "left").join(components, "rep", "left")
    whole = whole.select("label", "one", "two", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    linked = good.select("vec_id", "label", "one", "two").join(whole, ["label", "one", "two"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(threshold: float, step: int = 1024):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, home = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                rows = [tuple(x) for x in zip(*(piece[k].to_pylist() for k in [*KEYS, "role"]), strict=True)]
                cuts = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = piece.slice(a, b - a)
                    if rows[a][:3] != key:
                        key, homes, home = rows[a][:3], [], None
                    if not rows[a][3]:
                        homes.append((part["rep"].to_numpy(), part["n"].to_numpy(), _unit(part, "v")))
                    elif homes:
                        if home is None:
                            home = tuple(np.concatenate(c) for c in zip(*homes, strict=True))
                        yield from _links(part["rep"].to_numpy(), _unit(part, "v"), home, threshold)

    return compare


def _links(rep: np.ndarray, x: np.ndarray, home: tuple[np.ndarray, ...], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sums of the links of each row, and stars that hold together what is linked here."""
    reps, n, y = home
    i, j = np.nonzero(x @ y.T >= threshold)
    i, j = i[rep[i] != reps[j]], j[rep[i] != reps[j]]
    if not len(i):
        return
    sums = np.zeros(len(rep), np.int64)
    np.add.at(sums, i, n[j])
    ids, back = np.unique(np.append(rep[i], reps[j]), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    least = np.arange(len(ids))
    while True:
        low = least.copy()
        np.minimum.at(low, a, least[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == least).all():
            break
        least = low
    some = np.flatnonzero(sums)
    columns = np.append(rep[some], ids), np.append(rep[some], ids[least]), np.append(sums[some], np.zeros(len(ids), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])
