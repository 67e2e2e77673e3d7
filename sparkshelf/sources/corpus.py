"""Where documents come from: files of a folder and tables; and the settings of collections."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.functions import paths, text
from sparkshelf.sources.catalog import Catalog

EPOCH = "2024-01-01"
__all__ = ["Catalog", "Collections", "from_documents", "list_files", "read_files", "scan_changes", "scan_files", "vectors_of"]


def _walk(system: fs.FileSystem, top: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, time of the last change in ns) of all files below a folder, or of the file; folders that no scan enters aren't listed.

    Links are followed on a local disk, but for one to a folder that it lies in.
    """
    local = isinstance(system, fs.LocalFileSystem)
    info = system.get_file_info(top)
    if info.is_file:
        yield top, info.size, info.mtime_ns or 0
    todo: list[tuple[str, frozenset]] = [(top, frozenset())] if info.type == fs.FileType.Directory else []
    while todo:
        folder, above = todo.pop()
        if local:
            held = os.stat(folder)
            if (held.st_dev, held.st_ino) in above:
                continue
            above |= {(held.st_dev, held.st_ino)}
        try:
            found = system.get_file_info(fs.FileSelector(folder))
        except OSError:
            continue  # one that can't be read is left out, as its files are
        for x in found:
            if x.is_file:
                yield x.path, x.size, x.mtime_ns or 0
            elif x.type == fs.FileType.Directory and not x.base_name.startswith(".") and x.base_name not in paths.EXCLUDED:
                todo.append((x.path, above))


LISTING = "file string, size long, changed long"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All files below folders, and files, by Arrow's client of their file system; names that start with an underscore count."""
    for batch in batches:
        for uri in batch["uri"].to_pylist():
            walk = _walk(*file_system(uri))
            while part := list(islice(walk, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "size", "changed"])


def _contents(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(root)
        for batch in batches:
            for source, file in zip(batch["source"].to_pylist(), batch["file"].to_pylist(), strict=True):
                with system.open_input_file(file) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([f.read()], pa.binary())], names=["source", "content"])

    return read


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's client for a folder or file, and the path in it; a path without a scheme is a local one."""
    if uri.partition(":")[0] in (uri, "file"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith(("file:", "/")) else uri
    return fs.FileSystem.from_uri(uri)


def list_files(spark: SparkSession, folder: str, pattern: str = "**/*.md", tasks: int = 64) -> DataFrame:
    """(source, file, size, changed) of the files below a folder whose relative path fits the glob and isn't excluded; none is opened.

    The driver lists the folder's own entries; tasks list what lies below each. So names don't pass through the driver.
    """
    system, top = file_system(folder)
    top = top.rstrip("/") or "/"
    entries = [(x.path if folder.partition(":")[0] in (folder, "file") else f"{folder.partition('://')[0]}://{x.path}",) for x in system.get_file_info(fs.FileSelector(top)) if not x.base_name.startswith(".") and x.base_name not in paths.EXCLUDED]
    if not entries:
        return spark.createDataFrame([], f"source string, {LISTING}")
    names = spark.createDataFrame(entries, "uri string").repartition(min(tasks, len(entries))).mapInArrow(_listed, LISTING)
    files = names.select(F.expr(f"substring(file, {len(top.rstrip('/')) + 2})").alias("source"), "file", "size", "changed")
    return files.where(paths.matches_glob(F.col("source"), pattern) & ~paths.is_excluded(F.col("source")))


def read_files(files: DataFrame, folder: str, tasks: int = 64) -> DataFrame:
    """(source, body) of listed files (source, file); body is null where it isn't UTF-8. Tasks read them, dealt by file."""
    raw = files.select("source", "file").repartition(tasks, "file").mapInArrow(_contents(folder), "source string, content binary")
    return raw.select("source", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).alias("body"))


def scan_files(spark: SparkSession, folder: str, collection: str, pattern: str = "**/*.md", tasks: int = 64) -> DataFrame:
    """(collection, path, source, title, hash, body) of the UTF-8 files below a folder whose relative path fits the glob and isn't excluded; all are read."""
    good = read_files(list_files(spark, folder, pattern, tasks), folder, tasks).where("body is not null")
    return good.select(F.lit(collection).alias("collection"), paths.handelize(F.col("source")).alias("path"), "source", text.title(F.col("body")).alias("title"), text.content_hash(F.col("body")).alias("hash"), "body")


#: What is known of a collection's files. changed: in ns; settled: the file was older than that when it was read, so a later change shows in its time; hash: null where it isn't UTF-8; gone: no longer there.
FILES = "collection string, source string, size long, changed long, settled boolean, path string, title string, hash string, gone boolean"
#: Seconds within which a file may change again without another time.
UNSETTLED = 2.0


def scan_changes(spark: SparkSession, folder: str, collection: str, known: DataFrame, pattern: str = "**/*.md", tasks: int = 64, now: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(scan, read): what scan_files() gives of a folder but the bodies, from known files (FILES) where size and time are as they were; and the FILES rows of the files that had to be opened, with their body, and of those that are gone.

    Only files that are new, have another size or time, or were too young when they were last read are opened. `read` is checkpointed, so one state of each file goes into everything made of it.
    """
    now = time.time() if now is None else now
    listed = cut(list_files(spark, folder, pattern, tasks))
    old = known.where((F.col("collection") == collection) & ~F.col("gone")).drop("collection", "gone")
    both = listed.alias("l").join(old.alias("o"), "source", "left")
    same = F.col("o.settled") & (F.col("l.size") == F.col("o.size")) & (F.col("l.changed") == F.col("o.changed"))
    same = F.coalesce(same, F.lit(False))
    kept = both.where(same).select(F.lit(collection).alias("collection"), "o.path", "source", "o.title", "o.hash")
    todo = both.where(~same).select("source", "file", "l.size", "l.changed")
    bodies = read_files(todo, folder, tasks).join(todo.drop("file"), "source")
    read = bodies.select(
        F.lit(collection).alias("collection"), "source", "size", "changed", (F.col("changed") < int((now - UNSETTLED) * 1e9)).alias("settled"), paths.handelize(F.col("source")).alias("path"),
        text.title(F.col("body")).alias("title"), F.when(F.col("body").isNotNull(), text.content_hash(F.col("body"))).alias("hash"), F.lit(False).alias("gone"), "body",
    )
    gone = old.join(listed.select("source"), "source", "left_anti").select(F.lit(collection).alias("collection"), "source", "size", "changed", "settled", "path", "title", "hash", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("body"))
    read = cut(read.unionByName(gone))
    fresh = read.where(~F.col("gone")).select("collection", "path", "source", "title", "hash")
    return kept.unionByName(fresh).where("hash is not null"), read


def from_documents(docs: DataFrame) -> DataFrame:
    """The corpus of a table (doc_id, text, lang, source): doc_pk, collection, path, title (the first line), body, hash, active and modified_at."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").alias("doc_pk"), F.col("source").alias("collection"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        text.first_line(body).alias("title"), body.alias("body"), text.content_hash(body).alias("hash"), F.lit(True).alias("active"),
        F.concat(F.date_add(F.lit(EPOCH).cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string"), F.lit("T00:00:00Z")).alias("modified_at"),
    )


def vectors_of(embeddings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(hash, seq, pos, model, embedded_at, embedding) of vectors (vec_id, embedding) whose vec_id is a document's."""
    rows = embeddings.join(corpus.select(F.col("doc_pk").alias("vec_id"), "hash"), "vec_id").groupBy("hash").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return rows.select("hash", F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.lit("given").alias("model"), F.lit(f"{EPOCH}T00:00:00Z").alias("embedded_at"), "embedding")


class Collections:
    """Settings of collections and their contexts, and a global context, kept as one JSON text in a column of a catalog."""

    def __init__(self, text_: str = "{}"):
        held = json.loads(text_)
        self.all: dict[str, dict] = held.get("collections", {})
        self.general: str | None = held.get("general")

    def add(self, name: str, path: str, pattern: str = "**/*.md") -> None:
        self.all[name] = {"path": path, "pattern": pattern, "context": self.all.get(name, {}).get("context", {})}

    def remove(self, name: str) -> bool:
        return self.all.pop(name, None) is not None

    def rename(self, old: str, new: str) -> None:
        if old not in self.all or new in self.all:
            raise ValueError(f"{old} isn't there or {new} is")
        self.all[new] = self.all.pop(old)

    def set_context(self, name: str, prefix: str, context: str | None) -> None:
        held = self.all[name].setdefault("context", {})
        if context is None:
            held.pop(prefix, None)
        else:
            held[prefix] = context

    def dumps(self) -> str:
        return json.dumps({"collections": self.all, "general": self.general}, sort_keys=True, ensure_ascii=False)

    def contexts(self, spark: SparkSession) -> DataFrame:
        rows = [(n, p, c) for n, x in sorted(self.all.items()) for p, c in sorted(x["context"].items())]
        return spark.createDataFrame(rows, "collection string, prefix string, context string")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, x["path"], x["pattern"]) for n, x in sorted(self.all.items())], "name string, folder string, pattern string")
