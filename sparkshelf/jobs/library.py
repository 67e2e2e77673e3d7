"""A document library over one folder of snapshots: what a user calls, each answer a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.functions import paths, render, text
from sparkshelf.operators import cells, chunks, context, fts, fusion, maintenance, segments, status, vectors
from sparkshelf.shipping import ship
from sparkshelf.sources.catalog import Catalog, Transaction
from sparkshelf.sources.corpus import FILES, Collections, scan_changes
from sparkshelf.sources.sqlsearch import register_search
from sparkshelf.streaming.ingest import DOCUMENTS, ingest

CONTENT = "hash string, doc string, created_at string"
FAILURES = "hash string, seq int, error string, at string"
VECTORS = "hash string, seq int, pos int, model string, embedded_at string, embedding array<float>"


def reference(name: str) -> tuple[str, str, int | None]:
    """(kind, value, line) of a reference: '#a1b2c3', 'doc://c/p', 'c/p' or a glob, each maybe with ':line'."""
    line = None
    if (m := re.fullmatch(r"(.+):(\d+)", name)) and "://" not in m[1][-2:]:
        name, line = m[1], int(m[2])
    if re.fullmatch(r"#*[0-9a-fA-F]{6}", name):
        return "docid", name.lstrip("#").lower(), line
    for lead in (f"{paths.SCHEME}://", "//"):
        if name.startswith(lead):
            return "path", name[len(lead) :].lstrip("/"), line
    return ("glob" if re.search(r"[*?\[]", name) else "path"), name, line


class Library:
    """Documents, contents and vectors of named collections. now: the time that changes are dated with; stemmed: whether words are indexed and asked for by their stems."""

    def __init__(self, spark: SparkSession, root: str, now: str, stemmed: bool = True):
        self.spark, self.catalog, self.now, self.stemmed = ship(spark), Catalog(spark, root), now, stemmed

    documents = property(lambda self: self.catalog.read("documents", DOCUMENTS))
    content = property(lambda self: self.catalog.read("content", CONTENT))
    vectors = property(lambda self: self.catalog.read("vectors", VECTORS))

    @property
    def settings(self) -> Collections:
        return Collections(self.catalog.state().notes.get("settings", "{}"))

    def _set(self, change: Callable[[Collections], None]) -> None:
        """Changes settings in a commit of their own."""

        def work(t: Transaction) -> None:
            settings = Collections(t.told("settings", "{}"))
            change(settings)
            t.note("settings", settings.dumps())

        self.catalog.run(work)

    def corpus(self) -> DataFrame:
        """Active documents with their bodies and a key that follows from collection and path."""
        state = self.catalog.state()
        return self._corpus(self.catalog.rows(state, "documents", DOCUMENTS), self.catalog.rows(state, "content", CONTENT))

    @staticmethod
    def _corpus(documents: DataFrame, content: DataFrame, few: Column | None = None) -> DataFrame:
        """few: a condition on doc_pk that few documents meet; no bodies of others travel."""
        rows = documents.where("active").withColumn("doc_pk", F.xxhash64("collection", "path"))
        rows = rows if few is None else F.broadcast(rows.where(few))
        return rows.join(content.select("hash", F.col("doc").alias("body")), "hash")

    def add(self, name: str, folder: str, pattern: str = "**/*.md") -> DataFrame:
        """Takes a folder in as a collection; gives its changes, as update() does."""
        self._set(lambda settings: settings.add(name, folder, pattern))
        return self.update(name)

    def update(self, name: str) -> DataFrame:
        """Scans a collection's folder; (action, count). One commit holds its changes to contents, documents and known files.

        Only files that are new or whose size or time has changed are opened, and only what differs is written.
        """
        counts = self.catalog.run(lambda t: self._update(t, name))
        for table in ("documents", "content", "files"):
            self.catalog.merge_many(table)
        return self.spark.createDataFrame(counts, "action string, count long")

    def _update(self, t: Transaction, name: str) -> list:
        own = Collections(t.told("settings", "{}")).all[name]
        scan, read = scan_changes(self.spark, own["path"], name, t.read("files", FILES), own["pattern"])
        documents = t.read("documents", DOCUMENTS).where(F.col("collection") == name)
        changes = cut(maintenance.diff(scan, documents))
        counts = changes.groupBy("action").count().collect()
        bodies = read.where("hash is not null and not gone").groupBy("hash").agg(F.first("body").alias("doc"))
        new = cut(bodies.join(t.read("content", CONTENT).select("hash"), "hash", "left_anti").select("hash", "doc", F.lit(self.now).alias("created_at")))
        if not new.isEmpty():
            t.append("content", new)
        if any(r.action != "unchanged" for r in counts):
            t.append("documents", maintenance.changed_rows(documents, changes, self.now))
        if not read.isEmpty():
            t.append("files", read.drop("body"))
        return counts

    def ingest(self, stream: DataFrame, checkpoint: str, changes: int = 32):
        """Upserts and deletes a stream's documents (collection, path, body or null, ...); each batch is a commit. See streaming/ingest.py."""
        return ingest(stream, self.catalog, checkpoint, self.now, changes)

    def remove(self, name: str) -> None:
        def work(t: Transaction) -> None:
            settings = Collections(t.told("settings", "{}"))
            settings.remove(name)
            documents, content = maintenance.remove_collection(t.read("documents", DOCUMENTS), t.read("content", CONTENT), name)
            t.write("documents", documents)
            t.write("content", content)
            t.write("files", t.read("files", FILES).where(F.col("collection") != name))
            t.note("settings", settings.dumps())

        self.catalog.run(work)

    def rename(self, old: str, new: str) -> None:
        def work(t: Transaction) -> None:
            settings = Collections(t.told("settings", "{}"))
            settings.rename(old, new)
            t.write("documents", maintenance.rename_collection(t.read("documents", DOCUMENTS), old, new))
            t.write("files", t.read("files", FILES).withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection"))))
            t.note("settings", settings.dumps())

        self.catalog.run(work)

    def set_context(self, name: str, prefix: str, description: str | None) -> None:
        self._set(lambda settings: settings.set_context(name, prefix, description))

    def set_general_context(self, description: str | None) -> None:
        """What stands for documents without a context of their own."""
        self._set(lambda settings: setattr(settings, "general", description))

    def collections(self) -> DataFrame:
        """(name, folder, pattern) of the settings."""
        return self.settings.table(self.spark)

    def owner(self, files: DataFrame) -> DataFrame:
        """Paths of the file system (file, ...) with the collection that holds each and the rest of the path."""
        return context.owning_collection(files, self.collections())

    def _described(self, rows: DataFrame) -> DataFrame:
        """With context; scored rows stay in their order."""
        settings = self.settings
        found = context.with_context(rows, settings.contexts(self.spark), settings.general)
        return found.orderBy(F.desc(F.round("score", 9)), "collection", "path") if "score" in found.columns else found

    def index(self) -> segments.SegmentedIndex:
        """The stored index of the documents as the last commit left them. What has changed since it was last asked for is indexed now, by changes."""

        def work(t: Transaction) -> segments.Layout:
            layout, shown = segments.Layout.of(t.told("index"), self.stemmed), [t.state.folders("documents"), t.state.folders("content")]
            if t.told("indexed") == shown:
                return layout
            # the state that is indexed may go on changing: the next one to ask sees it
            rows = lambda table, schema: self.catalog.rows(t.state, table, schema)
            corpus = lambda few=None: self._corpus(rows("documents", DOCUMENTS), rows("content", CONTENT), few)
            after = segments.refreshed(self.spark, layout, corpus(), self.catalog.at, lambda: self.catalog.new_folder("index"), corpus)
            t.note("index", after.note())
            t.note("indexed", shown)
            return after

        return segments.SegmentedIndex(self.spark, self.catalog.run(work), self.catalog.at)

    def search(self, query: str, limit: int = 10, collection: str | None = None, min_score: float | None = None) -> DataFrame:
        """docid, file, title, score and context of the best documents by words, from the stored index."""
        return self._described(fts.search(self.index(), query, limit, collection, min_score))

    def register_sql(self, name: str = "shelf") -> None:
        """Table functions for SQL, {name}_search(q, k) and {name}_search_in(q, k, collection), over the index as it is now; see sources/sqlsearch.py."""
        register_search(self.spark, self.index(), name)

    def nearest(self, vector: list[float], limit: int = 10, collection: str | None = None, min_score: float | None = None) -> DataFrame:
        """The best documents by cosine of their first chunk. Where index_vectors() has been called since vectors last changed, only cells that may hold one are read."""
        note = self.catalog.state().notes.get("cells")
        if note and note["shown"] == self.catalog.state().folders("vectors"):
            documents = self.corpus().drop("body")
            documents = documents if collection is None else documents.where(F.col("collection") == collection)
            found, _ = cells.open_cells(self.spark, self.catalog.at(note["folders"][0])).search(vector, limit, lambda rows: documents.join(rows, "hash"), ("collection", "path"))
            best = found.select("doc_pk", "collection", "path", "score")
        else:
            best = vectors.nearest(self.corpus(), self.vectors, vector, limit, collection)
        return self._described(best if min_score is None else best.where(F.col("score") >= min_score))

    def hybrid(self, query: str, vector: list[float], limit: int = 10) -> DataFrame:
        """file, title, score, context and body: both searches with twice the limit, fused by rank."""
        return self._described(self._with_bodies(fusion.top(fusion.fuse(self._lists([("lex", query)], 2 * limit).unionByName(self._lists([("vec", query)], 2 * limit, lambda text: vector))), limit)))

    def vector_of(self, text_: str, embed=None) -> list[float]:
        """A query's vector."""
        embed = embed or vectors.hashed_embedding()
        return list(self.spark.createDataFrame([(text_,)], "text string").select(embed(vectors.query_prompt(F.col("text")))).first()[0])

    def sub_queries(self, query: str, expand: bool = True, generate: Callable[[str], str] | None = None) -> list[tuple[str, str]]:
        """(kind, text) of the queries that a hybrid search asks: those that a generator's text names, or the query itself by words and by meaning."""
        if not expand or generate is None:
            return [("lex", query), ("vec", query)]
        told = self.spark.createDataFrame([(0, generate(query), query)], "query_id int, output string, original string")
        return [(r.kind, r.text) for r in fusion.parse_expansion(told).orderBy("no").collect()]

    def _lists(self, queries: list[tuple[str, str]], limit: int, vector: Callable[[str], list[float]] | None = None, collection: str | None = None) -> DataFrame:
        """(list_id, rank, file, title): results by words of all lex queries as one list, and those by meaning as another."""
        found = self.spark.createDataFrame([], "list_id int, rank int, file string, title string")
        for list_id, kinds in enumerate((("lex",), ("vec", "hyde"))):
            parts = []
            for no, (_, text_) in enumerate(q for q in queries if q[0] in kinds):
                if kinds == ("lex",):
                    try:
                        rows = fts.search(self.index(), text_, limit, collection)
                    except fts.QuerySyntaxError:
                        continue  # an expansion need not be a query
                else:
                    rows = vectors.nearest(self.corpus(), self.vectors, vector(text_), limit, collection).select("collection", "path", "score", F.concat_ws("/", "collection", "path").alias("file"), F.lit("").alias("title"))
                rows = fusion.ranked(rows, list_id, F.desc(F.round("score", 9)), F.col("collection"), F.col("path"))
                parts.append(rows.select(F.lit(no).alias("query_no"), "rank", "file", "title"))
            for p in parts[1:]:
                parts[0] = parts[0].unionByName(p)
            if parts:
                found = found.unionByName(fusion.continued(parts[0], list_id).select("list_id", "rank", "file", "title"))
        return found

    def _with_bodies(self, best: DataFrame) -> DataFrame:
        rows = self.corpus().select(F.concat_ws("/", "collection", "path").alias("file"), "collection", "path", "body", F.col("title").alias("own"))
        return best.join(rows, "file").withColumn("title", F.col("own")).drop("own")

    def hybrid_search(self, query: str, limit: int = 10, collection: str | None = None, expand: bool = True, rerank: bool = True, generate: Callable[[str], str] | None = None, embed=None) -> DataFrame:
        """file, title, score, context and body of the best documents by words and by meaning.

        The query is expanded to several, whose results by words make one ranked list and those by
        meaning another; both are fused, and the best 2 * limit put in the order of the cosine of
        their text with the query. Scores stay those of the fusion.
        """
        queries = self.sub_queries(query, expand, generate)
        lists = self._lists(queries, 2 * limit, lambda text_: self.vector_of(text_, embed), collection)
        pool = self._with_bodies(fusion.top(fusion.fuse(lists), 2 * limit))
        if not rerank:
            return self._described(pool).limit(limit)
        best = self._reranked(pool, query, limit, embed)
        settings = self.settings
        return context.with_context(best, settings.contexts(self.spark), settings.general).orderBy(F.desc(F.round("rerank_score", 9)), "file")

    def _reranked(self, pool: DataFrame, query: str, limit: int, embed=None) -> DataFrame:
        embed = embed or vectors.hashed_embedding()
        own = pool.select("file", embed(vectors.document_prompt(F.col("title"), F.col("body"))).alias("embedding"))
        return fusion.rerank_by_vectors(pool, own, self.vector_of(query, embed), limit)

    def rerank(self, query: str, names: str, limit: int = 10, embed=None) -> DataFrame:
        """file and rerank_score of the documents that a comma list names, the most like the query first."""
        pool = self.multi_get(names, most=2**31 - 1).where("not skipped").select("file", "title", "body")
        return self._reranked(pool, query, limit, embed).select("file", "rerank_score")

    def get(self, name: str, lines: int | None = None) -> DataFrame:
        """The documents that a reference names, with their text from its line on."""
        kind, value, line = reference(name)
        rows = self.corpus().withColumn("file", F.concat_ws("/", "collection", "path"))
        if kind == "docid":
            rows = rows.where(F.col("hash").startswith(value)).orderBy("collection", "path").limit(1)
        else:
            rows = rows.where(F.col("file") == value if kind == "path" else paths.matches_glob(F.col("path"), value))
        body = text.line_range(F.col("body"), line or 1, lines) if line or lines else F.col("body")
        return self._described(rows).select("file", text.docid(F.col("hash")).alias("docid"), "title", "context", body.alias("body"))

    def multi_get(self, names: str, most: int = 10_240, max_lines: int | None = None) -> DataFrame:
        """Documents of a comma list or a glob; larger ones without their text, as skipped; of others max_lines lines at most.

        All names are met in one pass over the documents.
        """
        wanted = [n.strip() for n in names.split(",") if n.strip()] if "," in names and not re.search(r"[*?]", names) else [names]
        rows = self.corpus().withColumn("file", F.concat_ws("/", "collection", "path"))
        told = [reference(n) for n in wanted]
        files, docids = [v for k, v, _ in told if k == "path"], [v for k, v, _ in told if k == "docid"]
        hit = F.col("file").isin(files) | text.docid(F.col("hash")).isin(docids)
        for _, v, _ in (t for t in told if t[0] == "glob"):
            hit = hit | paths.matches_glob(F.col("path"), v)
        found = rows.where(hit)
        if docids:  # of a content's copies the first one answers for its docid
            first = F.min(F.struct("collection", "path")).over(Window.partitionBy(text.docid(F.col("hash"))))
            other = ~F.col("file").isin(files)
            for _, v, _ in (t for t in told if t[0] == "glob"):
                other = other & ~paths.matches_glob(F.col("path"), v)
            found = found.withColumn("_first", first).where(~other | (F.struct("collection", "path") == F.col("_first"))).drop("_first")
        large = F.octet_length("body") > most
        body = F.col("body") if max_lines is None else text.line_range(F.col("body"), 1, max_lines)
        return self._described(found).select("file", "title", "context", large.alias("skipped"), F.when(large, "File too large").alias("reason"), F.when(~large, body).alias("body"))

    def files(self, collection: str, prefix: str = "") -> DataFrame:
        rows = self.corpus().where((F.col("collection") == collection) & paths.has_prefix(F.col("path"), prefix))
        return rows.select("path", "title", "modified_at", F.length("body").alias("size"), render.format_bytes(F.octet_length("body")).alias("bytes")).orderBy("path")

    def status(self) -> DataFrame:
        """(name, documents, last_modified, contexts) of the collections."""
        settings = self.settings
        return status.with_contexts(status.by_collection(settings.table(self.spark), self.documents), settings.contexts(self.spark))

    def totals(self) -> DataFrame:
        return status.totals(self.documents, self.vectors)

    def health(self) -> DataFrame:
        return status.warnings(status.health(self.documents, self.vectors, self.now))

    def vector(self, hash_: str, seq: int = 0) -> DataFrame:
        """(embedding) of one content's chunk."""
        return vectors.vector_of(self.vectors, hash_, seq)

    def index_vectors(self, cell_vectors: int = cells.CELL_VECTORS) -> None:
        """Stores the first chunks' vectors by cells, for nearest()."""

        def work(t: Transaction) -> None:
            shown, folder = t.state.folders("vectors"), self.catalog.new_folder("cells")
            rows = self.catalog.rows(t.state, "vectors", VECTORS).where("seq = 0").select("hash", "embedding")
            cells.write_cells(rows, self.catalog.at(folder), cell_vectors)
            t.note("cells", {"folders": [folder], "shown": shown})

        self.catalog.run(work)

    def clear_vectors(self) -> int:
        """Forgets all vectors; how many there were."""
        def work(t: Transaction) -> int:
            n = t.read("vectors", VECTORS).count()
            t.write("vectors", self.spark.createDataFrame([], VECTORS))
            return n

        return self.catalog.run(work)

    def embed(self, embed=None, model: str = "hashed", most: int = chunks.TOKENS, overlap: int = chunks.TOKEN_OVERLAP, force: bool = False, with_model: Callable[[list[str]], list] | None = None) -> DataFrame:
        """Embeds chunks of contents that have no vector yet, with force of all: each content once, with its first title. One row: chunks embedded and failed, and empty contents left out.

        embed: a column function, whose errors end the job. with_model: a function from a list of texts to a list
        of vectors instead, called with texts of like length; a chunk for which it fails becomes a row of failures()
        and costs no other. A later call embeds only chunks that are new or have failed. Vectors are appended; none is written again.
        """

        def work(t: Transaction) -> tuple[int, int, int]:
            documents, corpus = t.read("documents", DOCUMENTS), self._corpus(t.read("documents", DOCUMENTS), t.read("content", CONTENT))
            old = t.read("vectors", VECTORS)
            old = old.limit(0) if force else old
            failed = t.read("failures", FAILURES).where("error is not null").select("hash", "seq")
            todo = vectors.pending(documents, old).select("hash").unionByName(failed.select("hash")).distinct()
            waiting = corpus.join(todo, "hash", "left_semi")
            each = waiting.where(F.col("body").rlike(r"\S")).groupBy("hash").agg(F.min_by("title", F.struct("collection", "path")).alias("title"), F.first("body").alias("body"))
            pieces = chunks.chunk_tokens(each, "hash", "body", most, overlap).join(each.select("hash", "title"), "hash").withColumn("seq", F.col("seq").cast("int"))
            pieces = pieces.join(old.select("hash", "seq"), ["hash", "seq"], "left_anti")
            prompt = vectors.document_prompt(F.col("title"), F.col("chunk"))
            if with_model is None:
                outcome = F.struct((embed or vectors.hashed_embedding())(prompt).alias("embedding"), F.lit(None).cast("string").alias("error"))
            else:
                outcome = vectors.checked_embedding(with_model)(prompt)
            told = cut(pieces.select("hash", "seq", "pos", F.lit(model).alias("model"), F.lit(self.now).alias("embedded_at"), outcome.alias("x")).select("hash", "seq", "pos", "model", "embedded_at", "x.embedding", "x.error"))
            counts = told.agg(F.count(F.when(F.col("error").isNull(), 1)), F.count("error")).first()
            (t.write if force else t.append)("vectors", told.where("error is null").drop("error"))
            # those that failed before and are done now have a row without error
            late = told.select("hash", "seq", "error", F.col("embedded_at").alias("at")).join(failed.withColumn("again", F.lit(True)), ["hash", "seq"], "left")
            late = late.where("error is not null or again").drop("again")
            if force or counts[1] or not failed.isEmpty():
                (t.write if force else t.append)("failures", late)
            return counts[0], counts[1], waiting.where(~F.col("body").rlike(r"\S")).select("hash").distinct().count()

        done = self.catalog.run(work)
        self.catalog.merge_many("vectors")
        return self.spark.createDataFrame([done], "embedded long, failed long, empty long")

    def failures(self) -> DataFrame:
        """(hash, seq, error, at) of chunks that the last calls of embed() could not embed."""
        return self.catalog.read("failures", FAILURES).where("error is not null")

    def overview(self) -> DataFrame:
        """All of the library in one row: documents, contents, embedded and needs_embedding, has_vector_index, and collections (name, documents, last_modified, contexts) by name."""
        return status.overview(self.totals(), self.status())

    def cleanup(self) -> None:
        def work(t: Transaction) -> None:
            documents, content, kept = maintenance.cleanup(t.read("documents", DOCUMENTS), t.read("content", CONTENT), t.read("vectors", VECTORS))
            t.write("documents", documents)
            t.write("vectors", kept)
            t.write("content", content)

        self.catalog.run(work)

    def vacuum(self, age: float = 86_400.0) -> int:
        """Merges changes and drops folders that only old commits hold, and older ones than `age` seconds that none does; how many snapshots and pieces of the index."""
        before = len(self.catalog.folders(f"{self.catalog.root}/index"))
        old = sum(len(self.catalog.vacuum(t, age)) for t in ("documents", "content", "vectors", "failures", "files", "index", "cells"))
        self.catalog.forget()
        return old + before - len(self.catalog.folders(f"{self.catalog.root}/index"))

    def ask_context(self, query: str, limit: int = 5) -> str:
        """Numbered openings of the best documents by words, for a generator's prompt."""
        best = self.search(fts.quote_terms(query), limit).join(self.corpus().select("doc_pk", "body"), "doc_pk").orderBy(F.desc("score"), "file")
        return "\n\n".join(f"[{i}] {r.file}\n{r.body[:1000]}" for i, r in enumerate(best.collect(), 1))

    def ask(self, question: str, generate: Callable[[str], str], limit: int = 5, collection: str | None = None, embed=None, by_words: bool = False) -> tuple[str, list[str]]:
        """A generator's answer from the openings of the best documents, by meaning or by words, and these documents; ('', []) if there are none."""
        found = self.search(fts.quote_terms(question), limit, collection) if by_words else self.nearest(self.vector_of(question, embed), limit, collection)
        best = found.select(F.concat_ws("/", "collection", "path").alias("file"), "score").join(self.corpus().select(F.concat_ws("/", "collection", "path").alias("file"), F.substring("body", 1, 1000).alias("opening")), "file")
        rows = best.orderBy(F.desc(F.round("score", 9)), "file").collect()
        if not rows:
            return "", []
        given = "\n\n".join(f"[{i}] {r.file}\n{r.opening}" for i, r in enumerate(rows, 1))
        return generate(f"Answer briefly and only from these documents.\n\n{given}\n\nQuestion: {question}\nAnswer:"), [r.file for r in rows]

    def describe(self) -> str:
        return self.settings.dumps()
