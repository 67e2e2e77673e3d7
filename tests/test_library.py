"""The library end to end over a folder of files."""

from pyspark.sql import functions as F

from sparkshelf.functions import render
from sparkshelf.functions.register import register
from sparkshelf.jobs.library import Library, reference
from sparkshelf.operators import fusion, vectors
from sparkshelf.sources.corpus import scan_files

FILES = {
    "guide/Error Handling.md": "# Handling errors\n\nA result holds an error or a value.\nMatch on it.\n",
    "guide/owners.md": "# Owners\n\nEach value has one owner; a borrow is a reference.\n",
    "notes.md": "no heading, but an error",
}


def test_references():
    assert reference("#ABC123") == ("docid", "abc123", None) and reference("doc://c/a.md:7") == ("path", "c/a.md", 7)
    assert reference("c/*.md") == ("glob", "c/*.md", None)


def test_library(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(body)
    lib = Library(spark, str(tmp_path / "root"), "2025-01-01T00:00:00Z")
    assert {tuple(r) for r in lib.add("docs", str(tmp_path / "in")).collect()} == {("new", 3)}
    lib.set_context("docs", "/guide", "how to")
    best = lib.search("error").collect()
    assert [r.file for r in best] and {r.path: r.context for r in best}["guide/error-handling-md"] == "how to"
    assert lib.search("title: owners").first().path == "guide/owners-md"
    lib.embed()
    assert lib.health().first().needs_embedding == 0
    vector = lib.vectors.join(lib.documents.where("path = 'notes-md'"), "hash").first().embedding
    assert lib.nearest(vector).first().path == "notes-md"
    assert lib.hybrid("error", vector).first().body
    assert lib.get("docs/guide/error-handling-md:3", 1).first().body == "A result holds an error or a value."
    assert {r.file for r in lib.multi_get("docs/notes-md, docs/guide/owners-md").collect()} == {"docs/notes-md", "docs/guide/owners-md"}
    assert [r.skipped for r in lib.multi_get("*owners*", most=5).collect()] == [True]
    assert [r.path for r in lib.files("docs", "GUIDE").collect()] == ["guide/error-handling-md", "guide/owners-md"]
    (tmp_path / "in" / "notes.md").unlink()
    (tmp_path / "in" / "guide" / "owners.md").write_text("# Owners\n\nchanged")
    assert {r["action"]: r["count"] for r in lib.update("docs").collect()} == {"removed": 1, "updated": 1, "unchanged": 1}
    lib.cleanup()
    assert lib.vectors.count() == 1 and lib.content.count() == 2
    lib.rename("docs", "texts")
    assert lib.status().first().documents == 2 and lib.vacuum() > 0
    assert "[1] texts/" in lib.ask_context("value")


def test_search_by_words_and_meaning(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(body)
    lib = Library(spark, str(tmp_path / "root"), "2025-01-01T00:00:00Z")
    lib.add("docs", str(tmp_path / "in"))
    assert lib.health().first().warning.startswith("3 documents (100%)")
    lib.embed()
    assert lib.health().first().warning is None and lib.totals().first().embedded == 3
    lib.set_general_context("everything")
    lib.set_context("docs", "/guide", "how to")
    assert {r.path: r.context for r in lib.search("error").collect()} == {"guide/error-handling-md": "how to", "notes-md": "everything"}
    assert lib.status().first().contexts == 1
    built = lib.catalog.folders(f"{lib.catalog.root}/index")
    lib.search("owner").collect()
    assert lib.catalog.folders(f"{lib.catalog.root}/index") == built  # read, not built again
    assert lib.sub_queries("a result") == [("lex", "a result"), ("vec", "a result")] == lib.sub_queries("a result", expand=False, generate=lambda q: "lex: a result")
    said = "lex: result value\nvec: what a result is\nhyde: A result holds a value\nlex: unrelated\nlex: (result"
    assert lib.sub_queries("result", generate=lambda q: said) == [("lex", "result value"), ("vec", "what a result is"), ("hyde", "A result holds a value"), ("lex", "(result")]
    best = lib.hybrid_search("result", limit=2, generate=lambda q: said).collect()
    assert len(best) == 2 and best[0].rerank_score >= best[1].rerank_score and all(r.body and r.context == ("everything" if r.path == "notes-md" else "how to") for r in best)
    every = {r.file: r.rerank_score for r in lib.rerank("result", "*").collect()}
    assert all(abs(every[r.file] - r.rerank_score) < 1e-9 for r in best) and len(every) == 3
    assert {r.path for r in lib.hybrid_search("result", limit=3, rerank=False).collect()} == {r.path for r in lib.hybrid_search("result", limit=3, expand=False).collect()}
    ranked = lib.rerank("a borrow is a reference", "docs/notes-md, docs/guide/owners-md").collect()
    assert [r.file for r in ranked] == ["docs/guide/owners-md", "docs/notes-md"] and ranked[0].rerank_score > ranked[1].rerank_score
    answer, sources = lib.ask("who owns a value", lambda prompt: prompt[-30:], limit=2)
    assert answer.endswith("Answer:") and len(sources) == 2
    assert lib.ask("owner", lambda prompt: "yes", by_words=True) == ("yes", ["docs/guide/owners-md"]) and lib.ask("zzz", lambda prompt: "yes", by_words=True) == ("", [])
    assert {r.file: r.body for r in lib.multi_get("docs/guide/error-handling-md, docs/notes-md, nowhere", max_lines=1).collect()} == {"docs/guide/error-handling-md": "# Handling errors", "docs/notes-md": "no heading, but an error"}
    docid = lib.get("docs/notes-md").first().docid
    assert [r.file for r in lib.multi_get(f"#{docid}, docs/notes-md").collect()] == ["docs/notes-md"] and len(lib.vector(lib.documents.where("path = 'notes-md'").first().hash).first().embedding) == 64
    files = spark.createDataFrame([(f"{tmp_path}/in/guide/owners.md",), ("/nowhere/x",)], "file string")
    assert {r.rest: r.collection for r in lib.owner(files).collect()} == {"guide/owners.md": "docs", None: None}
    (tmp_path / "in" / "notes.md").write_text("changed")
    lib.update("docs")
    lib.embed(force=True)
    assert lib.vectors.count() == 3 and not lib.search("error", collection="docs").where("path = 'notes-md'").count()
    assert lib.vacuum() > 0 and lib.clear_vectors() == 3 and lib.vectors.count() == 0


def test_scan_reads_what_lies_deep(spark, tmp_path):
    for name, body in {"a/b/c/_d.md": b"x", "a/.hidden/e.md": b"x", "node_modules/f.md": b"x", "g.md": b"\xff", "h i.md": "é".encode(), "j.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert {(r.source, r.body) for r in scan_files(spark, folder, "c").collect()} == {("a/b/c/_d.md", "x"), ("h i.md", "é")}
    (tmp_path / "none").mkdir()
    assert scan_files(spark, str(tmp_path / "none"), "c").count() == 0


def test_ranks_of_tables_and_vectors_of_unlike_lengths(spark):
    rows = spark.range(500).withColumn("x", F.col("id") % 7)
    got = {r.id: r["rank"] for r in fusion.ranked_table(rows, 0, F.desc("x"), F.col("id")).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [2.0, 0.0]), (8, [])], "vec_id long, embedding array<float>")
    found = {(r.query_id, r.vec_id): r.score for r in vectors.nearest_of_each(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), 8, query_rows=3, vector_rows=3).collect()}
    b = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("f"))
    pairs = v.crossJoin(b).select("vec_id", "b", vectors.cosine(F.col("embedding"), F.col("f")).alias("s"))
    assert found == {(r.vec_id, r.b): r.s for r in pairs.collect()}


def test_whole_outputs_of_no_rows(spark):
    none = spark.createDataFrame([], "docid string, score double, file string, title string, context string, body string")
    out = {kind: render.whole_output(render.render(none, kind), kind, "file").first().output for kind in ("csv", "xml", "json", "cli", "md")}
    assert out == {"csv": "docid,score,file,title,context\n", "xml": '<?xml version="1.0" encoding="UTF-8"?>\n<results>\n\n</results>', "json": "[]", "cli": "No results found.", "md": ""}


def test_sql_functions(spark):
    register(spark)
    assert tuple(spark.sql("select docid('Hello, world!'), is_docid('#abc123'), handelize('Notes/My File.md'), cosine(array(1D, 0D), array(2D, 0D)), cosine(array(0D), array(1D))").first()) == ("315f5b", True, "notes/my-file-md", 1.0, 0.0)
