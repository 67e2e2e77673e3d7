"""Paths, titles, chunks and rendering on literal cases."""

import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkshelf.functions import paths, render, text
from sparkshelf.jobs import queries
from sparkshelf.operators import chunks


def values(spark, inputs, *columns):
    """The columns' values over a column x of inputs."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows.select("i", *columns).collect()]


def test_paths(spark):
    x = F.col("x")
    assert values(spark, ["E:\\notes\\2024\\a b.md", "/srv/texts", "/e/notes/x", "/z/y.md", "\\q\\r", "/ab/c", "f/g"], paths.filesystem_path(x)) == ["E:/notes/2024/a b.md", "/srv/texts", "E:/notes/x", "Z:/y.md", "Q:/r", "/ab/c", "f/g"]
    assert values(spark, ["/srv/texts", "E:/notes", "e:\\notes", "/e/notes", "E:notes", "notes/e", "../up", ""], paths.is_absolute(x)) == [True, True, True, True, False, False, False, False]
    assert values(spark, ["Notes/My File.md___B--", "a//b"], paths.handelize(x)) == ["notes/my-file-md/b", "a/b"]
    assert values(spark, ["#abc123", "abc123", "#ab", "#ABCDEF"], paths.is_docid(x)) == [True, True, False, True]
    assert values(spark, ["doc://c/a/b.md", "doc:c", "//c/x", "c/x", " doc:///c/y"], paths.virtual_parts(x)) == [("c", "a/b.md"), ("c", ""), ("c", "x"), (None, None), ("c", "y")]
    assert values(spark, ["a/.git/x", "src/target/x.md", "_drafts/x.md", "ok.md"], paths.is_excluded(x)) == [True, True, False, False]
    assert values(spark, ["a/b.md", "b.md", "a/b.txt", "x[1].md"], paths.matches_glob(x, "**/*.md")) == [True, True, False, True]


def test_text(spark):
    x = F.col("x")
    assert values(spark, ["#tag\n ## A title \nx", "### no\n# yes", "#  \n# z", "none"], text.title(x)) == ["A title", "yes", "z", ""]
    assert values(spark, ["Café foo_bar 3.14 don't Straße x²"], text.tokens(x)) == [["cafe", "foo", "bar", "3", "14", "don", "t", "straße", "x²"]]
    assert values(spark, ["a\r\nb\n", "one"], text.line_numbers(x)) == ["     1\ta\n     2\tb", "     1\tone"]
    assert values(spark, ["a\nb\nc", "a"], text.line_range(x, 2, 5)) == ["b\nc", ""]
    body = "first line\n" + "x" * 300 + "\nthe Needle here\nlast"
    assert values(spark, [body, "short"], text.snippet(x, "an needle", 40)) == [("x" * 300, 2), ("short", 1)]
    assert values(spark, ["Hello, world!"], text.docid(text.content_hash(x))) == ["315f5b"]


def test_render(spark):
    n = F.col("x").cast("long")
    assert values(spark, ["0", "1023", "1024", "1048576", "1610612736"], render.format_bytes(n)) == ["0 B", "1023 B", "1.0 KB", "1.0 MB", "1.5 GB"]
    assert values(spark, ["2025-01-09T23:59:30Z", "2025-01-09T00:00:00Z", "what"], render.time_ago(F.col("x"), "2025-01-10T00:00:00Z")) == ["30s ago", "1d ago", "what"]


@given(st.text("ab. \n?!", max_size=400), st.integers(5, 60), st.integers(0, 30))
def test_chunks_cover_the_text(body, most, overlap):
    at = 0
    for start, chunk in chunks.by_chars(body, most, overlap):
        assert start <= at and body[start : start + len(chunk)] == chunk and len(chunk) <= most
        at = start + len(chunk)
    assert at == len(body)


@given(st.lists(st.text("abc ", min_size=1, max_size=20), max_size=12), st.integers(1, 12), st.integers(0, 6))
def test_token_chunks_hold_every_paragraph(paragraphs, most, overlap):
    body = "\n\n".join(paragraphs)
    found = list(chunks.by_tokens(body, most, overlap))
    for p in paragraphs:
        assert any(p in c for _, c, _ in found)


def test_line_queries_take_every_row(spark, tmp_path):
    texts = [None, "", "a\r\nb\n", "x\n\n", "a\rb\n\rc\n\r", "\n".join(f"line {i}" for i in range(2000)), "one\r\n\r\n", "ab\ncd ef\rg hij\r\nlex: cd  \nend"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(t for t in texts if t)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    split = lambda t: t.replace("\r\n", "\n").removesuffix("\n").split("\n")
    got = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got("line_numbers_whole") == [(i, None if t is None else "\n".join(f"{n:>6}\t{x}" for n, x in enumerate(split(t), 1))) for i, t in enumerate(texts)]
    assert got("line_range_whole") == [(i, None if t is None else "\n".join(split(t)[1:4])) for i, t in enumerate(texts)]
    want = []
    for i, o in enumerate(t for t in texts if t):
        own = []
        for no, line in enumerate(f"lex: {o.lower()}\nvec: about {o}\nhyde: zzz\nnoise".split("\n")):
            m = re.match(r"(?s)(lex|vec|hyde):(.*)", line.strip())
            if m and m[2].strip() and (len(o) < 3 or any(len(t) >= 3 and t in m[2].strip().lower() for t in o.lower().split())):
                own.append((i, no, m[1], m[2].strip()))
        want += own or [(i, 0, "lex", o), (i, 1, "vec", o), (i, 2, "hyde", f"Information about {o}")]
    assert got("expansion_parse_whole") == sorted(want)


def test_titles_know_one_line_end(spark):
    bodies = ["a\r# no", "a\u2028# no", "x\n \t## Real \t\r\ny", "# \n## \n# later", "#tag\n### deep", "\u00a0# spaced\u00a0", "plain"]
    assert values(spark, bodies, text.title(F.col("x"))) == ["", "", "Real", "later", "", "spaced", ""]


def test_times_of_listings(spark):
    stamps = ["2025-01-09T07:05:00Z", "2024-03-02T10:00:00Z", "2025-01-01T23:59:59+02:00", "soon"]
    assert values(spark, stamps, render.list_time(F.col("x"), "2025-01-10T00:00:00Z")) == ["Jan  9 07:05", "Mar  2  2024", "Jan  1 23:59", "soon"]
