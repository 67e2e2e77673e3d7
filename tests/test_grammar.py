"""The query language against SQLite's full-text engine, and what is an error."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkshelf.functions.porter import stem
from sparkshelf.operators import fts

ROWS = [
    ("c", "x", "alpha beta", "alpha gamma delta alpha"),
    ("c", "y", "beta", "alpha one two three four five six seven eight nine ten eleven gamma"),
    ("c", "z", "zeta", "beta alpha"),
    ("c", "w", "q", "w e r"),
    ("c", "v", "q", "t y u"),
    ("c", "u", "q", "i o p"),
]
QUERIES = [
    "^alpha", '"alpha gamma"', "alpha_gamma", "title : alpha", "NEAR(alpha gamma)", "NEAR(alpha gamma, 2)", "NEAR(alpha gamma, 12)", "alpha OR zeta", "body:(alpha OR beta)",
    "alpha NOT gamma", "title: alpha gamma", "alpha OR beta gamma", "alp*", '"alpha gam" *', "{title body}: beta", "-title: beta", "c/x".split("/")[0], "alpha + gamma", "running", "BETA",
]
ERRORS = ["NOT alpha", "alpha AND NOT gamma", "AND", "rust AND", "(rust", "OR", "", "  ", "a,b", "a;", "a/b", "x.y", "what's", "c++", "rust?", "a-b", "unknowncol:x"]


@pytest.fixture(scope="module")
def engine():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(filepath, title, body, tokenize='porter unicode61')")
    c.executemany("insert into t(rowid, filepath, title, body) values (?, ?, ?, ?)", [(i, f"{a}/{b}", t, x) for i, (a, b, t, x) in enumerate(ROWS, 1)])
    return c


@pytest.fixture(scope="module", params=["plan", "stored", "stored in parts"])
def index(spark, request, tmp_path_factory):
    corpus = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS, 1)], "doc_pk long, collection string, path string, title string, body string")
    built = fts.build_index(corpus)
    if request.param == "plan":
        return built
    path = str(tmp_path_factory.mktemp("index") / "i")
    fts.write_index(built, path, part_rows=5 if request.param == "stored in parts" else 1000)
    return fts.open_index(spark, path)


@pytest.mark.parametrize("query", QUERIES)
def test_rows_and_scores(engine, index, query):
    want = dict(engine.execute("select rowid, round(-bm25(t), 6) from t where t match ?", (query,)).fetchall())
    got = {r.doc_pk: round(r.score, 6) for r in fts.score(index, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


@pytest.mark.parametrize("query", ERRORS)
def test_errors(query):
    with pytest.raises(fts.QuerySyntaxError):
        fts.parse(query)


def test_quoted_terms_are_always_queries():
    for query in ERRORS:
        if query.strip():
            fts.parse(fts.quote_terms(query))


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghilmnorstuy", min_size=1, max_size=12))
def test_stems_are_those_of_sqlite(word):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(a, tokenize='porter unicode61')")
    c.execute("create virtual table v using fts5vocab(t, 'row')")
    c.execute("insert into t values (?)", (word,))
    assert c.execute("select term from v").fetchone()[0] == stem(word)


def test_only_parts_with_the_terms_are_opened(spark, tmp_path):
    rows = [(i, "c", f"p{i}", "", f"common w{i:03d} alp{i % 7}") for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_pk long, collection string, path string, title string, body string")
    fts.write_index(fts.build_index(corpus, stemmed=False), str(tmp_path / "i"), part_rows=100)
    index = fts.open_index(spark, str(tmp_path / "i"))
    parts = index.directory.count()
    assert parts > 8 and len(index.parts(["w100"], [])) == 1 and 3 <= len(index.parts(["common"], [])) < parts / 2 and not index.parts(["~"], [])
    assert len(index.parts([], ["alp"])) < parts / 2 and index.read([], ["alp"]).count() == 300
    assert {r.doc_pk for r in fts.score(index, "w100 common").collect()} == {100}
    assert index.read_terms(spark.createDataFrame([("w007",), ("w008",)], "term string")).count() == 2


def brute_points(path, query):
    """Over all ways to place the query's characters."""
    from itertools import combinations

    best = None
    for at in combinations(range(len(path)), len(query)):
        if all(path[a] == c for a, c in zip(at, query, strict=True)):
            points = 0
            for k, a in enumerate(at):
                points += fts.MATCH + (fts.START if not a or path[a - 1] in fts.SEPARATORS else 0)
                if k:
                    gap = a - at[k - 1] - 1
                    points += fts.NEXT if not gap else fts.GAP + fts.WIDER * (gap - 1)
            best = points if best is None else max(best, points)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab/-", max_size=10), st.text("ab/", min_size=1, max_size=4))
def test_fuzzy_points(path, query):
    assert fts.fuzzy_score(path, query) == brute_points(path, query)


def test_fuzzy_paths(spark):
    rows = spark.createDataFrame([("c", "src/Main.rs"), ("c", "some/remains"), ("c", "manual/in/rs"), ("c", "other")], "collection string, path string")
    got = [(r.path, r.points) for r in fts.fuzzy_paths(rows, "MAIN").collect()]
    assert got[0][0] == "src/Main.rs" and {p for p, _ in got} == {"src/Main.rs", "some/remains", "manual/in/rs"} and got == sorted(got, key=lambda x: -x[1])
