"""What the index keeps with postings, and their order."""

import random

import pytest
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut
from sparkshelf.operators import fts, segments


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    rows = []
    for i in range(60):
        words = [r.choice(["alpha", "beta", "gamma", "delta", "alphabet", "bet", "Épsilon"]) for _ in range(r.choice([0, 3, 12, 40]))]
        rows.append((i * 3, f"c{i % 3}", f"p/{i}.md", " ".join(words[:4]), " ".join(words)))
    return spark.createDataFrame(rows, "doc_pk long, collection string, path string, title string, body string").selectExpr("*", "sha2(body, 256) as hash").repartition(3)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    fts.write_index(fts.build_index(corpus, stemmed=False), path, part_rows=100)
    return fts.open_index(spark, path)


def test_documents_of_a_term_are_its_leads(spark, corpus, index, tmp_path):
    """Also where an index is kept by changes."""
    n = [0]

    def folder():
        n[0] += 1
        return f"s{n[0]}"

    at = lambda name: str(tmp_path / name)
    layout = segments.refreshed(spark, segments.Layout(stemmed=False), corpus.where("doc_pk % 2 = 0"), at, folder)
    layout = segments.refreshed(spark, layout, corpus, at, folder)
    for held in (index, segments.SegmentedIndex(spark, layout, at)):
        df = held.postings.groupBy("term").agg({"*": "count"}).count()
        rows = held.postings.selectExpr("term", "doc_pk", "cast(lead as int) as lead").groupBy("term").agg({"lead": "sum"}).toDF("term", "n").collect()
        want = held.postings.select("term", "doc_pk").distinct().groupBy("term").count().collect()
        assert len(rows) == df and {r.term: r.n for r in rows} == {r.term: r["count"] for r in want}


def test_postings_leave_in_the_order_of_terms(spark, corpus):
    """So that sorting them merges runs."""
    rows = fts.postings(corpus.coalesce(1), stemmed=True).select("term", "doc_pk").collect()
    assert [r.term for r in rows] == sorted(r.term for r in rows) and len(rows) > 300


def test_parts_are_alike_in_bytes(spark, tmp_path, monkeypatch):
    """A common term's postings have many positions: parts of as many postings as others would hold far more of them."""
    monkeypatch.setattr(fts, "PART_BYTES", 20_000, raising=False)
    rows = [(i, "c", f"p{i}", "", "often " * 200 + f"w{i}") for i in range(100)]
    corpus = spark.createDataFrame(rows, "doc_pk long, collection string, path string, title string, body string")
    fts.write_index(fts.build_index(corpus, stemmed=False), str(tmp_path / "i"))
    held = spark.read.parquet(str(tmp_path / "i" / "postings"))
    sizes = [r.bytes for r in held.groupBy("part").agg(F.sum(F.lit(140) + 4 * F.col("tf")).alias("bytes")).collect()]
    assert held.count() == 400 and len(sizes) >= 7 and max(sizes) <= 22_000


def test_the_directory_tells_first_and_last_terms(spark, corpus, index):
    told = {(r.part, r.first, r.last, r.postings) for r in index.directory.collect()}
    rows = spark.read.parquet(f"{index.path}/postings").groupBy("part").agg(F.min("term"), F.max("term"), F.count("*"))
    assert len(told) > 2 and told == {tuple(r) for r in rows.collect()}


def test_long_titles_are_compared_by_digest(spark, corpus, tmp_path, monkeypatch):
    n, seen = [0], []

    def folder():
        n[0] += 1
        return f"s{n[0]}"

    at = lambda name: str(tmp_path / name)
    layout = segments.refreshed(spark, segments.Layout(stemmed=False), corpus, at, folder)
    monkeypatch.setattr(segments, "cut", lambda df: seen.append(df) or cut(df))
    other = corpus.withColumn("title", F.when(F.col("doc_pk") < 9, F.concat("title", F.lit(" other"))).otherwise(F.col("title")))
    layout = segments.refreshed(spark, layout, other, at, folder)
    assert layout.segments[1].documents == 3 == layout.segments[0].dead
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join FullOuter") :].splitlines()
    sides = [line for line in join if "sha2" in line and (" AS title#" in line or " AS n_title#" in line)]
    assert len(sides) == 2, plan
