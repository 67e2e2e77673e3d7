"""Searches written in SQL."""

import pytest
from pyspark.sql import functions as F

from sparkshelf.jobs.library import Library
from sparkshelf.operators import fts
from sparkshelf.sources.sqlsearch import register_search
from sparkshelf.streaming.ingest import apply_batch

NOW = "2025-01-01T00:00:00Z"


def test_sql_ranks_as_the_query_language_and_prunes(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "root"), NOW, stemmed=False)
    rows = [("c" if i % 3 else "d", f"p{i}", " ".join(["Éclair", "alpha", "beta's", "gamma"][j % 4] for j in range(i % 7 + 1)) + f" word{i}") for i in range(50)]
    table = lambda rows: spark.createDataFrame(rows, "collection string, path string, body string")
    apply_batch(lib.catalog, table(rows), NOW)
    lib.register_sql("own")
    ask = lambda text: [(r.place, r.collection, r.path, round(r.score, 9)) for r in spark.sql(text).orderBy("place").collect()]
    want = lambda q, **o: [(n, r.collection, r.path, round(r.score, 9)) for n, r in enumerate(fts.search(lib.index(), q, **o).collect(), 1)]
    assert ask("select * from own_search('ÉCLAIR beta', 12)") == want("eclair OR beta", limit=12) != []
    assert ask("select * from own_search_in('alpha alpha word7', 5, 'd')") == want("alpha OR word7", limit=5, collection="d") != []
    assert ask("select * from own_search('nowhere', 3)") == [] == ask("select * from own_search(' ', 3)")
    plan = spark.sql("select * from own_search_in('alpha word7', 5, 'd')")._jdf.queryExecution().executedPlan().toString()
    pushed = [line.partition("PushedFilters: ")[2] for line in plan.splitlines() if "PushedFilters: " in line]
    assert any("In(term" in p and "alpha" in p and "word7" in p for p in pushed) and any("EqualTo(collection,d)" in p for p in pushed)
    # changes show once the functions are made again
    apply_batch(lib.catalog, table([("c", "p7", None), ("c", "new", "word7 alpha")]), NOW)
    lib.register_sql("own")
    assert [x[2] for x in ask("select * from own_search('word7', 3)")] == ["new"]
    with pytest.raises(Exception, match="more than 2 words"):
        register_search(spark, lib.index(), "few", most_words=2)
        spark.sql("select * from few_search('a b c', 3)").collect()


def test_names_and_stems(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "c", "p", "t", "b", "h")], "doc_pk long, collection string, path string, title string, body string, hash string")
    with pytest.raises(ValueError, match="stems"):
        register_search(spark, fts.build_index(corpus, True))
    with pytest.raises(ValueError, match="name"):
        register_search(spark, fts.build_index(corpus, False), "a b")
    assert corpus.select(F.lit(1)).count() == 1
