"""Search from SQL: views over a stored index, and table functions that rank documents by words."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from sparkshelf.functions.text import TOKEN, accents
from sparkshelf.operators import fts

#: Different words of a query, at most; more raise.
MOST_WORDS = 32


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_search(spark: SparkSession, index: fts.Index, name: str = "shelf", most_words: int = MOST_WORDS) -> None:
    """Makes the views {name}_postings, {name}_documents and {name}_totals, and two table functions of the session:

    {name}_search(q, k): (place, file, title, score, doc_pk, collection, path) of the k best documents that hold any
    word of q, by BM25, ties by collection and path; {name}_search_in(q, k, c): of those of a collection, scored over all.

    The words of a constant q become constants of the plan, so the scan of the postings gets them as pushed filters
    and skips what can't hold them, as postings are sorted by term; a constant c reaches the scan of the documents.
    The index must be one without stems: a stem isn't an expression of SQL. More than most_words different words raise.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"{name!r} isn't a name")
    if index.stemmed:
        raise ValueError("SQL searches need an index without stems")
    index.postings.createOrReplaceTempView(f"{name}_postings")
    index.documents.createOrReplaceTempView(f"{name}_documents")
    index.totals.createOrReplaceTempView(f"{name}_totals")
    old, new = accents()
    words = f"array_distinct(regexp_extract_all(translate(lower(q), {_literal(old)}, {_literal(new)}), {_literal(TOKEN)}, 0))"
    # folded to constants, or else every row of the postings raises
    some = f"if(size({words}) <= {most_words}, get({words}, 0), raise_error('more than {most_words} words')), " + ", ".join(f"get({words}, {i})" for i in range(1, most_words))
    odds = "ln((n - df + 0.5D) / (df + 0.5D))"
    used = f"select term, doc_pk, sum(tf) as f, first(dl) as dl from {name}_postings where term in ({some}) group by term, doc_pk"
    weighed = f"select doc_pk, f, dl, n, avgdl, if({odds} <= 0, {fts.FLOOR}D, {odds}) as weight from (select *, count(*) over (partition by term) as df from ({used})) cross join {name}_totals"
    scored = f"select doc_pk, sum(weight * f * {fts.K1 + 1}D / (f + {fts.K1}D * ({1 - fts.B}D + {fts.B}D * dl / avgdl))) as score from ({weighed}) group by doc_pk"
    columns = "place bigint, file string, title string, score double, doc_pk bigint, collection string, path string"

    def best(where: str) -> str:
        joined = f"select s.score, d.doc_pk, d.title, d.collection, d.path from ({scored}) s join {name}_documents d on s.doc_pk = d.doc_pk{where}"
        placed = f"select *, row_number() over (order by round(score, 9) desc, collection, path) as at from ({joined})"
        return f"select cast(at as bigint) as place, concat_ws('/', collection, path) as file, title, score, doc_pk, collection, path from ({placed}) where at <= k"

    spark.sql(f"create or replace temporary function {name}_search(q string, k int) returns table({columns}) return {best('')}")
    spark.sql(f"create or replace temporary function {name}_search_in(q string, k int, c string) returns table({columns}) return {best(' where d.collection = c')}")
