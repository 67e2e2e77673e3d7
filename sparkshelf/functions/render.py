"""Column functions that render results as JSON, CSV, XML, Markdown or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """With so many decimal places; ties go to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(x.cast("double"), places))


def format_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(fixed(n / float(1024**power), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def time_ago(stamp: Column, now: str) -> Column:
    """Age of an RFC 3339 text in seconds, minutes, hours or days; other text as it is."""
    s = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(stamp))
    out = F.format_string("%ds ago", s)
    for size, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        out = F.when(s >= size, F.format_string(f"%d{unit} ago", F.floor(s / size))).otherwise(out)
    return F.when(s.isNull(), stamp).otherwise(out)


def escape_csv(x: Column) -> Column:
    return F.when(x.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def escape_xml(x: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(c), F.lit(e))
    return x


def _mark(hash_: str = "docid") -> Column:
    return F.concat(F.lit("#"), F.col(hash_))


def csv_rows(results: DataFrame) -> DataFrame:
    """results (docid, score, file, title, context) with csv, a line of five fields."""
    fields = [escape_csv(_mark()), fixed(F.col("score"), 4), escape_csv(F.col("file")), escape_csv(F.col("title")), escape_csv(F.coalesce("context", F.lit("")))]
    return results.withColumn("csv", F.concat_ws(",", *fields))


def json_rows(results: DataFrame, full: bool = False) -> DataFrame:
    """With json: docid, score, file, title and, where not null, context and body."""
    fields = [_mark().alias("docid"), F.col("score"), F.col("file"), F.col("title"), F.col("context")]
    return results.withColumn("json", F.to_json(F.struct(*fields, *([F.col("body")] if full else []))))


def xml_rows(results: DataFrame, full: bool = False) -> DataFrame:
    tag = lambda name, x: F.concat(F.lit(f"    <{name}>"), x, F.lit(f"</{name}>\n"))
    maybe = lambda name, x: F.coalesce(tag(name, escape_xml(x)), F.lit(""))
    parts = [F.lit("  <result>\n"), tag("docid", _mark()), tag("score", fixed(F.col("score"), 4)), tag("file", escape_xml(F.col("file"))), tag("title", escape_xml(F.col("title"))), maybe("context", F.col("context"))]
    return results.withColumn("xml", F.concat(*parts, *([maybe("body", F.col("body"))] if full else []), F.lit("  </result>")))


def markdown_rows(results: DataFrame, full: bool = False) -> DataFrame:
    parts = [F.format_string("## %s (score: %s)\n\n", F.col("file"), fixed(F.col("score"), 4)), _bold("Title", F.col("title")), F.coalesce(_bold("Context", F.col("context")), F.lit(""))]
    return results.withColumn("md", F.concat(*parts, *([F.coalesce(_fenced(F.col("body")), F.lit(""))] if full else [])))


def _bold(name: str, x: Column) -> Column:
    return F.concat(F.lit(f"**{name}:** "), x, F.lit("\n\n"))


def _fenced(x: Column) -> Column:
    return F.concat(F.lit("```\n"), x, F.lit("\n```\n\n"))


def terminal_rows(results: DataFrame, full: bool = False) -> DataFrame:
    """A paragraph per result: docid, score and file, then title, context and body where they are there; without colours."""
    parts = [F.concat_ws(" ", _mark(), fixed(F.col("score"), 2), "file"), F.lit("\n"), F.when(F.col("title") != "", F.concat(F.lit("  "), F.col("title"), F.lit("\n"))), F.concat(F.lit("  Context: "), F.col("context"), F.lit("\n"))]
    parts += [F.concat(F.lit("\n"), F.col("body"), F.lit("\n"))] if full else []
    return results.withColumn("cli", F.concat(*[F.coalesce(p, F.lit("")) for p in [*parts, F.lit("\n")]]))


def text_rows(results: DataFrame) -> DataFrame:
    """Per result a line: docid, percent, file and title."""
    return results.withColumn("line", F.format_string("%s %d%% %s - %s", _mark(), F.floor(F.col("score") * 100), "file", "title"))


def meaning_rows(results: DataFrame) -> DataFrame:
    """As text_rows(), with a rounded percentage, for results by meaning."""
    return results.withColumn("line", F.concat_ws(" ", _mark(), F.concat(fixed(F.col("score") * 100, 0), F.lit("%")), "file", F.lit("-"), "title"))


def fused_rows(results: DataFrame) -> DataFrame:
    """As text_rows(), with the score to two places and without a mark, for fused results, whose scores are no shares."""
    return results.withColumn("line", F.concat_ws(" ", "docid", fixed(F.col("score"), 2), "file", F.lit("-"), "title"))


RENDERERS = {"csv": csv_rows, "json": json_rows, "xml": xml_rows, "md": markdown_rows, "cli": terminal_rows, "text": text_rows, "meaning": meaning_rows, "fused": fused_rows}


def render(results: DataFrame, kind: str, full: bool = False) -> DataFrame:
    """Rows with one more column that holds each one's rendering; 'files' keeps the path alone."""
    if kind == "files":
        return results.withColumn("files", F.col("file"))
    return RENDERERS[kind](results, full) if kind in ("json", "xml", "md", "cli") else RENDERERS[kind](results)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents (file, title, context, skipped, reason, body) with json and csv."""
    skipped = F.struct("file", F.lit(True).alias("skipped"), F.coalesce("reason", F.lit("unknown")).alias("reason"))
    whole = F.struct("file", "title", "context", "body")
    fields = [escape_csv(F.col("file")), escape_csv(F.col("title")), escape_csv(F.coalesce("context", F.lit(""))), F.col("skipped").cast("string"), escape_csv(F.coalesce(F.when(F.col("skipped"), F.col("reason")).otherwise(F.col("body")), F.lit("")))]
    return docs.withColumns({"json": F.when(F.col("skipped"), F.to_json(skipped)).otherwise(F.to_json(whole)), "csv": F.concat_ws(",", *fields)})


def _body_or(skipped: Column) -> Column:
    return F.coalesce(F.when(F.col("skipped"), skipped).otherwise(_fenced(F.col("body"))), F.lit(""))


def document_markdown(docs: DataFrame) -> DataFrame:
    """With md: the title only if it says more than the path; a skipped document has its reason as a quotation."""
    title = F.when((F.col("title") != "") & (F.col("title") != F.col("file")), _bold("Title", F.col("title")))
    reason = F.concat(F.lit("> "), F.coalesce("reason", F.lit("Skipped")), F.lit("\n\n"))
    parts = [F.concat(F.lit("## "), F.col("file"), F.lit("\n\n")), title, _bold("Context", F.col("context"))]
    return docs.withColumn("md", F.concat(*[F.coalesce(p, F.lit("")) for p in parts], _body_or(reason)))


def document_xml(docs: DataFrame) -> DataFrame:
    tag = lambda name, x: F.concat(F.lit(f"    <{name}>"), escape_xml(x), F.lit(f"</{name}>\n"))
    skipped = F.concat(F.lit("    <skipped>true</skipped>\n"), tag("reason", F.coalesce("reason", F.lit(""))))
    parts = [tag("file", F.col("file")), tag("title", F.col("title")), tag("context", F.col("context")), F.when(F.col("skipped"), skipped).otherwise(tag("body", F.col("body")))]
    return docs.withColumn("xml", F.concat(F.lit("  <document>\n"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("  </document>")))


def document_files(docs: DataFrame) -> DataFrame:
    return docs.withColumn("files", F.when(F.col("skipped"), F.concat("file", F.lit(" [SKIPPED]"))).otherwise(F.col("file")))


def document_terminal(docs: DataFrame) -> DataFrame:
    """With cli: a banner with the path, then the reason why it was skipped, or the context and the body."""
    rule = F.lit("=" * 60 + "\n")
    whole = F.concat(F.coalesce(F.concat(F.lit("Folder Context: "), F.col("context"), F.lit("\n---\n\n")), F.lit("")), F.coalesce(F.concat(F.col("body"), F.lit("\n")), F.lit("")))
    skipped = F.concat(F.lit("[SKIPPED: "), F.coalesce("reason", F.lit("unknown")), F.lit("]\n"))
    return docs.withColumn("cli", F.concat(F.lit("\n"), rule, F.lit("File: "), F.col("file"), F.lit("\n"), rule, F.lit("\n"), F.when(F.col("skipped"), skipped).otherwise(whole)))


DOCUMENTS = {"json": document_rows, "csv": document_rows, "md": document_markdown, "xml": document_xml, "files": document_files, "cli": document_terminal}


def render_documents(docs: DataFrame, kind: str) -> DataFrame:
    """Documents (file, title, context, skipped, reason, body) with one more column that holds each one's rendering."""
    return DOCUMENTS[kind](docs)


#: What stands before and behind a whole output, and between its rows.
FRAMES = {
    ("csv", "results"): ("docid,score,file,title,context\n", "\n", ""), ("csv", "documents"): ("file,title,context,skipped,body\n", "\n", ""),
    ("xml", "results"): ('<?xml version="1.0" encoding="UTF-8"?>\n<results>\n', "\n", "\n</results>"), ("xml", "documents"): ('<?xml version="1.0" encoding="UTF-8"?>\n<documents>\n', "\n", "\n</documents>"),
    ("json", "results"): ("[", ",", "]"), ("json", "documents"): ("[", ",", "]"),
    ("files", "results"): ("", "\n", ""), ("files", "documents"): ("", "\n", ""), ("text", "results"): ("", "\n", ""), ("meaning", "results"): ("", "\n", ""), ("fused", "results"): ("", "\n", ""),
}


def whole_output(rendered: DataFrame, kind: str, order: str, of: str = "results") -> DataFrame:
    """One row (output): the renderings of a short list in order of a column, with header or root. Without rows: the frame alone, for the terminal 'No results found.'"""
    before, between, behind = FRAMES.get((kind, of), ("", "", ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line" if kind in ("text", "meaning", "fused") else kind).alias("r")))), lambda x: x["r"])
    out = F.concat(F.lit(before), F.array_join(parts, between), F.lit(behind))
    return rendered.agg(F.when((F.count("*") == 0) & F.lit(kind == "cli" and of == "results"), F.lit("No results found.")).otherwise(out).alias("output"))


def list_time(stamp: Column, now: str) -> Column:
    """The time of a listing: month, day and the hour, or the year for times more than 180 days ago; in the stamp's own offset. Other text as it is."""
    at = F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(stamp))
    day = F.concat(F.date_format(at, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "))
    return F.when(at.isNull() | age.isNull(), stamp).when(age > 180 * 86400, F.concat(day, F.lit("  "), F.year(at))).otherwise(F.concat(day, F.date_format(at, " HH:mm")))
