"""Column functions over document text: identity, titles, tokens, lines and snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[\\p{L}\\p{N}\\p{Co}]+"


def content_hash(body: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex."""
    return F.sha2(body.cast("binary"), 256)


def docid(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


@cache
def accents() -> tuple[str, str]:
    """Lower-case Latin letters with one diacritic, and the letters without it, by Unicode decomposition."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and unicodedata.combining(parts[1]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, case-folded and without diacritics; null: none."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *accents()), F.lit(f"({TOKEN})"))


def title(body: Column) -> Column:
    """The first line that starts with '# ' or '## ' once trimmed, without that mark and the white space about it; '' if none has text. Only a line feed ends a line."""
    found = F.regexp_extract(body, "(?mdU)^[^\\S\\n]*##? [^\\S\\n]*(\\S[^\\n]*)$", 1)
    return F.regexp_replace(found, "(?U)\\s+$", "")


def first_line(body: Column) -> Column:
    return F.substring_index(body, "\n", 1)


def lines(body: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), "\n\\z", ""), "\n", -1)


def line_range(body: Column, start: int = 1, most: int | None = None) -> Column:
    """At most `most` lines from the 1-based line `start`; beyond the end: ''."""
    every = lines(body)
    return F.array_join(F.slice(every, max(1, start), F.size(every) if most is None else F.lit(most)), "\n")


def line_numbers(body: Column, start: int = 1) -> Column:
    """Each line after its number, right-aligned to six places, and a tab."""
    return F.array_join(F.transform(lines(body), lambda x, i: F.format_string("%6d\t%s", i + start, x)), "\n")


def marked_lines(body: Column, start: int = 1) -> Column:
    """Each line after its number, a colon and a space."""
    return F.array_join(F.transform(lines(body), lambda x, i: F.concat((i + start).cast("string"), F.lit(": "), x)), "\n")


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value worked out once however often it stands in there."""
    return F.element_at(F.transform(F.array(value), made), 1)


def snippet(body: Column, query: str, most: int, position: Column | None = None) -> Column:
    """struct(snippet, line): whole lines of about `most` characters about the first term of three or more bytes that occurs, or about `position`."""
    n = F.length(body)

    def first_term(low: Column) -> Column:
        # one place a term, from the first on; the last is the text's start
        places = [F.locate(t.lower(), low) for t in query.split() if len(t.encode()) >= 3]
        found = F.filter(F.array(*places, F.lit(1)), lambda place: place > 0)
        return F.greatest(F.lit(0), F.element_at(found, 1) - 51)

    at = let(F.lower(body), first_term) if position is None else F.least(position, F.greatest(F.lit(0), n - most))
    # up to the place, from the last line end on
    begin = let(F.substring(body, F.lit(1), at), lambda b: F.when(F.instr(b, "\n") > 0, F.length(b) - F.length(F.substring_index(b, "\n", -1))).otherwise(F.lit(0)))

    def cut(x: Column) -> Column:
        begin, end = x.begin, F.least(x.begin + most, n)
        stop = let(F.locate("\n", F.substring(body, end + 1, n)), lambda after: F.when(after > 0, end + after - 1).otherwise(n))
        line = let(F.substring(body, F.lit(1), begin), lambda lead: F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit(""))) + 1)
        return F.struct(F.substring(body, begin + 1, stop - begin).alias("snippet"), line.cast("int").alias("line"))

    short = F.struct(body.alias("snippet"), F.lit(1).alias("line"))
    return F.when(n <= most, short).otherwise(let(F.struct(begin.alias("begin")), cut))
