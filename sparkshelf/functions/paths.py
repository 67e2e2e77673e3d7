"""Column functions over file paths, virtual paths and references."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "doc"
#: Directories that a scan leaves out, besides those that start with a dot.
EXCLUDED = ["node_modules", ".git", ".cache", "vendor", "dist", "build", "target"]


def handelize(path: Column) -> Column:
    """A stable name: '___' parts, lower case, letters and digits kept, each other character a dash, none at a part's ends, no empty parts."""
    parts = F.split(F.lower(F.replace(path, F.lit("___"), F.lit("/"))), "/")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, "[^\\p{L}\\p{N}]", "-"), "^-+|-+$", ""))
    return F.array_join(F.filter(clean, lambda p: p != ""), "/")


def separators(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def drive_path(path: Column) -> Column:
    """/c/x as C:/x, for one ASCII letter; else as it is."""
    letter = F.regexp_extract(path, "^/([A-Za-z])/", 1)
    return F.when(letter != "", F.concat(F.upper(letter), F.lit(":"), F.substring(path, F.lit(3), F.length(path)))).otherwise(path)


def filesystem_path(path: Column) -> Column:
    return drive_path(separators(path))


def is_absolute(path: Column) -> Column:
    return path.rlike("^/|^[A-Za-z]:[/\\\\]")


def is_virtual(path: Column, scheme: str = SCHEME) -> Column:
    return F.trim(path).rlike(f"^({re.escape(scheme)}:|//)")


def virtual_parts(path: Column, scheme: str = SCHEME) -> Column:
    """struct(collection, rest) of scheme:, scheme:// or // paths, extra slashes aside; nulls for others."""
    rest = F.regexp_extract(F.trim(path), f"^(?:{re.escape(scheme)}:/*|//+)(.*)$", 1)
    found = is_virtual(path, scheme) & (F.substring_index(rest, "/", 1) != "")
    collection = F.substring_index(rest, "/", 1)
    return F.struct(F.when(found, collection).alias("collection"), F.when(found, F.substring(rest, F.length(collection) + 2, F.length(rest))).alias("rest"))


def virtual_path(collection: Column, path: Column, scheme: str = SCHEME) -> Column:
    return F.concat(F.lit(f"{scheme}://"), collection, F.lit("/"), path)


def is_docid(text: Column) -> Column:
    return text.rlike("^#*[0-9a-fA-F]{6}$")


def is_collection_name(name: Column) -> Column:
    return name.rlike("^[\\p{L}\\p{N}_-]+$")


def is_excluded(path: Column) -> Column:
    """Is any part of the relative path hidden or a directory of build products?"""
    return F.exists(F.split(path, "/"), lambda c: c.startswith(".") | c.isin(EXCLUDED))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob in which * and ? cross '/', [..] and [!..] are classes and **/ is any directories."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            out, i = out + ".*", i + 1
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            out, i = out + "[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:]) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def has_prefix(path: Column, prefix: str) -> Column:
    """LIKE prefix%: % and _ of the prefix are wildcards, ASCII letters of either case are alike."""
    parts = {"%": ".*", "_": "."}
    body = "".join(parts.get(c) or (f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)) for c in prefix)
    return path.rlike(f"(?s)^{body}")
