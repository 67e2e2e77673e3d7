"""The Porter stemmer with the length guards of common full-text engines, over a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = frozenset("aeiou")
#: The published algorithm's suffixes and replacements of its second and third steps.
SECOND = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
#: The suffixes that its fourth step drops.
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


#: The rules, longest first, and their ends.
_SECOND, _THIRD = ((sorted(rules, key=lambda r: -len(r[0])), tuple(end for end, _ in rules)) for rules in (SECOND, THIRD))
_FOURTH_BY_LENGTH, _FOURTH_ENDS = sorted(FOURTH, key=lambda e: -len(e)), tuple(FOURTH)


def _kinds(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).lstrip("c").count("vc")


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replaced(w: str, rules: list[tuple[str, str]], ends: tuple[str, ...]) -> str:
    if not w.endswith(ends):
        return w
    for end, new in rules:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w


def stem(w: str) -> str:
    """Of a folded token; tokens shorter than three or longer than 64 bytes stay."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith("sses") or (w.endswith("ies") and len(w) > 3) else w[:-1]
    tail = ""
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _kinds(w[:-2]):
        tail = w = w[:-2]
    elif w.endswith("ing") and "v" in _kinds(w[:-3]):
        tail = w = w[:-3]
    if tail:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, *_SECOND), *_THIRD)
    for end in _FOURTH_BY_LENGTH if w.endswith(_FOURTH_ENDS) else ():
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem_all(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(stem)


def stems(column: str) -> Column:
    """Meant for distinct words; a corpus's tokens join their stems. Called nondeterministic so that filters on stems aren't evaluated for every token instead."""
    return F.pandas_udf(stem_all, StringType()).asNondeterministic()(column)
