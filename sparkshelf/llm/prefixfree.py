"""Prefix-free parsing of a collection of byte strings: suffix arrays of dictionary and parse, combined into the order of all suffixes.

Triggers are places where a rolling hash of GRAM bytes is 0 modulo MODULUS. A phrase reaches from
one trigger, or its string's start, through the next trigger, or through the mark behind its
string. So no suffix of a phrase that is longer than a trigger is the beginning of another one,
and two suffixes of the collection are ordered by what is left of their phrases and, where that
is equal, by the phrases that follow. Both orders are needed only as deep as the strings that are
compared, so the suffix arrays are doubled until that depth is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .blocks import Rolling, lanes, mix

GRAM, MODULUS = 4, 12
#: Behind every string; no byte of UTF-8.
END = b"\xff"


@dataclass
class Parse:
    """The collection's bytes, each string with END behind it; cut: where its phrases start; word: each phrase's number in the dictionary, whose phrases are dictionary[begins[i]:begins[i + 1]]; last: phrases that end their string."""

    data: np.ndarray
    cut: np.ndarray
    word: np.ndarray
    last: np.ndarray
    dictionary: np.ndarray
    begins: np.ndarray


def parse(strings: list[bytes], gram: int = GRAM, modulus: int = MODULUS) -> Parse:
    joined = END.join(strings) + END
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[np.append(0, np.cumsum(sizes))] = True
    cut = edge[:-1].copy()
    if len(data) > gram:
        trigger = np.flatnonzero(mix(Rolling(data).windows(gram)) % np.uint64(modulus) == 0)
        ends = np.cumsum(edge)  # a trigger lies in one string, before its END
        cut[trigger[ends[trigger] == ends[np.minimum(trigger + gram, len(data) - 1)]]] = True
    cut = np.flatnonzero(cut)
    last = edge[np.append(cut[1:], len(data))]
    stop = np.append(cut[1:], len(data)) + np.where(last, 0, gram)
    numbers: dict[bytes, int] = {}
    word = np.array([numbers.setdefault(joined[a:z], len(numbers)) for a, z in zip(cut.tolist(), stop.tolist(), strict=True)], np.int64)
    begins = np.append(0, np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers))))
    return Parse(data, cut, word, last, np.frombuffer(b"".join(numbers), np.uint8), begins)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, where a new key starts in it, and each key's rank (the place in the order of its first equal)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if len(keys) else 0
    return order, new, rank


def suffix_ranks(keys: np.ndarray, left: np.ndarray, seen: int, depth: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling; equal ones share a rank.

    keys: of each suffix its first `seen` symbols as a number; left: how many symbols it has.
    Suffixes that are equal as far as `depth` symbols may share a rank, too.
    """
    order, new, rank = _ranks(keys)
    while seen < depth and not new.all():
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(order)))
        some = np.repeat((sizes > 1) & np.logical_or.reduceat(left[order] > seen, heads), sizes)
        slots = np.flatnonzero(some)
        if not len(slots):
            break
        x = order[slots]
        after = np.where(left[x] > seen, rank[np.minimum(x + seen, len(rank) - 1)] + 1, 0)
        inner = np.lexsort((after, rank[x]))
        x, after = x[inner], after[inner]
        same = np.zeros(len(x), bool)
        same[1:] = (rank[x[1:]] == rank[x[:-1]]) & (after[1:] == after[:-1])
        order[slots], new[slots] = x, ~same
        rank[x] = slots[np.flatnonzero(~same)[np.cumsum(~same) - 1]]
        seen *= 2
    return rank


def corpus_ranks(p: Parse, depth: int) -> np.ndarray:
    """For every byte of the collection a number that orders its suffixes, as far as `depth` bytes at least."""
    left = np.repeat(p.begins[1:], np.diff(p.begins)) - np.arange(len(p.dictionary))
    short = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    of_dictionary = suffix_ranks(lanes(p.dictionary, ">u8")[:-1].astype(np.uint64) >> short << short, left, 8, depth)
    whole = of_dictionary[p.begins[:-1]][p.word]
    ends = np.flatnonzero(p.last)
    follow = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(whole)) + 1
    of_parse = suffix_ranks(whole, follow, 1, depth)
    after = np.where(p.last, 0, np.append(of_parse[1:], 0) + 1)
    n = np.diff(np.append(p.cut, len(p.data)))
    phrase = np.repeat(np.arange(len(p.cut)), n)
    place = np.arange(len(p.data)) - p.cut[phrase] + p.begins[p.word[phrase]]
    return of_dictionary[place] << 32 | after[phrase]


def equal_strings(p: Parse, at: np.ndarray, length: int) -> np.ndarray:
    """Numbers for the strings of `length` bytes that start at the places `at`: the same for equal ones, read off the corpus order."""
    rank = corpus_ranks(p, length)[at]
    order = np.argsort(rank, kind="stable")
    x, eight = at[order], lanes(p.data)
    same = np.ones(max(0, len(x) - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else ():
        same &= eight[x[1:] + k] == eight[x[:-1] + k]
    for k in range(length) if length < 8 else ():
        same &= p.data[x[1:] + k] == p.data[x[:-1] + k]
    out = np.empty(len(at), np.int64)
    out[order] = np.append(0, np.cumsum(~same)) if len(at) else 0
    return out
