"""Documents cut to overlapping chunks, by characters or by a tokenizer's counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS, CHAR_OVERLAP, TOKENS, TOKEN_OVERLAP = 3200, 480, 800, 120
#: Ends of a chunk, the best first; paragraphs, sentences in this order, lines and words.
BREAKS = ["\n\n", ". ", ".\n", "? ", "?\n", "! ", "!\n", "\n", " "]


def break_point(text: str, start: int, end: int) -> int:
    """The place after the last best break in the final three tenths of text[start:end], or else its end."""
    low = start + (end - start) * 7 // 10
    for mark in BREAKS:
        at = text.rfind(mark, low, end)
        if at >= 0:
            return at + len(mark)
    return end


def by_chars(text: str, most: int = CHARS, overlap: int = CHAR_OVERLAP) -> Iterator[tuple[int, str]]:
    """(position, chunk) by characters; each starts `overlap` before the last one's end, if that moves on."""
    start = 0
    while True:
        end = len(text) if len(text) - start <= most else max(break_point(text, start, start + most), start + 1)
        yield start, text[start:end]
        if end >= len(text):
            return
        start = end - overlap if end - overlap > start else end


def count_words(text: str) -> int:
    return len(text.split())


def overlap_text(chunk: str, target: int, count: Callable[[str], int]) -> str:
    """Of the chunk's last fifth: what follows a paragraph's end, if short enough, or else target / 2 words."""
    tail = chunk[len(chunk) * 4 // 5 :]
    _, mark, rest = tail.partition("\n\n")
    if mark and count(rest) <= 2 * target:
        return rest
    return " ".join(tail.split()[-(target // 2) :]) if target // 2 else ""


def by_tokens(text: str, most: int = TOKENS, overlap: int = TOKEN_OVERLAP, count: Callable[[str], int] = count_words) -> Iterator[tuple[int, str, int]]:
    """(position, chunk, tokens): paragraphs packed up to `most` tokens, two for each gap; a longer paragraph stays whole."""
    total = count(text)
    if total <= most:
        yield 0, text, total
        return
    held, size, start, at = "", 0, 0, 0
    for i, paragraph in enumerate(text.split("\n\n")):
        own, gap = count(paragraph), 2 * (i > 0)
        if held and size + own + gap > most:
            yield start, held, size
            held = overlap_text(held, overlap, count)
            size, start = count(held), max(0, at - len(held))
        held = f"{held}\n\n{paragraph}" if held else paragraph
        size += own + gap
        at += len(paragraph) + gap
    if held:
        yield start, held, size


#: Characters of chunks that a task holds before it hands them on.
HELD_CHARS = 1_000_000


def _rows(docs: DataFrame, key: str, body: str, fields: str, cut: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """(key, seq, fields) of each document's pieces; the last field is the chunk. Besides a batch as it came, a task holds one text and few chunks."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int32()] * (fields.count(",") + 1), pa.string()]
            names = [key, "seq", *[f.split()[0] for f in fields.split(", ")]]
            rows, held = [], 0
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)  # noqa: B023, E731
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                own = k.as_py()
                for seq, piece in enumerate(cut(text.as_py())):
                    rows.append((own, seq, *piece))
                    held += len(piece[-1])
                    if held >= HELD_CHARS:
                        yield made()
                        rows, held = [], 0
            if rows:
                yield made()

    return docs.select(key, body).mapInArrow(pieces, f"`{key}` {docs.schema[key].dataType.simpleString()}, seq int, {fields}")


def chunk_chars(docs: DataFrame, key: str, body: str, most: int = CHARS, overlap: int = CHAR_OVERLAP) -> DataFrame:
    """(key, seq, pos, chunk) of all documents; those that fit stay out of Python."""
    fits = F.length(body) <= most
    short = docs.where(fits).select(key, F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.col(body).alias("chunk"))
    return short.unionByName(_rows(docs.where(~fits), key, body, "pos int, chunk string", lambda t: by_chars(t, most, overlap)))


def chunk_tokens(docs: DataFrame, key: str, body: str, most: int = TOKENS, overlap: int = TOKEN_OVERLAP, count: Callable[[str], int] = count_words) -> DataFrame:
    """(key, seq, pos, tokens, chunk) of all documents."""
    cut = lambda t: ((p, n, c) for p, c, n in by_tokens(t, most, overlap, count))
    return _rows(docs.where(F.col(body).isNotNull()), key, body, "pos int, tokens int, chunk string", cut)
