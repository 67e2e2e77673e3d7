"""Token counts of whole texts; huge documents are encoded in overlapping chunks and spliced."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut

from .blocks import SPACED, blocks, words
from .groups import settled

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Distinct pieces whose counts a worker keeps before it starts anew.
KEPT = 200_000
SPACES = " \t\n\v\f\r"

#: Of each tokenizer file the counts of pieces that this worker has seen.
_counts: dict[str, dict[int, int]] = defaultdict(dict)


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_rules(path: str) -> None:
    """Raises unless the file's rules drop white space and don't look across it, on which counts by piece and by chunk rest.

    That holds where the text is first split by a pattern that keeps only what it matches, which
    never is white space nor looks ahead or behind, and neither normalizers nor added tokens need it.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = rules.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    spaced = re.sub(r"\[\^(?:[^\]\\]|\\.)*\\s(?:[^\]\\]|\\.)*\]", "", pattern)
    fine = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and pattern and not re.search(r"\s|\\[sSWDPXR]|\(\?|\.|\[\^", spaced)
    normal = rules.get("normalizer") or {}
    for x in normal.get("normalizers", [normal] if normal else []):
        fine = fine and (x["type"] in ("NFC", "NFD", "Lowercase", "StripAccents") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ")
    for t in rules.get("added_tokens") or []:
        fine = fine and not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]))
    if not fine or rules.get("truncation") or rules.get("padding"):
        raise ValueError(f"{path}: its rules may look across white space")


def whole_counts(texts: pa.Array, path: str) -> Iterator[tuple[slice, np.ndarray]]:
    """Tokens of each text.

    The tokenizer drops white space and none of its rules looks across it, so a text has just
    the tokens of its pieces between white space; each distinct piece is encoded once.
    """
    library, known = tokenizer(path), _counts[path]
    for block in blocks(texts):
        found = words(block, SPACED)
        distinct, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        got = np.array([known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            data, at = block.data.tobytes(), first[new]
            pieces = [data[a:b].decode("utf-8", "replace") for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist(), strict=True)]
            got[new] = [len(e.ids) for e in library.encode_batch_fast(pieces, add_special_tokens=False)]
            if len(known) + len(new) > KEPT:
                known.clear()
            known.update(zip(distinct[new].tolist(), got[new].tolist(), strict=True))
        sums = np.zeros(len(back) + 1, np.int64)
        np.cumsum(got[back.reshape(-1)], out=sums[1:])
        yield block.rows, sums[found.first[1:]] - sums[found.first[:-1]]


def chunk_summary(text: str, start: int, size: int, overlap: int, path: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Of a chunk that starts at `start` in its document and reaches into the next one's first characters:

    its tokens, and in either overlap the stable boundaries (places where a token starts after
    white space) with the number of the chunk's tokens before each.
    """
    e = tokenizer(path).encode(text, add_special_tokens=False)
    sides: tuple[list[int], ...] = ([], [], [], [])
    begins = [a for a, _ in e.offsets]
    for i, a in enumerate(begins):
        if a and text[a - 1] in SPACES and (not i or begins[i - 1] < a):
            if a < overlap:
                sides[0].append(start + a)
                sides[1].append(i)
            if a >= size:
                sides[2].append(start + a)
                sides[3].append(i)
    return len(e.ids), *sides


def _chunked(chunk: int, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                starts = list(range(0, len(text), chunk))
                while len(starts) > 1 and starts[-2] + chunk + overlap >= len(text):
                    starts.pop()  # the one before reaches the end
                for at in range(0, len(starts), 64):
                    part = starts[at : at + 64]
                    yield pa.RecordBatch.from_pydict({"row": [row] * len(part), "start": part, "piece": [text[s : s + chunk + overlap] for s in part]}, pa.schema([("row", pa.int64()), ("start", pa.int64()), ("piece", pa.string())]))

    return split


def _summed(chunk: int, overlap: int, path: str):
    kinds = [("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("left", "left_n", "right", "right_n")]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16).to_pylist()
                found = [chunk_summary(p["piece"], p["start"], chunk, overlap, path) for p in part]
                columns = [[p["row"] for p in part], [p["start"] for p in part], *map(list, zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])

    return encode


def spliced_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of documents (row, text); n_tokens is null where two chunks share no stable boundary.

    Chunks spread over all tasks. From a boundary that two neighbours share, the left one's
    tokens end and the right one's begin: what stands before white space can't change what follows.
    """
    rows = long.mapInArrow(_chunked(chunk, overlap), "row long, start long, piece string").repartition(F.col("row"), F.col("start"))
    lists = "left array<long>, left_n array<long>, right array<long>, right_n array<long>"
    each = rows.mapInArrow(_summed(chunk, overlap, path), f"row long, start long, n long, {lists}")
    order = Window.partitionBy("row").orderBy("start")
    each = each.withColumn("last", F.lead("start").over(order).isNull())
    each = each.withColumn("meet", F.when(~F.col("last"), F.array_min(F.array_intersect("right", F.lead("left").over(order)))))
    each = each.withColumn("met", F.lag("meet").over(order))
    place = lambda at, keys, counts: F.get(counts, (F.array_position(keys, at) - 1).cast("int"))
    begin = F.when(F.col("start") == 0, F.lit(0)).otherwise(place(F.col("met"), F.col("left"), F.col("left_n")))
    end = F.when(F.col("last"), F.col("n")).otherwise(place(F.col("meet"), F.col("right"), F.col("right_n")))
    whole = each.groupBy("row").agg(F.sum(end - begin).alias("sum"), F.count(end - begin).alias("known"), F.count("*").alias("all"))
    return whole.select("row", F.when(F.col("known") == F.col("all"), F.col("sum")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document, without begin, end or added special tokens.

    path: a tokenizer file whose rules drop white space and don't look across it; others raise. Texts of more
    than `chunk` characters are encoded in chunks with overlaps; while some chunks of a document
    share no stable boundary, that document is encoded anew with overlaps eight times as wide, up
    to its whole length. Null and empty texts have no tokens; a null doc_id stays null; repeated documents get a row each;
    an empty table gives no rows; other columns are left out.
    """
    check_rules(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n in whole_counts(batch["text"], path):
                yield pa.RecordBatch.from_arrays([batch["doc_id"][part], batch["n_bytes"][part], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    few = rows.where(F.length("text") <= chunk).select("doc_id", size, "text").mapInArrow(short, "doc_id long, n_bytes long, n_tokens long")
    long = settled(rows.where(F.length("text") > chunk)).withColumn("row", F.monotonically_increasing_id())
    found, todo = None, long.select("row", "text")
    while True:
        got = cut(spliced_counts(todo, path, chunk, overlap))
        done = got.where("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = got.where("n_tokens is null").select("row")
        if failed.isEmpty():
            break
        todo, overlap = long.select("row", "text").join(failed, "row", "left_semi"), overlap * 8
    counted = long.select("row", "doc_id", size).join(found, "row").select("doc_id", "n_bytes", "n_tokens")
    return few.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
