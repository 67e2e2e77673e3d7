"""Suffix-array dedup of bytes: prefix-free parses of content-dealt parts of the corpus give the order of their suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block
from .repeats import Rule, Symbols, remove_repeats

LENGTH = 50
GRAM = 24
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])


def rule(length: int = LENGTH, gram: int = GRAM) -> Rule:
    """Strings of bytes, dealt to buckets by the smallest hash of `gram` bytes in each."""
    return Rule(words=False, window=length, gram=min(gram, length), within=False, block_bytes=1 << 20, bucket_bytes=4 << 20)


def _finish(block: Block, s: Symbols, gone: np.ndarray, table: pa.Table) -> pa.Table:
    edge = np.zeros(len(gone) + 1, bool)
    edge[block.offsets[:-1]] = edge[-1] = True
    begin, end = gone.copy(), gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:-1]
    end[:-1] &= ~gone[1:] | edge[1:-1]
    a, z = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.searchsorted(a, block.offsets)
    bounds[-1] = len(a)
    of = np.repeat(np.arange(len(block)), np.diff(bounds))
    spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x - block.offsets[of], pa.int64()) for x in (a, z)], names=["start", "end"]))
    stay = ~gone
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(stay, out=total[1:])
    at = total[block.offsets]
    kept = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(block.data[stay]))])
    sizes = np.diff(block.offsets)
    ids = [None if n else d for d, n in zip(table["doc"].to_pylist(), table["no_id"].to_pylist(), strict=True)]
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(at), pa.int64()), spans, kept], schema=RESULT)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, rules: Rule | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, start and end in bytes) and kept (the bytes that stay) of every document.

    A byte goes if a string of `length` bytes over it also starts in a document of a smaller
    doc_id; strings don't cross documents and are judged on the input.

    Blocks find the parts of their texts whose strings may stand elsewhere and deal them by content,
    so that equal strings meet in one bucket (see repeats.py). A bucket's collection, many variants
    of few passages, is parsed prefix-free at triggers of a rolling hash; the suffix arrays of its
    dictionary and of its parse give the order of all its suffixes (see prefixfree.py), in which
    equal strings are neighbours, and each string's smallest document is read off.
    Null text: empty. A null doc_id stands last. Rows that share a doc_id are judged apart, and
    neither is smaller. No rows give no rows; other columns are left out.
    """
    return remove_repeats(docs, rules or rule(length), _finish, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_bytes_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
