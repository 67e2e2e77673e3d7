"""Substring dedup of words by super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block
from .repeats import Rule, Symbols, remove_repeats

WINDOW = 20
GRAM = 6
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def rule(window: int = WINDOW, gram: int = GRAM) -> Rule:
    """Windows of words; the minimiser of a window is its smallest run of `gram` words by hash."""
    return Rule(words=True, window=window, gram=min(gram, window), within=True)


def _finish(block: Block, s: Symbols, gone: np.ndarray, table: pa.Table) -> pa.Table:
    data, kept, removed = block.data.tobytes(), [], []
    for i in range(len(block)):
        text = data[block.offsets[i] : block.offsets[i + 1]].split()
        flags = gone[s.first[i] : s.first[i + 1]]
        n = int(flags.sum())
        removed.append(n)
        kept.append(b" ".join(text if not n else [w for w, g in zip(text, flags.tolist(), strict=True) if not g]))
    ids = [None if n else d for d, n in zip(table["doc"].to_pylist(), table["no_id"].to_pylist(), strict=True)]
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(s.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=RESULT)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, rules: Rule | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every document.

    Words are runs of anything but ASCII white space. A window is `window` consecutive words of
    one document; a word goes if a window over it also starts earlier: in a document of a smaller
    doc_id, or before it in the same one. All windows are judged on the input.

    Consecutive windows with the same minimiser are a super-k-mer, which travels as one string of
    words to its minimiser's bucket (see repeats.py), where windows are sorted and compared word by word.
    Null text: no words. A null doc_id stands last. Rows that share a doc_id are judged apart, and
    neither is earlier. Texts of fewer words than a window stay. No rows give no rows; other columns are left out.
    """
    return remove_repeats(docs, rules or rule(window), _finish, "doc_id long, n_words long, n_removed long, kept string")


def repeated_words_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256."""
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
