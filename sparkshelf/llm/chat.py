"""Chat formatting: whole conversations rendered by a template, encoded once with offsets, and a loss mask aligned to them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer

#: Characters of a part of a conversation, about, and of text that is encoded at once.
PART_CHARS, ENCODED_CHARS = 65_536, 1 << 18
PARTS = "conv_id long, range long, seq long, whole boolean, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"
#: Where the byte-level pattern always begins a token: a space between two characters that aren't white space.
BREAK = re.compile(r"(?<=\S)(?= \S)")


@dataclass(frozen=True)
class Template:
    """Marks of a turn: before its role, between role and text, and behind it.

    also: further strings that must not stand in a text as they are, as other templates or the
    tokenizer read them as controls. In texts and roles an `escape` goes behind the first character of
    each control string, and one more where some are there already; so no control string is left, and taking
    one out of each gives the text back. learned: roles whose texts the loss covers.
    """

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    done: str = "<|done|>"
    also: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    _patterns: list = field(default_factory=list, compare=False, repr=False)

    def __post_init__(self):
        controls = sorted({*self.marks(), *self.also})
        heads, bodies = {c[:1] for c in controls}, [c[1:] for c in controls]
        for c in controls:
            # else an escape in one could hide or break another
            rest = [c[j + 1 :] for j in range(1, len(c)) if c[j] in heads]
            if len(c) < 2 or self.escape in c or len(self.escape) != 1 or any(b.startswith(r) or r.startswith(b) for r in rest for b in bodies):
                raise ValueError(f"{c!r} can't be told from the other control strings")
        body = "|".join(map(re.escape, sorted(bodies, key=len, reverse=True)))
        lead, e = "".join(map(re.escape, sorted(heads))), re.escape(self.escape)
        self._patterns.extend([re.compile(f"(?<=[{lead}])(?={e}*(?:{body}))"), re.compile(f"(?<=[{lead}]){e}(?={e}*(?:{body}))")])

    def hide(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: self.escape, text)

    def show(self, text: str) -> str:
        return self._patterns[1].sub("", text)

    def marks(self) -> list[str]:
        return [self.turn, self.says, self.done]

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn, and where in it the text begins and ends."""
        lead, body = f"{self.turn}{self.hide(role)}{self.says}", self.hide(text)
        return f"{lead}{body}{self.done}", len(lead), len(lead) + len(body)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of rendered turns: the way back."""
        out = []
        for one in formatted.split(self.turn)[1:]:
            role, text = one.split(self.says)
            out.append((self.show(role), self.show(text.removesuffix(self.done))))
        return out


@cache
def _encoder(path: str, marks: tuple[str, ...]):
    from tokenizers import AddedToken

    own = type(tokenizer(path)).from_file(path)
    own.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in marks])
    return own


def check_tokenizer(path: str, template: Template) -> None:
    """Raises unless the file's tokens cover every character in order and the template hides all of its special strings.

    That holds for byte-level files without a normalizer; their pattern always cuts at BREAK, too.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    first = rules.get("pre_tokenizer") or {}
    if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or rules.get("normalizer") or rules.get("post_processor") or rules.get("truncation") or rules.get("padding"):
        raise ValueError(f"{path}: its tokens may not cover all of a text")
    left = {t["content"] for t in rules.get("added_tokens") or []} - {*template.marks(), *template.also}
    if left:
        raise ValueError(f"the template doesn't hide {sorted(left)}")


def encoded(texts: list[str], path: str, template: Template, most: int = ENCODED_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token ids, starts and ends in characters of each text. Longer texts are encoded in pieces of about `most` characters, cut where a token always begins."""
    pieces, owner, shift = [], [], []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            m = BREAK.search(text, at + most)
            if not m:
                break
            pieces.append(text[at : m.start()])
            owner.append(i)
            shift.append(at)
            at = m.start()
        pieces.append(text[at:])
        owner.append(i)
        shift.append(at)
    found, k = [], 0
    for e in _encoder(path, tuple(template.marks())).encode_batch(pieces, add_special_tokens=False):
        spans = np.array(e.offsets, np.int32).reshape(-1, 2) + np.int32(shift[k])
        found.append((np.array(e.ids, np.int32), spans[:, 0], spans[:, 1]))
        k += 1
    k = 0
    for i, text in enumerate(texts):
        own = []
        while k < len(owner) and owner[k] == i:
            own.append(found[k])
            k += 1
        ids, starts, ends = (np.concatenate(x) for x in zip(*own, strict=True))
        if len(text) and (not len(ids) or starts[0] or ends[-1] != len(text) or (starts[1:] > ends[:-1]).any()):
            raise ValueError("the tokens don't cover the text")
        yield ids, starts, ends


def aligned(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie under the spans (begin, end), which are sorted and apart, by binary search in the tokens' sorted bounds."""
    begin, end = spans.reshape(-1, 2).T
    low, high = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
    some = end > begin
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, low[some], 1)
    np.add.at(edges, high[some], -1)
    return np.cumsum(edges)[:-1] > 0


@dataclass
class _Part:
    conv_id: int | None
    seq: int
    first: bool
    pieces: list[str] = field(default_factory=list)
    spans: list[int] = field(default_factory=list)
    size: int = 0
    whole: bool = False

    def add(self, turn: tuple[str, int, int], learned: bool) -> None:
        text, a, b = turn
        if learned:
            self.spans += [self.size + a, self.size + b]
        self.pieces.append(text)
        self.size += len(text)


def _format(path: str, template: Template, part_chars: int):
    def batch_of(parts: list[_Part], number: int) -> pa.RecordBatch:
        texts = ["".join(p.pieces) for p in parts]
        found = list(encoded(texts, path, template))
        offsets = pa.array(np.append(0, np.cumsum([len(ids) for ids, _, _ in found])), pa.int32())
        loss = [aligned(starts, ends, np.array(p.spans, np.int64)) for p, (_, starts, ends) in zip(parts, found, strict=True)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]), pa.int32())) for i in range(3)]
        columns = [pa.array([p.conv_id for p in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([p.seq for p in parts], pa.int64()), pa.array([p.whole for p in parts]), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *lists, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(loss)))], names=["conv_id", "range", "seq", "whole", "formatted", "token_ids", "token_starts", "token_ends", "loss"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, ready, size = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if part is None:
                    part = _Part(conv, 0, True)
                elif part.conv_id != conv or part.size >= part_chars:
                    same = part.conv_id == conv
                    # a range's first and last conversations may go on in another range
                    part.whole = not same and not part.first and not part.seq
                    ready.append(part)
                    size += part.size
                    part = _Part(conv, part.seq + 1 if same else 0, part.first and same)
                part.add(template.render(role or "", text or ""), (role or "") in template.learned)
                if size >= part_chars:
                    yield batch_of(ready, number)
                    ready, size = [], 0
        if part is not None:
            ready.append(part)
        if ready:
            yield batch_of(ready, number)

    return render


def format_conversations(rows: DataFrame, path: str, template: Template = Template(), part_chars: int = PART_CHARS) -> DataFrame:  # noqa: B008
    """Conversations (conv_id, turn, role, text) rendered by the template and encoded: conv_id, range, seq, whole, formatted, token_ids, token_starts, token_ends (in characters of formatted) and loss, a mask of the tokens of learned roles' texts.

    path: a byte-level tokenizer file, others raise; the template's marks become special tokens behind its own. Turns are in
    order of turn (null first), of one turn by role and text. Conversations are dealt by
    ranges of conversation and turn, so that one with very many turns is spread over tasks; they
    stream by and are cut between turns into parts of about part_chars characters. As marks are always
    tokens of their own, a part's tokens are those that it has in the whole. A conversation's parts in order of
    (range, seq) are its rendering; whole marks one of a single part. A turn isn't cut, its text is encoded in pieces.

    Null conv_ids are one conversation, null roles and texts are empty, repeated rows are turns of
    their own, no rows give no rows; other columns are left out.
    """
    check_tokenizer(path, template)
    order = ["conv_id", "turn", "role", "text"]
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_format(path, template, part_chars), PARTS)


PIECES = "conv_id long, range long, seq long, whole boolean, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray, template: Template) -> list[str]:
    """The texts under the mask, without escapes: one of each stretch of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
    return [template.show(formatted[starts[a] : ends[z - 1]]) for a, z in edges.reshape(-1, 2).tolist()]


def _told(template: Template):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            lists = {c: (batch[c].offsets.to_numpy() - batch[c].offsets[0].as_py(), batch[c].flatten().to_numpy(zero_copy_only=False)) for c in ("token_starts", "token_ends", "loss")}
            for i, formatted in enumerate(batch["formatted"].to_pylist()):
                own = [flat[at[i] : at[i + 1]] for at, flat in lists.values()]
                turns, texts = template.turns(formatted), masked_texts(formatted, *own, template)
                said, loss = "".join(f"{role}\n{text}\n" for role, text in turns).encode(), "".join(texts)
                whole = batch["whole"][i].as_py()
                for c, v in zip(columns, (len(turns), hashlib.sha256(said).hexdigest().encode() if whole else said, len(loss), hashlib.sha256(loss.encode()).hexdigest().encode() if whole else loss.encode(), len(formatted)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("conv_id", "range", "seq", "whole")], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", "range", "seq", "whole", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"])

    return tell


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts stand next to each other, in order; parts stream by."""
    held, out = None, []

    def close() -> None:
        if held:
            conv, n, turns, chars, loss, size = held
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for p in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
            if p["whole"]:
                out.append((p["conv_id"], p["n_turns"], p["turns"].decode(), p["loss_chars"], p["loss"].decode(), p["formatted_chars"]))
                continue
            if held is None or held[0] != p["conv_id"]:
                close()
                held = [p["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            held[1] += p["n_turns"]
            held[2].update(p["turns"])
            held[3] += p["loss_chars"]
            held[4].update(p["loss"])
            held[5] += p["formatted_chars"]
        if len(out) > 1000:
            yield batch_of()
            out.clear()
    close()
    yield batch_of()


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, n_turns, turns_sha256 (of role, line end, text, line end of each turn), loss_chars, loss_sha256 (of all text under the mask) and formatted_chars, read from format_conversations()'s rows.

    A whole conversation is told where it was formatted. Of the others, each part's texts travel and pass a
    task in order, one at a time, as a digest of all of them needs them in sequence; so memory doesn't
    grow with a conversation.
    """
    order = ["conv_id", "range", "seq"]
    told = parts.mapInArrow(_told(template), PIECES)
    return told.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_joined, REPORT)
