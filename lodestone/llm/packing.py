"""Harmonic packing of token ids into sequences of a fixed capacity.

A document's ids are cut into pieces whose lengths are shares of the capacity:
whole sequences first, then the largest of the shares 1/2, 1/4, 1/8 ... that
fits what is left.  A piece of class k is capacity // k long, so a bin of class k
takes exactly k pieces, whatever documents they are from, and is full.  Each task
fills the bins of each class on its own, holds the pieces of at most one open bin
a class (fewer ids than the capacity times the number of classes), and closes
what is open at its end as bins of 1, 2, 4 ... pieces, which are a power of two
long where the capacity is one.  One pass over the texts, no shuffle.

Ids come from a byte-level BPE vocabulary.  Text is encoded in units between
spaces, which no token crosses, so a unit met before costs a lookup, and memory
does not grow with the longest text but by its ids.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm import textscan as ts
from lodestone.llm.scratch import bound_batches

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])
#: The public pattern by which byte-level vocabularies of this kind split text before merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once, and units that a worker remembers.
PART = 1 << 16
CACHE_UNITS = 300_000
#: Bytes of ids, and rows, that a task hands over at once.
BATCH_BYTES, BATCH_ROWS = 1 << 21, 4_000
#: sequence_id holds the task's partition above this bit and its own count below.
_SEQUENCE_BITS = 33


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """unit -> the ids of a space and the unit, each in 4 bytes, little-endian; encode() gives those of whole texts."""

    def __init__(self, vocabulary: bytes, part: int = PART) -> None:
        import tiktoken

        spec = json.loads(vocabulary)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix space is asked for")
        letters = _byte_letters()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in model["vocab"].items() if token not in added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = [model["vocab"][a + b] for a, b in pairs]
        if order != sorted(order):
            raise ValueError("ids must rise in the order of merges")
        self.engine = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {k: array("I", [i]).tobytes() for k, i in added.items()}
        self.special = re.compile("|".join(f"({re.escape(x)})" for x in sorted(added, key=len, reverse=True))) if added else None
        self.part = part

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.engine.encode_ordinary(" " + unit)).tobytes()
        if len(unit) <= 64:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text; names of added tokens in it are those tokens."""
        if self.special is not None and any(x in text for x in self.added):
            return b"".join(self.added.get(x) or self._ordinary(x) for x in self.special.split(text) if x)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if len(text) <= self.part:
            return self._units(text)
        out, at = [], 0
        while at < len(text):
            ids, at = self._stretch(text, at)
            out.append(ids)
        return b"".join(out)

    def _units(self, text: str) -> bytes:
        """A text that no space follows white space in is its units; any other is encoded as it is."""
        if _WHITE_SPACE.search(text):
            return array("I", self.engine.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.engine.encode_ordinary(first)).tobytes() if first else b""
        return head + b"".join(map(self.__getitem__, rest))

    def _stretch(self, text: str, at: int) -> tuple[bytes, int]:
        """The ids of text from at up to some place where encoding may start anew, and that place."""
        if len(text) - at <= self.part:
            return self._units(text[at:]), len(text)
        if found := _BOUNDARY.search(text, at + self.part // 2, at + self.part):
            return self._units(text[at : found.end()]), found.end()
        return self._unbroken(text, at)

    def _unbroken(self, text: str, at: int) -> tuple[bytes, int]:
        """As _stretch, where no space is near.

        Ids are those of the whole text exactly if each two neighbours are what their
        own text gives.  So encoding may start anew after any id that, with the ids
        that follow then, is what the text of both gives; such an id is soon found
        from the end of the part back.  Letters must not be parted from an apostrophe,
        nor the last two of white space, as the pattern looks at what follows them.
        """
        part = text[at : at + self.part]
        ids = self.engine.encode_ordinary(part)
        ends = self._ends(ids, part)
        for k in range(len(ids) - 2, 0, -1):
            cut = ends[k]
            if cut < 0 or not _same_kind(part[cut - 1 : cut + 2]):
                continue
            start = next((j for j in range(k - 1, -1, -1) if ends[j] >= 0), -1)
            rest = text[at + cut : at + cut + self.part]
            following = self.engine.encode_ordinary(rest)
            close = self._ends(following[:64], rest)
            stop = next((j for j, e in enumerate(close) if e >= 0), None)
            if stop is None:
                continue
            left = part[ends[start] if start >= 0 else 0 : cut]
            if self.engine.encode_ordinary(left + rest[: close[stop]]) == [*ids[start + 1 : k + 1], *following[: stop + 1]]:
                return array("I", ids[: k + 1]).tobytes(), at + cut
        return array("I", self.engine.encode_ordinary(text[at:])).tobytes(), len(text)

    def _ends(self, ids: list[int], text: str) -> list[int]:
        """Where in text each id ends, -1 where that is within a character."""
        n_bytes, at, out = 0, {0: 0}, []
        total = 0
        for k, c in enumerate(text):
            total += len(c.encode("utf-8", "surrogatepass"))
            at[total] = k + 1
        for i in ids:
            n_bytes += len(self.engine.decode_single_token_bytes(i))
            out.append(at.get(n_bytes, -1))
        return out


_WHITE_SPACE = re.compile(r"\s ")
#: A sign, digit or letter before white space: no id reaches across.
_BOUNDARY = re.compile(r"[!-~](?=[ \t\n\r])|\w(?=[ \t\n\r])")


def _same_kind(three: str) -> bool:
    """Whether the characters before and after a cut, and the one after that, are letters, digits, white space or signs alike."""
    kind = lambda c: "L" if c.isalpha() else "N" if c.isnumeric() else "S" if c.isspace() else "O"
    kinds = {kind(c) for c in three}
    return len(three) == 3 and len(kinds) == 1 and "'" not in three


_ENCODERS: dict[int, Encoder] = {}


def _encoder(key: int, vocabulary: bytes) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def shares(capacity: int, grain: int = 1) -> list[tuple[int, int]]:
    """(k, capacity // k) for k = 1, 2, 4 ... while the share is grain at least."""
    out, k = [], 1
    while capacity // k >= max(1, grain):
        out.append((k, capacity // k))
        k *= 2
    return out


def cut(n: int, classes: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(k, length) of the pieces of n ids in order; what is shorter than the least share is a piece of its class."""
    for k, share in classes:
        while n >= share:
            yield k, share
            n -= share
    if n:
        yield classes[-1][0], n


class Bins:
    """The open bins of one task; add() and close() give the rows of the bins that they fill."""

    def __init__(self, partition: int) -> None:
        self.open: dict[int, list[tuple]] = {}
        self.next = partition << _SEQUENCE_BITS

    def add(self, k: int, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, doc_tokens, ids)."""
        if k == 1:
            return self._fill([piece])
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        return self._fill(self.open.pop(k)) if len(waiting) == k else []

    def close(self) -> list[tuple]:
        out = []
        for k in sorted(self.open):
            left = self.open[k]
            while left:
                n = 1 << (len(left).bit_length() - 1)
                out += self._fill(left[:n])
                left = left[n:]
        self.open = {}
        return out

    def _fill(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for doc_id, start, length, tokens, ids in pieces:
            rows.append((doc_id, start, length, tokens, self.next, at, ids))
            at += length
        self.next += 1
        return rows


def pack(docs: DataFrame, vocabulary: bytes, capacity: int = 2048, end: int | None = 1, grain: int = 1) -> DataFrame:
    """PIECES: every row of docs (doc_id, text, ...) as pieces of sequences of at most capacity ids.

    A document's ids are those of its text by the vocabulary (the bytes of a
    tokenizers JSON file), then end.  start counts the document's ids before the
    piece, offset the sequence's; ids are 4 bytes each, little-endian.  doc_tokens
    counts the document's ids with end.  A null text is an empty one, whose only id
    is end; rows without doc_id or with repeated ones are documents of their own;
    other columns are ignored; no rows give none.  Pieces shorter than grain are not
    cut, at the price of padding; with grain 1 and a capacity that is a power of two
    every sequence is a power of two long.  A sequence is filled from one partition
    of docs: sequence_id is stable where the partitions are, as in a table's scan.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary
    key, classes = hash(vocabulary), shares(capacity, grain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = _encoder(key, shared.value), Bins(TaskContext.get().partitionId())
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = encoder.encode(text or ""), 0
                if end is not None:
                    ids += array("I", [end]).tobytes()
                tokens = len(ids) // 4
                for k, length in cut(tokens, classes):
                    full = bins.add(k, (doc_id, start, length, tokens, ids[4 * start : 4 * (start + length)]))
                    rows += full
                    held += sum(len(r[-1]) for r in full)
                    start += length
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows + bins.close())

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(ts.thrifty(run), PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
