"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi search.

The pieces form the automaton.  One pass over a text visits, at each position,
every piece that ends there (the automaton's state and what its output links lead
to) and relaxes the best score of reaching that position; following the best
starts back gives the segmentation of greatest total score.  Characters that no
piece holds become byte pieces.

Where no piece crosses from a letter to a space mark, or holds a line feed, the
search falls apart there, so segmentations of the parts between are remembered in
a bounded cache.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lodestone.llm import textscan as ts
from lodestone.llm.scratch import bound_batches

MARK = "▁"
#: What an unknown character costs below the least piece score.
UNKNOWN_PENALTY = 10.0
#: Units that are remembered within a task, twice over.
CACHE_UNITS = 150_000
#: Characters, or ids, of a very long text that are taken apart at once.
PART = 1_000_000
#: Characters that the search keeps scores and starts of at once.
SEARCHED = 1 << 18
_NEVER = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Encoder:
    """Encodes and decodes with the pieces of a model file (path on every executor, or the file's bytes)."""

    def __init__(self, model: str | bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.byte_ids: dict[int, int] = {}
        self.content: list[bytes] = []
        self.scores: list[float] = []
        self.unknown_id = 0
        self.automaton = ahocorasick.Automaton()
        pieces = []
        for i, p in enumerate(proto.pieces):
            self.scores.append(p.score)
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.content.append(bytes([value]))
            elif p.type in (NORMAL, USER):
                self.content.append(p.piece.replace(MARK, " ").encode())
                pieces.append(p.piece)
                self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
            else:
                self.content.append(b"")
                if p.type == UNKNOWN:
                    self.unknown_id = i
        self.automaton.make_automaton()
        self.singles = {p for p in pieces if len(p) == 1}
        self.longest = max(map(len, pieces), default=1)
        self.unknown_score = min(self.scores) - UNKNOWN_PENALTY
        # may a text be cut before a mark that follows something else, and around line feeds?
        self.divisible = not any("\n" in p or any(b == MARK != a for a, b in zip(p, p[1:])) for p in pieces)
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def segment(self, text: str) -> Sequence[int]:
        """Ids of the best segmentation of text, in which marks stand for spaces.

        A text of more than SEARCHED characters is searched in parts.  No piece reaches
        over ``longest`` positions, so the best way through the text leads to one of
        the last so many of a part; where the ways to all of them have come together,
        the ids until there are settled, and the search goes on from there.
        """
        if len(text) <= SEARCHED:
            best, start, piece = self._search(text, 0.0)
            return tuple(self._ids_to(text, len(text), start, piece))
        out, at, size, reached = array("i"), 0, SEARCHED, 0.0
        while at < len(text):
            part = text[at : at + size]
            best, start, piece = self._search(part, reached)
            to = len(part)
            if at + to < len(text):
                ways = {p for p in range(max(0, to - self.longest + 1), to + 1) if best[p] > _NEVER}
                while len(ways) > 1:
                    last = max(ways)
                    ways.remove(last)
                    ways.add(start[last])
                to = ways.pop()
            if not to:  # they have not come together yet
                size *= 2
                continue
            out.extend(self._ids_to(part, to, start, piece))
            at, size, reached = at + to, SEARCHED, best[to]
        return out

    def _search(self, text: str, reached: float) -> tuple[list[float], list[int], list[int]]:
        """Of each position the best score, that of the first being given, and the start and piece that lead to it."""
        n = len(text)
        best = [_NEVER] * (n + 1)
        best[0] = reached
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        if self.singles.issuperset(text):
            # of equal scores the piece that starts first stays: pieces that end together come longest first
            for end, (length, score, i) in self.automaton.iter(text):
                end += 1
                score += best[end - length]
                if score > best[end]:
                    best[end], start[end], piece[end] = score, end - length, i
        else:
            done = 0  # positions up to here may also be reached by an unknown character
            for end, (length, score, i) in chain(self.automaton.iter(text), [(n, (0, 0.0, -1))]):
                for e in range(done + 1, min(end, n) + 1):
                    s = best[e - 1] + self.unknown_score
                    if text[e - 1] not in self.singles and s > best[e]:
                        best[e], start[e], piece[e] = s, e - 1, -1
                done = max(done, end)
                end += 1
                if length and (s := best[end - length] + score) > best[end]:
                    best[end], start[end], piece[end] = s, end - length, i
        return best, start, piece

    def _ids_to(self, text: str, at: int, start: list[int], piece: list[int]) -> list[int]:
        out: list[int] = []
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                raw = text[start[at] : at].encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)] if self.byte_ids else [self.unknown_id]
            at = start[at]
        out.reverse()
        return out

    def _unit(self, unit: str) -> Sequence[int]:
        ids = self._young.get(unit)
        if ids is None:
            ids = self._old.get(unit)
            if ids is None:
                ids = self.segment(unit)
            if len(unit) <= 64:
                if len(self._young) >= CACHE_UNITS:
                    self._old, self._young = self._young, {}
                self._young[unit] = ids
        return ids

    def forget(self) -> None:
        """Give the cache's memory back: worker processes outlive tasks and stages."""
        self._young, self._old = {}, {}

    def encode(self, text: str) -> list[int]:
        return list(self.ids(text))

    def ids(self, text: str) -> Sequence[int]:
        """The ids of a text, of a very long one in 4 bytes each; an empty text has none."""
        if not text:
            return ()
        marked = text.replace(" ", MARK)
        if self.dummy_prefix:
            marked = MARK + marked
        if not self.divisible:
            return self.segment(marked)
        out: list[int] | array = [] if len(text) <= PART else array("i")
        known = self._young
        if MARK in text or "  " in text or marked[:2] == MARK * 2 or not self.dummy_prefix:
            for unit in _units(marked):
                out.extend(self._unit(unit))
            return out
        for part in _parts(text):
            own: list[int] | array = [] if len(part) <= 4 * PART else array("i")
            for word in part.split(" "):
                ids = known.get(MARK + word)
                if ids is None:
                    if "\n" in word:
                        for unit in _units(MARK + word):
                            own.extend(self._unit(unit))
                        continue
                    ids = self._unit(MARK + word)
                    known = self._young
                own.extend(ids)
            if len(text) <= PART:
                return own
            out.extend(own)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: what encode() got, but that a mark in the text itself comes back as a space."""
        raw = b"".join(map(self.content.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _units(marked: str) -> Iterator[str]:
    """Cut before marks that follow something else, and around line feeds."""
    start, n = 0, len(marked)
    for k in range(1, n):
        a, b = marked[k - 1], marked[k]
        if a == "\n" or b == "\n" or b == MARK != a:
            yield marked[start:k]
            start = k
    if n:
        yield marked[start:n]


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART characters that were joined by one space."""
    at = 0
    while (cut := text.find(" ", at + PART)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(key: int, model: bytes) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def read_model(spark, path: str) -> bytes:
    """The bytes of a model file in any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path or not path.startswith("/") else f"file://{path}").first()["content"])


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with ids array<int> and round_trip: whether decoding the ids gives the text back.

    A null text has null ids, an empty one no ids; both count as a round trip.
    Columns of these names in docs are replaced; all others stay.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("ids", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary
    at, key = docs.columns.index("text"), hash(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in batches:
            for texts in ts.chunks(batch.column(at)):
                part = batch.slice(texts.first_row, len(texts))
                flat, offsets, same, gone = array("i"), [0], [], []
                for text in part.column(at).to_pylist():
                    ids = encoder.ids(text or "")
                    flat.extend(ids)
                    offsets.append(len(flat))
                    same.append(encoder.decode(ids) == (text or ""))
                    gone.append(text is None)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32)), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(same)], names=[*part.schema.names, "ids", "round_trip"])
        encoder.forget()

    return docs.mapInArrow(ts.thrifty(run), StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """rows with decoded: the text of the column ids (null: null).  A column decoded in rows is replaced."""
    bound_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at, key = rows.columns.index("ids"), hash(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(ts.thrifty(run), StructType([*rows.schema.fields, StructField("decoded", StringType())]))
