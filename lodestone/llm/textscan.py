"""Vectorised word scanning over Arrow string columns.

The functions here work on the contiguous byte buffer of many texts at once, so
the cost per word is a few numpy passes and memory is bounded by ``max_bytes``
of text (or one text, if that is longer).  Word hashes are polynomial hashes
modulo 2**64 over random byte values, finished with an avalanche step; hashes of
runs of words are polynomials over those.  Both are computed in slices, so a very
long text needs no tables as long as itself.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

CHUNK_BYTES = 1_000_000
#: Most texts of a chunk, however short.
CHUNK_ROWS = 2_000
#: Bytes, or words, that are hashed at once: tables of powers are no longer than that.
SLICE = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE_BYTES, _BASE_WORDS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUES = seeded(256, 7)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, min(2 * len(have[0]), SLICE + 1) if have else 0)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have


@dataclass
class Texts:
    """Some rows of a string column as bytes: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = as_array(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still span bytes
        lengths = np.diff(offsets)
        gone = ~np.asarray(column.is_valid())
        if lengths[gone].any():
            return buffers(column.fill_null(""))
    return raw, offsets


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS) -> Iterator[Texts]:
    """The rows of a column in order, at most max_bytes of text and max_rows rows at a time, or one text."""
    raw, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), row + max_rows, n)
        start = offsets[row]
        yield Texts(raw[start : offsets[end]], offsets[row : end + 1] - start, row)
        row = end


@dataclass
class Words:
    """Words of some texts: word i is data[start[i]:end[i]] of text doc[i]; text d has words first[d]:first[d + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: Texts, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators; none crosses from a text to the next."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1]
    heads = heads[heads < n]
    begin[heads] = inside[heads]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    tails = offsets[1:] - 1
    tails = tails[(tails >= 0) & (offsets[1:] > offsets[:-1])]
    close[tails] = inside[tails]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(close) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def _polynomials(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The sum of values[k] * base ** (k - start[i]) over start[i] <= k < end[i], for ascending starts and ends; values are looked up slice by slice."""
    out = np.zeros(len(start), U64)
    i, n = 0, len(start)
    while i < n:
        a = int(start[i])
        j = max(int(np.searchsorted(end, a + SLICE, side="right")), i + 1)
        b = int(end[j - 1])
        if b - a <= SLICE:
            up, down = powers(base, b - a + 1)
            sums = np.zeros(b - a + 1, U64)
            np.cumsum(values[a:b] * up[: b - a], out=sums[1:])
            out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        else:  # one run longer than a slice
            up, _ = powers(base, SLICE)
            shift, total = 1, 0
            for k in range(a, b, SLICE):
                part = values[k : min(k + SLICE, b)]
                total += shift * int((part * up[: len(part)]).sum(dtype=U64))
                shift = shift * pow(base, SLICE, 1 << 64) % (1 << 64)
            out[i] = U64(total % (1 << 64))
        i = j
    return out


class _Mapped:
    """BYTE_VALUES[fold[data]], looked up for the slices that are asked for."""

    def __init__(self, data: np.ndarray, fold: np.ndarray | None) -> None:
        self.data, self.table = data, BYTE_VALUES if fold is None else BYTE_VALUES[fold]

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.table[self.data[part]]


def word_hashes(texts: Texts, found: Words, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, mapped through fold first if given."""
    return mix(_polynomials(_Mapped(texts.data, fold), found.start, found.end, _BASE_BYTES))


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE_WORDS) -> np.ndarray:
    """A 64-bit hash of each run hashes[start[i]:end[i]]; starts and ends ascend."""
    return mix(_polynomials(hashes, start, end, base) + (end - start).astype(U64))


def release() -> None:
    """Give freed memory back to the system: a worker process outlives its tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def thrifty(run: Mapper) -> Mapper:
    """run, a function for mapInArrow, that gives its memory back at the end of its task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each run of width words within a text, texts' first windows as in Words.first)."""
    per_text = np.maximum(found.counts - width + 1, 0)
    first = np.zeros(len(per_text) + 1, np.int64)
    np.cumsum(per_text, out=first[1:])
    start = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], per_text)
    return start, first
