"""Runs of words that repeat with a period: repeated k-gram masking, then Main-Lorentz.

A run of period q that is long enough overlaps its own shift by q in
k = min over q of max(shortest - q, (times - 1) * q) words at least.  So each of its
words lies in a k-gram that its document holds twice, and words outside such k-grams
part a text into segments that no run crosses.  Only what survives is searched.

The search is that of Main and Lorentz, level by level for all segments of a chunk
at once: a stretch is halved, and a run across the middle m with period q shows as
words that agree q apart around m - q and m, or around m and m + q.  Agreement over
a length is a comparison of two prefix hashes modulo 2**61 - 1, so one pass over all
(m, q) of a level leaves few candidates, whose exact ends are found by bisection.
Every run is then compared word for word; hashes that misled are replaced by exact
numbers of words.  All of it runs inside Arrow batches, one pass over the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import textscan as ts
from lodestone.llm.scratch import bound_batches

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, n_kept long, kept_text string, kept_sha256 string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: The modulus of prefix hashes, a Mersenne prime, and their base.
PRIME, BASE = (1 << 61) - 1, 0x1A5B3C9D7E2F4681 % ((1 << 61) - 1)
#: (middle, period) pairs that are looked at at once.
PAIRS = 1 << 17
_U = np.uint64


def overlap(shortest: int, times: int) -> int:
    """The k of the masking: words in which any run agrees with its shift by one period."""
    return min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below it."""
    half, low = _U(31), _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << half) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


class Prefixes:
    """Prefix hashes of a sequence of symbols, to compare stretches of it."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.n = n
        self.power = np.ones(n + 1, _U)
        have = 1
        while have <= n:
            more = min(have, n + 1 - have, PAIRS)
            self.power[have : have + more] = _times(self.power[:more], _U(pow(BASE, have, PRIME)))
            have += more
        self.sums = np.zeros(n + 1, _U)
        for at in range(0, n, PAIRS):  # sums of the values' upper and lower bits stay below 2 ** 64
            value = _times(_reduced(symbols[at : at + PAIRS]), self.power[at : min(n, at + PAIRS)])
            high, low = _reduced(np.cumsum(value >> _U(31))), _reduced(np.cumsum(value & _U((1 << 31) - 1)))
            part = _reduced(_times(high, _U(1 << 31)) + low)
            self.sums[at + 1 : at + 1 + len(part)] = _reduced(part + self.sums[at])

    def equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether length symbols from i and from i + q agree; what reaches beyond an end does not."""
        fits = (i >= 0) & (i + q + length <= self.n)
        i, length = np.where(fits, i, 0), np.where(fits, length, 0)
        q = np.where(fits, q, 0)
        prime = _U(PRIME)
        left = _reduced(self.sums[i + length] + prime - self.sums[i])
        right = _reduced(self.sums[i + q + length] + prime - self.sums[i + q])
        return fits & (_times(left, self.power[q]) == right)

    def forward(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many symbols from i on agree with those q later."""
        return self._most(lambda n: self.equal(i, q, n), self.n - q - i)

    def backward(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many symbols before i agree with those q later."""
        return self._most(lambda n: self.equal(i - n, q, n), i)

    def _most(self, holds, limit: np.ndarray) -> np.ndarray:
        """The largest n up to limit for which holds(n), which holds for all smaller ones too."""
        low, high = np.zeros(len(limit), np.int64), np.maximum(limit, 0)
        step = np.ones(len(limit), np.int64)
        growing = high > 0
        while growing.any():  # gallop, as most stretches are short
            next_ = np.minimum(low + step, high)
            good = growing & holds(next_)
            high = np.where(growing & ~good, next_ - 1, high)
            low = np.where(good, next_, low)
            growing = good & (low < high)
            step *= 2
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def find_runs(symbols: np.ndarray, longest: int, shortest: int, times: int) -> np.ndarray:
    """Rows (start, end, period) by start, then period: the maximal stretches of at least max(shortest, times * period) symbols, with their least period.

    longest bounds the stretches; times is 3 or more.
    """
    prefixes, n = Prefixes(symbols), len(symbols)
    found = set()
    half = 1
    while 2 * half < shortest:
        half *= 2
    while half < n:
        middles = np.arange(half, n, 2 * half, dtype=np.int64)
        most = max(min(2 * half, longest) // times, 1)
        per = max(1, PAIRS // most)
        for k in range(0, len(middles), per):
            some, known = middles[k : k + per], []
            for first in range(1, most + 1, PAIRS):  # more than one round for one middle only
                periods = np.arange(first, min(first + PAIRS, most + 1), dtype=np.int64)
                known += _across(prefixes, np.repeat(some, len(periods)), np.tile(periods, len(some)), shortest, times, known)
            found.update(known)
        half *= 2
    least: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        least[start, end] = min(q, least.get((start, end), q))
    rows = np.array([(s, e, q) for (s, e), q in least.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _across(prefixes: Prefixes, m: np.ndarray, q: np.ndarray, shortest: int, times: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches (start, end, q) around the middles m, in order, but for multiples of a period within known ones or others found."""
    out: list[tuple[int, int, int]] = []
    need = np.maximum((times - 1) * q, shortest - q)  # agreeing symbols
    part = (need + 1) // 2  # so many on one side at least
    for left in (m - q, m):
        near = prefixes.equal(left, q, part) | prefixes.equal(left - part, q, part)
        for start, end, c in known:
            near &= (q % c != 0) | (left < start) | (left + q >= end)
        i, j, p, least = left[near], m[near], q[near], need[near]
        while len(i):
            _, at = np.unique(j, return_index=True)  # pairs of a middle come with rising periods
            a, c = i[at], p[at]
            start, end = a - prefixes.backward(a, c), a + c + prefixes.forward(a, c)
            good = end - start >= c + least[at]
            out += zip(start[good].tolist(), end[good].tolist(), c[good].tolist(), strict=True)
            # a multiple within a run gives the run again
            which = np.cumsum(np.isin(np.arange(len(j)), at)) - 1
            inside = (p % c[which] == 0) & (i >= start[which]) & (i + p < end[which])
            rest = ~inside
            rest[at] = False
            i, j, p, least = i[rest], j[rest], p[rest], least[rest]
    return out


def masked(hashes: np.ndarray, found: ts.Words, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in their document, or more."""
    start, first = ts.windows(found, k)
    covered = np.zeros(len(hashes), bool)
    if not len(start):
        return covered
    grams = ts.run_hashes(hashes, start, start + k)
    grams ^= np.repeat(ts.seeded(len(first) - 1, 11), np.diff(first))
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return covered
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    hit = start[twice[at] == grams]
    edge = np.zeros(len(hashes) + k, np.int8)  # first words of k-grams differ, so each edge counts once
    edge[hit] += 1
    edge[hit + k] -= 1
    return np.cumsum(edge[: len(hashes)], dtype=np.int32) > 0


def _segments(covered: np.ndarray, first: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """(first word, one past the last) of the covered stretches within a document that are long enough."""
    step = np.diff(covered.astype(np.int8), prepend=0, append=0)
    cuts = first[1:-1]
    start = np.union1d(np.flatnonzero(step > 0), cuts[(cuts < len(covered)) & np.append(covered, False)[cuts]])
    end = np.union1d(np.flatnonzero(step < 0), cuts[(cuts > 0) & np.append(covered, False)[cuts - 1]])
    return [(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True) if b - a >= shortest]


def _agree(texts: ts.Texts, found: ts.Words, a: int, b: int, n: int) -> bool:
    """Whether n words from a on are those from b on, letter for letter."""
    for at in range(0, n, 1 << 16):
        x, y = slice(a + at, a + min(n, at + (1 << 16))), slice(b + at, b + min(n, at + (1 << 16)))
        sizes = found.end[x] - found.start[x]
        if not np.array_equal(sizes, found.end[y] - found.start[y]):
            return False
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if not np.array_equal(texts.data[np.repeat(found.start[x], sizes) + within], texts.data[np.repeat(found.start[y], sizes) + within]):
            return False
    return True


def runs_of(texts: ts.Texts, found: ts.Words, shortest: int = 24, times: int = 3, hashes: np.ndarray | None = None) -> np.ndarray:
    """Rows (first word, one past the last, period) of the runs within the documents of a chunk, words counted over the chunk."""
    exact = hashes is not None
    hashes = ts.word_hashes(texts, found) if hashes is None else hashes
    parts = _segments(masked(hashes, found, overlap(shortest, times)), found.first, shortest)
    if not parts:
        return np.zeros((0, 3), np.int64)
    # one sequence, with symbols of their own between the segments
    between = ts.seeded(len(parts), 13)
    symbols = np.concatenate([x for (a, b), own in zip(parts, between, strict=True) for x in (hashes[a:b], [own])])
    sizes = np.array([b - a + 1 for a, b in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    rows = find_runs(symbols, int(sizes.max()) - 1, shortest, times)
    if len(rows):
        which = np.searchsorted(begin, rows[:, 0], side="right") - 1
        rows[:, :2] += (np.array([a for a, _ in parts], np.int64)[which] - begin[which])[:, None]
    sound = all(b <= found.first[np.searchsorted(found.first, a, side="right")] and _agree(texts, found, a, a + q, b - a - q) for a, b, q in rows.tolist())
    if sound or exact:
        return rows
    numbers: dict[bytes, int] = {}
    raw = texts.data.tobytes()
    exactly = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
    return runs_of(texts, found, shortest, times, ts.mix(np.array(exactly, _U)))


def _kept(rows: np.ndarray, n: int) -> np.ndarray:
    """Which words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _collapsed(texts: ts.Texts, found: ts.Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, kept words of each text): the kept words of each text, joined by one space."""
    words = np.concatenate([[0], np.cumsum(kept)])[found.first]
    start, end = found.start[kept], found.end[kept]
    size = end - start
    last = np.zeros(len(start), bool)
    last[words[1:][np.diff(words) > 0] - 1] = True
    edge = np.zeros(len(texts.data) + 2, np.int8)
    edge[start] += 1  # words and the byte after them lie apart
    stop = end + ~last
    np.add.at(edge, stop, -1)
    keep = np.cumsum(edge[: len(texts.data)], dtype=np.int8) > 0
    data = texts.data[keep]
    ends = np.cumsum(size + ~last)
    data[ends[~last] - 1] = 0x20
    offsets = np.concatenate([[0], ends])[words]
    return data, offsets, np.diff(words)


def collapse(docs: DataFrame, shortest: int = 24, times: int = 3, text: bool = True) -> DataFrame:
    """RUNS: the periodic runs of every row of docs (doc_id, text, ...) and its text without their repeats.

    Words are stretches outside [\\x20\\x09-\\x0D], numbered from 0.  A run is a
    stretch of at least max(shortest, times * period) words, period being its least
    one, that no neighbouring word extends with that period; runs come by start, then
    period.  kept_text joins, by one space, the words that no run contains after its
    first period; kept_sha256 is its SHA-256 in hexadecimal.  With text False
    kept_text is null, and no text leaves the worker.  A null or empty text has no
    words and the hash of nothing.  Rows without doc_id or with repeated ones are
    rows like others; other columns are ignored; no rows give none.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ts.chunks(batch.column(1)):
                yield _searched(batch.column(0).slice(texts.first_row, len(texts)), texts, shortest, times, text)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(ts.thrifty(run), RUNS)


def _searched(ids: pa.Array, texts: ts.Texts, shortest: int, times: int, text: bool) -> pa.RecordBatch:
    found = ts.words(texts)
    rows = runs_of(texts, found, shortest, times)
    data, offsets, n_kept = _collapsed(texts, found, _kept(rows, int(found.first[-1])))
    view = memoryview(np.ascontiguousarray(data))
    digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    of = np.searchsorted(found.first, rows[:, 0], side="right") - 1
    columns = [rows[:, 0] - found.first[of], rows[:, 1] - rows[:, 0], rows[:, 2]]
    runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), runs)
    if text:
        kept = pa.array([bytes(view[a:b]).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    else:
        kept = pa.nulls(len(texts), pa.string())
    columns = [ids, pa.array(found.counts, pa.int64()), lists, pa.array(n_kept, pa.int64()), kept, pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "n_kept", "kept_text", "kept_sha256"])
