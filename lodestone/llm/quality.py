"""Text quality by weak supervision.

Overlapping heuristic labellers vote good, bad or nothing on each text.
Expectation-maximisation over the counts of vote patterns (all texts; the
patterns are bounded by 3 ** labellers) estimates each labeller's accuracy on
good and on bad texts and the share of good ones.  The posteriors label a bounded
sample of texts, on which a hashed linear scorer is trained; it scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm import textscan as ts
from lodestone.llm.sample import sampled_texts
from lodestone.llm.scratch import bound_batches

#: Hashed features: byte-class trigrams, then statistics by bucket.
DIMS = 4096
#: Texts, and bytes, whose trigrams are counted at once.
ROWS, PIECE = 250, 1 << 20
LABELLERS = ("symbols", "shouting", "table", "echo", "variety", "word_length", "stops", "line_repeats")
GOOD, BAD, NONE = "1", "0", "-"

_KIND = np.zeros(256, np.uint8)  # classes of bytes, 5 bits
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x20] = 4
_KIND[[0x0A, 0x0D]] = 5
_KIND[0x80:] = 6
for _k, _c in enumerate(b".,;:!?'\"()[]{}|#$%&*@_-+=/\\<>~^`"):
    _KIND[_c] = 7 + _k % 25
LETTER, UPPER, OTHER = (np.isin(_KIND, k) for k in ((1, 2, 6), (2,), range(7, 32)))


@dataclass
class Signals:
    """Statistics of each text, all as float arrays."""

    n_words: np.ndarray
    symbol_share: np.ndarray
    upper_share: np.ndarray
    pipe_share: np.ndarray
    echo_share: np.ndarray
    variety: np.ndarray
    word_length: np.ndarray
    stop_share: np.ndarray
    line_repeat: np.ndarray


def signals(texts: ts.Texts) -> Signals:
    n = len(texts)
    found = ts.words(texts)
    hashes = ts.word_hashes(texts, found, ts.LOWER)
    words = found.counts
    some = np.maximum(words, 1)
    size = np.diff(texts.offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]).astype(float)

    letters, upper = per_text(LETTER[texts.data]), per_text(UPPER[texts.data])
    symbols = per_text(OTHER[texts.data] & ~np.isin(texts.data, np.frombuffer(b".,;:'\"?()-", np.uint8)))
    doc = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pipe = np.zeros(len(hashes), bool)
    pipe[:] = (texts.data[found.start] == 0x7C) & (found.end - found.start == 1)
    distinct = np.fromiter((len(np.unique(hashes[found.first[i] : found.first[i + 1]])) for i in range(n)), float, n)
    length = (found.end - found.start).astype(float)
    stop = (length >= 2) & (length <= 3)
    count = lambda flags: np.bincount(doc, flags, n) if len(doc) else np.zeros(n)
    lines = ts.words(texts, _NEWLINE)
    line_hash = ts.word_hashes(texts, lines)
    line_kinds = np.fromiter((len(np.unique(line_hash[lines.first[i] : lines.first[i + 1]])) for i in range(n)), float, n)
    return Signals(words.astype(float), symbols / np.maximum(size, 1), upper / np.maximum(letters, 1), count(pipe) / some, count(same) / some, distinct / np.sqrt(some), count(length) / some, count(stop) / some, 1 - line_kinds / np.maximum(lines.counts, 1))


_NEWLINE = np.zeros(256, bool)
_NEWLINE[[0x0A, 0x0D]] = True


def votes(s: Signals) -> np.ndarray:
    """(texts, labellers) of 1 good, 0 bad, -1 no vote; a text without words gets no vote but ``variety`` bad."""
    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    some = s.n_words > 0
    return np.stack(
        [
            vote(s.symbol_share > 0.04, some & (s.symbol_share < 0.01)),
            vote(s.upper_share > 0.4, some & (s.upper_share < 0.15)),
            vote(s.pipe_share > 0.1, some & (s.pipe_share == 0) & (s.n_words > 30)),
            vote(s.echo_share > 0.1, some & (s.echo_share < 0.05)),
            vote(~some | ((s.n_words > 30) & (s.variety < 2)), s.variety > 5),
            vote((s.n_words > 10) & ((s.word_length < 2.5) | (s.word_length > 14)), (s.word_length > 3.5) & (s.word_length < 9)),
            vote((s.n_words > 50) & (s.stop_share < 0.05), s.stop_share > 0.15),
            vote((s.n_words > 100) & (s.line_repeat > 0.5), (s.n_words > 30) & (s.line_repeat < 0.1)),
        ],
        axis=1,
    ).astype(np.int8)


def _trigrams(data: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, DIMS) counts of the hashed byte-class trigrams that lie within one text; doc names the text of each byte."""
    kinds = _KIND[data].astype(np.uint32)
    key = (((kinds[:-2] << 10) | (kinds[1:-1] << 5) | kinds[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    whole = doc[:-2] == doc[2:]
    return np.bincount(doc[:-2][whole] * DIMS + key[whole], minlength=n * DIMS).reshape(n, DIMS)


def features(texts: ts.Texts, s: Signals) -> np.ndarray:
    """(texts, DIMS) float32: square roots of byte-class trigram shares, and one-hot buckets of the statistics."""
    n = len(texts)
    out = np.zeros((n, DIMS), np.float32)
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        start, end = int(texts.offsets[a]), int(texts.offsets[b])
        if b - a > 1:  # a chunk of several texts is no longer than a piece
            out[a:b] += _trigrams(texts.data[start:end], np.repeat(np.arange(b - a), np.diff(texts.offsets[a : b + 1])), b - a)
            continue
        for p in range(start, end - 2, PIECE):  # a piece ends with the two bytes that its last trigrams run into
            part = texts.data[p : min(p + PIECE + 2, end)]
            out[a] += _trigrams(part, np.zeros(len(part), np.int64), 1)[0]
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
    np.sqrt(out, out=out)
    for k, (value, edges) in enumerate(
        ((s.n_words, (1, 5, 20, 80, 320, 1280)), (s.echo_share, (0.01, 0.05, 0.1, 0.3)), (s.variety, (1, 2, 4, 8, 16)), (s.pipe_share, (0.001, 0.05, 0.2)), (s.upper_share, (0.05, 0.2, 0.4, 0.7)), (s.line_repeat, (0.05, 0.2, 0.5)))
    ):
        bucket = np.digitize(value, edges)
        slot = ((np.uint32(k) * np.uint32(64) + bucket.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)) >> np.uint32(20)
        out[np.arange(n), slot] += 0.5
    return out


@dataclass
class LabelModel:
    """Latent classes: good texts first, then a way of being bad for each labeller that may see it alone.

    share[class], and likelihood[labeller, class, vote]: of the votes cast, bad and good; the third column stays unused.
    """

    share: np.ndarray
    likelihood: np.ndarray

    def classes(self, pattern: np.ndarray) -> np.ndarray:
        """(rows, classes) probabilities for rows of votes."""
        at = np.where(pattern < 0, 2, pattern)
        logs = np.log(self.likelihood)
        logs[:, :, 2] = 0  # no vote tells nothing: a short text gets few
        joint = np.log(self.share)[None, :] + sum(logs[j][:, at[:, j]].T for j in range(at.shape[1]))
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        return joint / joint.sum(axis=1, keepdims=True)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        return self.classes(pattern)[:, 0]

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """For each labeller, P(right | voted) on bad and on good texts."""
        bad = np.einsum("c,jcv->jv", self.share[1:], self.likelihood[:, 1:])
        good = self.likelihood[:, 0]
        return {name: (float(bad[j, 0] / bad[j, :2].sum()), float(good[j, 1] / good[j, :2].sum())) for j, name in enumerate(LABELLERS)}


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often each occurs.

    Labellers see different faults and contradict each other on most bad texts, so
    two classes would average the rare faults away; each labeller starts a class.
    """
    n = patterns.shape[1]
    start = np.tile(np.array([0.04, 0.96, 1.0]), (n, n + 1, 1))
    start[:, 1:, :2] = (0.2, 0.8)
    for j in range(n):
        start[j, j + 1, :2] = (0.95, 0.05)
    share = np.array([0.8] + [0.2 / n] * n)
    model = LabelModel(share, start)
    if not len(patterns):
        return model
    total = counts.sum()
    for _ in range(rounds):
        weight = counts[:, None] * model.classes(patterns)
        new = np.ones_like(start)
        for vote in (0, 1):
            new[:, :, vote] = ((patterns == vote).T @ weight) + start[:, :, vote] * (1 + 0.002 * total)
        new[:, :, :2] /= new[:, :, :2].sum(axis=2, keepdims=True)
        done = np.abs(new - model.likelihood).max() < 1e-6
        model = LabelModel((weight.sum(axis=0) + share) / (total + 1), new)
        if done:
            break
    return model


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def scores(self, texts: ts.Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, signals(texts)) @ self.weight + self.bias, -30, 30)))


def train(texts: list[str | None], posterior: np.ndarray, steps: int = 300) -> Scorer:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    column = pa.array(texts, pa.large_string())
    x = np.concatenate([features(part, signals(part)) for part in ts.chunks(column)]) if len(texts) else np.zeros((0, DIMS), np.float32)
    w, b, vw, vb = np.zeros(DIMS, np.float32), 0.0, np.zeros(DIMS, np.float32), 0.0
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - posterior) / len(x)
        vw, vb = 0.9 * vw - 3.0 * (x.T @ g.astype(np.float32) + 1e-5 * w), 0.9 * vb - 1.0 * g.sum()
        w, b = w + vw, b + vb
    return Scorer(w.astype(np.float32), float(b))


def vote_patterns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with votes: a character 1, 0 or - for each labeller; whole texts, null as empty.

    A column votes in docs is replaced; all others stay.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("votes")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array([GOOD, BAD, NONE])[[1, 0, 2]]
        for batch in batches:
            for texts in ts.chunks(batch.column(at), 1_000_000):
                v = votes(signals(texts))
                part = batch.slice(texts.first_row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(["".join(letters[r]) for r in v], pa.string())], names=[*part.schema.names, "votes"])

    return docs.mapInArrow(ts.thrifty(run), StructType([*docs.schema.fields, StructField("votes", StringType())]))


def parse(patterns: list[str]) -> np.ndarray:
    value = {GOOD: 1, BAD: 0, NONE: -1}
    return np.array([[value[c] for c in p] for p in patterns], np.int8).reshape(-1, len(LABELLERS))


def fit(docs: DataFrame, max_rows: int = 4000) -> tuple[LabelModel, Scorer]:
    """Accuracies from the votes on all of docs, and a scorer from at most max_rows texts, least hash of doc_id first.

    Rows without doc_id vote, but are not in the sample; a null text votes as an
    empty one.  Without rows the accuracies are the starting ones and every text
    scores 0.5.
    """
    voted = vote_patterns(docs.select("doc_id", "text"))
    counted = voted.groupBy("votes").count().collect()  # at most 3 ** labellers rows
    model = estimate(parse([r["votes"] for r in counted]), np.array([r["count"] for r in counted], float))
    sample = sampled_texts(docs, docs.select("doc_id", F.lit(1).alias("any")), "any", [1], max_rows)
    texts = [r["text"] for r in sample]
    column = pa.array(texts, pa.large_string())
    own = np.concatenate([votes(signals(p)) for p in ts.chunks(column)]) if texts else np.zeros((0, len(LABELLERS)), np.int8)
    scorer = train(texts, model.posterior(own) if len(own) else np.zeros(0))
    del sample, texts, column, own
    ts.release()
    return model, scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with score double (0 to 1, higher is better): every row, whole texts; null scores as empty.

    A column score in docs is replaced; all others stay.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # DIMS weights
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ts.chunks(batch.column(at), 1_000_000):
                part = batch.slice(texts.first_row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(texts).astype(float))], names=[*part.schema.names, "score"])

    return docs.mapInArrow(ts.thrifty(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
