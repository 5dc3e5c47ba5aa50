"""Language identification by error-correcting output codes.

Each language has a binary codeword.  For each bit a linear classifier over byte
n-grams (2 and 3 bytes; A-Z lower-cased, everything but letters one gap) predicts
the bit of a text's language.  Decoding is loss-weighted: a language's loss sums,
over the bits, the logistic loss of its codeword bit under the classifier's
margin, weighted by how well the classifier does in training; the least loss
wins, and a text whose two least losses are close is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lodestone.llm import textscan as ts
from lodestone.llm.sample import sampled_texts
from lodestone.llm.scratch import bound_batches

BIGRAMS, TRIGRAM_BITS = 1 << 16, 17
#: Index of n-grams that count for nothing: those that would run into the next text.
NOTHING = BIGRAMS + (1 << TRIGRAM_BITS)
UNKNOWN = "und"
#: Bytes of a very long text that are looked up at once.
PIECE = 400_000
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """An n-row matrix of -1 and 1: all distinct dichotomies up to 5 languages, else random ones far apart."""
    if n <= 5:
        found = [c for c in product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(found, np.int8).T if n > 1 else np.ones((1, 1), np.int8)
    rng, bits = np.random.default_rng(seed), max(15, int(10 * np.log2(n)))
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(200)]
    return max(tries, key=lambda c: min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)))


def features(texts: ts.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram index at each byte for 2 and for 3 bytes)."""
    data = _FOLD[texts.data].astype(np.uint32)
    n = len(data)
    two, three = np.full(n, NOTHING, np.uint32), np.full(n, NOTHING, np.uint32)
    two[:-1] = data[:-1] * 256 + data[1:]
    if n > 2:
        key = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        three[:-2] = ((key * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)) + BIGRAMS
    ends = texts.offsets[1:][np.diff(texts.offsets) > 0]
    two[ends - 1] = three[ends - 1] = NOTHING
    before = ends - 2
    three[before[before >= 0]] = NOTHING
    return two, three


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    slope: np.ndarray
    trust: np.ndarray
    prior: np.ndarray

    def margins(self, texts: ts.Texts) -> np.ndarray:
        """Each text's mean n-gram weight for each bit."""
        sums = np.zeros((len(texts), self.code.shape[1]))
        filled = np.flatnonzero(np.diff(texts.offsets) > 0)
        if len(texts) == 1 and len(texts.data) > PIECE:  # a very long text by pieces, each with the two bytes that its last n-grams run into
            for a in range(0, len(texts.data), PIECE):
                data = texts.data[a : a + PIECE + 2]
                for index in features(ts.Texts(data, np.array([0, len(data)]), 0)):
                    sums[0] += self.weight[index[:PIECE]].sum(axis=0, dtype=np.float64)
        elif len(filled):
            heads = texts.offsets[:-1][filled]
            for index in features(texts):
                sums[filled] += np.add.reduceat(self.weight[index], heads, axis=0)
        return sums / np.maximum(2 * np.diff(texts.offsets), 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, second-best score) of each row."""
        z = margins * self.slope
        loss = np.logaddexp(0, -self.code[None, :, :] * z[:, None, :]) @ self.trust - self.prior[None, :]
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ranked = np.sort(p, axis=1)
        second = ranked[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, ranked[:, -1], second


def train(texts: list[str], languages: list[str]) -> Model | None:
    """Fit on labelled texts; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    column = pa.array(texts, pa.large_string())
    y = np.array([names.index(g) for g in languages])
    counts = np.zeros((len(names), NOTHING + 1))
    for part in ts.chunks(column):
        for index in features(part):
            size = np.diff(part.offsets)
            # a long text counts for no more than a short one, beyond 2,000 bytes
            value = np.repeat(1 / np.maximum(size / 2000, 1), size)
            label = np.repeat(y[part.first_row : part.first_row + len(part)], size)
            counts += np.bincount(label * (NOTHING + 1) + index, value, len(names) * (NOTHING + 1)).reshape(len(names), -1)
    counts[:, NOTHING] = 0
    share = (counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * NOTHING)
    code = codewords(len(names))
    weight = np.zeros((NOTHING + 1, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        groups = [share[code[:, b] == v] for v in (1, -1)]
        if all(len(g) for g in groups):
            weight[:, b] = np.log(groups[0].mean(axis=0)) - np.log(groups[1].mean(axis=0))
    weight[NOTHING] = 0
    model = Model(names, code, weight, np.ones(code.shape[1]), np.ones(code.shape[1]), np.zeros(len(names)))
    margins = np.concatenate([model.margins(part) for part in ts.chunks(column)])
    for b in range(code.shape[1]):
        sign = code[y, b].astype(float)
        slope = 1.0
        for _ in range(40):  # one-dimensional logistic regression
            z = np.clip(slope * margins[:, b] * sign, -30, 30)
            p = 1 / (1 + np.exp(z))
            grad, curve = (p * margins[:, b] * sign).sum() - 0.01 * slope, (p * (1 - p) * margins[:, b] ** 2).sum() + 0.01
            slope = min(max(slope + min(max(grad / curve, -5), 5), 0.1), 60.0)
        model.slope[b] = slope
        error = (margins[:, b] * sign <= 0).mean()
        model.trust[b] = max(0.05, 1 - 2 * error)
    model.trust /= model.trust.sum() / max(1.0, code.shape[1] / 2)
    return model


def fit(docs: DataFrame, training: str = "true", max_rows: int = 1500) -> Model | None:
    """A model from docs (doc_id, text, lang); training is an SQL condition, max_rows bounds each language's sample, least hash first.

    Rows without lang, doc_id or text teach nothing; an id that has several
    languages counts in each.  Without anything to learn from there is no model.
    """
    rows = docs.filter(training).filter("lang IS NOT NULL")
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())  # a row for each language
    sample = [r for r in sampled_texts(docs, rows, "lang", names, max_rows) if r["text"]]
    model = train([r["text"] for r in sample], [r["lang"] for r in sample])
    del sample
    ts.release()
    return model


def _has_letter(text: str | None) -> bool:
    return text is not None and next(filter(str.isalpha, text), None) is not None


def predict(docs: DataFrame, model: Model | None, close: float = 0.25) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous: every row, whole texts.

    A text that is null or has no letter gets ``und`` with score 0; so does
    everything where there was nothing to learn from.  ambiguous: the second
    language's score is within ``close`` of the first's.  Columns of these names in
    docs are replaced; all others stay.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the n-gram tables
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for texts in ts.chunks(batch.column(at), PIECE):
                part = batch.slice(texts.first_row, len(texts))
                lettered = np.fromiter((model is not None and _has_letter(t) for t in part.column(at).to_pylist()), bool, len(texts))
                name, score, unsure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if lettered.any():
                    best, first, second = model.decode(model.margins(texts))
                    name[lettered] = np.array(model.languages, object)[best][lettered]
                    score[lettered], unsure[lettered] = first[lettered], (first - second < close)[lettered]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(name, pa.string()), pa.array(score), pa.array(unsure)], names=[*part.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(ts.thrifty(run), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]))
