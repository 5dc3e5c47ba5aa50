"""Toxicity by a support vector machine with a gapped subsequence string kernel.

Texts are split at white space into units; punctuation inside a unit is skipped,
and runs of single characters ("i d i o t") are joined to one unit more.  The
kernel of two units sums, over all subsequences of four characters (a mark at
either end counts as one), the product of decay ** gaps, so gaps and inserted
characters cost weight but still match.
Nystroem landmarks give the feature map, a squared-hinge machine is trained on
units of labelled texts (a toxic text is a bag in which some unit is toxic), and
a text's score is a logistic function of its units' three largest margins.

The feature space of the kernel is finite (characters fall into 64 classes,
subsequences are hashed into 2 ** 20 features), so a trained machine collapses to
one weight for each feature: scoring is a table lookup, equal to evaluating the
kernel against every landmark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm import textscan as ts
from lodestone.llm.sample import sampled_texts
from lodestone.llm.scratch import bound_batches

#: Subsequences are hashed into 2 ** BITS features.
BITS = 20
DECAY, MAX_SPAN = 0.7, 8
#: The class of the marks before and after a unit.
EDGE = 63
#: How many of a text's margins its score is made of.
TOP = 3
#: Longer units are scored in windows of this many characters, half overlapping.
LONGEST = 24
#: Longer texts are scored in pieces.
PIECE = 1_000_000
_SEAM, _BLANK = re.compile(r"[a-z]{2}\s(?=([a-z]{2}))", re.A | re.I), re.compile(r"\s")
_COMBOS: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}


def _classes() -> np.ndarray:
    """Class of each code point below 0x250: 0 skips, a-z 1-26, digits 27-36, other letters 37-62."""
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()[:1]
        if "a" <= ch <= "z":
            table[c] = ord(ch) - 96
        elif "0" <= ch <= "9":
            table[c] = ord(ch) - 48 + 27
        elif ch.isalpha():
            table[c] = 37 + ord(ch) * 7 % 26
    return table


CLASS_OF = _classes()


def combos(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(index quadruples (4, T), weights, norm) of the subsequences of a unit of n characters and its marks."""
    if n not in _COMBOS:
        n_all = n + 2
        found = [(i, j, k, m) for i in range(n_all) for j in range(i + 1, n_all) for k in range(j + 1, n_all) for m in range(k + 1, min(n_all, i + MAX_SPAN))]
        at = np.array(found, np.int64).reshape(-1, 4).T
        weight = DECAY ** (at[3] - at[0] - 3).astype(np.float64)
        _COMBOS[n] = (at, weight, float(np.sqrt((weight**2).sum())) or 1.0)
    return _COMBOS[n]


@dataclass
class Units:
    """Units of several texts as runs of classes: unit i is codes[start[i]:start[i] + length[i]] in text[i]."""

    codes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray


def units(texts: list[str | None]) -> Units:
    lowered = [(t or "").lower() for t in texts]
    joined = "\n".join(lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = np.minimum(points, 0x24F)
    codes = np.where(points < 0x250, CLASS_OF[near], 37 + (points % 26).astype(np.uint8)).astype(np.uint8)
    gap = (points <= 32) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x200A)) | (points == 0x2028) | (points == 0x3000)
    codes[gap] = 255
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    stays = codes != 0
    kept = codes[stays]
    row_end = np.cumsum(stays)[np.minimum(ends, len(stays)) - 1] if len(stays) else np.zeros(len(ends), np.int64)
    inside = kept != 255
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(close) + 1 - start
    text = np.searchsorted(row_end, start, side="right")
    # runs of four or more single characters
    single = (length == 1).astype(np.int8)
    edge = np.diff(np.concatenate(([0], single, [0])))
    extra, e_start, e_length, e_text, at = [], [], [], [], len(kept)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        for t in np.unique(text[a:b]) if b - a >= 4 else ():
            own = start[a:b][text[a:b] == t]
            if len(own) >= 4:
                extra.append(kept[own])
                e_start.append(at)
                e_length.append(len(own))
                e_text.append(t)
                at += len(own)
    if extra:
        kept = np.concatenate([kept, *extra])
        start, length, text = np.append(start, e_start), np.append(length, e_length), np.append(text, e_text)
    # windows of long units
    long = np.flatnonzero(length > LONGEST)
    if len(long):
        w_start, w_text = [], []
        for i in long:
            offsets = [*range(0, int(length[i]) - LONGEST, LONGEST // 2), int(length[i]) - LONGEST]
            w_start += [int(start[i]) + o for o in offsets]
            w_text += [int(text[i])] * len(offsets)
        short = length <= LONGEST
        start, length, text = np.append(start[short], w_start), np.append(length[short], np.full(len(w_start), LONGEST)), np.append(text[short], w_text)
    enough = length >= 3
    return Units(kept, start[enough].astype(np.int64), length[enough].astype(np.int64), text[enough].astype(np.int64))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut where two units of two characters or more meet.

    Where there is no such place within another PIECE, the cut falls after any
    white space, and where there is none of that, anywhere: a run of single
    characters, or a unit, that long is then scored in parts.
    """
    at = 0
    while len(text) - at > PIECE:
        cut = _SEAM.search(text, at + PIECE, at + 2 * PIECE)
        blank = None if cut else _BLANK.search(text, at + PIECE, at + 2 * PIECE)
        end = cut.start(1) if cut else blank.end() if blank else min(len(text), at + 2 * PIECE)
        yield text[at:end]
        at = end
    yield text[at:]


def unit_hashes(found: Units) -> np.ndarray:
    """A 64-bit hash of each unit's classes."""
    out = np.zeros(len(found.start), np.uint64)
    for n in np.unique(found.length):
        own = np.flatnonzero(found.length == n)
        h = np.full(len(own), np.uint64(n))
        for i in range(int(n)):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += ts.BYTE_VALUES[found.codes[found.start[own] + i]]
        out[own] = ts.mix(h)
    return out


def distinct(found: Units) -> tuple[np.ndarray, np.ndarray]:
    """(index of one unit of each kind, kind of each unit)."""
    _, one, kind = np.unique(unit_hashes(found), return_index=True, return_inverse=True)
    return one, kind


def keys_of(codes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The features of units of n characters."""
    at, _, _ = combos(n)
    c = np.full((len(start), n + 2), EDGE, np.uint32)
    c[:, 1:-1] = codes[start[:, None] + np.arange(n)]
    key = ((c[:, at[0]] * np.uint32(64) + c[:, at[1]]) * np.uint32(64) + c[:, at[2]]) * np.uint32(64) + c[:, at[3]]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Machine:
    """weight of each feature, bias, and the logistic function of a text's largest margins (its constant last)."""

    weight: np.ndarray
    bias: float
    logistic: np.ndarray

    def margins(self, found: Units) -> np.ndarray:
        """The margin of each unit."""
        one, kind = distinct(found)
        out = np.zeros(len(one), np.float32)
        length = found.length[one]
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            _, w, norm = combos(int(n))
            for k in range(0, len(own), 4_000):
                part = own[k : k + 4_000]
                out[part] = self.weight[keys_of(found.codes, found.start[one[part]], int(n))] @ (w / norm).astype(np.float32) + self.bias
        return out[kind]

    def text_margins(self, texts: list[str | None]) -> np.ndarray:
        """The TOP largest unit margins of each text, in -1.5 to 1.5; missing ones are -1.5."""
        if any(t and len(t) > PIECE for t in texts):  # the largest margins of a text are among those of its pieces
            out = np.full((len(texts), TOP), -1.5)
            for i, text in enumerate(texts):
                for piece in pieces(text or ""):
                    out[i] = -np.sort(-np.append(out[i], self._margins_of([piece])[0]))[:TOP]
            return out
        return self._margins_of(texts)

    def _margins_of(self, texts: list[str | None]) -> np.ndarray:
        found = units(texts)
        out = np.full((len(texts), TOP), -1.5)
        if len(found.start):
            margin = np.clip(self.margins(found), -1.5, 1.5)
            order = np.lexsort((-margin, found.text))
            text = found.text[order]
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            top = rank < TOP
            out[text[top], rank[top]] = margin[order[top]]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.text_margins(texts) @ self.logistic[:-1] + self.logistic[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(found: Units, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in index, keys, normalised weights) by length."""
    length = found.length[index]
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        _, w, norm = combos(int(n))
        yield own, keys_of(found.codes, found.start[index[own]], int(n)), w / norm


def kernel(found: Units, rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of units against landmarks, both given as indices of units."""
    parts = list(_features(found, landmarks))
    columns = np.unique(np.concatenate([k.ravel() for _, k, _ in parts]))
    table = np.zeros((len(columns) + 1, len(landmarks)), np.float32)
    for own, keys, w in parts:
        np.add.at(table, (np.searchsorted(columns, keys), own[:, None]), w[None, :].astype(np.float32))
    place = np.full(1 << BITS, len(columns), np.int32)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for own, keys, w in _features(found, rows):
        for k in range(0, len(own), 4096):
            at = place[keys[k : k + 4096]]
            sums = np.zeros((len(at), len(landmarks)), np.float32)
            for t, weight in enumerate(w.astype(np.float32)):
                sums += weight * table[at[:, t]]
            out[own[k : k + 4096]] = sums
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 12) -> np.ndarray:
    """Primal Newton for the squared hinge; the last column of x is the bias, not regularised much."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs = x[on] * np.sqrt(cost[on])[:, None]
        new = np.linalg.solve(ridge + xs.T @ xs, (x[on] * (cost[on] * y[on])[:, None]).sum(0))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _grams(codes: bytes) -> set[bytes]:
    return {codes[i : i + 4] for i in range(max(1, len(codes) - 3))}


def _tells(toxic: int, clean: int, n1: int, n0: int) -> float:
    """Signed root log-likelihood ratio of a count in n1 toxic and n0 clean texts; 0 or less if it tells of clean ones."""
    p, p1, p0 = (toxic + clean) / (n1 + n0), toxic / n1, clean / n0
    if p1 <= p0:
        return 0.0
    like = lambda k, n, q: (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)
    return math.sqrt(max(0.0, 2 * (like(toxic, n1, p1) + like(clean, n0, p0) - like(toxic, n1, p) - like(clean, n0, p))))


def _apart(texts: list[str | None], labels: list[int], minima: int = 8) -> list[int]:
    """Indices of texts that are no near copies of an earlier one of their class: a text whose copies abound would make all its words tell."""
    seen: set[tuple[int, int, int]] = set()
    found = units(texts)
    hashes = unit_hashes(found)
    order = np.argsort(found.text, kind="stable")
    edge = np.searchsorted(found.text[order], np.arange(len(texts) + 1))
    kept = []
    for t in range(len(texts)):
        own = hashes[order[edge[t] : edge[t + 1]]]
        if len(own) > 2:
            own = ts.mix(own[:-2] + own[1:-1] * np.uint64(3) + own[2:] * np.uint64(7))
        marks = {(labels[t], k, int((own * (s | np.uint64(1))).min())) for k, s in enumerate(ts.seeded(minima, 23))} if len(own) else set()
        if len(seen & marks) < 2:
            kept.append(t)
        seen |= marks
    return kept


def train(texts: list[str | None], labels: list[int], landmarks: int = 360, rounds: int = 4, sure: float = 4.0, seed: int = 5) -> Machine:
    """Fit on labelled texts: 1 toxic, 0 not.  With one class only, the machine gives that class's constant.

    Which unit of a toxic text is toxic is not labelled.  Training begins with the
    units, and where a text has none, with the 4-grams, whose counts tell most of
    toxic texts (``sure`` root log-likelihood ratio at least; a text without any is
    taken for a wrong label), and lets the bags choose anew in each round.  Where
    labels are too few or too varied for any to reach ``sure``, it is lowered until
    some unit does.  Where no unit tells of toxic texts at all, no text is toxic.
    """
    kept = _apart(texts, labels)
    texts, labels = [texts[t] for t in kept], [labels[t] for t in kept]
    # a quarter of the texts stays out of training: only there do clean texts show how high unseen units reach
    apart = [k for c in (0, 1) for k in [t for t in range(len(texts)) if labels[t] == c][3::4]]
    aside, aside_labels = [texts[t] for t in apart], np.array([labels[t] for t in apart], np.int64)
    if min(np.bincount(aside_labels, minlength=2), default=0) < 15:
        aside, aside_labels = texts, np.asarray(labels)
    else:
        rest = sorted(set(range(len(texts))) - set(apart))
        texts, labels = [texts[t] for t in rest], [labels[t] for t in rest]
    y_text = np.asarray(labels)
    found = units(texts)
    none = Machine(np.zeros(1 << BITS, np.float32), 0.0, np.array([0.0] * TOP + [-9.0 if not y_text.any() else 9.0]))
    if not y_text.any() or y_text.all():
        return none
    harmless = Machine(none.weight, 0.0, np.array([0.0] * TOP + [-9.0]))
    if not len(found.start):
        return harmless
    one, kind = distinct(found)
    names = [found.codes[found.start[i] : found.start[i] + found.length[i]].tobytes() for i in one]
    pairs = np.stack(np.divmod(np.unique(found.text * len(one) + kind), len(one)))
    n1, n0 = int(y_text.sum()), int(len(y_text) - y_text.sum())
    is_toxic = y_text[pairs[0]] == 1
    in_toxic, in_clean = (np.bincount(pairs[1, m], minlength=len(one)) for m in (is_toxic, ~is_toxic))
    bags = [np.array(pairs[1, np.searchsorted(pairs[0], t) : np.searchsorted(pairs[0], t + 1)]) for t in range(len(texts))]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for t, own in enumerate(bags):
        seen[int(y_text[t])].update(set().union(*(_grams(names[k]) for k in own)) if len(own) else ())
    tells = np.array([_tells(int(a), int(b), n1, n0) for a, b in zip(in_toxic, in_clean)])
    for level, times in ((sure, 4), (sure / 2, 4), (sure / 4, 4), (1e-9, 4), (1e-9, 1)):
        ratio = in_toxic / n1 > times * in_clean / n0
        positive = {int(k) for k in np.flatnonzero(ratio & (in_toxic >= 2) & (tells >= level))}
        gram = {k: max(_tells(seen[1][g], seen[0][g], n1, n0) for g in _grams(names[k])) for t in np.flatnonzero(y_text == 1) for k in map(int, bags[t]) if ratio[k]}
        toxic_bags = [[int(k) for k in bags[t] if ratio[k]] for t in np.flatnonzero(y_text == 1)]
        for b in toxic_bags:
            if b and not positive.intersection(b) and gram[best := max(b, key=gram.__getitem__)] >= level:
                # of few labels many units tell alike, and which of them is toxic is not known
                positive |= {best} if level == sure else {k for k in b if gram[k] == gram[best]}
        if positive:
            break
    else:
        return harmless
    rng = np.random.default_rng(seed)
    clean = np.array([k for k in np.flatnonzero(in_clean) if not ratio[k]])
    negative = set(map(int, rng.choice(clean, min(len(clean), 6000), replace=False)))
    machine = none
    for _ in range(rounds):
        pos, neg = np.array(sorted(positive)), np.array(sorted(negative - positive))
        marks = np.unique(np.concatenate([rng.choice(pos, min(len(pos), landmarks // 2), replace=False), rng.choice(neg, min(len(neg), landmarks // 2), replace=False)]))
        base = kernel(found, one[marks], one[marks]).astype(np.float64)
        value, vector = np.linalg.eigh(base)
        good = value > 1e-4 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        rows = np.concatenate([pos, neg])
        x = kernel(found, one[rows], one[marks]).astype(np.float64) @ root
        x = np.hstack([x, np.ones((len(rows), 1))])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        cost = np.where(y > 0, 10.0 * max(1.0, len(neg) / len(pos) / 8), 10.0)
        w = _machine(x, y, cost)
        beta = root @ w[:-1]
        weight = np.zeros(1 << BITS)
        for own, keys, wt in _features(found, one[marks]):
            np.add.at(weight, keys, beta[own][:, None] * wt[None, :])
        machine = Machine(weight.astype(np.float32), float(w[-1]), none.logistic)
        margin = np.zeros(len(one))
        margin[kind] = machine.margins(found)
        # bags choose anew; what clean texts have near or above the margin joins the negatives
        positive |= {k for b in toxic_bags for k in b if margin[k] > 0.3 and gram[k] >= 1.5 * level}
        hard = clean[np.argsort(-margin[clean])[:4000]]
        negative |= set(map(int, hard[margin[hard] > -0.8]))
    x = np.hstack([machine.text_margins(aside), np.ones((len(aside), 1))])
    if level == sure:
        return Machine(machine.weight, machine.bias, _logistic(x, aside_labels))
    # margins that tell little leave the decision to the shares of the labels: toxic texts count no more than clean ones
    logistic = _logistic(x, aside_labels, share=np.where(aside_labels == 1, min(1.0, (aside_labels == 0).sum() / (aside_labels == 1).sum()), 1.0))
    return Machine(machine.weight, machine.bias, logistic) if logistic[:-1].any() else harmless


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30, share: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; only the last column, the constant, may get a negative weight.  share is how much each row counts."""
    w = np.zeros(x.shape[1])
    share = np.ones(len(x)) if share is None else share
    for _ in range(steps):
        if (w[:-1] < 0).any():
            used = np.append(w[:-1] >= 0, True)
            w = np.zeros(x.shape[1])
            w[used] = _logistic(x[:, used], y, ridge, steps, share)
            return w
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (y - p)) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


def fit(docs: DataFrame, labels: DataFrame, training: str = "true", max_rows: int = 1500) -> Machine:
    """A machine from labels (doc_id, toxic) and the texts of docs; max_rows bounds the rows of each class that the driver fits on.

    training is an SQL condition on the ids to learn from.  Labels that are null,
    have no doc_id or name no document teach nothing; an id that is labelled both
    ways counts in both classes; a null text is one without units.  Without any
    labelled text, or with one class only, every text gets that class's constant.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL").distinct()
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(training).join(known, "doc_id")
    rows = sampled_texts(docs, labelled, "toxic", [0, 1], max_rows)
    machine = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    del rows
    ts.release()  # the kernel's matrices
    return machine


def score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """docs with column, a double from 0 to 1: every row, whole texts; null and unitless texts score near 0.

    A column of that name in docs is replaced; all others stay.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2 ** BITS weights whatever the corpus
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ts.chunks(batch.column(at)):
                part = batch.slice(texts.first_row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(at).to_pylist()))], names=[*part.schema.names, column])

    return docs.mapInArrow(ts.thrifty(run), StructType([*docs.schema.fields, StructField(column, DoubleType())]))
