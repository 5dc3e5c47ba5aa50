"""Hard-negative mining: blocked dense products of anchors against all rows, in two passes.

Anchors are a stated query set.  They are taken in rounds of a bounded size; a
round's matrix is broadcast, and each task multiplies its rows with it, block by
block, in float64, which is exact for integers below 2**53.  The first pass keeps
the best rows of an anchor's own label, the second the best rows of other labels
within a window below each of those scores.  A task keeps one short list for each
anchor whatever it reads, and lists merge, so what is shuffled is a list for each
anchor and task; no pair of rows is ever a row of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from lodestone.llm import textscan as ts
from lodestone.llm.scratch import Scratch

NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LISTED = "anchor_id long, slot int, vec_id long, score long"
#: Bytes of anchors' vectors that are collected and broadcast at once.
ROUND_BYTES = 16 << 20
#: Anchors and rows of a block; its products take 8 bytes each.
ANCHOR_ROWS, BLOCK_ROWS = 512, 1024
_NONE, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Rows:
    """ids, labels and vectors of rows; vectors hold integers as float64."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, start: int, size: int) -> Rows:
        at = slice(start, start + size)
        return Rows(self.ids[at], self.labels[at], self.vectors[at])


def _rows(batch: pa.RecordBatch | pa.Table, scale: float) -> Rows:
    """Rows of (vec_id, label, embedding); shorter vectors are filled up with zeros."""
    ids, labels, vectors = (ts.as_array(batch.column(k)) for k in range(3))
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    sizes = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        matrix = flat.reshape(len(vectors), width)
    else:
        matrix = np.zeros((len(vectors), width))
        matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return Rows(np.asarray(ids).astype(np.int64), np.asarray(labels).astype(np.int64), np.floor(scale * matrix))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of a with those of b, as 64-bit integers; beyond their range the nearest one."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    limit = math.isqrt((1 << 53) // max(width, 1))
    wide_a, wide_b = (np.flatnonzero(np.abs(x).max(axis=1, initial=0) > limit) for x in (a, b))
    if not len(wide_a) and not len(wide_b):
        return (a @ b.T).astype(np.int64)
    narrow_a, narrow_b = a.copy(), b.copy()
    narrow_a[wide_a], narrow_b[wide_b] = 0, 0
    out = (narrow_a @ narrow_b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    bounded = lambda x: np.clip(x, _NONE + 1, _NO_ID).astype(np.int64)
    if len(wide_a):
        out[wide_a] = bounded(whole(a[wide_a]) @ whole(b).T)
    if len(wide_b):
        out[:, wide_b] = bounded(whole(a) @ whole(b[wide_b]).T)
    return out


class Best:
    """The k best (score, id) of each of n lists, ties to the smaller id, an id once."""

    def __init__(self, n: int, k: int) -> None:
        self.scores = np.full((n, k), _NONE, np.int64)
        self.ids = np.full((n, k), _NO_ID, np.int64)

    def offer(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores[i, j] of ids[j], where allowed, to list first + i."""
        at = slice(first, first + len(scores))
        worst, worst_id = self.scores[at, -1], self.ids[at, -1]
        row, column = np.nonzero(allowed & (scores >= worst[:, None]))
        score, own = scores[row, column], ids[column]
        better = (score > worst[row]) | (own < worst_id[row])
        row, score, own = row[better], score[better], own[better]
        if not len(row):
            return
        lists, k = np.unique(row), self.scores.shape[1]
        row = np.concatenate([np.repeat(lists, k), row])
        score = np.concatenate([self.scores[at][lists].ravel(), score])
        own = np.concatenate([self.ids[at][lists].ravel(), own])
        order = np.lexsort((~score, own, row))  # ~x falls as x rises, for all x
        row, score, own = row[order], score[order], own[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1]) | (own[1:] == _NO_ID)
        row, score, own = row[once], score[once], own[once]
        order = np.lexsort((own, ~score, row))
        row, score, own = row[order], score[order], own[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        self.scores[first + row[top], rank[top]] = score[top]
        self.ids[first + row[top], rank[top]] = own[top]

    def batch(self, anchor_ids: np.ndarray, slot: int) -> pa.RecordBatch:
        n, k = self.ids.shape
        held = (self.ids != _NO_ID).ravel()
        anchor = np.repeat(anchor_ids, k)[held]
        columns = [pa.array(anchor), pa.array(np.full(len(anchor), slot, np.int32)), pa.array(self.ids.ravel()[held]), pa.array(self.scores.ravel()[held])]
        return pa.RecordBatch.from_arrays(columns, names=["anchor_id", "slot", "vec_id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], anchors: Rows, scale: float) -> Iterator[tuple[int, Rows, Rows, np.ndarray]]:
    """(first anchor, anchors, rows, their products) of each block."""
    for batch in batches:
        rows = _rows(batch, scale)
        for at in range(0, len(rows), BLOCK_ROWS):
            block = rows.part(at, BLOCK_ROWS)
            for first in range(0, len(anchors), ANCHOR_ROWS):
                some = anchors.part(first, ANCHOR_ROWS)
                yield first, some, block, products(some.vectors, block.vectors)


def _nearest_alike(shared, scale: float, k: int):
    """For mapInArrow: the best k rows of each anchor's label, but for the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = Best(len(anchors), k)
        for first, some, block, scores in _blocks(batches, anchors, scale):
            best.offer(first, scores, (some.labels[:, None] == block.labels) & (some.ids[:, None] != block.ids), block.ids)
        yield best.batch(anchors.ids, 0)

    return run


def _nearest_others(shared, scale: float, k: int):
    """For mapInArrow: of each anchor and slot, the best k rows of other labels within [low, high]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = shared.value
        slots = [Best(len(anchors), k) for _ in range(low.shape[1])]
        for first, some, block, scores in _blocks(batches, anchors, scale):
            other = (some.labels[:, None] != block.labels) & (some.ids[:, None] != block.ids)
            for s, best in enumerate(slots):
                a, b = low[first : first + len(some), s], high[first : first + len(some), s]
                if (a <= b).any():
                    best.offer(first, scores, other & (scores >= a[:, None]) & (scores <= b[:, None]), block.ids)
        for s, best in enumerate(slots):
            yield best.batch(anchors.ids, s)

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The best k of all tasks' lists, with rank."""
    once = lists.repartition("anchor_id").groupBy("anchor_id", "slot", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 1.0, scratch: Scratch | None = None, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """NEGATIVES: for each anchor and each of its positives, the best negatives below the positive's score.

    vectors has vec_id, label (integers) and embedding (an array of numbers), of which
    components x are taken as floor(scale * x); a score is the inner product with the
    anchor, higher ones first, ties by smaller vec_id.  Positives are an anchor's first
    ``positives`` rows of its label, negatives the first ``negatives`` of other labels
    with low * positive score <= 100 * score <= high * positive score.  Rows with a
    null vec_id, label or embedding, or with a component that is null or not finite,
    take no part.  Vectors that are shorter than others count as filled up with zeros.
    Rows that share a vec_id: an anchor is the least of them by (label, embedding),
    none is its own anchor's positive or negative, and in a list the best one counts.
    Products are exact up to 64 bits.  Other columns are ignored; no rows or anchors
    give no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    embedding = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), embedding.alias("embedding"), is_anchor.alias("is_anchor"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = scratch.save(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite), "rows")
    known = rows.filter("is_anchor").agg(F.count_distinct("vec_id").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not known["n"]:
        return spark.createDataFrame([], NEGATIVES)
    rounds = math.ceil(known["n"] * (8 * known["width"] + 16) / round_bytes)
    anchors = rows.filter("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("own")).select("vec_id", "own.*", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).alias("round"))
    anchors = scratch.save(anchors, "anchors")
    rows = rows.drop("is_anchor")
    for k in range(rounds):
        own = _rows(anchors.filter(F.col("round") == k).drop("round").toArrow(), scale)
        alike = rows.mapInArrow(ts.thrifty(_nearest_alike(spark.sparkContext.broadcast(own), scale, positives)), _LISTED)
        found = scratch.save(_merged(alike, positives), f"positives-{k}", like=anchors)
        bounds = _windows(own, found.toArrow(), positives, low, high)
        others = rows.mapInArrow(ts.thrifty(_nearest_others(spark.sparkContext.broadcast((own, *bounds)), scale, negatives)), _LISTED)
        slots = found.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        chosen = _merged(others, negatives).join(slots, ["anchor_id", "slot"])
        chosen = chosen.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        scratch.save(chosen, f"negatives-{k}", like=anchors)
    return scratch.read("negatives-*", NEGATIVES)


def _windows(anchors: Rows, found: pa.Table, slots: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of negatives by anchor and slot; where there is no positive, none fits."""
    least, most = np.full((len(anchors), slots), _NO_ID), np.full((len(anchors), slots), _NONE)
    order = np.argsort(anchors.ids)
    at = order[np.searchsorted(anchors.ids, np.asarray(found["anchor_id"]), sorter=order)]
    for a, rank, score in zip(at.tolist(), found["rank"].to_pylist(), found["score"].to_pylist(), strict=True):
        least[a, rank - 1], most[a, rank - 1] = (min(max(x, _NONE + 1), _NO_ID) for x in (-(-low * score // 100), high * score // 100))
    return least, most
