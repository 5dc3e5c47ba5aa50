"""A stored vector index: inverted lists by nearest centre, with an exact finish.

Centres come from k-means over a bounded sample; every row lies in the list of its
centre, and a centre knows the angle of the row farthest from it.  A query looks
through the lists of its nearest centres, which finds most of its neighbours; for
the exact ones it goes on to the lists that may still hold a better row, as no row
of a list is closer to the query than the centre's angle less the list's greatest
one.  Lists are met by cogrouped blocks of bounded size, so none needs one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.search import HIT, Hits, _batch, _best, _joined, _vectors

#: Rows that the centres are fitted on, most centres, rounds of k-means, and rows of a block.
SAMPLE, CENTRES, ROUNDS, PART = 100_000, 4096, 10, 65_536
_SUMS, _CELLS = "cell int, total array<double>, n long", "cell int, centre array<double>, reach double"


def _cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, unit vectors, cell of each, cosine to its centre); of equal centres the first."""
    for batch in batches:
        if batch.num_rows:
            e = _vectors(batch.column(batch.num_columns - 1))
            score = e @ centres.T
            cell = score.argmax(axis=1)
            yield batch, e, cell, score[np.arange(len(cell)), cell]


def fit_centres(rows: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n unit centres of rows (doc_id, embedding): spherical k-means from the rows whose hashes are least; tasks pass on a sum for each centre."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("embedding").toArrow()
    centres = np.unique(_vectors(first["embedding"].combine_chunks()), axis=0)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for _, e, cell, _ in _cells(batches, shared.value):
                np.add.at(total, cell, e)
                count += np.bincount(cell, minlength=len(count))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(list(total[held]), pa.list_(pa.float64())), pa.array(count[held])], names=["cell", "total", "n"])

        added = rows.select("embedding").mapInArrow(sums, _SUMS).groupBy("cell").agg(F.collect_list("total").alias("totals")).collect()  # a row for each centre
        moved = centres.copy()
        for r in added:
            total = np.sum(np.array(r["totals"]), axis=0)
            if (length := np.linalg.norm(total)) > 0:
                moved[r["cell"]] = total / length
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


class VectorIndex:
    """The index in the folder root, which driver and executors share; build() makes one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        cells = spark.read.schema(_CELLS).parquet(f"{self.root}/cells").orderBy("cell").collect()  # at most CENTRES
        self.centres = np.array([r["centre"] for r in cells], np.float64) if cells else np.zeros((0, 1))
        self.reach = np.array([r["reach"] for r in cells], np.float64)

    @classmethod
    def build(cls, store: DataFrame, root: str, centres: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index every row of store (doc_id, embedding) that has an embedding; the centres are fitted on ``sample`` rows at most."""
        spark, root = store.sparkSession, root.rstrip("/")
        rows = store.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter("embedding IS NOT NULL")
        total = rows.count()
        share = min(1.0, sample / max(total, 1))
        some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
        some.write.parquet(f"{root}/sample")
        fitted = fit_centres(spark.read.parquet(f"{root}/sample"), centres or min(CENTRES, max(1, math.isqrt(total)))) if total else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(fitted)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, cell, cosine in _cells(batches, shared.value):
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(cosine, -1, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "embedding", "cell", "angle"])

        kind = rows.schema["embedding"].dataType.simpleString()
        part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.lit(total) / PART)).cast("int")  # a list's rows are spread over all parts at most
        lists = rows.mapInArrow(placed, f"doc_id long, embedding {kind}, cell int, angle double").withColumn("part", part)
        lists.repartition("cell", "part").write.partitionBy("cell").parquet(f"{root}/lists")
        if total:
            spark.read.parquet(f"{root}/lists").groupBy(F.col("cell").cast("int").alias("cell"), "part").agg(F.max("angle").alias("reach")).write.parquet(f"{root}/parts")
        held = spark.read.parquet(f"{root}/parts").groupBy("cell").agg(F.max("reach").alias("reach")).collect() if total else []
        known = {r["cell"]: r["reach"] for r in held}
        cells = [(c, v.tolist(), known.get(c, -math.pi)) for c, v in enumerate(fitted)]
        spark.createDataFrame(cells, _CELLS).coalesce(1).write.parquet(f"{root}/cells")
        return cls(spark, root)

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank): the k rows most like each query (query_id, embedding).

        Scores are cosines cut below at 0 and rounded to 6 decimals; ties go to the
        smaller doc_id.  The lists of the ``probes`` nearest centres are looked
        through; with exact, then those that may hold a row of the k best.
        """
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding IS NOT NULL")
        if not len(self.centres):
            return self.spark.createDataFrame([], f"{HIT}, rank long")
        found = self._meet(self._ways(asked, probes, None), k)
        if exact:
            worst = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
            least = asked.join(worst, "query_id", "left").select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(-1.0).alias("least"), "embedding")
            found = found.unionByName(self._meet(self._ways(least, probes, k), k))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)

    def _ways(self, asked: DataFrame, probes: int, k: int | None) -> DataFrame:
        """(query_id, embedding, cell) of the nearest lists; with k of all others that may hold a row scoring least or more."""
        shared = self.spark.sparkContext.broadcast((self.centres, self.reach))
        kind = asked.schema["embedding"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, reach = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                cosine = np.clip(_vectors(batch.column(batch.num_columns - 1)) @ centres.T, -1, 1)
                near = np.zeros(cosine.shape, bool)
                np.put_along_axis(near, np.argsort(-cosine, axis=1, kind="stable")[:, :probes], True, axis=1)
                if k is not None:
                    most = np.cos(np.maximum(np.arccos(cosine) - reach - 1e-9, 0))
                    near = ~near & (np.maximum(most, 0) >= batch.column(1).to_numpy()[:, None] - 1e-6)
                near &= reach >= 0  # lists without rows
                row, cell = np.nonzero(near)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(batch.num_columns - 1).take(at), pa.array(cell.astype(np.int32))], names=["query_id", "embedding", "cell"])

        return asked.mapInArrow(run, f"query_id long, embedding {kind}, cell int")

    def _meet(self, ways: DataFrame, k: int) -> DataFrame:
        """The best k of each query and block of a list, then of each query."""
        lists = self.spark.read.parquet(f"{self.root}/lists").select("doc_id", "embedding", F.col("cell").cast("int").alias("cell"), "part")
        blocks = ways.join(self.spark.read.parquet(f"{self.root}/parts").select("cell", "part"), "cell")

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            found: Hits | None = None
            if a.num_rows and b.num_rows:
                a, b = a.combine_chunks(), b.combine_chunks()
                for q in range(0, b.num_rows, 1024):
                    own = b.slice(q, 1024)
                    ids, vectors, mine = own["query_id"].to_numpy(), _vectors(own["embedding"].combine_chunks()), None
                    for start in range(0, a.num_rows, 4096):
                        some = a.slice(start, 4096)
                        mine = _joined(mine, _best(ids, vectors, some["doc_id"].to_numpy(), _vectors(some["embedding"].combine_chunks()), k, False), k)
                    found = mine if found is None else tuple(np.concatenate(x) for x in zip(found, mine, strict=True))
            batch = _batch(found) if found is not None else _batch((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
            return pa.Table.from_batches([batch])

        hits = lists.groupBy("cell", "part").cogroup(blocks.groupBy("cell", "part")).applyInArrow(meet, HIT)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
