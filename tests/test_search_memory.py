"""What a task of a search holds does not grow with queries or rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import search


def test_scores_are_held_tile_by_tile():
    rng = np.random.default_rng(3)
    ids, q = np.arange(3000), rng.normal(size=(3000, 8))
    e = rng.normal(size=(9000, 8)).astype(np.float32)
    column = pa.array(list(e), pa.list_(pa.float32()))
    found = [None] * -(-len(ids) // search.SLICE)
    tracemalloc.start()
    search._scan(found, ids, q / np.linalg.norm(q, axis=1, keepdims=True), np.arange(9000), column, 3, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # all scores are 216 MB
    query, doc, score = (np.concatenate(x) for x in zip(*found))
    assert len(query) == 9000 and (np.bincount(query) == 3).all()


def test_tiles_give_what_one_pass_does(spark, monkeypatch):
    """A few hundred queries, ties among them, by either way, against the plain order."""
    rng = np.random.default_rng(4)
    e = np.round(rng.normal(size=(5000, 4)), 1)
    store = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "doc_id long, embedding array<double>").repartition(3)
    queries = store.filter("doc_id % 12 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    score = np.floor(np.maximum(unit[::12] @ unit.T, 0) * 1e6 + 0.5) / 1e6
    want = {(12 * i, int(d), r + 1) for i, s in enumerate(score) for r, d in enumerate(np.lexsort((np.arange(5000), -s))[:4])}
    for most in (4096, 100):
        monkeypatch.setattr(search, "QUERY_BLOCK", most)
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in search.top_k(store, queries, 4).collect()} == want
