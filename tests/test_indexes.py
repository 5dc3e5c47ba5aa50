"""Stored indexes against the searches that look at every row."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import search, textindex, vectorindex


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


def test_pruned_text_search_is_the_full_one(spark, tmp_path, monkeypatch):
    """Words as frequent as 1 / rank, ties, repeated texts, blocks of few documents."""
    monkeypatch.setattr(textindex, "BLOCK", 16)
    monkeypatch.setattr(textindex, "SEED", 30)
    pick = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(pick.choices(words, weights, k=pick.randint(0, 40)))) for k in range(-40, 360)] + [(400, None), (401, ""), (402, "w0 w0"), (403, "w0 w0")]
    store = spark.createDataFrame(docs, "doc_id long, text string")
    asked = [(k, " ".join(pick.choices(words, weights, k=pick.randint(1, 8)))) for k in range(25)] + [(90, "unknown"), (91, None), (92, "w0"), (93, "w0 w1 w2 w299"), (93, "w0 w1 w2 w299")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = textindex.TextIndex.build(store, f"file://{tmp_path}/index", buckets=4)
    for k in (1, 5):
        assert rows_of(index.search(queries, k)) == rows_of(search.text_rank(store, queries, k))
    assert index.share_read(queries, 5) < 1
    again = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    assert again.search(queries.filter("false"), 5).collect() == []


def test_stop_words_are_not_expanded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    pick = random.Random(1)
    docs = [(k, "the of and " * 3 + f"topic{k % 200} " + " ".join(f"x{pick.randint(0, 5000)}" for _ in range(10))) for k in range(4000)]
    store, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, f"the topic{k} of and") for k in range(5)], "query_id long, text string")
    index = textindex.TextIndex.build(store, f"file://{tmp_path}/index")
    assert rows_of(index.search(queries, 3)) == rows_of(search.text_rank(store, queries, 3))
    assert index.share_read(queries, 3) < 0.5


def test_an_index_of_nothing(spark, tmp_path):
    store = spark.createDataFrame([(1, None)], "doc_id long, text string")
    index = textindex.TextIndex.build(store, f"file://{tmp_path}/text")
    assert index.search(spark.createDataFrame([(1, "a")], "query_id long, text string"), 2).collect() == []
    none = spark.createDataFrame([], "doc_id long, embedding array<double>")
    assert vectorindex.VectorIndex.build(none, f"file://{tmp_path}/vectors").search(none.withColumnRenamed("doc_id", "query_id"), 2).collect() == []


def vectors(spark, n, seed, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16))
    rows = [(k, (middle[k % centres] + 0.6 * rng.normal(size=16)).tolist()) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 4)]  # a common vector
    return spark.createDataFrame([*rows, (10**6, None), (10**6 + 1, [0.0] * 16)], "doc_id long, embedding array<double>").repartition(4)


def test_vector_index(spark, tmp_path, monkeypatch):
    """Exact results whatever is probed; nearly all of them with few probes; lists in parts."""
    monkeypatch.setattr(vectorindex, "PART", 200)
    store = vectors(spark, 1200, 1)
    queries = store.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    index = vectorindex.VectorIndex.build(store, f"file://{tmp_path}/index", centres=20, sample=500)
    want = rows_of(search.top_k(store, queries, 10))
    for probes in (1, 6):
        assert rows_of(index.search(queries, 10, probes)) == want
    near = {(q, d) for q, _, d, _ in rows_of(index.search(queries, 10, 4, exact=False))}
    assert len(near & {(q, d) for q, _, d, _ in want}) >= 0.9 * len(want)
    assert rows_of(vectorindex.VectorIndex(spark, f"file://{tmp_path}/index").search(queries.limit(3), 2, 1)) == rows_of(search.top_k(store, queries.limit(3), 2))
    assert index.search(queries.filter("false"), 3).collect() == []


def test_centres_lie_where_rows_do(spark):
    store = vectors(spark, 400, 5, centres=4).filter("embedding IS NOT NULL AND doc_id < 400")
    centres = vectorindex.fit_centres(store, 4)
    e = np.array([r["embedding"] for r in store.select(F.col("embedding")).collect()])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    assert centres.shape == (4, 16) and (e @ centres.T).max(axis=1).mean() > 0.7
