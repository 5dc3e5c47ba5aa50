"""Retrieval: exact nearest neighbours, filters, rank fusion, cross-source probes.

Queries are a stated set against all rows.  Scores of a block of queries against a
batch of the store are computed in one pass; a partition keeps and passes on only
its best k for each query, so what is shuffled grows with queries and partitions,
not with the store.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


#: Most queries that are sent to every task at once; beyond, blocks of queries meet blocks of the store.
QUERY_BLOCK, STORE_BLOCK = 4096, 65_536
#: Queries and rows whose scores a task holds at once: 8 MB, however many there are of either.
SLICE, TILE = 256, 4096
HIT = "query_id long, doc_id long, score double"
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _vectors(column: pa.Array) -> np.ndarray:
    e = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)


def _cut(hits: Hits, k: int) -> Hits:
    """Of (query, doc, score) each query's best k, ties to the smaller doc."""
    query, doc, score = hits
    order = np.lexsort((doc, -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[rank < k]
    return query[order], doc[order], score[order]


def _best(ids: np.ndarray, q: np.ndarray, docs: np.ndarray, e: np.ndarray, k: int, exclude_self: bool) -> Hits:
    """The best k of docs for each query; only what reaches a query's k-th score is put in order."""
    score = q @ e.T
    np.maximum(score, 0, out=score)
    score *= 1e6
    score += 0.5
    np.floor(score, out=score)
    score /= 1e6
    if exclude_self:
        score[ids[:, None] == docs[None, :]] = -1
    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -1.0)
    row, col = np.nonzero((score >= least[:, None]) & (score >= 0))
    return _cut((ids[row], docs[col], score[row, col]), k)


def _joined(a: Hits | None, b: Hits, k: int) -> Hits:
    return b if a is None else _cut(tuple(np.concatenate(x) for x in zip(a, b)), k)


def _scan(found: list[Hits | None], ids: np.ndarray, q: np.ndarray, docs: np.ndarray, embeddings: pa.Array, k: int, exclude_self: bool) -> None:
    """Bring found, the best k of each SLICE of the queries, up to some rows of the store."""
    for start in range(0, len(docs), TILE):
        own, e = docs[start : start + TILE], _vectors(embeddings.slice(start, TILE))
        for i in range(len(found)):
            at = slice(i * SLICE, (i + 1) * SLICE)
            found[i] = _joined(found[i], _best(ids[at], q[at], own, e, k, exclude_self), k)


def _batch(hits: Hits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in hits], names=["query_id", "doc_id", "score"])


def _in_blocks(store: DataFrame, queries: DataFrame, n: int, k: int, exclude_self: bool) -> DataFrame:
    """Blocks of the store and of the queries, each pair met by one task; neither side passes the driver."""
    # as large on either side as a task can hold: the store is shuffled once for each block of queries
    q_blocks, s_blocks = -(-n // STORE_BLOCK), max(1, -(-store.count() // STORE_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = store.select("doc_id", "embedding", own("doc_id", s_blocks).alias("s"), every(q_blocks).alias("q"))
    right = queries.select("query_id", "embedding", own("query_id", q_blocks).alias("q"), every(s_blocks).alias("s"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([], pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]))
        a, b = a.combine_chunks(), b.combine_chunks()
        ids, vectors = b["query_id"].to_numpy(), _vectors(b["embedding"].combine_chunks())
        best: list[Hits | None] = [None] * -(-len(ids) // SLICE)
        _scan(best, ids, vectors, a["doc_id"].to_numpy(), a["embedding"].combine_chunks(), k, exclude_self)
        return pa.Table.from_batches([_batch(x) for x in best])

    return left.groupBy("s", "q").cogroup(right.groupBy("s", "q")).applyInArrow(meet, HIT)


def top_k(store: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k rows of store (doc_id, embedding) most like each query (query_id, embedding).

    Scores are cosines cut below at 0 and rounded to 6 decimals; ties go to the
    smaller doc_id.  Rows without an embedding are no hits, and queries without one
    have none.  Up to QUERY_BLOCK queries go to every task, which passes on the best
    k of its whole partition; more are met block by block.
    """
    spark = store.sparkSession
    store = store.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter("embedding IS NOT NULL")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding IS NOT NULL")
    some = queries.limit(QUERY_BLOCK + 1).collect()
    if not some:
        return spark.createDataFrame([], f"{HIT}, rank long")
    if len(some) > QUERY_BLOCK:
        out = _in_blocks(store, queries, queries.count(), k, exclude_self)
    else:
        vectors = np.array([r[1] for r in some], np.float64).reshape(len(some), -1)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in some], np.int64), vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            found: list[Hits | None] = [None] * -(-len(ids) // SLICE)
            for batch in batches:
                _scan(found, ids, q, batch.column(0).to_numpy(), batch.column(1), k, exclude_self)
            yield from (_batch(x) for x in found if x is not None)

        out = store.mapInArrow(best, HIT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


#: Words of texts and queries: ASCII letters and digits, in lower case.
TERM = "[a-z0-9]+"


def text_rank(store: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k rows of store (doc_id, text) that match each query (query_id, text) best by BM25.

    A query's terms meet the texts' by an equi-join, so only texts that share a
    term are scored; scores are rounded to 6 decimals, ties go to the smaller doc_id.
    Null texts have no terms; a query without a known term has no hits.
    """
    terms = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))
    docs = store.select("doc_id", terms(F.col("text")).alias("terms")).withColumn("n", F.size("terms"))
    size = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))  # one row
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    tf = docs.select("doc_id", "n", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "n").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = asked.join(weighed.select("term", "doc_id", weight.alias("w")), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def hybrid(store: DataFrame, queries: DataFrame, k: int, depth: int = 20, by_text: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k rows of store (doc_id, text, embedding) that the rankings by vector and by text, depth deep, put highest together.

    by_text is the ranking by text where an index has made it; see textindex.
    """
    return fuse(top_k(store, queries, depth), text_rank(store, queries, depth) if by_text is None else by_text, k)


def fuse(a: DataFrame, b: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query_id, doc_id, rank)."""
    both = a.select("query_id", "doc_id", "rank").union(b.select("query_id", "doc_id", "rank"))
    scored = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.col("rank") + constant)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def cross_source(hits: DataFrame) -> DataFrame:
    """(query_id, n_types, only_type) of queries whose hits come from one source type: those to probe the others for."""
    g = hits.groupBy("query_id").agg(F.countDistinct("source_type").alias("n_types"), F.min("source_type").alias("only_type"))
    return g.filter("n_types = 1")


def cross_source_probe(hits: DataFrame, store: DataFrame, queries: DataFrame, least: float = 0.3, types: tuple[str, ...] = ("code", "doc", "ticket")) -> DataFrame:
    """(query_id, source_type, doc_id, score): for queries whose hits have one type, the best row of each other type that scores above least."""
    alone = cross_source(hits).select("query_id", "only_type")
    asked = queries.join(alone.select("query_id"), "query_id", "left_semi")
    found = [top_k(store.filter(F.col("source_type") == t), asked, 1).select("query_id", F.lit(t).alias("source_type"), "doc_id", "score") for t in types]
    best = reduce(DataFrame.union, found).filter(F.col("score") > least)
    return best.join(alone, "query_id").filter("source_type <> only_type").drop("only_type")
