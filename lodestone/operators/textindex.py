"""A stored full-text index: parts of documents with the postings of their terms, searched with MaxScore pruning.

Documents are dealt to parts of some PART postings, and a part keeps each term's
postings with their greatest weight.  A search brings every query to every part once,
and a part passes on its best k only, so what is shuffled grows with postings and with
queries times parts, not with the documents that queries match.  A search of the rarest
terms alone first gives a score that the k best at least reach.  Terms whose greatest
weights in a part together stay below that score cannot carry a document among the k
best: their postings, those of the most frequent words, are never expanded, but looked
up for the documents that the other terms leave as candidates.  The result is that of
scoring every document.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.search import HIT, TERM, _cut

#: Documents, by their ids, that stay together; postings that a query's first terms have at most; what rounding may hide.
BLOCK, SEED, SLACK = 128, 4096, 2e-6
#: Postings of a part, queries that a part meets at once, and texts whose words a task counts at once.
PART, QUERIES, TEXTS = 2_000_000, 65_536, 256
_COUNTED = "doc_id long, n int, terms array<string>, tf array<int>"
_POSTINGS = "bucket int, term string, docs array<long>, weights array<double>, df long, most double"
_WORD = re.compile(TERM)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(_low(text), F.lit(TERM), F.lit(0))


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each text (doc_id, text) and how often they occur."""
    for batch in batches:
        for start in range(0, len(batch), TEXTS):
            found = [Counter(_WORD.findall(t)) for t in batch.column(1).slice(start, TEXTS).to_pylist()]
            n = pa.array([sum(c.values()) for c in found], pa.int32())
            terms, tf = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, TEXTS), n, terms, tf], names=["doc_id", "n", "terms", "tf"])


def _inverted(docs: pa.Table, mean: float, k1: float, b: float) -> pa.Table:
    """The postings of a part's documents, those of a term in the order of their ids."""
    docs = docs.sort_by([("doc_id", "ascending"), ("n", "ascending")]).combine_chunks()
    bucket, terms = docs["bucket"][0].as_py(), docs["terms"].combine_chunks()
    coded, row = terms.flatten().dictionary_encode(), np.repeat(np.arange(len(docs)), terms.value_lengths().to_numpy())
    names, code = coded.dictionary, coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, row, tf = code[order], row[order], docs["tf"].combine_chunks().flatten().to_numpy()[order].astype(np.float64)
    doc, n = docs["doc_id"].to_numpy()[row], docs["n"].to_numpy()[row]

    def heads(*columns: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.logical_or.reduce([np.append(True, c[1:] != c[:-1])[: len(c)] for c in columns]))

    at = heads(code, doc, n)  # rows of one id and length count as one document, as where terms are counted by grouping
    tf = np.add.reduceat(tf, at) if len(at) else tf
    code, doc, n = code[at], doc[at], n[at]
    df, weight = np.bincount(code, minlength=len(names)), tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
    at = heads(code, doc)
    weight = np.add.reduceat(weight, at) if len(at) else weight
    code, doc = code[at], doc[at]
    starts = np.searchsorted(code, np.arange(len(names) + 1)).astype(np.int32)
    most = np.maximum.reduceat(weight, starts[:-1]) if len(at) else weight
    lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (doc, weight)]
    return pa.table([pa.array(np.full(len(names), bucket, np.int32)), names, *lists, pa.array(df.astype(np.int64)), pa.array(most)], names=["bucket", "term", "docs", "weights", "df", "most"])


def _searched(postings: pa.Table, asked: pa.Table, k: int, count: bool) -> pa.Table:
    """The best k of a part's documents for each query (query_id, reach, terms, idf); with count, how many postings that takes."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if postings.num_rows and asked.num_rows:
        postings, asked = postings.combine_chunks(), asked.combine_chunks()
        lists, most = postings["docs"].combine_chunks(), postings["most"].to_numpy()
        starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        ids, doc = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        weight = postings["weights"].combine_chunks().flatten().to_numpy()
        terms = asked["terms"].combine_chunks()
        ends = np.cumsum(terms.value_lengths().to_numpy())
        place = pc.index_in(terms.flatten(), value_set=postings["term"].combine_chunks()).fill_null(-1).to_numpy()
        every_idf, reaches = asked["idf"].combine_chunks().flatten().to_numpy(), asked["reach"].to_numpy()
        for query, reach, start, end in zip(asked["query_id"].to_numpy(), reaches, np.append(0, ends), ends):
            known = place[start:end] >= 0
            own, idf = place[start:end][known], every_idf[start:end][known]
            bound = idf * most[own]
            order = np.argsort(bound, kind="stable")
            below = np.cumsum(bound[order])
            cut = np.searchsorted(below, reach)
            if cut == len(order):
                continue
            rest = below[cut - 1] if cut else 0.0
            spans = [(slice(starts[own[i]], starts[own[i] + 1]), idf[i]) for i in order]
            score = np.bincount(np.concatenate([doc[s] for s, _ in spans[cut:]]), np.concatenate([weight[s] * f for s, f in spans[cut:]]), len(ids))
            hit = np.flatnonzero(score)
            least = max(reach, np.partition(score[hit], -k)[-k] - SLACK if len(hit) > k else reach)
            hit = hit[score[hit] + rest >= least]
            if count:
                found.append((np.array([query]), np.array([sum(s.stop - s.start for s, _ in spans[cut:]) + cut * len(hit)]), np.zeros(1)))
                continue
            total = score[hit]
            for s, f in spans[:cut]:
                there = np.minimum(np.searchsorted(doc[s], hit), s.stop - s.start - 1)
                total += np.where(doc[s][there] == hit, weight[s][there] * f, 0.0)
            hit, total = hit[total >= least], np.floor(total[total >= least] * 1e6 + 0.5) / 1e6
            found.append(_cut((np.full(len(hit), query), ids[hit], total), k))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "doc_id", "score"])


class TextIndex:
    """The index in the folder root, which driver and executors share; build() makes one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets, self.docs = spark.read.parquet(f"{self.root}/size").select("buckets", "docs").first()

    @classmethod
    def build(cls, store: DataFrame, root: str, k1: float = 1.2, b: float = 0.75, buckets: int | None = None) -> TextIndex:
        """Index the rows of store (doc_id, text) for BM25; null texts have no terms, rows without doc_id are left out.

        buckets is the number of parts; by default there is one for each PART postings.
        """
        spark, root = store.sparkSession, root.rstrip("/")
        texts = store.select(F.col("doc_id").cast("long").alias("doc_id"), _low(F.col("text")).alias("text")).filter("doc_id IS NOT NULL")
        texts.mapInArrow(_counted, _COUNTED).write.parquet(f"{root}/counted")
        docs = spark.read.schema(_COUNTED).parquet(f"{root}/counted")
        parts = F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.size("terms")), F.lit(0)) / PART)).cast("int") if buckets is None else F.lit(buckets)
        docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), parts.alias("buckets")).write.parquet(f"{root}/size")
        size = spark.read.parquet(f"{root}/size").first()
        mean, bucket = size["mean"] or 1.0, F.pmod(F.xxhash64(F.expr(f"doc_id DIV {BLOCK}")), F.lit(size["buckets"])).cast("int")
        docs.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda part: _inverted(part, mean, k1, b), _POSTINGS).write.parquet(f"{root}/postings")
        every = spark.read.schema(_POSTINGS).parquet(f"{root}/postings")
        every.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{root}/terms")
        return cls(spark, root)

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.root}/postings")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): the k rows that match each query (query_id, text) best.

        Scores are rounded to 6 decimals, ties go to the smaller doc_id; a query
        without a known term has no hits.
        """
        asked, reach = self._asked(queries, k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long")
        return self._met(asked, k, reach).withColumn("rank", rank).filter(F.col("rank") <= k)

    def share_read(self, queries: DataFrame, k: int) -> float:
        """Of the postings of the queries' terms, the part that a search expands or looks up."""
        asked, reach = self._asked(queries, k)
        every = asked.agg(F.sum("df")).first()[0]
        return (self._met(asked, k, reach, count=True).agg(F.sum("doc_id")).first()[0] or 0) / every if every else 0.0

    def _asked(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The terms of the queries (query_id, term, df, idf), and a score (query_id, reach) that the k best of a query at least reach."""
        at = f"{self.root}/searches/{uuid.uuid4().hex}"

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{name}")

        known = self.spark.read.schema("term string, df long").parquet(f"{self.root}/terms")
        idf = F.log(1 + (self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).filter("query_id IS NOT NULL").distinct().join(known, "term")
        asked = kept(asked.select("query_id", "term", "df", idf.alias("idf")), "asked")
        rarest = Window.partitionBy("query_id").orderBy("df", "term")
        rare = asked.withColumn("i", F.row_number().over(rarest)).withColumn("upto", F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0)))
        first = self._met(rare.filter((F.col("i") == 1) | (F.col("upto") <= SEED)), k)
        ranked = first.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("i") == k)
        return asked, kept(ranked.select("query_id", F.col("score").alias("reach")), "reach")

    def _met(self, asked: DataFrame, k: int, reach: DataFrame | None = None, count: bool = False) -> DataFrame:
        """The best k of each part for each query; parts and blocks of queries, each pair met by one task."""
        blocks = -(-asked.select("query_id").distinct().count() // QUERIES)
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        of_query = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("asks")).select("query_id", F.col("asks.term").alias("terms"), F.col("asks.idf").alias("idf"))
        of_query = of_query.withColumn("reach", F.lit(0.0)) if reach is None else of_query.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
        block = F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))).cast("int")
        right = of_query.select("query_id", (F.col("reach") - SLACK).alias("reach"), "terms", "idf", block.alias("block"), every(self.buckets).alias("bucket"))
        left = self._postings().join(asked.select("term").distinct(), "term", "left_semi").withColumn("block", every(max(blocks, 1)))
        return left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(lambda a, b: _searched(a, b, k, count), HIT)
