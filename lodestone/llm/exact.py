"""Stateful streaming exact deduplication.

Rows arrive as a stream of (digest, size, identifier, locator).  Keyed state in
RocksDB, without expiry, retains for each digest the best row so far (most code
points, then smallest doc_id), the file in which its content lies, and how many
rows came.  When the stream has drained, the full normalised texts of every group
with a hit are compared; a text of an earlier call is fetched by its locator.
The state lives in a folder, so an index can take in one batch after another.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, exists, fresh, joined

SPACES = r"[\x20\x09-\x0D]+"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # every partition has a store: without these each holds megabytes of preallocated files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
VERDICT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, locator string"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def raw_key(text: Column) -> Column:
    """What tells unchanged texts apart: a hash and the length in bytes; null differs from empty."""
    return F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))


def arrivals(docs: DataFrame) -> DataFrame:
    """What the stream carries of each row: (doc_id, digest, n_points, raw, locator)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("digest"), F.length(text).cast("long").alias("n_points"), raw_key(F.col("text")).alias("raw"), F.input_file_name().alias("locator")
    )


def deduplicate_stream(stream: DataFrame) -> DataFrame:
    """Update-mode stream (digest, best, group_size) over a stream of arrivals.

    best is struct(n_points, ~doc_id, locator): its maximum has the most code
    points, then the smallest doc_id; null ids come last.
    """
    rank = F.struct("n_points", F.bitwise_not("doc_id").alias("reversed_id"), "locator")
    return stream.groupBy("digest").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))


def differing(texts: DataFrame) -> DataFrame:
    """(digest) of texts (digest, content) that have different contents.

    Equal contents are folded where they are read, so a group of a billion copies
    sends one text for each task.
    """
    return texts.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("digest")


class ExactIndex:
    """What has arrived so far, and the keyed state over it, below a folder that driver and executors share.

    A folder that is there already is gone on with; batches are judged against all
    that came before them, in this session or another.
    """

    def __init__(self, spark: SparkSession, root: str, files_per_batch: int | None = None) -> None:
        self.spark, self.files_per_batch = spark, files_per_batch
        self.tables = Scratch(spark, "exact", root)
        self.schema = arrivals(spark.createDataFrame([], "doc_id long, text string")).schema

    def groups(self) -> DataFrame:
        """(digest, keep_id, locator, group_size): the state, as the stream's updates tell it."""
        updates = self.tables.path("updates")
        rows = self.spark.read.schema("digest string, best struct<n_points: long, reversed_id: long, locator: string>, group_size long, batch int").option("basePath", updates).parquet(updates)
        last = rows.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("last"))  # state only grows: the largest count is the latest
        return last.select("digest", F.bitwise_not("last.best.reversed_id").alias("keep_id"), F.col("last.best.locator").alias("locator"), F.col("last.group_size").alias("group_size"))

    def _drain(self) -> None:
        """Run the stream over the arrivals until it has none left."""
        reader = self.spark.readStream.schema(self.schema)
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)

        def put(batch: DataFrame, batch_id: int) -> None:  # a batch that is run again after a failure overwrites its own folder
            batch.write.mode("overwrite").parquet(self.tables.path(f"updates/batch={batch_id}"))

        before = {k: self.spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            self.spark.conf.set(k, v)
        try:
            stream = deduplicate_stream(reader.parquet(self.tables.path("arrivals/*")))
            stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", self.tables.path("state")).foreachBatch(put).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def add(self, docs: DataFrame, scratch: Scratch, name: str | None = None) -> DataFrame:
        """Take in docs (doc_id, text, ...); (doc_id, keep_id, group_size, kept, text_sha256, locator, raw) of its rows.

        A call that failed may be made again under its name: rows that have
        arrived under a name do not arrive twice.  Raises RuntimeError if two
        different texts have one digest.
        """
        known = scratch.save(self.groups(), "known") if exists(self.spark, self.tables.path("updates")) else None
        name = f"arrivals/{name or uuid.uuid4().hex}"
        landed = self.tables.read(name, self.schema) if self.tables.has(name) else self.tables.save(arrivals(docs), name)
        if landed.isEmpty():
            return self.spark.createDataFrame([], f"{VERDICT}, raw struct<hash: long, bytes: int>")
        self._drain()
        groups = scratch.save(self.groups(), "groups")
        # a merge join at every size, so that adaptive execution can split a hot digest
        verdicts = landed.drop("locator", "n_points").join(groups.hint("merge"), "digest")
        verdicts = verdicts.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "locator", "raw")
        verdicts = scratch.save(verdicts, "verdicts", like=landed)
        self._check_bytes(docs, verdicts, known, scratch)
        return verdicts

    def _check_bytes(self, docs: DataFrame, verdicts: DataFrame, known: DataFrame | None, scratch: Scratch) -> None:
        """Compare the full texts of all groups with a hit, those of earlier calls by the text that stayed then.

        An earlier row that came from no file has no locator; its group is compared
        among its new rows.
        """
        hits = scratch.save(verdicts.filter("group_size > 1").select("raw").distinct(), "hits")
        # the unchanged text tells which rows to look at, so only these are normalised again
        near = joined(docs.select("text", raw_key(F.col("text")).alias("raw")), hits, "raw", "left_semi")
        texts = near.select(normalised(F.col("text")).alias("content"))
        if known is not None:
            met = known.join(verdicts.select(F.col("text_sha256").alias("digest")).distinct(), "digest", "left_semi").filter("locator <> ''")
            met = scratch.save(met.select("digest", "locator"), "met", like=known)
            files = sorted(unquote(r[0]) for r in met.select("locator").distinct().collect())  # names of files, not of documents
            if files:
                old = self.spark.read.parquet(*files).select(normalised(F.col("text")).alias("content"), F.sha2(normalised(F.col("text")), 256).alias("digest"))
                texts = texts.union(joined(old, met.select("digest").distinct(), "digest", "left_semi").select("content"))
        wrong = differing(texts.select(F.sha2("content", 256).alias("digest"), "content")).count()
        scratch.drop("hits", "met")
        if wrong:
            raise RuntimeError(f"{wrong} digests have different texts")


def _judged(docs: DataFrame, files_per_batch: int | None, scratch: Scratch) -> DataFrame:
    return ExactIndex(docs.sparkSession, scratch.path("index"), files_per_batch).add(docs, scratch)


def exact_duplicates(docs: DataFrame, files_per_batch: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, locator) of every row of docs (doc_id, text, ...).

    Texts are equal when they are so without white space; null counts as empty.
    locator is the file that holds the row that stays.  Rows that repeat a doc_id
    and a text share one verdict.  A row without doc_id stays only if all of its
    group lack one.  No rows give no rows.  Other columns are ignored.  Raises
    RuntimeError if two different texts had one digest.
    """
    return _judged(docs, files_per_batch, scratch or Scratch(docs.sparkSession, "exact")).drop("raw")


def first_copies(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that stay; null counts as empty."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    verdicts = _judged(docs, None, scratch)
    gone_id, gone_raw = fresh(docs, "gone_id"), fresh(docs, "gone_raw")
    # verdicts depend on doc_id and text only, so no row that stays has the keys of one that goes
    gone = scratch.save(verdicts.filter("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct(), "gone")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & raw_key(F.col("text")).eqNullSafe(F.col(gone_raw))
    return joined(docs, gone, match, "left_anti")
