"""Incremental removal of repeated word windows through a log-structured fingerprint index.

The index is a folder of immutable runs.  A run holds, for each bucket of the hash
space, the sorted 64-bit hashes of windows and the least doc_id in which each
starts.  All runs lie in one Parquet table that is partitioned by run and bucketed,
so a batch is dealt to buckets, sorted and merge-joined with the runs where they
lie: history is read, but never shuffled again.  Hits go back to the batch's
documents, and what is new becomes a run.  ``compact`` merges runs into one.  A
manifest with a rising number says which runs count; an index that is opened again
goes on from there.

A hit names a smaller document that has a window of the same hash.  Each stretch of
hits is verified word for word in that document's text.  The windows of hashes for
which this fails are told apart by their words over all documents, so the result
does not depend on the hash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textscan as ts
from lodestone.llm.scratch import Scratch, exists, remove
from lodestone.llm.scratch import joined as keyed

ROW = "kind int, bucket int, hashes binary, docs binary, firsts binary"
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("firsts", pa.binary())])
#: Kinds of rows: windows of the batch or of a new run; hits, with a smaller document for each.
NEW, HIT = 0, 1
#: Text that is combined before its windows are dealt out, and text for which the hash space gets one bucket more.
SCAN_BYTES, BUCKET_BYTES = 2_000_000, 2_500_000
#: Fewest and most buckets of an index.
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 20
#: Repeated windows that a task remembers, so that each of them is dealt out once by a task.
REMEMBERED = 1 << 18
#: Hits that a task puts in the order of documents at once.
GATHERED = 1 << 20
#: Stretches that are verified against one copy of a text, and colliding hashes that are told apart at once.
PACKET, COLLISIONS = 1000, 1_000_000


def window_hashes(texts: ts.Texts, width: int, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, texts' first windows, hash of each window)."""
    found = ts.words(texts)
    hashes = ts.word_hashes(texts, found)
    start, first = ts.windows(found, width)
    return start, first, ts.run_hashes(hashes, start, start + width) & np.uint64(mask)


def _least(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, heads of the runs of equal hashes in that order, least doc of each run)."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    return order, heads, np.minimum.reduceat(docs[order], heads) if len(heads) else docs[:0]


def _spread(least: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(least, np.diff(np.append(heads, n)))


def _look_up(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each wanted hash is among the sorted known ones, its place there)."""
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return (known[at] == wanted) if len(known) else np.zeros(len(wanted), bool), at


def _dealt(bucket: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """A row of kind NEW for each bucket present."""
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    packed = _binaries(order, at, hashes, docs)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(names), np.int32)), pa.array(names.astype(np.int32)), *packed, pa.nulls(len(names), pa.binary())], schema=_ROW)


def _one(kind: int, bucket: int, hashes: np.ndarray, docs: np.ndarray, firsts: np.ndarray | None = None) -> pa.RecordBatch:
    packed = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in (hashes, docs, firsts)]
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), *packed], schema=_ROW)


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _scanner(width: int, buckets: int, mask: int):
    """Texts to windows by bucket.

    Of the documents that share a window only the least of a chunk is dealt out; the
    others are hits at once, and so is every later document of the task.  A passage
    that everybody quotes thus stays small, and its hits bypass its bucket: they have
    a negative one of their own, chunk by chunk.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, seen_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for texts in ts.chunks(batch.column(1), SCAN_BYTES):
                _, first, hashes = window_hashes(texts, width, mask)
                if not len(hashes):
                    continue
                docs = np.repeat(ids[texts.first_row : texts.first_row + len(texts)], np.diff(first))
                known, at = _look_up(seen, hashes)
                late = known.copy()
                late[known] = docs[known] > seen_doc[at[known]]
                rest = np.flatnonzero(~late)
                order, heads, least = _least(hashes[rest], docs[rest])
                order = rest[order]
                low = _spread(least, heads, len(order))
                later = docs[order] > low
                again = np.unique(_spread(np.arange(len(heads)), heads, len(order))[later])
                # in the order of the text, so that runs of one doc_id compress to nothing
                place = np.argsort(order[heads], kind="stable")
                own = order[heads][place]
                yield _dealt((hashes[own] % np.uint64(buckets)).astype(np.int32), hashes[own], least[place])
                hit = np.concatenate([np.flatnonzero(late), order[later]])
                if len(hit):
                    firsts = np.concatenate([seen_doc[at[late]], low[later]])
                    place = np.argsort(hit, kind="stable")
                    name = int(ts.mix(np.array([int(docs[hit[0]]) & (2**63 - 1)], np.uint64) + np.uint64(len(hit)))[0] >> np.uint64(34))
                    yield _one(HIT, -1 - name, hashes[hit[place]], docs[hit[place]], firsts[place])
                if len(again):
                    # the newest come first: beyond the bound, what was seen long ago is dealt out again
                    news = hashes[order[heads[again]]]
                    fresh = ~_look_up(np.sort(news), seen)[0]
                    both, both_doc = np.concatenate([news, seen[fresh]])[:REMEMBERED], np.concatenate([least[again], seen_doc[fresh]])[:REMEMBERED]
                    place = np.argsort(both, kind="stable")
                    seen, seen_doc = both[place], both_doc[place]

    return scan


def _judge(keep_run: bool):
    """Rows of a bucket, and of the runs there, to hits and to what is new to the runs."""

    def judge(key: tuple[pa.Scalar, ...], batch: pa.Table, runs: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0 or not batch.num_rows:
            return batch.select(_ROW.names).cast(_ROW)
        hashes, docs = _unpacked(batch["hashes"], np.uint64), _unpacked(batch["docs"], np.int64)
        order, heads, least = _least(hashes, docs)
        low = _spread(least, heads, len(order))
        later = docs[order] > low
        found = hashes[order[heads]]
        hits = [(hashes[order[later]], docs[order[later]], low[later])]
        unseen = np.ones(len(found), bool)
        if runs.num_rows:
            old, old_doc = _folded(runs)
            known, at = _look_up(old, found)
            older = old_doc[at]
            also = known & (older < least)
            hits.append((found[also], least[also], older[also]))
            unseen = ~known | (least < older)
        out = [_one(HIT, bucket, *(np.concatenate([h[k] for h in hits]) for k in range(3)))] if sum(len(h[0]) for h in hits) else []
        if keep_run and unseen.any():
            out.append(_one(NEW, bucket, found[unseen], least[unseen]))
        return pa.Table.from_batches(out, _ROW)

    return judge


def _judge_alone(keep_run: bool):
    """The same without runs."""
    judge = _judge(keep_run)

    def alone(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        return judge(key, batch, batch.slice(0, 0))

    return alone


def _folded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, the least doc of each) of several runs' rows of a bucket."""
    hashes, docs = _unpacked(rows["hashes"], np.uint64), _unpacked(rows["docs"], np.int64)
    order, heads, least = _least(hashes, docs)
    return hashes[order[heads]], least


def _fold(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_one(NEW, key[0].as_py(), *_folded(rows))], _ROW)


HITS = "doc_id long, hashes binary, firsts binary"
_PART = "part int, hashes binary, docs binary, firsts binary"


def _binaries(order: np.ndarray, at: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """For each of values, 8 bytes each, a binary for each stretch of the order that begins at one of at."""
    offsets = pa.py_buffer((np.append(at, len(order)) * 8).astype(np.int32))
    return [pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(x[order])]) for x in values]


def _by_part(parts: int):
    """Hits by bucket to hits by part of the documents: a row for each part and GATHERED hits of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h, d, f = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            part = (ts.mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            names, at = np.unique(part[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(names), *_binaries(order, at, h, d, f)], names=["part", "hashes", "docs", "firsts"])

        n = 0
        for batch in batches:
            for h, d, f in zip(*(batch.column(k) for k in range(3))):
                held.append(tuple(np.frombuffer(x.as_buffer(), kind).copy() for x, kind in ((h, np.uint64), (d, np.int64), (f, np.int64))))
                n += len(held[-1][0])
                if n >= GATHERED:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def _by_document(rows: pa.Table) -> pa.Table:
    """All hits of a part to a row for each of its documents."""
    h, d, f = (_unpacked(rows[c], kind) for c, kind in (("hashes", np.uint64), ("docs", np.int64), ("firsts", np.int64)))
    order = np.argsort(d, kind="stable")
    ids, at = np.unique(d[order], return_index=True)
    return pa.table([pa.array(ids), *_binaries(order, at, h, f)], names=["doc_id", "hashes", "firsts"])


_SPAN = pa.struct([("first_doc", pa.int64()), ("words", pa.string())])
KEPT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<first_doc: long, words: string>>"


def _remover(width: int, mask: int, doubtful: np.ndarray | None = None, text: bool = True):
    """(doc_id, text, hits, exact) to KEPT: windows of doubtful hashes count if exact names their words, all others if they are hits; without text, its hash only."""
    unsure = np.zeros(0, np.uint64) if doubtful is None else doubtful

    def one(raw: np.ndarray, hashes: np.ndarray, hits: pa.Scalar, exact: pa.Scalar) -> tuple[int, int, bytes, list[dict]]:
        own = raw.tobytes().split()
        if len(own) < width or not (hits.is_valid or exact.is_valid):
            return len(own), 0, b" ".join(own), []
        wanted, firsts = (np.frombuffer(hits[k].as_buffer(), kind) if hits.is_valid else np.zeros(0, kind) for k, kind in (("hashes", np.uint64), ("firsts", np.int64)))
        order = np.lexsort((firsts, wanted))
        wanted, firsts = wanted[order], firsts[order]  # of several firsts the look-up finds the least
        hit, at = _look_up(wanted, hashes)
        spans = []
        if len(unsure):
            doubt = _look_up(unsure, hashes)[0]
            known = set(exact.as_py()) if exact.is_valid else set()
            hit = np.where(doubt, [d and b" ".join(own[k : k + width]).decode("utf-8", "surrogatepass") in known for k, d in enumerate(doubt)], hit)
        else:
            place = np.flatnonzero(hit)
            first = firsts[at[place]]
            cuts = np.flatnonzero((np.diff(place) != 1) | (np.diff(first) != 0)) + 1
            edges = [0, *cuts.tolist(), len(place)] if len(place) else []
            spans = [{"first_doc": int(first[a]), "words": b" ".join(own[place[a] : place[b - 1] + width]).decode("utf-8", "surrogatepass")} for a, b in zip(edges, edges[1:])]
        edge = np.zeros(len(own) + 1, np.int64)
        edge[: len(hit)] += hit
        edge[width : width + len(hit)] -= hit
        stays = np.cumsum(edge[:-1]) == 0
        return len(own), len(own) - int(stays.sum()), b" ".join(w for w, s in zip(own, stays) if s), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ts.chunks(batch.column(1)):
                part = batch.slice(texts.first_row, len(texts))
                _, first, hashes = window_hashes(texts, width, mask)
                rows = [one(texts.data[a:b], hashes[i:j], h, e) for a, b, i, j, h, e in zip(texts.offsets, texts.offsets[1:], first, first[1:], part.column(2), part.column(3))]
                count, gone, kept, spans = zip(*rows)
                said = pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()) if text else pa.nulls(len(kept), pa.string())
                digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), said, digests, pa.array(spans, pa.list_(_SPAN))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"])

    return run


def _verifier(width: int, mask: int):
    """(first_doc, text, words array) to (first_doc, hash) of the windows of the stretches that the text does not hold word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bad = [], []
            for doc, text, stretches in zip(*(batch.column(k) for k in range(3))):
                held = b" " + b" ".join((text.as_py() or "").encode("utf-8", "surrogatepass").split()) + b" "
                for words in stretches.as_py():
                    raw = words.encode("utf-8", "surrogatepass")
                    if b" " + raw + b" " in held:
                        continue
                    own = raw.split()
                    data = np.frombuffer(raw, np.uint8)
                    hashes = window_hashes(ts.Texts(data, np.array([0, len(data)]), 0), width, mask)[2]
                    wrong = {int(h) for k, h in enumerate(hashes) if b" " + b" ".join(own[k : k + width]) + b" " not in held}
                    ids += [doc.as_py()] * len(wrong)
                    bad += sorted(wrong)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(bad, np.uint64).view(np.int64))], names=["first_doc", "hash"])

    return run


def _finder(width: int, mask: int, hashes: np.ndarray):
    """(doc_id, text) to (doc_id, words) of the windows that have one of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ts.chunks(batch.column(1)):
                start, first, found = window_hashes(texts, width, mask)
                ids, words = [], []
                near = _look_up(hashes, found)[0]
                for i in range(len(texts)):
                    here = np.flatnonzero(near[first[i] : first[i + 1]])
                    own = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().split() if len(here) else []
                    new = {b" ".join(own[k : k + width]) for k in here}
                    ids += [batch.column(0)[texts.first_row + i].as_py()] * len(new)
                    words += [w.decode("utf-8", "surrogatepass") for w in sorted(new)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["doc_id", "words"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of window hashes below a folder, for documents that come in batches.

    Batches are judged against all earlier batches and themselves.  With batches in
    ascending doc_id order the result is that of one batch.  ``buckets`` is fixed
    for the life of an index: it bounds the memory of a merge, so choose it for the
    corpus to come (``buckets_for``); ``parts`` is the number of tasks of a merge.
    A folder that holds an index already is opened, and its own numbers hold.  bits
    is the width of the hash; fewer than 64 only make more windows to tell apart.
    """

    def __init__(self, spark: SparkSession, root: str, width: int = 13, buckets: int = 512, bits: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.state = {"width": width, "buckets": buckets, "bits": bits, "parts": max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))), "runs": [], "next": 0}
        self.version = -1
        while exists(spark, f"{self.root}/manifest/{self.version + 1:08d}/_SUCCESS"):
            self.version += 1
        if self.version >= 0:
            known = json.loads(spark.read.text(f"{self.root}/manifest/{self.version:08d}").first()[0])
            if known["width"] != width:
                raise ValueError(f"the index has windows of {known['width']} words")
            self.state = known
        self.mask = (1 << self.state["bits"]) - 1
        self.table = f"fingerprints_{hashlib.md5(self.root.encode()).hexdigest()}"
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        place = self.root.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.table} (bucket INT, hashes BINARY, docs BINARY, run INT) USING parquet PARTITIONED BY (run) CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.state['parts']} BUCKETS LOCATION '{place}/runs'")
        if self.runs:
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    @property
    def runs(self) -> list[int]:
        return self.state["runs"]

    def _commit(self, runs: list[int], following: int) -> None:
        """The next version of the manifest; older versions stay, so that the newest is found by counting."""
        self.state |= {"runs": runs, "next": following}
        self.version += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{self.version:08d}")

    def entries(self) -> DataFrame:
        """All runs' rows (bucket, hashes, docs, run), bucketed as they lie."""
        return self.spark.table(self.table).filter(F.col("run").isin(self.runs))

    def _write_run(self, rows: DataFrame, runs: list[int]) -> None:
        """A new run that counts beside runs; a run of that number that a failed call has left goes first."""
        k = self.state["next"]
        self._delete([k])
        rows.select("bucket", "hashes", "docs", F.lit(k).alias("run")).write.insertInto(self.table)
        self._commit([*runs, k], k + 1)

    def _delete(self, runs: list[int]) -> None:
        for k in runs:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = {k})")
            remove(self.spark, f"{self.root}/runs/run={k}")

    def merge(self, docs: DataFrame, keep_run: bool = True) -> DataFrame:
        """The plan of an ingest: rows (kind, bucket, hashes, docs, firsts) of hits and, with keep_run, of what is new."""
        texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
        scanned = texts.mapInArrow(ts.thrifty(_scanner(self.state["width"], self.state["buckets"], self.mask)), ROW)
        if not self.runs:
            return scanned.groupBy("bucket").applyInArrow(_judge_alone(keep_run), ROW)
        return scanned.groupBy("bucket").cogroup(self.entries().groupBy("bucket")).applyInArrow(_judge(keep_run), ROW)

    def ingest(self, docs: DataFrame, scratch: Scratch, name: str, keep_run: bool = True) -> DataFrame:
        """HITS of the batch's documents that share a hash with a smaller doc_id, a row for each of them, and a new run."""
        merged = scratch.save(self.merge(docs, keep_run), f"{name}-merged", like=docs)
        hits = merged.filter(F.col("kind") == HIT).select("hashes", "docs", "firsts").mapInArrow(ts.thrifty(_by_part(self.state["buckets"])), _PART)
        hits = scratch.save(hits.groupBy("part").applyInArrow(_by_document, HITS), f"{name}-hits", like=docs)
        if keep_run:
            self._write_run(merged.filter(F.col("kind") == NEW), self.runs)
        scratch.drop(f"{name}-merged")
        return hits

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket where they lie, and delete them."""
        old = list(self.runs)
        if len(old) > 1:
            self._write_run(self.entries().groupBy("bucket").applyInArrow(_fold, ROW), [])
            self._delete(old)

    def drop(self) -> None:
        """Delete the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.root)

    def apply(self, docs: DataFrame, hits: DataFrame, scratch: Scratch, corpus: DataFrame | None = None, text: bool = True) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_text, kept_sha256): the batch without the words that verified windows cover; without text, kept_text is null.

        corpus (doc_id, text) holds all documents that the index has taken in, to
        verify hits in; without it docs are all there are.  hits have a row for each
        doc_id: what ingest() gave, or a union over batches that share no id.
        """
        hits = hits.select("doc_id", F.struct("hashes", "firsts").alias("hits"))
        corpus = docs if corpus is None else corpus
        docs, corpus = (x.select(F.col("doc_id").cast("long").alias("doc_id"), "text") for x in (docs, corpus))
        width = self.state["width"]
        none = F.lit(None).cast("array<string>")
        joined = docs.join(hits, "doc_id", "left").select("doc_id", "text", "hits", none.alias("exact"))
        kept = scratch.save(joined.mapInArrow(ts.thrifty(_remover(width, self.mask, text=text)), KEPT), "kept", like=docs)
        bad = self._unverified(kept, corpus, scratch)
        n = bad.count()
        result = kept.drop("spans")
        if not n:
            return result
        blocks = -(-n // COLLISIONS)
        for k in range(blocks):  # a share of the colliding hashes at a time
            mine = bad.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k) if blocks > 1 else bad
            hashes = np.sort(np.array([r[0] for r in mine.collect()], np.int64).view(np.uint64))
            shared = self.spark.sparkContext.broadcast(hashes)
            found = corpus.filter("doc_id IS NOT NULL").mapInArrow(ts.thrifty(_lazily(_finder, width, self.mask, shared)), "doc_id long, words string")
            found = scratch.save(found.distinct(), f"found-{k}", like=corpus)
            first = found.groupBy("words").agg(F.min("doc_id").alias("first"))
            exact = found.join(first.hint("merge"), "words").filter("doc_id > first").groupBy("doc_id").agg(F.collect_list("words").alias("exact"))
            scratch.save(exact, f"exact-{k}", like=found)
        exact = scratch.read("exact-*", "doc_id long, exact array<string>").groupBy("doc_id").agg(F.flatten(F.collect_list("exact")).alias("exact"))
        ids = scratch.save(scratch.read("found-*", "doc_id long").distinct(), "doubtful-ids")
        doubtful = self.spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in bad.toLocalIterator()], np.int64).view(np.uint64)))
        again = docs.join(ids, "doc_id", "left_semi").join(hits, "doc_id", "left").join(exact, "doc_id", "left").select("doc_id", "text", "hits", "exact")
        again = again.mapInArrow(ts.thrifty(_lazily(partial(_remover, text=text), width, self.mask, doubtful)), KEPT)
        return result.join(ids, "doc_id", "left_anti").unionByName(again.drop("spans"))

    def _unverified(self, kept: DataFrame, corpus: DataFrame, scratch: Scratch) -> DataFrame:
        """(hash) of windows of kept's spans that their first document does not hold word for word."""
        spans = scratch.save(kept.select(F.explode("spans").alias("s")).select("s.*").distinct(), "spans", like=kept)
        counts = scratch.save(spans.groupBy("first_doc").agg(F.count("*").alias("n")), "spans-firsts")
        packet = F.pmod(F.xxhash64("words"), F.ceil(F.col("n") / PACKET)).alias("packet")
        packets = spans.join(counts, "first_doc").select("first_doc", "words", packet).groupBy("first_doc", "packet").agg(F.collect_list("words").alias("stretches"))
        packets = scratch.save(packets.select("first_doc", "stretches"), "packets", like=spans)
        wanted = counts.select(F.col("first_doc").alias("doc_id"))
        texts = scratch.save(keyed(corpus, wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("first_doc"), "text"), "firsts", like=corpus)
        met = texts.join(packets.hint("merge"), "first_doc").select("first_doc", "text", "stretches")
        bad = scratch.save(met.mapInArrow(ts.thrifty(_verifier(self.state["width"], self.mask)), "first_doc long, hash long"), "failed", like=spans)
        # an id with several texts holds what any of them holds
        several = texts.groupBy("first_doc").agg(F.count("*").alias("texts"))
        bad = bad.groupBy("first_doc", "hash").agg(F.count("*").alias("n")).join(several, "first_doc").filter("n >= texts")
        bad = scratch.save(bad.select("hash").distinct(), "doubtful", like=spans)
        scratch.drop("spans", "spans-firsts", "packets", "firsts", "failed")
        return bad


def _lazily(make, width: int, mask: int, shared):
    """make(width, mask, the value of a broadcast), for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return make(width, mask, shared.value)(batches)

    return run


def buckets_for(n_bytes: int) -> int:
    """How many buckets an index of texts of so many bytes in all should have: some 400,000 windows each, until there are MOST_BUCKETS."""
    return min(max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES), MOST_BUCKETS)


def remove_repeats(docs: DataFrame, width: int = 13, history: float = 0.25, scratch: Scratch | None = None, bits: int = 64, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of every row of docs (doc_id, text, ...).

    Words are runs outside [\\x20\\x09-\\x0D]; kept_text joins the kept ones by one
    space, kept_sha256 is its SHA-256; without text kept_text is null, and none is
    written.  A null text has no words.  A row without doc_id is neither history nor
    changed.  Rows that share a doc_id are one document: windows that they share are
    no repeats.  Other columns are ignored.  The table is ingested as three batches:
    the least ``history`` of the doc_ids in two halves, whose runs are compacted, and
    the rest, which is merged with them; any split gives this result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    known = docs.agg(F.percentile_approx("doc_id", [history / 2, history], 1000).alias("cuts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if known["cuts"] is None:
        return FingerprintIndex(spark, scratch.path("index"), width, 1, bits).apply(docs, spark.createDataFrame([], HITS), scratch, text=text)
    index = FingerprintIndex(spark, scratch.path("index"), width, buckets_for(known["bytes"] or 0), bits)
    low, high = known["cuts"]
    doc_id = F.col("doc_id")
    hits = index.ingest(docs.filter(doc_id <= low), scratch, "first")
    hits = hits.union(index.ingest(docs.filter((doc_id > low) & (doc_id <= high)), scratch, "second"))
    index.compact()
    hits = hits.union(index.ingest(docs.filter(doc_id > high), scratch, "rest", keep_run=False))
    index.drop()
    return index.apply(docs, hits, scratch, text=text)
