"""Near-duplicate detection: universal hash minima, banding, verification, components.

1. One scan turns each text into its set of distinct word shingles and keeps the
   set's size, a 128-bit fingerprint, minima under ``bands * rows`` universal hash
   functions (hashed into one key a band) and a sketch of 4 bits a minimum.
2. Equal sets collapse to their least id, so copies never meet as pairs.
3. A bucket's least id leads it.  Each member and the leader with which it shares
   most buckets are compared by sketch, then verified on full sets, and members
   of one leader get one label.
4. In buckets that hold several labels, members without the label that most have are compared in blocks with each other and
   with those that have it, by a finer sketch (2,048 minima, one bit each), and what passes is verified on full sets.  Pairs
   of one label need no check: they are connected.  Components of all verified links follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textscan as ts
from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch

#: bands * rows minima. A pair of similarity 0.75 is missed with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
BANDS, ROWS = 32, 4
#: Sketch words of 16 minima, 4 bits each.
SKETCH = BANDS * ROWS // 16
#: Minima of the fine sketch, one bit each, of members of buckets that hold several components.
FINE = 2048
#: Members of a bucket that one task compares with each other at once.
BLOCK = 256


def sketch_limit(similarity: float, minima: int = BANDS * ROWS, deviations: float = 5.5) -> int:
    """Differing minima up to which a pair may have the similarity: 4 bits agree by chance once in 16."""
    differ = (1 - similarity) * 15 / 16
    return int(minima * differ + deviations * (minima * differ * (1 - differ)) ** 0.5)


def shingle_sets(texts: ts.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes[first[i]:first[i + 1]] are the sorted distinct shingle hashes of text i."""
    found = ts.words(texts)
    hashes = ts.word_hashes(texts, found, ts.LOWER)
    counts = found.counts
    per_text = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_text, out=first[1:])
    start = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], per_text)
    end = np.minimum(start + width, np.repeat(found.first[1:], per_text))
    runs = ts.run_hashes(hashes, start, end)
    sets = [np.unique(runs[first[i] : first[i + 1]]) for i in range(len(counts))]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return (np.concatenate(sets) if sets else runs), out


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of a * x + b modulo 2**64 over the set, for each (a, b)."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 4096):
        part = np.multiply.outer(a, values[k : k + 4096])
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ts.seeded(BANDS * ROWS, 11) | np.uint64(1)
        b = ts.seeded(BANDS * ROWS, 13)
        shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :]
        names = ts.seeded(BANDS, 17)
        for batch in batches:
            ids = batch.column(0)
            for texts in ts.chunks(batch.column(1)):
                values, first = shingle_sets(texts, width)
                n = len(texts)
                sizes = np.diff(first)
                prints = np.zeros((2, n), np.uint64)
                sums = np.zeros(len(values) + 1, np.uint64)
                for k, v in enumerate((values, ts.mix(values + np.uint64(0x51ED2701)))):
                    np.cumsum(v, out=sums[1:])
                    prints[k] = ts.mix(sums[first[1:]] - sums[first[:-1]])
                low = np.zeros((n, BANDS * ROWS), np.uint64)
                for i in np.flatnonzero(sizes):
                    low[i] = _minima(values[first[i] : first[i + 1]], a, b)
                keys = np.zeros((n, BANDS), np.uint64)
                rows = low.reshape(n, BANDS, ROWS)
                for r in range(ROWS):
                    keys = ts.mix(keys ^ rows[:, :, r])
                keys ^= names[None, :]
                bits = (ts.mix(low) >> np.uint64(60)).reshape(n * SKETCH, 16)
                sketch = np.bitwise_or.reduce(bits << shifts, axis=1)
                offsets = lambda w: pa.array(np.arange(n + 1, dtype=np.int32) * w)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(texts.first_row, n),
                        pa.array(sizes),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(offsets(BANDS), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(offsets(SKETCH), pa.array(sketch.view(np.int64))),
                    ],
                    schema=_SIGNED,
                )

    return sign


FINE_SKETCH = "rep long, n long, fine array<long>"


def _fine_signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ts.seeded(FINE, 19) | np.uint64(1), ts.seeded(FINE, 29)
        for batch in batches:
            for texts in ts.chunks(batch.column(1)):
                values, first = shingle_sets(texts, width)
                n = len(texts)
                bits = np.zeros((n, FINE), np.uint8)
                for i in range(n):
                    for k in range(0, FINE, 256):
                        low = _minima(values[first[i] : first[i + 1]], a[k : k + 256], b[k : k + 256])
                        bits[i, k : k + 256] = ts.mix(low) >> np.uint64(63)
                packed = np.packbits(bits, axis=1).reshape(-1).view(np.int64)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (FINE // 64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first_row, n), pa.array(np.diff(first)), pa.ListArray.from_arrays(offsets, pa.array(packed))], names=["rep", "n", "fine"])

    return sign


def fine_limit(similarity: float, deviations: float = 5.5) -> int:
    """Differing bits of the fine sketch up to which a pair may have the similarity: bits agree by chance once in 2."""
    differ = (1 - similarity) / 2
    return int(FINE * differ + deviations * (FINE * differ * (1 - differ)) ** 0.5)


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ts.chunks(batch.column(1)):
                values, first = shingle_sets(texts, width)
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(first * 8), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first_row, len(texts)), sets.cast(pa.binary())], names=["id", "hashes"])

    return make


def _linker(similarity: float):
    percent = round(similarity * 100)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int(np.count_nonzero(q[at] == p))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return link


def _differing(x: str, y: str) -> Column:
    """Of the minima, how many sketches differ."""
    total = F.lit(0)
    for k in range(SKETCH):
        d = f"({x}[{k}] ^ {y}[{k}])"
        total = total + F.expr(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & 1229782938247303441L)")
    return total


def deal(mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, rep, component, i, j, block) of the members of mixed (band, rep, component) in buckets of several components.

    Each pair of blocks (i, j) meets once; a bucket's most frequent component is in
    blocks of its own, which meet the others only, so a crowd with one stray is
    dealt in proportion to its size, not to its square.
    """
    labels = mixed.groupBy("band", "component").agg(F.count("*").alias("n"))
    bands = labels.groupBy("band").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    bands = bands.select("band", F.col("most.component").alias("major"), blocks(F.col("size") - F.col("most.n")).alias("few"), blocks(F.col("most.n")).alias("many"))
    rows = scratch.save(mixed.join(scratch.save(bands, "mixed-bands"), "band"), "mixed-rows", like=mixed)
    major, hashed = F.col("component") == F.col("major"), F.xxhash64("rep")
    block = F.when(major, F.col("few") + F.pmod(hashed, "many")).otherwise(F.pmod(hashed, "few")).cast("int")
    others = F.sequence(F.lit(0), F.when(major, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    each = rows.withColumn("block", block).withColumn("other", F.explode(others))
    return each.select("band", "rep", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


DEALT = ["band", "i", "j", "block", "rep", "component", "n", "fine", "bands"]


def _crosser(similarity: float):
    """Rows sorted by (band, i, j) to pairs (a, b) of different labels whose fine sketches allow the similarity.

    Blocks i < j are compared with each other, i = j within; a pair comes out of
    the first bucket that it shares only.  Memory is bounded by two blocks.
    """
    limit = fine_limit(similarity)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def group(band: int, within: bool, block, rep, label, n, fine, bands) -> tuple[np.ndarray, np.ndarray]:
        if within:
            x, y = np.triu_indices(len(rep), 1)
        else:
            first = block == block.min()
            x, y = (k.ravel() for k in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
        ok = (label[x] != label[y]) & (rep[x] != rep[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * (similarity - 1e-9))
        x, y = x[ok], y[ok]
        found = []
        for k in range(0, len(x), 20_000):
            p, q = x[k : k + 20_000], y[k : k + 20_000]
            near = np.bitwise_count((fine[p] ^ fine[q]).view(np.uint64)).sum(axis=1, dtype=np.int32) <= limit
            p, q = p[near], q[near]
            same = bands[p] == bands[q]
            here = bands[p, same.argmax(axis=1)] == band
            found.append((p[here], q[here]))
        x, y = (np.concatenate([f[k] for f in found]) if found else x[:0] for k in (0, 1))
        return np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            table = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
            if table is None or not table.num_rows:
                continue
            band, i, j, block, rep, label, n = (table.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            fine, bands = matrix(table.column(7)), matrix(table.column(8))
            cuts = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = np.concatenate(([0], cuts, [len(band)] if batch is None else []))  # the last group may go on
            pairs = []
            for s, e in zip(cuts[:-1].astype(int), cuts[1:].astype(int)):
                if e - s > 1:
                    pairs.append(group(band[s], i[s] == j[s], block[s:e], rep[s:e], label[s:e], n[s:e], fine[s:e], bands[s:e]))
            rest = None if batch is None else table.slice(int(cuts[-1]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], names=["a", "b"])

    return cross


def _sizes_allow(x: str, y: str, similarity: float) -> Column:
    return F.least(f"n_{x}", f"n_{y}") >= F.greatest(f"n_{x}", f"n_{y}") * F.lit(similarity - 1e-9)


def _may_link(x: str, y: str, similarity: float) -> Column:
    """Sizes and sketches allow the similarity."""
    return _sizes_allow(x, y, similarity) & (_differing(f"sketch_{x}", f"sketch_{y}") <= sketch_limit(similarity))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.75, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text, ...).

    Words are runs of characters outside [\\x20\\x09-\\x0D] with A-Z lower-cased.  A
    null or wordless text has no shingles and links with nothing.  Rows that share
    a doc_id are one document that links by any of their texts; n_shingles is each
    row's own.  A row without doc_id is no document: its component_id is null and
    it is kept.  Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(texts.mapInArrow(ts.thrifty(_signer(width)), SIGNED), "signed")
    filled = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]

    sets = scratch.save(filled.groupBy(*key).agg(F.min("doc_id").alias("rep")), "sets")
    owned = scratch.save(filled.join(sets, key), "owned", like=signed)
    reps = owned.filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "bands", "sketch")

    rows = reps.select(F.explode("bands").alias("band"), "rep")
    shared = scratch.save(rows.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).filter("size > 1"), "shared")
    buckets = scratch.save(rows.join(shared, "band"), "buckets", like=signed)

    def side(x: str) -> DataFrame:
        return reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    # of each member's leaders the one with which it shares most buckets
    stars = buckets.filter("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("shared"))
    stars = stars.groupBy("rep").agg(F.max(F.struct("shared", F.bitwise_not("leader").alias("reversed"))).alias("best"))
    stars = scratch.save(stars.select(F.bitwise_not("best.reversed").alias("a"), F.col("rep").alias("b")), "stars")
    first = scratch.save(stars.join(side("b"), "b"), "stars-b", like=signed).join(side("a"), "a").filter(_may_link("a", "b", similarity)).select("a", "b")
    first = scratch.save(first, "first", like=signed)
    links = _verified(texts, first, width, similarity, scratch, "first")

    # the same id with several texts
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc_id")
    several = owned.select("doc_id", "rep").join(several, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = links.union(scratch.save(several.filter("a <> b").distinct(), "several", like=signed))

    # verified leaders lead down to smaller ids: two jumps give members that share a leader one label
    parent = links.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("up"))
    parent = scratch.save(parent, "parent")
    up = parent.select(F.col("id").alias("up"), F.col("up").alias("upper"))
    found = scratch.save(parent.join(up, "up", "left").select("id", F.coalesce("upper", "up").alias("up")).join(up, "up", "left").select("id", F.coalesce("upper", "up").alias("component")), "found", like=parent)

    # buckets that may still hold several components
    mixed = buckets.select("band", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    mixed = scratch.save(mixed.withColumn("component", F.coalesce("component", "rep")), "mixed", like=buckets)
    dealt = deal(mixed, scratch)
    ids = scratch.save(scratch.read("mixed-rows", "rep long").select(F.col("rep").alias("doc_id")).distinct(), "mixed-ids")
    fine = scratch.save(texts.join(ids, "doc_id").mapInArrow(ts.thrifty(_fine_signer(width)), FINE_SKETCH), "fine", like=texts).filter("n > 0")
    dealt = dealt.join(fine, "rep").join(reps.select("rep", "bands"), "rep")
    dealt = dealt.select(*DEALT).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    rest = dealt.mapInArrow(ts.thrifty(_crosser(similarity)), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    rest = scratch.save(rest, "rest", like=buckets)
    scratch.drop("stars", "stars-b", "mixed", "mixed-rows", "mixed-bands", "mixed-ids", "fine", "shared", "buckets")
    more = _verified(texts, rest, width, similarity, scratch, "rest")
    found = scratch.save(components(links.union(more), scratch, "cc"), "components")
    scratch.drop("first", "first-links", "rest", "rest-links", "several", "parent", "found")

    empty = signed.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = owned.select("doc_id", "n_shingles", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    every = joined.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).union(empty)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _verified(texts: DataFrame, pairs: DataFrame, width: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of doc_ids of which a text each has the similarity, on full shingle sets."""
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    made = texts.join(ids, "doc_id").mapInArrow(ts.thrifty(_set_maker(width)), "id long, hashes binary")
    full = scratch.save(made.filter("length(hashes) > 0"), f"{name}-sets", like=texts)  # an id may have an empty text beside another
    met = pairs.join(full.toDF("a", "hashes_a"), "a").join(full.toDF("b", "hashes_b"), "b").select("a", "b", "hashes_a", "hashes_b")
    links = scratch.save(met.mapInArrow(ts.thrifty(_linker(similarity)), "a long, b long"), f"{name}-links", like=full)
    scratch.drop(f"{name}-ids", f"{name}-sets")
    return links
