"""Longest-processing-time sharding of groups that must stay together.

Groups of one size are interchangeable, so the schedule needs only how many
groups there are of each size.  That histogram has at most sqrt(2 * total bytes)
rows whatever the corpus holds, and the heap runs over it on the driver; for
each size it yields how many of the size's groups each shard takes.  Everything
that has a row for each group or document stays distributed: groups get their
rank within a size from a range partitioning, rows get slots from prefix counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: monotonically_increasing_id() holds the partition above this bit and the row below it.
_ROW_BITS = 33


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (size, groups of that size), sizes descending: how many of them each shard takes.

    This is what a heap of shard loads gives when the groups are dealt one by one
    to the least-loaded shard, ties to the lowest shard.  Once loads differ by less
    than the size, the heap deals in rounds, and full rounds are dealt at once.
    """
    heap = [(0, s) for s in range(shards)]
    for size, groups in sizes:
        taken = [0] * shards
        while groups:
            if groups >= 2 * shards and max(heap)[0] - heap[0][0] < size:
                rounds = groups // shards - 1
                heap = [(load + rounds * size, s) for load, s in heap]
                taken = [t + rounds for t in taken]
                groups -= rounds * shards
            load, s = heap[0]
            # the least-loaded shard takes groups until it passes the next one
            rest = min(heap[1:], default=(load, s))
            n = 1 if rest[0] <= load else min(groups, -(-(rest[0] - load) // size))
            heapq.heapreplace(heap, (load + n * size, s))
            taken[s] += n
            groups -= n
        yield size, taken


def assign(docs: DataFrame, shards: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs (doc_id, text, ...).

    size is the text's UTF-8 bytes (null: none) plus 1.  Rows with equal texts, null
    and empty counting as equal, go to one shard.  slot numbers a shard's rows from
    0 without gaps.  Rows without doc_id or with repeated ones are rows like others.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = scratch.save(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    ranked = groups.repartitionByRange(parts, F.desc("bytes"), "digest").sortWithinPartitions(F.desc("bytes"), "digest").withColumn("at", F.monotonically_increasing_id())
    ranked = scratch.save(ranked.withColumn("part", F.shiftright("at", _ROW_BITS)), "groups")

    histogram = ranked.groupBy("bytes").count().orderBy(F.desc("bytes"))
    plan, start = [], 0
    for size, taken in schedule(((r["bytes"], r["count"]) for r in histogram.toLocalIterator()), shards):
        plan.append((size, start, list(accumulate(taken))))
        start += sum(taken)
    plan = scratch.save(spark.createDataFrame(plan, "bytes long, start long, upto array<long>"), "plan")
    counts = sorted((r["part"], r["count"]) for r in ranked.groupBy("part").count().collect())  # a row for each partition
    before = [(p, b) for (p, _), b in zip(counts, accumulate((n for _, n in counts), initial=0))]
    before = spark.createDataFrame(before, "part long, before long")

    # the bytes of a rank's own size tell where the size begins; a partition starts after `before` groups
    within = F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1) - F.col("start")
    placed = ranked.join(F.broadcast(before), "part").join(plan, "bytes").withColumn("within", within)
    placed = scratch.save(placed.select("digest", F.size(F.filter("upto", lambda c: c <= F.col("within"))).alias("shard")), "shards")

    out = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard").withColumn("at", F.monotonically_increasing_id())
    out = scratch.save(out.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(4 * parts)).cast("int")), "placed")
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.save(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")), "before")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "at"))
    numbered = out.withColumn("rank", rank).join(before, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
