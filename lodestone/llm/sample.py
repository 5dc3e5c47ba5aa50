"""Bounded samples of labelled texts for the driver to fit on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The ranking hash has 64 bits, with a sign.
_LEAST, _MOST, _SPACE = -(1 << 63), (1 << 63) - 1, 1 << 64


def sampled_texts(docs: DataFrame, labelled: DataFrame, label: str, values: list, max_rows: int) -> list[Row]:
    """(doc_id, label, text), for each value of the label the max_rows ids of least hash.

    labelled (doc_id, label) decides which ids are taken, without touching texts.
    One pass counts the ids of each value; a second one brings the driver those
    whose hash is below a bound that some more than max_rows ids reach, and they
    are ranked there.  The texts of the chosen ids, at most max_rows * len(values),
    are then fetched with one join, broadcast because of that bound.  Rows without
    doc_id are never chosen; ids count once however often they occur, and an id with
    several texts gives the least of them (null if it has no other).  The order is that of
    ids, labels and texts, so a sample can be repeated.
    """
    rank = F.xxhash64("doc_id")
    rows = labelled.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    if not values or max_rows < 1:
        return []
    rows = rows.filter(F.coalesce(F.col("label").isin([v for v in values if v is not None]), F.lit(None in values)))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row for each value
    share = 1.3
    while True:
        # below the bound lie `share` times max_rows ids, give or take a few deviations; all of them where there are few
        bound = F.lit(_MOST)
        for value, n in counts.items():
            if n > 2 * max_rows + 100:
                bound = F.when(F.col("label").eqNullSafe(F.lit(value)), F.lit(min(_MOST, _LEAST + int(_SPACE * share * (max_rows + 50) / n)))).otherwise(bound)
        near = rows.withColumn("rank", rank).filter(F.col("rank") <= bound).distinct().collect()
        found = {v: sorted((r["rank"], r["doc_id"]) for r in near if r["label"] == v) for v in counts}
        if share * max_rows > 2 * max(counts.values(), default=0) or all(len(found[v]) >= max_rows or n <= 2 * max_rows + 100 for v, n in counts.items()):
            break
        share *= 4  # ids that repeat much leave less than the counts promise
    chosen = [(i, v) for v in found for _, i in found[v][:max_rows]]
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, rows.select("doc_id", "label").schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.col("text").isNull().alias("gone"), "text")).alias("least"))
    met = each.select("doc_id", F.col("label").alias(label), "least.text").collect()
    return sorted(met, key=lambda r: (r["doc_id"], str(r[label])))
