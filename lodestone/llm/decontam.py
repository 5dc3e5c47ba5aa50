"""Benchmark decontamination with DataFrame functions only.

An item's windows are its runs of ``window`` words (one run if it has fewer).
Instead of hashing every window of every document, the scan probes short grams:
a window of m words covers every stretch of m - g + 1 consecutive positions with
a g-gram that lies wholly inside it, so looking only at positions that are
multiples of that stride, and at all g-grams of the benchmark's windows, finds
each occurrence.  With m = 13 and g = 7 that is one probe per seven words.  The
probes meet the benchmark's grams in a hash join, broadcast where the grams are
measured to be small; documents with a probe hit are then compared window by
window, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, fresh, joined

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a document that are looked through at once.
STRETCH = 1024
#: Largest table of benchmark grams, in rows, that is broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The normalised words of a text, null where it is null."""
    # lower() touches other letters too, so it serves only where there are none
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _gram(m: int) -> tuple[int, int]:
    """(words in a gram, stride) for windows of m words."""
    g = (m + 1) // 2
    return g, m - g + 1


def _hashed_grams(starts: Column, g: int, m: int) -> Column:
    """Hashes of the g words from each 1-based start; m keeps the grams of different window lengths apart."""
    return F.transform(starts, lambda i: F.xxhash64(F.lit(m), F.slice("words", i, g)))


def _spans(starts: Column, m: int) -> Column:
    """(at, words): the m words from each 0-based start of a stretch, at counted over the document."""
    return F.transform(starts, lambda i: F.struct((F.col("base") + i).cast("int").alias("at"), F.slice("words", i + 1, m).alias("words")))


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """(doc_id, text_key) that tell a document's text; with the text's hash beside it, any id does for a null one."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key")


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(item_id, m, words): the distinct windows of each item; a wordless item has none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter("item_id IS NOT NULL AND size(words) > 0")
    items = items.withColumn("m", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)
    return items.select("item_id", "m", F.explode_outer(F.transform(starts, lambda i: F.slice("words", i, F.col("m")))).alias("words")).distinct()


def hit_documents(docs: DataFrame, windows: DataFrame, lengths: list[int], scratch: Scratch) -> DataFrame:
    """(doc_id, text_key) of the documents that have a gram of some window at a probed position."""
    tokens = docs.select(*_key(docs), words(F.col("text")).alias("words"))
    probes, grams = [], []
    for m in lengths:
        g, stride = _gram(m)
        # positions 1, 1 + stride, ... with a whole gram; sequence() counts down from 1 to 0, so guard short texts
        at = F.when(F.size("words") >= g, F.sequence(F.lit(1), F.size("words") - (g - 1), F.lit(stride)))
        probes.append(_hashed_grams(at, g, m))
        inside = F.sequence(F.lit(1), F.lit(m - g + 1))
        of_m = windows.filter(F.col("m") == m)
        grams.append(of_m.select(F.explode_outer(_hashed_grams(inside, g, m)).alias("gram")))
    known = grams[0]
    for other in grams[1:]:
        known = known.union(other)
    known = scratch.save(known.distinct(), "grams")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<bigint>")) for p in probes])) if len(probes) > 1 else probes[0]
    # explode() would have its input's size tested in a filter below, and there the words anew for every gram
    probed = tokens.select("doc_id", "text_key", every.alias("probes")).select("doc_id", "text_key", F.explode_outer("probes").alias("gram"))
    return probed.join(known, "gram", "left_semi").select("doc_id", "text_key").distinct()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, n_words, hit_positions array<int>, item_ids array<string>) of the documents that hold a window of an item.

    hit_positions are the 0-based positions, ascending, of the words inside any
    occurrence.  Rows without text hold nothing.  Rows that share a doc_id are taken
    apart by their text, of which text_key is the hash; a null doc_id is 0 here.  An
    empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontam")
    windows = scratch.save(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())  # at most `window` numbers
    if not lengths:
        return spark.createDataFrame([], "doc_id long, text_key long, n_words long, hit_positions array<int>, item_ids array<string>")
    suspects = scratch.save(hit_documents(docs, windows, lengths, scratch), "suspects")
    # few documents are left: here every window is compared, word for word, a stretch of the document at a time
    tokens = docs.select(*_key(docs), "text").join(suspects, ["doc_id", "text_key"]).select("doc_id", "text_key", words(F.col("text")).alias("words"))
    stretch = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRETCH)), lambda i: F.struct(i.cast("int").alias("base"), F.slice("words", i + 1, F.lit(STRETCH + window - 1)).alias("words")))
    tokens = tokens.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), stretch.alias("stretches")).select("doc_id", "text_key", "n_words", F.inline("stretches"))
    tokens = scratch.save(tokens, "tokens")
    # a window that many items share is met once, and its items are looked up once a document
    kinds = scratch.save(windows.select("m", "words").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    owners = scratch.save(windows.join(kinds, ["m", "words"]).select("kind", "item_id"), "owners", like=windows)
    found = None
    for m in lengths:
        starts = F.when(F.size("words") >= m, F.sequence(F.lit(0), F.least(F.size("words") - m, F.lit(STRETCH - 1))))
        spans = _spans(starts, m)
        each = tokens.select("doc_id", "text_key", F.inline_outer(spans))
        met = each.join(kinds.filter(F.col("m") == m).select("kind", "words"), "words")
        part = met.select("doc_id", "text_key", "kind", "at", F.lit(m).alias("m"))
        found = part if found is None else found.union(part)
    found = scratch.save(found, "found", like=tokens)
    covered = found.select("doc_id", "text_key", "at", "m").distinct().select("doc_id", "text_key", F.explode(F.expr("sequence(at, at + m - 1)")).alias("at")).distinct()
    positions = covered.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("hit_positions"))
    items = found.select("doc_id", "text_key", "kind").distinct().join(owners, "kind").select("doc_id", "text_key", "item_id").distinct()
    items = items.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    counts = tokens.select("doc_id", "text_key", "n_words").distinct()
    return positions.join(items, ["doc_id", "text_key"]).join(counts, ["doc_id", "text_key"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Every row of docs (doc_id, text) with n_words, hit_positions, item_ids and contaminated.

    contaminated: there is a hit and hits are at least ``percent`` of the words.
    A null text has no words and is clean.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    found = scratch.save(contaminated_words(docs, benchmark, window, scratch), "verdicts")
    own_id, text_key = _key(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), own_id, text_key, F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long").alias("n_words"))
    own = own.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    joined = own.join(found.drop("n_words"), ["doc_id", "text_key"], "left").drop("text_key", "doc_id").withColumnRenamed("own_id", "doc_id")
    none = F.array().cast("array<int>")
    joined = joined.withColumn("hit_positions", F.coalesce("hit_positions", none)).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    hits = F.size("hit_positions").cast("long")
    return joined.withColumn("contaminated", (hits > 0) & (hits * 100 >= F.col("n_words") * percent)).select("doc_id", "n_words", "hit_positions", "item_ids", "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that are not contaminated."""
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    found = contaminated_words(docs, benchmark, window, scratch).select("doc_id", "text_key", "n_words", F.size("hit_positions").cast("long").alias("n_hit"))
    gone_id, gone_key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = found.filter(F.col("n_hit") * 100 >= F.col("n_words") * percent).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    gone = scratch.save(gone, "gone", like=found)
    own_id, text_key = _key(docs)
    return joined(docs, gone, (own_id == F.col(gone_id)) & (text_key == F.col(gone_key)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, words): the normalised words of every row outside the hits, for span removal instead of document removal."""
    found = contaminated_words(docs, benchmark, window, scratch)
    own_id, text_key = _key(docs)
    own = docs.select(F.col("doc_id").alias("own_id"), own_id, text_key, words(F.col("text")).alias("words")).join(found, ["doc_id", "text_key"], "left")
    hits = F.coalesce("hit_positions", F.array().cast("array<int>"))
    return own.select(F.col("own_id").alias("doc_id"), F.filter("words", lambda w, i: ~F.array_contains(hits, i)).alias("words"))
