"""Order-dependent operators: windows, gaps and islands, budgets, first and last of a key.

Every operator takes the columns that order its rows, so results do not depend
on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, cap: int, max_rows: int | None = None) -> DataFrame:
    """rows with within: whether the running total of size up to the row is at most cap; of each key at most max_rows rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_idx", F.row_number().over(w))
    if max_rows is not None:
        ranked = ranked.filter(F.col("_idx") <= max_rows)
    total = F.sum(size).over(Window.partitionBy(*keys).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("within", total <= cap).drop("_idx")


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_idx = 1").drop("_idx")


def islands(rows: DataFrame, keys: list[str], order: list[str], continues: Column) -> DataFrame:
    """rows with island: numbers runs of rows of a key that continue the one before (an expression over _prev)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    started = rows.withColumn("_prev", F.lag(F.struct(*rows.columns)).over(w))
    start = F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)
    return started.withColumn("_start", start).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_prev", "_start")


def line_windows(files: DataFrame, step: int = 60, length: int = 70, max_chars: int = 4000) -> DataFrame:
    """(path, chunk_index, text): overlapping windows of lines, blank ones dropped, cut to max_chars."""
    x = files.select("path", F.split("content", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(step))
    # a window's row holds its own text, not all lines of the file
    texts = F.transform(starts, lambda s: F.substring(F.array_join(F.slice("lines", s, length), "\n"), 1, max_chars))
    each = x.select("path", F.posexplode(texts).alias("chunk_index", "text"))
    return each.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), "text").filter(F.trim(F.col("text")) != "")


def function_groups(chunks: DataFrame, name: Column, keys: list[str], order: str, text: str = "text", overlap: int = 10, named: str | None = None) -> DataFrame:
    """chunks with island, which numbers the functions of a key in order, each of one chunk or several.

    A chunk goes on with the function of the one before if both have the same name, or
    if its first ``overlap`` lines, white space around them aside, stand within the
    last ones of the chunk before and the line after them is indented.  name is an
    expression over a chunk; a chunk of no more lines than overlap goes on by name only.
    With named, the chunk's own name stays as a column of that name.
    """
    lines = F.filter(F.split(F.regexp_replace(F.col(text), r"\n$", ""), r"\r\n|\n|\r"), lambda x: x.isNotNull())
    join = lambda x: F.array_join(x, "\n")
    last = F.slice("_lines", F.greatest(F.size("_lines") - (overlap - 1), F.lit(1)), F.lit(overlap))
    said = chunks.withColumn("_lines", lines).withColumns({
        "_name": name, "_head": stripped(join(F.slice("_lines", 1, overlap))), "_tail": join(last), "_inside": F.coalesce(F.get("_lines", F.lit(overlap)).rlike(r"^[ \t]"), F.lit(False)),
    }).drop("_lines")
    w = Window.partitionBy(*keys).orderBy(order)
    before = said.withColumn("_prev", F.lag(F.struct("_name", "_tail")).over(w))
    overlaps = F.col("_inside") & (F.col("_head") != "") & F.contains(F.col("_prev._tail"), F.col("_head"))
    start = F.when(F.coalesce((F.col("_prev._name") == F.col("_name")), F.lit(False)) | F.coalesce(overlaps, F.lit(False)), 0).otherwise(1)
    numbered = before.withColumn("_start", start).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.withColumnRenamed("_name", named) if named else numbered.drop("_name")).drop("_head", "_tail", "_inside", "_prev", "_start")


def stripped(text: Column) -> Column:
    """A text without white space of any script before and behind it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def document_chunks(sections: Column, text: Column, max_chars: int = 4000) -> Column:
    """array<struct<heading, text>> of a document's sections (heading, level, content): one that fits is one chunk, a longer one is packed; without headings the whole text is.

    A document always has one chunk.
    """
    one = lambda t, h: F.struct(h.alias("heading"), t.alias("text"))
    packed = lambda t, h: F.transform(pack_paragraphs(t, max_chars), lambda c: one(c, h))
    own = F.flatten(F.transform(F.filter(sections, lambda s: stripped(s["content"]) != ""), lambda s: F.when(F.length(stripped(s["content"])) <= max_chars, F.array(one(stripped(s["content"]), s["heading"]))).otherwise(packed(stripped(s["content"]), s["heading"]))))
    found = F.when(F.exists(sections, lambda s: s["level"] > 0), own).otherwise(packed(stripped(text), F.lit("")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(one(F.substring(F.coalesce(text, F.lit("")), 1, max_chars), F.lit(""))))


def pack_paragraphs(text: Column, max_chars: int, delimiter: str = "\n\n", joiner: str = "\n\n") -> Column:
    """array<string>: paragraphs, set apart by blank lines, packed greedily into chunks of at most max_chars; longer ones are cut into pieces first."""
    parts = F.filter(F.transform(F.split(text, delimiter), stripped), lambda p: p != "")
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / max_chars).cast("int")), lambda i: F.substring(p, i * max_chars + 1, F.lit(max_chars)))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, piece: Column) -> Column:
        fits = F.length(state["now"]) + len(joiner) + F.length(piece) <= max_chars
        empty = state["now"] == ""
        return F.when(empty, F.struct(state["done"].alias("done"), piece.alias("now"))).when(fits, F.struct(state["done"].alias("done"), F.concat(state["now"], F.lit(joiner), piece).alias("now"))).otherwise(F.struct(F.array_append(state["done"], state["now"]).alias("done"), piece.alias("now")))

    return F.aggregate(pieces, zero, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def dedup_chunks(chunks: DataFrame, text: str, order: str) -> DataFrame:
    """chunks with first_id, the first row (by order) of equal signature, and is_duplicate.

    The signature is the hash of the trimmed text, its number of words and of lines.
    """
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    signed = chunks.withColumn("_sha", F.substring(F.sha2(F.trim(F.col(text)), 256), 1, 16)).withColumn("_words", words).withColumn("_lines", F.size(F.split(F.col(text), "\n")))
    first = signed.groupBy("_sha", "_words", "_lines").agg(F.min(order).alias("first_id"))
    joined = signed.join(first, ["_sha", "_words", "_lines"])
    return joined.withColumn("is_duplicate", F.col(order) != F.col("first_id")).drop("_sha", "_words", "_lines")
