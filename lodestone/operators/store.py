"""The knowledge-base store: entries to rows, idempotent upserts, purges, unions.

Tables are plain Parquet: an upsert is an anti-join with the old rows and a union,
keyed by a stable id, so running a batch again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stable_id(text: Column, *meta: Column) -> Column:
    """24 hex digits of the content and its metadata; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", text, *[F.coalesce(m, F.lit("")) for m in meta]), 256), 1, 24)


def skip_index(category: Column, value: Column) -> Column:
    """Stored but not searchable: boilerplate of low value."""
    return F.coalesce((category == "boilerplate") & (value == "low"), F.lit(False))


def source_kind(chunk_type: Column, category: Column) -> Column:
    """specification, overview, operational or reference; the category wins over the type."""
    by_type = F.when(chunk_type == "function_card", "specification").when(chunk_type.isin("file_overview", "class_overview"), "overview").otherwise("reference")
    return F.when(category == "contract", "specification").when(category == "error_handling", "operational").otherwise(by_type)


def ticket_kind(category: Column) -> Column:
    return F.when(category.isin("root_cause", "design_decision"), "rationale").when(category == "workaround", "operational").otherwise("reference")


def entry_rows(entries: DataFrame) -> DataFrame:
    """Each entry to its summary row and, if the code is longer than 30 characters, a raw-code row.

    Entries to skip and without a summary give none.
    """
    e = entries.filter(~skip_index(F.col("chunk_category"), F.col("search_value")) & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    code = F.trim(F.coalesce("raw_code", F.lit("")))
    summary = F.struct(F.trim("summary").alias("text"), F.col("chunk_type").alias("chunk_type"), source_kind(F.col("chunk_type"), F.col("chunk_category")).alias("source_kind"))
    raw = F.struct(code.alias("text"), F.lit("raw_code").alias("chunk_type"), F.lit("").alias("source_kind"))
    rows = F.when(F.length(code) > 30, F.array(summary, raw)).otherwise(F.array(summary))
    return e.select("doc_id", "source_file", "module", F.inline(rows))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_i = 1").drop("_i")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with new's rows in place of those with the same keys; a null key is a key like others."""
    new = latest(new, keys, order) if order else new.dropDuplicates(keys)
    gone = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return old.join(gone, same, "left_anti").unionByName(new, allowMissingColumns=True)


def metadata(**values: Column) -> Column:
    """map<string, string> of the values that are neither null nor empty, in order of their names."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(values.items())])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def knowledge_rows(entries: DataFrame, source_type: str) -> DataFrame:
    """entries to (id, text, meta): what a store takes in; entries to skip and without a summary give none.

    The id is that of the text and its metadata, so the same entry is one row however often it comes.
    """
    e = entries.filter(~skip_index(F.col("chunk_category"), F.col("search_value")) & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    kind = source_kind(F.col("chunk_type"), F.col("chunk_category"))
    meta = metadata(source_file=F.col("source_file"), module=F.col("module"), chunk_type=F.col("chunk_type"), source_type=F.lit(source_type), source_kind=kind, search_value=F.col("search_value"))
    rows = e.select(F.trim("summary").alias("text"), meta.alias("meta"))
    # the metadata as sorted name=value texts: a map itself has no order to hash
    return rows.select(stable_id(F.col("text"), F.array_join(F.transform(F.map_entries("meta"), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ",")).alias("id"), "text", "meta").dropDuplicates(["id"])


def replacement_id(error: Column) -> Column:
    """The id that an "already exists" error names, null if it is another error: the document to delete before the next try."""
    return F.nullif(F.regexp_extract(error, "([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}) already exists", 1), F.lit(""))


def add_to_kb(contributions: DataFrame) -> DataFrame:
    """contributions (doc_id, topic, summary, source_files, raw_code) to the rows that are indexed at once: (doc_id, text, source_file, chunk_type, status)."""
    file = F.coalesce(F.get("source_files", F.lit(0)), F.lit("unknown"))
    text = F.struct(F.concat(F.lit("["), "topic", F.lit("] "), "summary").alias("text"), F.lit("function_summary").alias("chunk_type"))
    code = F.struct(F.col("raw_code").alias("text"), F.lit("raw_code").alias("chunk_type"))
    rows = F.when(F.length(F.trim(F.coalesce("raw_code", F.lit("")))) > 30, F.array(text, code)).otherwise(F.array(text))
    return contributions.select("doc_id", file.alias("source_file"), F.lit("indexed").alias("status"), F.inline(rows))


def audit(contributions: DataFrame, path: str) -> None:
    """Append contributions to the audit log, a JSON line each, with status and time."""
    contributions.withColumn("status", F.lit("indexed")).withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def save_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str, schema: str = "path string, hash string, n_ids int") -> DataFrame:
    """What save_manifest() wrote; a missing file is empty, and so are lines that cannot be parsed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def purge(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def changed(current: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """The current rows whose hash the manifest does not have."""
    old = manifest.select(key, F.col("hash").alias("_old"))
    return current.join(old, key, "left").filter(F.coalesce("_old", F.lit("")) != F.col("hash")).drop("_old")
