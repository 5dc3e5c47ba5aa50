"""Wiki spaces: which pages of a listing to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import paged


def listing(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    """The pages of a space that a paged interface lists, with the fields of schema; its pages are fetched side by side."""
    paged.register(spark)
    raw = spark.read.format("paged").options(url=url, **options).load()
    return raw.select(F.from_json("value", schema).alias("x")).select("x.*")


def pages_to_fetch(listing: DataFrame, manifest: DataFrame, include: str | None = None, exclude: str | None = None, max_pages: int = 500) -> DataFrame:
    """The rows of listing (page_id, title, version, ...) to fetch.

    Of the first max_pages pages (the limit comes before the patterns) those whose
    title matches include, does not match exclude, in any case, and whose version
    is not the one that the manifest (page_id, version) has.
    """
    kept = listing.orderBy("page_id").limit(max_pages)
    if include:
        kept = kept.filter(F.col("title").rlike(f"(?i){include}"))
    if exclude:
        kept = kept.filter(~F.col("title").rlike(f"(?i){exclude}"))
    return kept.join(manifest.select("page_id", "version"), ["page_id", "version"], "left_anti").select(*listing.columns)
