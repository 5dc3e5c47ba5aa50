"""Model answers, which are texts that should be JSON, as typed columns with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip_fence


def _parsed(answer: Column, schema: str) -> Column:
    """The answer as a struct, null if it is no JSON object."""
    bare = strip_fence(answer)
    # a permissive parse gives a struct of nulls for what is no object
    return F.when(F.get_json_object(bare, "$").startswith("{"), F.from_json(bare, schema))


def extraction(answer: Column) -> Column:
    """struct<useful, summary, solution, category> of a ticket; no JSON is useless and has no category."""
    j = _parsed(answer, "useful boolean, summary string, solution string, category string")
    text = lambda c, d="": F.when(j.isNull(), "").otherwise(F.coalesce(c, F.lit(d)))
    return F.struct(F.coalesce(j["useful"], F.lit(False)).alias("useful"), text(j["summary"]).alias("summary"), text(j["solution"]).alias("solution"), text(j["category"], "general").alias("category"))


def doc_summary(answer: Column, text: Column) -> Column:
    """struct<summary, source_kind> of a document's chunk; without an answer its first 300 characters, for one that is no JSON the first 200."""
    j = _parsed(answer, "summary string, source_kind string")
    summary = F.when(answer.isNull(), F.substring(text, 1, 300)).when(j.isNull(), F.trim(F.substring(text, 1, 200))).otherwise(F.coalesce(j["summary"], F.lit("")))
    return F.struct(summary.alias("summary"), F.coalesce(j["source_kind"], F.lit("overview")).alias("source_kind"))


def code_summary(answer: Column, path: Column, chunk: Column) -> Column:
    """struct<summary, category, value> of a chunk of code; without a usable answer its place, unknown, low."""
    j = _parsed(answer, "summary string, category string, search_value string")
    place = F.concat(F.lit("["), path, F.lit(" chunk "), chunk.cast("string"), F.lit("]"))
    good = j["summary"].isNotNull()
    return F.struct(F.coalesce(j["summary"], place).alias("summary"), F.when(good, F.coalesce(j["category"], F.lit("unknown"))).otherwise("unknown").alias("category"), F.when(good, F.coalesce(j["search_value"], F.lit("low"))).otherwise("low").alias("value"))


def review(answer: Column) -> Column:
    """The improved summary of a review that does not keep the old one, null otherwise or if it is no JSON."""
    j = _parsed(answer, "keep boolean, improved string")
    return F.when(~F.coalesce(j["keep"], F.lit(False)), F.nullif(F.trim(j["improved"]), F.lit("")))


def verdict(answer: Column) -> Column:
    """struct<consistent, explanation> of a judge; what cannot be parsed is flagged."""
    j = _parsed(answer, "consistent boolean, explanation string")
    broken = F.struct(F.lit(False).alias("consistent"), F.lit("LLM response was unparseable; flagging for manual review").alias("explanation"))
    return F.when(j.isNull(), broken).otherwise(F.struct(F.coalesce(j["consistent"], F.lit(True)).alias("consistent"), F.coalesce(j["explanation"], F.lit("")).alias("explanation")))


def decision(answer: Column) -> Column:
    """approve, edit or reject: the first of them that the answer's decision contains; anything else is a reject."""
    said = F.lower(F.trim(F.coalesce(_parsed(answer, "decision string")["decision"], F.lit("reject"))))
    return F.when(F.contains(said, F.lit("approve")), "approve").when(F.contains(said, F.lit("edit")), "edit").otherwise("reject")
