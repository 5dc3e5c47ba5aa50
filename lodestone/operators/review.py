"""Curation: structural filters, review routing, staging states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import answers

# States of resolved tickets, and resolutions that teach nothing.
RESOLVED = ("done", "closed", "resolved", "fixed", "complete", "verified")
REJECTED = ("won't fix", "wontfix", "duplicate", "cannot reproduce", "incomplete", "not a bug")


def structural_filter(tickets: DataFrame, key_pattern: str | None = None) -> DataFrame:
    """Tickets that may teach something: open ones all, resolved ones with a real resolution and two comments."""
    clean = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    resolved = clean("status").isin(*RESOLVED)
    good = ~clean("resolution").isin(*REJECTED) & (F.coalesce(F.size("comments"), F.lit(0)) >= 2)
    kept = tickets.filter(~resolved | good)
    return kept.filter(F.col("key").rlike(key_pattern)) if key_pattern else kept


def route(staged: DataFrame) -> DataFrame:
    """staged with route: pending and failed rows go on, indexed and approved ones to the audit log, the rest to the rejects."""
    s = F.col("status")
    return staged.withColumn("route", F.when(s.isin("pending", "index_error"), "queue").when(s.isin("indexed", "approve", "approved", "edit"), "log").otherwise("rejected"))


def decide(staged: DataFrame, answer: Column) -> DataFrame:
    """staged (summary, source_files, status, ...) with the decision of a reviewer's answer, the summary that is indexed, and the status that follows.

    Only pending rows are judged.  Paths that leave the tree are blocked; a row all
    of whose files are is rejected, whatever the answer.
    """
    j = answers.decision(answer)
    final = F.coalesce(F.nullif(F.get_json_object(answer, "$.final_summary"), F.lit("")), F.col("summary"))
    escapes = F.exists("source_files", lambda p: p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"))
    pending = F.col("status") == "pending"
    said = F.when(pending, F.when(escapes, "reject").otherwise(j))
    after = F.when(said == "reject", "rejected").otherwise(F.coalesce(said, F.col("status")))
    return staged.withColumn("decision", said).withColumn("summary", F.when(said.isin("approve", "edit"), final).otherwise(F.col("summary"))).withColumn("status", F.when(pending, after).otherwise(F.col("status")))


def audit_report(pairs: DataFrame, verdict: Column) -> DataFrame:
    """One row over doc and code pairs (query_id, doc_id, stale): pairs checked, stale suspects, and conflicts that the judge's verdict finds among them."""
    conflict = F.col("stale") & ~verdict["consistent"]
    return pairs.agg(F.countDistinct("query_id").alias("docs"), F.count("*").alias("pairs"), F.count_if("stale").alias("suspects"), F.count_if(conflict).alias("conflicts"))
