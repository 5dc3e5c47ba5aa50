"""A corpus pipeline of five stages over `documents`, each on what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
docs, whatever their names; the last one adds the token ids.  Every stage takes a
null text as an empty one and keeps rows without doc_id, unless exact dedup finds
their text elsewhere; no rows give no rows.  run() writes each stage's result as
Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, exact, minhash, sentencepiece, toxicity
from lodestone.llm.queries import TOKENIZER
from lodestone.llm.scratch import Scratch, fresh, joined, recorded


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on `labels`, scores below 0.5."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "NOT coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false)")
    score = fresh(docs, "score")
    return toxicity.score(docs, machine, score).filter(F.col(score) < 0.5).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the longest, then first one."""
    return exact.first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; a text without words is in no group."""
    scratch = Scratch(spark, "near")
    found = minhash.near_duplicates(docs, scratch=scratch).filter("NOT kept")
    gone = scratch.save(found.select("doc_id").distinct(), "gone", like=docs)
    return joined(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words lie in windows of benchmark items."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with ids, which decode to its text, round_trip and n_tokens; columns of these names are replaced."""
    coded = sentencepiece.encode(docs, sentencepiece.read_model(spark, TOKENIZER))
    return coded.withColumn("n_tokens", F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)).cast("long"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokenised),
]
#: A trained machine and a Viterbi search are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """All stages over the table `documents`.

    A stage's intermediate tables go when its result is written, the result when
    the next one is.  With root, a folder that driver and executors share, the
    last result stays there, and a run that has lost its driver goes on after the
    last stage whose result was written: give it the same root and inputs.
    """
    scratch = Scratch(spark, "pipeline", root)
    done = max((k for k in range(len(STAGES)) if scratch.has(f"stage-{k}")), default=-1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet" if done < 0 else scratch.path(f"stage-{done}"))
    for k, (_, stage) in enumerate(STAGES[done + 1 :], done + 1):
        with recorded() as made:
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        for own in made:
            own.drop()
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
