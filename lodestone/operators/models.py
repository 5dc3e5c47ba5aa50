"""The boundary to language models: protocols, deterministic defaults, batched calls with retries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A call maps texts to answers, in order; it may raise.
Call = Callable[[list[str]], list[str]]


def fallback_doc_summary(text: Column) -> Column:
    """What stands for a summary where no model is plugged in."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 300)


def fallback_code_summary(path: Column, chunk: Column) -> Column:
    return F.concat(F.lit("["), path, F.lit(" chunk "), chunk.cast("string"), F.lit("]"))


def lesson_allowed(summary: Column, solution: Column, text: Column, least: int = 30) -> Column:
    return (F.coalesce(summary, F.lit("")) != "") & (F.coalesce(solution, F.lit("")) != "") & (F.length(F.coalesce(text, F.lit(""))) >= least)


def call_model(rows: DataFrame, column: str, call: Call, attempts: int = 3, trim: float = 0.15, per_minute: float | None = None, workers: int = 4) -> DataFrame:
    """rows with answer and status (ok, failed or skipped): call on each batch's texts.

    A batch that fails is tried again row by row, each time with the text cut by
    `trim` more; an error that names a quota skips the rest of the partition.
    per_minute limits the calls of the whole job: rows are dealt to so many workers,
    and each has its share.  Columns answer and status in rows are replaced.
    """
    rows = rows.drop("answer", "status")
    if per_minute:
        rows, per_minute = rows.repartition(workers), per_minute / workers
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, last = False, 0.0

        def one(text: str) -> tuple[str | None, str]:
            nonlocal spent, last
            for k in range(attempts):
                if spent:
                    return None, "skipped"
                if per_minute:
                    time.sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                    last = time.monotonic()
                try:
                    return call([text[: int(len(text) * (1 - trim * k))]])[0], "ok"
                except Exception as e:  # the boundary: whatever a model client raises
                    spent = "quota" in str(e).lower()
            return None, "skipped" if spent else "failed"

        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            answers: list[tuple[str | None, str]]
            try:
                answers = [(a, "ok") for a in call(texts)] if not (spent or per_minute) else [one(t) for t in texts]
            except Exception:
                answers = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.string())], names=[*batch.schema.names, "answer", "status"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("status", StringType())]))


def edit_rate(reviewed: DataFrame) -> DataFrame:
    """One row: reviews, edits and their share."""
    return reviewed.agg(F.count("*").alias("reviews"), F.count_if("edited").alias("edits"), F.coalesce(F.try_divide(F.count_if("edited").cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("rate"))


#: A model that uses tools: messages and tools to (text, calls), a call being (name, arguments).
Speaker = Callable[[list[dict], list[str]], tuple[str, list[tuple[str, dict]]]]
#: What a tool answers to end the loop with its arguments.
ACCEPTED = "__ACCEPTED__"


def tool_loop(speak: Speaker, messages: list[dict], tools: dict[str, Callable[..., object]], terminal: tuple[str, ...] = (), max_rounds: int = 10, trim: float = 0.15) -> tuple[list[dict], dict | None]:
    """(conversation, arguments): let a model call tools until it calls a terminal one, a tool accepts, or it stops calling.

    Arguments are those of the call that ended the loop, null if the model only
    talked or used up its rounds.  A terminal tool is not run.  An unknown tool and
    one that fails answer with the error.  Where the model says that the context is
    too long, the longest user message is cut, twice at most, for that round.
    """
    talk = list(messages)
    for _ in range(max_rounds):
        said = talk
        for attempt in range(1, 4):
            try:
                text, calls = speak(said, list(tools))
                break
            except Exception as e:
                if attempt == 3 or not any(x in str(e).lower() for x in ("context length", "maximum context", "too many tokens")):
                    raise
                said = _shortened(talk, trim * attempt)
        talk.append({"role": "assistant", "content": text, "calls": calls})
        if not calls:
            break
        for name, arguments in calls:
            if name in terminal:
                return talk, arguments
            try:
                answer = str(tools[name](**arguments))
            except KeyError:
                answer = f"error: unknown tool {name}"
            except Exception as e:
                answer = f"error: {e}"
            talk.append({"role": "tool", "name": name, "content": answer})
            if answer == ACCEPTED:
                return talk, arguments
    return talk, None


def _shortened(talk: list[dict], fraction: float) -> list[dict]:
    """talk with its longest user message cut by fraction."""
    mine = [k for k, m in enumerate(talk) if m["role"] in ("user", "human")]
    if not mine:
        return talk
    k = max(mine, key=lambda i: len(talk[i]["content"]))
    kept = talk[k]["content"][: int(len(talk[k]["content"]) * (1 - fraction))]
    return [*talk[:k], talk[k] | {"content": kept + "\n[...truncated to fit context window...]"}, *talk[k + 1 :]]


def with_loops(rows: DataFrame, column: str, speak: Speaker, tools: dict[str, Callable[..., object]], terminal: tuple[str, ...], answer: str, max_rounds: int = 10) -> DataFrame:
    """rows with answer: of a tool loop on each row's prompt the argument of that name, null where the loop ended without one."""
    rows = rows.drop("answer")
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [tool_loop(speak, [{"role": "user", "content": t or ""}], tools, terminal, max_rounds)[1] for t in batch.column(at).to_pylist()]
            found = [None if e is None or e.get(answer) is None else str(e[answer]) for e in ends]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "answer"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


#: Words whose slots a task remembers.
REMEMBERED = 100_000


def word_slot(word: str, size: int = 64) -> int:
    """A word's place in the offline embedding: the first hex digits of its MD5."""
    return int(hashlib.md5(word.encode()).hexdigest()[:2], 16) * size // 256


def hashed_embedding(texts: DataFrame, size: int = 64) -> DataFrame:
    """texts (doc_id, text, ...) to (doc_id, embedding): counts of a text's words (at white space, in lower case) by hash, the offline default; a null or empty text is all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            counts = np.zeros((batch.num_rows, size))
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w in (text or "").lower().split():
                    if w not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = word_slot(w, size)
                    counts[i, known[w]] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(counts.ravel()))], names=["doc_id", "embedding"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, embedding array<double>")


def reviewed(entries: DataFrame, score: Column, call: Call, least: float = 0.15) -> DataFrame:
    """entries (doc_id, summary, ...) with the summaries that a reviewer improves, and edited; only those that score at least `least` are shown to it."""
    from lodestone.functions import answers

    due = F.col("_due")
    marked = entries.withColumn("_due", score >= least)
    shown = call_model(marked.filter(due), "summary", call).withColumn("_new", answers.review(F.col("answer"))).drop("answer", "status")
    done = shown.withColumn("edited", F.col("_new").isNotNull()).withColumn("summary", F.coalesce("_new", "summary")).drop("_new")
    return done.unionByName(marked.filter(~due).withColumn("edited", F.lit(False))).drop("_due")
