"""The build of a knowledge base: what is left to summarise, its context, cards of long functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import render
from lodestone.functions import text as x
from lodestone.operators import sequences as seq


def chunk_hash(text):
    return F.substring(F.sha2(text, 256), 1, 12)


def with_action(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """chunks (path, chunk_index, chunk, ...) with action: new, reuse (done (path, chunk_index, hash) has this content, or no hash), redo."""
    old = done.select("path", "chunk_index", F.col("hash").alias("_old"), F.lit(True).alias("_known"))
    j = chunks.join(old, ["path", "chunk_index"], "left")
    action = F.when(F.col("_known").isNull(), "new").when(F.col("_old").isNull() | (F.col("_old") == chunk_hash(F.col("chunk"))), "reuse").otherwise("redo")
    return j.withColumn("action", action).drop("_old", "_known")


def work_items(chunks: DataFrame, done: DataFrame, file_summaries: DataFrame, class_summaries: DataFrame, contexts: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, chunk_index, chunk, context): what a model has to summarise.

    New and changed chunks; of chunks of one signature the first by place only.
    The context has a line each of the file's summary (path, summary), of the class
    that the chunk declares or belongs to (path, class, summary; of its own file,
    else of any), and of the chunk's own context (path, chunk_index, context).
    """
    todo = with_action(chunks, done).filter("action <> 'reuse'").drop("action")
    owner = F.coalesce(x.class_name(F.col("chunk")), x.class_owner(F.col("chunk")))
    local = class_summaries.groupBy("path", "class").agg(F.max("summary").alias("_local"))
    anywhere = class_summaries.groupBy("class").agg(F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("_anywhere"))
    j = todo.withColumn("class", owner).join(file_summaries.select("path", F.col("summary").alias("_file")), "path", "left").join(local, ["path", "class"], "left").join(anywhere, "class", "left")
    j = j.join(contexts.select("path", "chunk_index", F.col("context").alias("_own")), ["path", "chunk_index"], "left")
    about = F.coalesce(F.nullif(F.col("_local"), F.lit("")), F.nullif(F.col("_anywhere"), F.lit("")))
    context = F.concat_ws("\n", F.nullif(F.col("_file"), F.lit("")), F.concat(F.lit("Class "), F.col("class"), F.lit(": "), about), F.nullif(F.col("_own"), F.lit("")))
    placed = j.select("path", "chunk_index", "chunk", context.alias("context"), F.struct("path", "chunk_index").alias("_place"))
    first = seq.dedup_chunks(placed, "chunk", "_place").filter(~F.col("is_duplicate")).select("path", "chunk_index", "chunk", "context")
    return first.orderBy("path", "chunk_index").limit(limit) if limit is not None else first


def function_cards(chunks: DataFrame, summaries: DataFrame, least: int = 2) -> DataFrame:
    """(path, island, name, chunk_index, summaries, code) for each function of several chunks.

    chunks (path, chunk_index, island, chunk): chunks of one island are one function,
    named by the first of them; code is theirs in order, without the middle where it
    is long; summaries (path, chunk_index, summary) are listed by chunk, and a
    function without any gets no card.  A card's own chunk_index is -3.
    """
    j = chunks.join(summaries.select("path", "chunk_index", "summary"), ["path", "chunk_index"], "left")
    said = F.when(F.col("summary").isNotNull(), F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"), F.lit(": "), "summary"))
    g = j.groupBy("path", "island").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk", said.alias("said")))).alias("c"), F.count("*").alias("n")).filter(F.col("n") >= least)
    name = F.coalesce(x.function_name(F.col("c")[0]["chunk"]), F.lit("unknown"))
    listed = F.filter(F.transform("c", lambda e: e["said"]), lambda e: e.isNotNull())
    code = F.array_join(F.transform("c", lambda e: e["chunk"]), "\n")
    return g.select("path", "island", name.alias("name"), F.lit(-3).alias("chunk_index"), listed.alias("summaries"), render.head_and_tail(code).alias("code")).filter(F.size("summaries") > 0)


#: What a model says of a function of several chunks; questions of a chunk are a list or one text.
PREPASS = "summary STRING, params ARRAY<STRING>, chunk_questions ARRAY<STRING>"


def function_contexts(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(path, chunk_index, context) for the chunks of functions of several: what their summaries should know.

    chunks (path, chunk_index, island, chunk, or name where that is known already);
    answers (path, island, answer): JSON of PREPASS, fenced or not.  Each chunk gets the function's summary, parameters and its
    own questions.  Where there is no answer, or none that can be read, the chunks
    after the first are told what they continue.
    """
    w = Window.partitionBy("path", "island").orderBy("chunk_index")
    name = F.col("name") if "name" in chunks.columns else x.function_name(F.col("chunk"))
    named = chunks.select("path", "island", "chunk_index", F.row_number().over(w).alias("i"), F.first(F.coalesce(name, F.lit("unknown"))).over(w).alias("name"))
    said = named.join(answers.select("path", "island", F.from_json(x.strip_fence(F.col("answer")), PREPASS).alias("a")), ["path", "island"], "left")
    read = F.col("a.summary").isNotNull() | F.col("a.params").isNotNull() | F.col("a.chunk_questions").isNotNull()
    several = said.withColumn("n", F.max("i").over(Window.partitionBy("path", "island"))).filter("n > 1")
    summary = F.coalesce("a.summary", F.concat("name", F.lit(": unknown purpose")))
    own = F.when(F.col("i") == 1, F.concat(F.lit("[Function: "), "name", F.lit("] "))).otherwise(F.concat(F.lit("[Continuation of "), "name", F.lit("()] ")))
    params = F.when(F.size("a.params") > 0, F.concat(F.lit("Parameters: "), F.array_join("a.params", "; ")))
    asked = F.get("a.chunk_questions", F.col("i") - 1)
    questions = F.when(F.startswith(asked, F.lit("[")), F.array_join(F.from_json(asked, "ARRAY<STRING>"), "; ")).otherwise(asked)
    full = F.concat_ws("\n", F.concat(own, summary), params, F.concat(F.lit("Focus on: "), F.nullif(questions, F.lit(""))))
    fallback = F.when(F.col("i") > 1, F.concat(F.lit("[Continuation of "), "name", F.lit("()]")))
    return several.select("path", "chunk_index", F.when(F.coalesce(read, F.lit(False)), full).otherwise(fallback).alias("context")).filter("context IS NOT NULL")


def import_map(files: DataFrame, assigned: DataFrame, definitions: DataFrame) -> DataFrame:
    """(module, n_files, coverage): the files of each definition (module, ...), also of those without any, and of "other"; coverage is the whole per cent of files that have a definition."""
    placed = files.select("path").distinct().join(assigned.select("path", "module"), "path", "left")
    counted = placed.groupBy(F.coalesce("module", F.lit("other")).alias("module")).agg(F.count("*").alias("n_files"))
    every = definitions.select("module").distinct().join(counted, "module", "full").select("module", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))
    total = counted.agg(F.sum("n_files").alias("_all"), F.sum(F.when(F.col("module") != "other", F.col("n_files")).otherwise(0)).alias("_own"))
    return every.crossJoin(F.broadcast(total)).select("module", "n_files", F.coalesce(F.floor(F.try_divide(F.col("_own") * 100, F.col("_all"))), F.lit(0)).cast("long").alias("coverage"))  # one row
