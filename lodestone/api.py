"""The knowledge base as an object: search, add, status, modules; and tools by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import render
from lodestone.operators import modules, search, store
from lodestone.sources import files as source


class KnowledgeBase:
    """A store of rows (doc_id, text, source_type, module, source_file, chunk_type, embedding); every method returns a DataFrame or a new store."""

    def __init__(self, spark: SparkSession, rows: DataFrame) -> None:
        self.spark, self.rows = spark, rows

    def search(self, embedding: list[float], limit: int = 10, source_types: list[str] | None = None) -> DataFrame:
        """The best hits with their rows; filters apply before the ranking."""
        kept = self.rows.filter(F.col("source_type").isin(*source_types)) if source_types else self.rows
        one = self.spark.createDataFrame([(0, embedding)], "query_id long, embedding array<double>")
        return search.top_k(kept, one, limit).drop("query_id").join(kept.drop("embedding"), "doc_id").orderBy("rank")

    def search_codebase(self, queries: DataFrame, limit: int = 5, log: str | None = None) -> DataFrame:
        """(query_id, query, answer, num_results, approx_tokens, result_files) of queries (query_id, query, embedding).

        An answer is the hits as Markdown; where they all have one source type, it
        ends with the best row of each other type that is close.  A query without
        hits says so.  With log, a line for each query is appended there.
        """
        hits = search.top_k(self.rows, queries, limit).join(self.rows.drop("embedding"), "doc_id")
        block = render.result_block(*[F.col(c) for c in ("rank", "text", "score", "source_type")], F.lit(""), *[F.col(c) for c in ("chunk_type", "source_file", "module")])
        found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), "source_file"))).alias("h"))
        probe = search.cross_source_probe(hits, self.rows, queries).join(self.rows.select("doc_id", "source_file"), "doc_id")
        titles = {"code": "Code", "doc": "Documentation", "ticket": "Ticket knowledge"}
        name = F.coalesce(*[F.when(F.col("source_type") == k, F.lit(t)) for k, t in titles.items()], F.col("source_type"))
        line = F.concat(F.lit("- **"), name, F.lit("**: `"), F.coalesce("source_file", F.lit("?")), F.lit("`"))
        notes = probe.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("notes"))
        j = queries.select("query_id", "query").join(found, "query_id", "left").join(notes, "query_id", "left")
        none = F.array().cast("array<string>")
        blocks = F.coalesce(F.transform("h", lambda x: x["block"]), none)
        answer = F.concat_ws("\n\n", render.results_text(blocks), F.concat(F.lit("**Related knowledge in other sources:**\n"), "notes"))
        paths = F.coalesce(F.array_distinct(F.filter(F.transform("h", lambda x: x["source_file"]), lambda p: p != "")), none)
        out = j.select("query_id", "query", answer.alias("answer"), F.size(blocks).alias("num_results"), paths.alias("result_files")).withColumn("approx_tokens", F.floor(F.length("answer") / 4).cast("long"))
        if log:
            out.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(log)
        return out

    def add(self, new: DataFrame) -> KnowledgeBase:
        """A store with new's rows in place of those with the same doc_id."""
        return KnowledgeBase(self.spark, store.upsert(self.rows, new, ["doc_id"]))

    def add_to_kb(self, contributions: DataFrame, log: str | None = None) -> KnowledgeBase:
        """A store with contributions (doc_id, topic, summary, source_files, raw_code) indexed; with log, a line for each is appended there."""
        rows = store.add_to_kb(contributions).withColumn("source_type", F.lit("code")).withColumn("module", F.lit("user_contributed"))
        if log:
            store.audit(contributions, log)
        return KnowledgeBase(self.spark, store.upsert(self.rows, rows.drop("status"), ["doc_id", "chunk_type"]))

    def remove(self, ids: DataFrame) -> KnowledgeBase:
        return KnowledgeBase(self.spark, store.purge(self.rows, ids, ["doc_id"]))

    def kb_status(self) -> DataFrame:
        return self.rows.groupBy("source_type").agg(F.count("*").alias("n"))

    def list_modules(self) -> DataFrame:
        return self.rows.groupBy("module").agg(F.count("*").alias("entries"), F.countDistinct("source_file").alias("files"))

    def discover_modules(self, files: DataFrame) -> DataFrame:
        """(module, n_files): a first map of a tree (path): its top directories."""
        top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("."))
        return files.select("path").distinct().groupBy(top.alias("module")).agg(F.count("*").alias("n_files"))

    def import_modules(self, files: DataFrame, definitions: DataFrame) -> DataFrame:
        """(path, module) by definitions (dir, module, ord): the deepest directory above a path; without one, other."""
        return modules.orphan_prefix(files, definitions).select("path", "module")

    def summarize_codebase(self, files: DataFrame) -> DataFrame:
        """One row: what there is to see of a tree (path, content), as one text."""
        return source.bundle_text(files)


TOOLS = ("search", "search_codebase", "add", "add_to_kb", "remove", "kb_status", "list_modules", "discover_modules", "import_modules", "summarize_codebase")


def call_tool(kb: KnowledgeBase, name: str, **arguments):
    """A tool by its name; unknown names raise."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}: there are {', '.join(TOOLS)}")
    return getattr(kb, name)(**arguments)
