"""Entities of a knowledge base derived from the driver's tables, in Spark and, as CTEs, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import sequences as seq


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, ts, k, query, module, scope, num_results, approx_tokens, n_files)."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").withColumn("k", k)
    return e.select(
        "event_id", "ts", "k", "value",
        F.concat_ws("-", "event_type", F.col("k").cast("string")).alias("query"),
        F.col("event_type").alias("module"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("scope"),
        (F.col("k") % 6).alias("num_results"),
        (F.col("k") * 20).alias("approx_tokens"),
        F.least(F.col("k") % 6, F.lit(3)).alias("n_files"),
    )


QUERY_LOG = """qlog AS (
    SELECT event_id, ts, k, value, event_type || '-' || k AS query, event_type AS module, 'u' || (user_id % 5) AS scope,
           k % 6 AS num_results, k * 20 AS approx_tokens, least(k % 6, 3) AS n_files
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def cost_log(spark: SparkSession, d: str) -> DataFrame:
    """(agent, phase, prompt, completion, ts): token usage of runs."""
    q = table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase"))
    k = F.get_json_object("props", "$.k").cast("long")
    return q.select(F.col("event_type").alias("agent"), F.concat(F.lit("pass"), (F.col("user_id") % 4).cast("string")).alias("phase"), k.alias("prompt"), (k % 7).alias("completion"), "ts", "event_id")


COST_LOG = """clog AS (
    SELECT event_type AS agent, 'pass' || (user_id % 4) AS phase, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt,
           CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS completion, ts, event_id
    FROM events WHERE event_type IN ('signup', 'purchase'))"""


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def tickets(spark: SparkSession, d: str) -> DataFrame:
    """(key, conv_id, title, description, status, resolution, comments array<struct<turn, author, body>>)."""
    c = table(spark, d, "conversations")
    later = F.when(F.col("turn") > 0, F.struct("turn", F.col("role").alias("author"), F.col("text").alias("body")))
    g = c.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("description"),
        F.sort_array(F.collect_list(later)).alias("comments"),
    )
    status = F.element_at(F.array(*map(F.lit, ("Done", "Open", "Closed"))), (F.col("conv_id") % 3 + 1).cast("int"))
    resolution = F.element_at(F.array(*map(F.lit, ("Fixed", "Won't Fix", "", "Duplicate", "Fixed"))), (F.col("conv_id") % 5 + 1).cast("int"))
    return g.select(
        F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")).alias("key"), "conv_id",
        F.substring(F.coalesce("description", F.lit("")), 1, 40).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"), status.alias("status"), resolution.alias("resolution"), "comments",
    )


TICKETS = """tk AS (
    SELECT 'CONV-' || conv_id AS key, conv_id, substr(coalesce(description, ''), 1, 40) AS title, coalesce(description, '') AS description,
           CASE conv_id % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'Open' ELSE 'Closed' END AS status,
           CASE conv_id % 5 WHEN 0 THEN 'Fixed' WHEN 1 THEN 'Won''t Fix' WHEN 2 THEN '' WHEN 3 THEN 'Duplicate' ELSE 'Fixed' END AS resolution,
           n_comments FROM (
        SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS description, count(CASE WHEN turn > 0 THEN 1 END) AS n_comments
        FROM conversations GROUP BY conv_id))"""


def kb(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source_type, module, source_file, embedding): the vector store."""
    kind = F.element_at(F.array(*map(F.lit, ("code", "doc", "ticket"))), (F.col("label") % 3 + 1).cast("int"))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), kind.alias("source_type"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("module"),
        F.concat(F.lit("f"), (F.col("vec_id") % 97).cast("string"), F.lit(".py")).alias("source_file"), "label", "embedding",
    )


KB = """kb AS (
    SELECT vec_id AS doc_id, CASE label % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'doc' ELSE 'ticket' END AS source_type,
           'm' || label AS module, 'f' || (vec_id % 97) || '.py' AS source_file, label, embedding FROM embeddings)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Summary entries (doc_id, summary, raw_code, source_file, module, chunk_type, chunk_category, search_value, chunk_index)."""
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        F.col("text").alias("summary"),
        F.col("text").alias("raw_code"),
        F.concat_ws("/", "source", F.concat((i % 50).cast("string"), F.lit(".py"))).alias("source_file"),
        F.col("source").alias("module"),
        pick(("function_summary", "function_card", "file_overview", "class_overview", "raw"), i).alias("chunk_type"),
        pick(("algorithm", "contract", "glue", "error_handling", "data_model", "boilerplate", "unknown"), i).alias("chunk_category"),
        pick(("high", "medium", "low", ""), i).alias("search_value"),
        F.floor(i / 50).cast("long").alias("chunk_index"),
    )


def _case(values: tuple[str, ...], by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


ENTRIES = f"""en AS (
    SELECT doc_id, text AS summary, text AS raw_code, source || '/' || (doc_id % 50) || '.py' AS source_file, source AS module,
           {_case(("function_summary", "function_card", "file_overview", "class_overview", "raw"), "doc_id")} AS chunk_type,
           {_case(("algorithm", "contract", "glue", "error_handling", "data_model", "boilerplate", "unknown"), "doc_id")} AS chunk_category,
           {_case(("high", "medium", "low", ""), "doc_id")} AS search_value, CAST(floor(doc_id / 50) AS BIGINT) AS chunk_index
    FROM documents)"""


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """(path, line_no, line): a source tree made of orders (files) and lineitem (call lines)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return li.join(o, "l_orderkey").select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 20).cast("string"), F.lit("/d"), (F.col("o_custkey") % 7).cast("string"), F.lit("/f"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"),
        F.col("l_linenumber").cast("long").alias("line_no"), "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
        F.concat(F.lit("    handler_"), F.col("l_partkey").cast("string"), F.lit("(arg)")).alias("line"),
    )


CODE = """code AS (
    SELECT 'm' || (o_custkey % 20) || '/d' || (o_custkey % 7) || '/f' || l_orderkey || '.py' AS path, CAST(l_linenumber AS BIGINT) AS line_no, l_orderkey, l_partkey, l_suppkey, l_shipdate,
           '    handler_' || l_partkey || '(arg)' AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path): a file tree of orders, with directories and suffixes that scans skip."""
    o = table(spark, d, "orders")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    top = pick(DIRS, F.col("o_custkey"))
    name = pick(NAMES, F.col("o_orderkey"))
    return o.select(F.concat_ws("/", top, F.concat(F.lit("d"), (F.col("o_custkey") % 7).cast("string")), F.concat(name, F.col("o_orderkey").cast("string"), pick(SUFFIXES, F.col("o_orderkey") + F.col("o_custkey")))).alias("path"), F.col("o_orderkey").alias("file_id"))


DIRS = ("src", "lib", "build", "tests", "jtest", "latest", "contest", "vendor", "core", "mock_api", "app")
NAMES = ("f", "test_f", "conf", "util", "mod_test")
SUFFIXES = (".py", ".cpp", ".pyc", ".java", ".md", ".h", ".lock")
FILES = f"""fl AS (
    SELECT {_case(DIRS, "o_custkey")} || '/d' || (o_custkey % 7) || '/' || {_case(NAMES, "o_orderkey")} || o_orderkey || {_case(SUFFIXES, "(o_orderkey + o_custkey)")} AS path, o_orderkey AS file_id FROM orders)"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(path, hash, doc_ids): what a former run has seen of `documents`: a tenth is missing, a seventh differs."""
    t = table(spark, d, "documents").filter(F.col("doc_id") % 10 != 0)
    h = F.substring(F.sha2("text", 256), 1, 16)
    return t.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(h).alias("hash"), (F.col("doc_id") % 4 > 0).cast("int").alias("n_ids"))


def current(spark: SparkSession, d: str) -> DataFrame:
    """(path, hash, doc_id): what is there now."""
    return table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"), "doc_id")


MANIFEST = """old AS (
    SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE substr(sha256(text), 1, 16) END AS hash, CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END AS n_ids
    FROM documents WHERE doc_id % 10 <> 0), cur AS (SELECT source || '/' || doc_id AS path, substr(sha256(text), 1, 16) AS hash, doc_id FROM documents)"""


def functions(spark: SparkSession, d: str) -> DataFrame:
    """(path, chunk_index, text): overlapping windows of a source tree whose files hold the words of `documents`, a line each, in functions of some 97 lines."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\n]+"), F.lit(0))
    line = lambda w, i: F.when(i % 97 == 0, F.concat(F.lit("def f"), F.floor(i / 97).cast("string"), F.lit("(x):"))).when(i % 13 == 5, w).otherwise(F.concat(F.lit("    "), w))
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.array_join(F.transform(words, line), "\n").alias("content"))
    return seq.line_windows(files)


FUNCTIONS = r"""fnl AS (
    SELECT concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, list_transform(regexp_extract_all(coalesce(text, ''), '[^ \n]+'),
           lambda w, i: CASE WHEN (i - 1) % 97 = 0 THEN 'def f' || ((i - 1) // 97) || '(x):' WHEN (i - 1) % 13 = 5 THEN w ELSE '    ' || w END) AS lines FROM documents),
    fnw AS (SELECT path, lines, unnest(generate_series(1, greatest(len(lines), 1), 60)) AS start FROM fnl),
    fnc AS (SELECT path, (start - 1) // 60 AS chunk_index, substr(array_to_string(lines[start:start + 69], chr(10)), 1, 4000) AS text FROM fnw),
    fnx AS (SELECT *, string_split(text, chr(10)) AS ls FROM fnc WHERE trim(text) <> ''),
    fnp AS (SELECT *, nullif(regexp_extract(array_to_string(ls[1:5], chr(10)), 'def (f[0-9]+)', 1), '') AS name, trim(array_to_string(ls[1:10], chr(10))) AS head, array_to_string(ls[greatest(len(ls) - 9, 1):len(ls)], chr(10)) AS tail, coalesce(ls[11], '') LIKE ' %' AS inside FROM fnx),
    fno AS (SELECT *, lag(name) OVER o AS pname, lag(tail) OVER o AS ptail FROM fnp WINDOW o AS (PARTITION BY path ORDER BY chunk_index)),
    fng AS (SELECT path, chunk_index, text, name, CAST(sum(CASE WHEN name = pname OR (inside AND head <> '' AND contains(ptail, head)) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM fno)"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): source files of `documents` that include and import one another, by path, by place and by a name that several have."""
    i = F.col("doc_id")
    s = lambda *p: F.concat(*[F.lit(q) if isinstance(q, str) else q.cast("string") for q in p])
    name = F.when(i % 5 == 0, s("util", i % 40, ".h")).when(i % 5 == 1, s("m", i, ".py")).when(i % 5 == 2, s("m", i % 40, ".hpp")).when(i % 5 == 3, s("Cls", i % 40, ".h")).otherwise(s("sub/n", i, ".h"))
    head = s('#include "util', (i + 5) % 40, '.h"\n#include "../p0/Cls3.h"\n#include <sub/n', i + 4 - i % 5, '.h>\nimport p', F.floor(i / 80), ".m", i % 40, "\nCls", i % 90, "::run();\nimport p1\n")
    return table(spark, d, "documents").select(s("p", F.floor(i / 40), "/", name).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))


TREE = """tr AS (
    SELECT 'p' || (doc_id // 40) || '/' || CASE doc_id % 5 WHEN 0 THEN 'util' || (doc_id % 40) || '.h' WHEN 1 THEN 'm' || doc_id || '.py' WHEN 2 THEN 'm' || (doc_id % 40) || '.hpp' WHEN 3 THEN 'Cls' || (doc_id % 40) || '.h' ELSE 'sub/n' || doc_id || '.h' END AS path,
           '#include "util' || ((doc_id + 5) % 40) || '.h"' || chr(10) || '#include "../p0/Cls3.h"' || chr(10) || '#include <sub/n' || (doc_id + 4 - doc_id % 5) || '.h>' || chr(10) || 'import p' || (doc_id // 80) || '.m' || (doc_id % 40) || chr(10) || 'Cls' || (doc_id % 90) || '::run();' || chr(10) || 'import p1' || chr(10) || coalesce(text, '') AS content
    FROM documents)"""
