"""Queries on streams, model boundaries and the API."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestone.api import KnowledgeBase, call_tool
from lodestone.functions import answers
from lodestone.functions import text as x
from lodestone.operators import explore, models
from lodestone.operators.store import skip_index
from lodestone.plans import catalog_text as t
from lodestone.plans import views as v
from lodestone.plans.registry import folder, query
from lodestone.streaming import flows


def _stream(spark, d, name):
    t = v.table(spark, d, name)
    return spark.readStream.schema(t.schema).parquet(f"{d}/{name}.parque[t]")  # a glob: the file source takes a single file only so


@query("stm_append_log", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm_append_log(spark, d):
    """The log as a stream, counted by hour of event time: each batch writes the windows that it has changed, and the last count of each is read back."""
    at = folder(spark)

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    flows.hourly(_stream(spark, d, "events")).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    return flows.latest_counts(rows).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("stm_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stm_session(spark, d):
    """The log as a stream of three runs of one checkpoint, the last a heartbeat that closes what is open; each batch writes the sessions that it closes."""
    at, e = folder(spark), v.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    half = e.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5, 1000).alias("t")).first()["t"]
    heartbeat = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast(e.schema["user_id"].dataType).alias("user_id"), "ts", F.lit("heartbeat").alias("kind"))
    early = F.col("ts").cast("double") <= half if half is not None else F.lit(True)

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    for part in (e.filter(early), e.filter(~early), heartbeat):
        part.write.mode("append").parquet(f"{at}/in")
        stories = flows.session_stories(spark.readStream.schema(part.schema).parquet(f"{at}/in"))
        stories.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(flows.STORY).parquet(f"{at}/out").filter("user_id IS NOT NULL")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stm_high_watermark", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def stm_high_watermark(spark, d):
    """Two runs: the second reads from the day on that the first has saved."""
    state, events = f"{folder(spark)}/since", v.table(spark, d, "events")
    flows.read_since(events.filter("event_id % 2 = 0"), state, "ts")
    return flows.read_since(events, state, "ts").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("stm_poll_queue", """SELECT event_id, CASE WHEN event_id % 40 < 20 THEN CASE WHEN event_id % 8 = 0 THEN 'approve' ELSE 'reject' END ELSE 'pending' END AS decision, CASE WHEN event_id % 40 >= 20 THEN 'pending' WHEN event_id % 8 = 0 THEN 'indexed' ELSE 'rejected' END AS status FROM events WHERE event_id % 4 = 0""")
def stm_poll_queue(spark, d):
    """Suggestions and decisions as two streams: decisions come in time, too late or before what they are about; what was decided runs through the queue, the rest stays pending."""
    at, i = folder(spark), F.col("event_id")
    asked = v.table(spark, d, "events").filter("event_id % 4 = 0").select(i.alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("id") % 40
    shift = F.when(k < 20, k * 60).when(k < 30, F.lit(3600)).otherwise(-60)
    told = asked.select("id", F.timestamp_micros(F.unix_micros("ts") + shift * 1_000_000).alias("ts"), F.when(F.col("id") % 8 == 0, "approve").otherwise("reject").alias("decision"))
    end = asked.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    nobody = F.lit(-1).cast(asked.schema["id"].dataType).alias("id")

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{at}/judged/batch={batch_id}")

    for s, j in ((asked, told), (end.select(nobody, "ts"), end.select(nobody, "ts", F.lit("").alias("decision")))):  # the second run is a heartbeat
        s.write.mode("append").parquet(f"{at}/asked")
        j.write.mode("append").parquet(f"{at}/told")
        joined = flows.reviewed(spark.readStream.schema(asked.schema).parquet(f"{at}/asked"), spark.readStream.schema(told.schema).parquet(f"{at}/told"))
        joined.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    judged = spark.read.schema("id long, ts timestamp, decision string").parquet(f"{at}/judged").drop("batch").filter("id >= 0")
    judged.select(F.col("id").alias("event_id"), "decision", F.when(F.col("decision") == "pending", "waiting").otherwise("pending").alias("status")).write.parquet(f"{at}/queue")
    queue = spark.readStream.schema("event_id long, decision string, status string").parquet(f"{at}/queue")
    after = F.when(F.col("decision") == "approve", "indexed").otherwise("rejected")
    flows.process_queue(spark, queue, lambda b: b.withColumn("status", after), f"{at}/out", f"{at}/queued")
    done = spark.read.schema("event_id long, decision string, status string").parquet(f"{at}/out").drop("batch")
    return done.unionByName(judged.filter("decision = 'pending'").select(F.col("id").alias("event_id"), "decision", F.lit("pending").alias("status")))


@query("stm_resume", "SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_ids FROM events")
def stm_resume(spark, d):
    """Two runs of one checkpoint write each row once."""
    at = folder(spark)
    for _ in range(2):
        flows.run_available(_stream(spark, d, "events").select("event_id"), f"{at}/out", f"{at}/check")
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("distinct_ids"))


@query("udf_summarize_doc", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'S' || doc_id WHEN 1 THEN trim(substr(text, 1, 200)) ELSE substr(text, 1, 300) END AS summary, CASE WHEN doc_id % 6 = 0 THEN 'tutorial' ELSE 'overview' END AS source_kind FROM documents")
def udf_summarize_doc(spark, d):
    """Summaries of documents: by a model's JSON, by the text where that cannot be parsed or there is none."""
    i = F.col("doc_id")
    kind = F.when(i % 6 == 0, ', "source_kind": "tutorial"').otherwise("")
    said = F.when(i % 3 == 0, F.concat(F.lit('{"summary": "S'), i.cast("string"), F.lit('"'), kind, F.lit("}"))).when(i % 3 == 1, "not JSON")
    return v.table(spark, d, "documents").select("doc_id", answers.doc_summary(said, F.col("text")).alias("a")).select("doc_id", "a.*")


@query("udf_summarize_code", f"""WITH {v.ENTRIES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'does ' || doc_id ELSE '[' || source_file || ' chunk ' || chunk_index || ']' END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'algorithm' ELSE 'unknown' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS value FROM en""")
def udf_summarize_code(spark, d):
    """Summaries of code by a model that searches, then writes; one that never writes leaves the place of the chunk."""

    def speak(messages, tools):
        i = int(messages[0]["content"])
        if i % 3 == 1:
            return "no idea", []
        if len(messages) == 1 or i % 3 == 2:
            return "", [("search_kb", {"query": str(i)})]
        return "", [("write_summary", {"json": f'{{"summary": "does {i}", "category": "algorithm", "search_value": "high"}}'})]

    e = v.entries(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("prompt"), "source_file", "chunk_index")
    said = models.with_loops(e, "prompt", speak, {"search_kb": lambda query: f"found {query}"}, ("write_summary",), "json", max_rounds=4)
    return said.select("doc_id", answers.code_summary(F.col("answer"), F.col("source_file"), F.col("chunk_index")).alias("a")).select("doc_id", "a.*")


@query("udf_tool_loop", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'found ' || n_name WHEN 1 THEN 'error: unknown tool nothing' ELSE NULL END AS answer FROM nation")
def udf_tool_loop(spark, d):
    """A scripted model: it searches and writes what it found, calls a tool that is not there, only talks, or never ends."""

    def speak(messages, tools):
        k, name = messages[0]["content"].split(" ", 1)
        last = messages[-1]
        if last["role"] == "tool" and int(k) % 4 < 2:
            return "", [("write", {"text": last["content"]})]
        return "", [] if int(k) % 4 == 2 else [("nothing" if int(k) % 4 == 1 else "search", {"query": name})]

    n = v.table(spark, d, "nation").select("n_nationkey", F.concat_ws(" ", F.col("n_nationkey").cast("string"), "n_name").alias("prompt"))
    return models.with_loops(n, "prompt", speak, {"search": lambda query: f"found {query}"}, ("write",), "text", max_rounds=3).select("n_nationkey", "answer")


def _first_line(texts: list[str]) -> list[str]:
    if any(t.startswith("The ") for t in texts):
        raise ValueError("context overflow")
    return [t.split("\n")[0][:40] for t in texts]


@query("udf_llm_call", "SELECT doc_id, CASE WHEN text LIKE 'The %' THEN NULL ELSE substr(string_split(text, chr(10))[1], 1, 40) END AS answer, CASE WHEN text LIKE 'The %' THEN 'failed' ELSE 'ok' END AS status FROM documents")
def udf_llm_call(spark, d):
    """A model that is a function; texts it refuses are tried three times, each time shorter."""
    return models.call_model(v.table(spark, d, "documents").select("doc_id", "text"), "text", _first_line).select("doc_id", "answer", "status")


@query("udf_rate_limit", "SELECT n_nationkey, upper(n_name) AS answer FROM nation")
def udf_rate_limit(spark, d):
    return models.call_model(v.table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", lambda ts: [t.upper() for t in ts], per_minute=60000).select("n_nationkey", "answer")


@query("udf_review", f"""WITH {t.SUMMARY}, r AS (SELECT doc_id, summary, {t._REVIEW} >= 0.15::DOUBLE AS due FROM sm) SELECT count(*) AS reviews, count(*) FILTER (due AND length(summary) % 3 = 0) AS edits, CAST(count(*) FILTER (due AND length(summary) % 3 = 0) AS DOUBLE) / count(*) AS rate FROM r""")
def udf_review(spark, d):
    """A reviewer sees the summaries that score as weak, and improves some."""
    say = lambda ts: ['{"keep": false, "improved": "better"}' if len(y) % 3 == 0 else '{"keep": true}' for y in ts]
    return models.edit_rate(models.reviewed(t.summaries(spark, d), x.review_score(F.col("summary")), say))


@query("udf_lesson", f"WITH {v.TICKETS} SELECT key FROM tk WHERE title <> '' AND resolution <> '' AND length(description) >= 30")
def udf_lesson(spark, d):
    return v.tickets(spark, d).filter(models.lesson_allowed(F.col("title"), F.col("resolution"), F.col("description"))).select("key")


@query("udf_extract_ticket", f"""WITH {v.TICKETS} SELECT key, conv_id % 2 = 0 AS useful, CASE WHEN conv_id % 2 = 0 THEN 'about ' || key ELSE '' END AS summary, CASE WHEN conv_id % 2 = 0 THEN 'general' ELSE '' END AS category FROM tk""")
def udf_extract_ticket(spark, d):
    """Knowledge from a ticket's context by a model that answers in JSON for half of them."""

    def call(texts):
        keys = [y.split(" ", 2)[1] for y in texts]
        return [f'{{"useful": true, "summary": "about {k}"}}' if int(k.split("-")[1]) % 2 == 0 else "nothing to say" for k in keys]

    context = x.ticket_context(*map(F.col, ("key", "title", "description", "resolution", "comments")))
    said = models.call_model(v.tickets(spark, d).select("key", context.alias("context")), "context", call)
    return said.select("key", answers.extraction(F.col("answer")).alias("e")).select("key", "e.useful", "e.summary", "e.category")


@query("udf_judge", "SELECT doc_id, length(text) % 3 = 0 AS consistent, CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN 'odd' ELSE 'LLM response was unparseable; flagging for manual review' END AS explanation FROM documents")
def udf_judge(spark, d):
    """A judge is a model whose answer is parsed; what cannot be is flagged."""
    say = lambda ts: [('{"consistent": true}', '{"consistent": false, "explanation": "odd"}', "??")[len(y) % 3] for y in ts]
    j = models.call_model(v.table(spark, d, "documents").select("doc_id", "text"), "text", say)
    return j.select("doc_id", answers.verdict(F.col("answer")).alias("v")).select("doc_id", "v.*")


@query("udf_embed", r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda y: y <> ''), lambda y: (instr('0123456789abcdef', substr(md5(y), 1, 1)) - 1) * 4 + (instr('0123456789abcdef', substr(md5(y), 2, 1)) - 1) // 4) AS slots FROM documents)
    SELECT doc_id, list_transform(generate_series(0, 63), lambda k: CAST(len(list_filter(slots, lambda y: y = k)) AS DOUBLE)) AS embedding FROM w""")
def udf_embed(spark, d):
    """The offline default: 64 counts of words by hash."""
    return models.hashed_embedding(v.table(spark, d, "documents"))


@query("api_mcp", f"""WITH {v.KB}, q AS (SELECT doc_id AS query_id, embedding AS qe FROM kb WHERE doc_id % 50 = 0), s AS (SELECT query_id, doc_id, source_type, source_file, module, floor(greatest(0, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5) / 1e6 AS score FROM q, kb),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, CAST(count(*) AS INTEGER) AS num_results, list_sort(list(DISTINCT source_file)) AS files, list(source_type ORDER BY rank) AS kinds FROM r WHERE rank <= 5 GROUP BY 1""")
def api_mcp(spark, d):
    """search_codebase for the stated queries (ids divisible by 50): answers, and what the query log gets of each."""
    kb = KnowledgeBase(spark, v.kb(spark, d).withColumn("text", F.col("source_file")).withColumn("chunk_type", F.lit("function_summary")))
    asked = kb.rows.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.lit("q").alias("query"), "embedding")
    found = kb.search_codebase(asked, 5)
    kinds = F.regexp_extract_all("answer", F.lit(r"\[(\w+)/function_summary\]"), F.lit(1))
    return found.select("query_id", "num_results", F.array_sort("result_files").alias("files"), kinds.alias("kinds"))


@query("api_agent_tools", f"""WITH {v.KB}, {v.FILES} SELECT 'kb_status' AS tool, source_type AS name, count(*) AS n FROM kb WHERE doc_id % 10 <> 0 GROUP BY 2 UNION ALL SELECT 'list_modules', module, count(*) FROM kb WHERE doc_id % 10 <> 0 GROUP BY 2 UNION ALL SELECT 'discover_modules', split_part(path, '/', 1), count(DISTINCT path) FROM fl GROUP BY 2""")
def api_agent_tools(spark, d):
    """Tools by name: rows are removed, then the status, the modules, and the modules of a tree are asked for."""
    kb = KnowledgeBase(spark, v.kb(spark, d))
    kept = call_tool(kb, "remove", ids=kb.rows.filter("doc_id % 10 = 0").select("doc_id"))
    one = lambda tool, df, name, n: df.select(F.lit(tool).alias("tool"), F.col(name).alias("name"), F.col(n).alias("n"))
    found = call_tool(kept, "discover_modules", files=v.files(spark, d).select("path"))
    return one("kb_status", call_tool(kept, "kb_status"), "source_type", "n").unionByName(one("list_modules", call_tool(kept, "list_modules"), "module", "entries")).unionByName(one("discover_modules", found, "module", "n_files"))


@query("api_explorer", f"""WITH {v.FILES}, {v.ENTRIES}, l AS (SELECT split_part(path, '/', 2) AS name, count(*) AS n FROM fl WHERE starts_with(path, 'src/') GROUP BY 1), t AS (SELECT split_part(path, '/', 1) AS name, count(*) AS n FROM fl GROUP BY 1)
    SELECT 'list_dir' AS action, name, n FROM l UNION ALL SELECT 'tree', name, n FROM t UNION ALL SELECT 'gap', module, count(*) FROM en GROUP BY 2 UNION ALL SELECT 'define_module', 'src/d1', count(*) FROM fl WHERE starts_with(path, 'src/d1/')""")
def api_explorer(spark, d):
    """Actions of an explorer on a tree."""
    e = explore.Explorer(v.files(spark, d).select("path", F.lit("x").alias("content")), v.entries(spark, d))
    one = lambda action, df, name, n: df.select(F.lit(action).alias("action"), F.col(name).alias("name"), n.cast("long").alias("n"))
    parts = [one("list_dir", e.act("list_dir", "src"), "name", F.col("n_files")), one("tree", e.act("tree").filter("NOT contains(dir, '/')"), "dir", F.col("total")), one("gap", e.act("gap"), "module", F.col("entries")), one("define_module", e.act("define_module", "src/d1"), "module", F.size("files"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("api_cli", f"""WITH {v.ENTRIES}, {v.TICKETS} SELECT 'doc' AS source_type, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'code', count(DISTINCT doc_id) FROM en WHERE NOT (chunk_category = 'boilerplate' AND search_value = 'low') UNION ALL SELECT 'ticket', count(DISTINCT key) FROM tk WHERE title <> '' OR resolution <> ''""")
def api_cli(spark, d):
    """One build: documents, then code, then tickets, into one store, whose status is asked for."""
    e = v.entries(spark, d).filter(~skip_index(F.col("chunk_category"), F.col("search_value")))
    row = lambda kind, key: (F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("doc_id"), F.lit(kind).alias("source_type"))
    kb = KnowledgeBase(spark, v.table(spark, d, "documents").select(*row("doc", "doc_id")))
    kb = kb.add(e.select(*row("code", "doc_id"))).add(v.tickets(spark, d).filter("title <> '' OR resolution <> ''").select(*row("ticket", "key")))
    return kb.kb_status()


@query("src_tickets_json", "SELECT DISTINCT conv_id AS id, 'ticket ' || conv_id AS title FROM conversations")
def src_tickets_json(spark, d):
    """Ticket files of one object or of an array, read back; broken files beside them are dropped."""
    from lodestone.sources.files import read_json

    at = folder(spark)
    t = v.table(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.concat(F.lit("ticket "), F.col("conv_id").cast("string")).alias("title"))
    one = F.to_json(F.struct("id", "title"))
    t.filter("id % 10 = 0").select(F.col("id").alias("file"), one.alias("value")).write.partitionBy("file").text(f"{at}/objects")
    t.filter("id % 10 <> 0").groupBy((F.col("id") % 50).alias("file")).agg(F.to_json(F.collect_list(F.struct("id", "title"))).alias("value")).write.partitionBy("file").text(f"{at}/arrays")
    t.filter("id % 25 = 0").select(F.col("id").alias("file"), F.concat(F.lit("{"), one).alias("value")).write.partitionBy("file").text(f"{at}/broken")
    return read_json(spark, at, "id long, title string", lines=False)


@query("src_json_jsonl", "SELECT r_regionkey AS id FROM region")
def src_json_jsonl(spark, d):
    from lodestone.sources.files import read_json

    at = folder(spark)
    good = v.table(spark, d, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("id"))).alias("value"))
    bad = spark.createDataFrame([("not json",), ("",)], "value string")
    good.union(bad).write.text(f"{at}/lines")
    return read_json(spark, f"{at}/lines", "id int").filter("id IS NOT NULL")
