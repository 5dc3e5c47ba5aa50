"""Queries on usage, cost and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import metrics as m
from lodestone.operators.ledger import Ledger
from lodestone.plans import views as v
from lodestone.plans.registry import folder, query

WITHOUT = "CASE WHEN num_results = 0 THEN 6500 ELSE greatest(n_files, 2) * 3000 + 1000 END"
COSTED = f"{v.QUERY_LOG}, costed AS (SELECT *, CAST({WITHOUT} AS BIGINT) AS without_kb, CAST(approx_tokens + 200 AS BIGINT) AS with_kb FROM qlog)"
TOTALS = f"""{COSTED}, t AS (SELECT count(*) AS total_queries, CAST(count(*) FILTER (num_results = 0) AS BIGINT) AS zero_results,
    CAST(sum(without_kb) AS BIGINT) AS total_without, CAST(sum(with_kb) AS BIGINT) AS total_with FROM costed)"""
MIXED = "({t} * 0.6::DOUBLE * 3.0::DOUBLE / 1e6 + {t} * 0.4::DOUBLE * 15.0::DOUBLE / 1e6)"


@query(
    "agg_savings",
    f"""WITH {TOTALS} SELECT *, total_without - total_with AS saved, total_without // total_queries AS avg_without, total_with // total_queries AS avg_with,
        CAST(total_queries - zero_results AS DOUBLE) / total_queries * 100 AS answerable_pct, (total_without - total_with) * 100.0::DOUBLE / total_without AS reduction_pct FROM t""",
)
def agg_savings(spark, d):
    return m.savings(v.query_log(spark, d))


@query("agg_by_module", f"WITH {COSTED} SELECT coalesce(nullif(module, ''), 'all') AS module, CAST(sum(without_kb) AS BIGINT) AS without_kb, CAST(sum(with_kb) AS BIGINT) AS with_kb, count(*) AS n FROM costed GROUP BY 1")
def agg_by_module(spark, d):
    return m.by_label(v.query_log(spark, d), "module", "all")


@query("agg_by_scope", f"WITH {COSTED} SELECT coalesce(nullif(scope, ''), 'general') AS scope, CAST(sum(without_kb) AS BIGINT) AS without_kb, CAST(sum(with_kb) AS BIGINT) AS with_kb, count(*) AS n FROM costed GROUP BY 1")
def agg_by_scope(spark, d):
    return m.by_label(v.query_log(spark, d), "scope", "general")


@query("agg_by_hour", f"WITH {v.QUERY_LOG} SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM qlog GROUP BY 1")
def agg_by_hour(spark, d):
    return m.by_hour(v.query_log(spark, d))


@query("agg_top_queries", f"WITH {v.QUERY_LOG} SELECT substr(query, 1, 80) AS query, count(*) AS n, min(event_id) AS first_seen FROM qlog GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def agg_top_queries(spark, d):
    return m.top_queries(v.query_log(spark, d))


INDEX_COST = f"""{v.COST_LOG}, ic AS (SELECT agent, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, count(*) AS runs, max(ts) AS last_run,
    CAST(sum(prompt) + sum(completion) AS BIGINT) AS total FROM clog GROUP BY 1)"""


@query("agg_index_cost", f"WITH {INDEX_COST} SELECT agent, prompt, completion, runs, total FROM ic WHERE total > 0")
def agg_index_cost(spark, d):
    return m.index_cost(v.cost_log(spark, d)).drop("last_run")


@query("win_latest_run", f"WITH {INDEX_COST} SELECT agent, strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run FROM ic")
def win_latest_run(spark, d):
    return v.cost_log(spark, d).groupBy("agent").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query(
    "agg_roi",
    f"""WITH {INDEX_COST}, {TOTALS}, x AS (SELECT CAST((SELECT coalesce(sum(total), 0) FROM ic WHERE total > 0) AS BIGINT) AS index_tokens, total_without - total_with AS saved, total_queries FROM t),
        y AS (SELECT *, {MIXED.format(t="index_tokens")} AS index_dollars, {MIXED.format(t="saved")} AS saved_dollars FROM x)
        SELECT *, saved_dollars / index_dollars AS ratio, CAST(trunc(index_dollars / (saved_dollars / total_queries)) AS BIGINT) AS break_even FROM y""",
)
def agg_roi(spark, d):
    return m.roi(m.index_cost(v.cost_log(spark, d)), m.savings(v.query_log(spark, d)))


@query("agg_token_phase", f"""WITH {v.COST_LOG} SELECT coalesce(phase, 'total') AS phase, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, count(*) AS calls FROM clog GROUP BY ROLLUP (phase)""")
def agg_token_phase(spark, d):
    return m.token_phases(v.cost_log(spark, d))


@query("snk_cost_log", f"""WITH {v.COST_LOG} SELECT agent, phase, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, count(*) AS calls FROM clog GROUP BY 1, 2""")
def snk_cost_log(spark, d):
    """Two runs append what they used to the log, a record each call; the log is read back."""
    at, log = folder(spark), v.cost_log(spark, d)
    for mine in ("phase IN ('pass0', 'pass1')", "phase NOT IN ('pass0', 'pass1')"):
        m.append_cost(log.filter(mine), at)
    return m.read_cost(spark, at).groupBy("agent", "phase").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.count("*").alias("calls"))


@query("agg_projection", f"""WITH {TOTALS}, p AS (SELECT unnest([5, 10, 20])::BIGINT AS team, (total_without - total_with) // total_queries AS each FROM t)
    SELECT team, team * 550 AS queries, team * 550 * each AS tokens, {MIXED.format(t="(team * 550 * each)")} AS dollars FROM p""")
def agg_projection(spark, d):
    return m.projection(m.savings(v.query_log(spark, d)))


@query("agg_cost_estimate", """SELECT source AS module, count(*) AS files, count(*) * 3 AS chunks, count(*) * 3 * 2500 + 50000 AS tokens, CAST(ceil(count(*) * 3 / 60.0::DOUBLE) AS BIGINT) AS minutes FROM documents GROUP BY 1""")
def agg_cost_estimate(spark, d):
    """Three chunks a file, 2,000 prompt and 500 completion tokens a chunk, 50,000 for the first pass, 60 calls a minute."""
    n = v.table(spark, d, "documents").groupBy(F.col("source").alias("module")).agg(F.count("*").alias("files"))
    chunks = F.col("files") * 3
    return n.select("module", "files", chunks.alias("chunks"), (chunks * 2500 + 50000).alias("tokens"), F.ceil(chunks / 60).cast("long").alias("minutes"))


@query("flt_since", f"WITH {v.QUERY_LOG} SELECT event_id, module FROM qlog WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def flt_since(spark, d):
    """Queries of the 7 days before a fixed anchor; without a time stamp they are dropped."""
    since = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 7 DAY")
    return v.query_log(spark, d).filter(F.col("ts") >= since).select("event_id", "module")


@query("str_estimate_tokens", f"WITH {COSTED} SELECT event_id, without_kb, with_kb FROM costed")
def str_estimate_tokens(spark, d):
    return m.costed(v.query_log(spark, d)).select("event_id", "without_kb", "with_kb")


@query(
    "str_dollars",
    f"""WITH {COSTED}, p(model, i, o) AS (VALUES ('claude-sonnet', 3.0::DOUBLE, 15.0::DOUBLE), ('claude-opus', 15.0, 75.0), ('claude-haiku', 0.25, 1.25), ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('default', 3.0, 15.0)),
        s AS (SELECT CAST(sum(without_kb) AS BIGINT) AS tokens FROM costed)
        SELECT model, tokens, tokens * i / 1e6 AS input, tokens * o / 1e6 AS output, tokens * 0.6::DOUBLE * i / 1e6 + tokens * 0.4::DOUBLE * o / 1e6 AS mixed FROM p, s""",
)
def str_dollars(spark, d):
    tokens = m.costed(v.query_log(spark, d)).agg(F.sum("without_kb").alias("tokens"))
    prices = spark.createDataFrame([(k, *x) for k, x in m.MODEL_COSTS.items()], "model string, i double, o double")
    t = F.col("tokens")
    both = prices.crossJoin(F.broadcast(tokens))  # one row
    return both.select("model", "tokens", (t * F.col("i") / 1e6).alias("input"), (t * F.col("o") / 1e6).alias("output"), (t * 0.6 * F.col("i") / 1e6 + t * 0.4 * F.col("o") / 1e6).alias("mixed"))


def _units(n: str) -> str:
    def scaled(unit: str, letter: str) -> str:
        t = f"CAST(floor({n} / {unit}::DOUBLE * 10 + 0.5) AS BIGINT)"
        return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '{letter}'"

    return f"CASE WHEN {n} >= 1000000 THEN {scaled('1e6', 'M')} WHEN {n} >= 1000 THEN {scaled('1e3', 'K')} ELSE CAST({n} AS VARCHAR) END"


@query("str_format_units", f"WITH {v.QUERY_LOG} SELECT event_id, {_units('(approx_tokens * approx_tokens)')} AS tokens, {_units('k')} AS small FROM qlog")
def str_format_units(spark, d):
    t = F.col("approx_tokens")
    return v.query_log(spark, d).select("event_id", m.format_tokens(t * t).alias("tokens"), m.format_tokens(F.col("k")).alias("small"))


@query("top_modules_saved", f"WITH {COSTED} SELECT module || '-' || (k % 7) AS module, CAST(sum(without_kb) - sum(with_kb) AS BIGINT) AS saved FROM costed GROUP BY 1 ORDER BY saved DESC, module LIMIT 10")
def top_modules_saved(spark, d):
    log = v.query_log(spark, d).withColumn("module", F.concat_ws("-", "module", (F.col("k") % 7).cast("string")))
    g = m.by_label(log, "module", "all")
    return g.select("module", (F.col("without_kb") - F.col("with_kb")).alias("saved")).orderBy(F.desc("saved"), "module").limit(10)


@query("snk_clear_stats", f"""WITH {v.KB}, k AS (SELECT unnest(['code', 'doc', 'ticket', 'total']) AS source_type), t AS (SELECT coalesce(source_type, 'total') AS source_type, count(*) AS n FROM kb GROUP BY GROUPING SETS ((source_type), ()))
    SELECT 'filled' AS stage, source_type, coalesce(n, 0) AS n FROM k LEFT JOIN t USING (source_type) UNION ALL SELECT 'cleared', source_type, 0 FROM k""")
def snk_clear_stats(spark, d):
    """Rows of a store by source type and in all, before and after it is cleared."""
    store = Ledger(spark, folder(spark), ["doc_id"])
    filled = store.upsert(v.kb(spark, d).select("doc_id", "source_type", "module"))
    store.clear()
    return m.store_counts(store.read(filled.version)).withColumn("stage", F.lit("filled")).unionByName(m.store_counts(store.read()).withColumn("stage", F.lit("cleared")))


@query(
    "agg_status",
    f"""WITH {v.QUERY_LOG}, {v.KB}, {v.COST_LOG}
        SELECT 'queries' AS artifact, count(*) AS n FROM qlog UNION ALL SELECT 'entries', count(*) FROM kb UNION ALL SELECT 'modules', count(DISTINCT module) FROM kb
        UNION ALL SELECT 'runs', count(*) FROM clog UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def agg_status(spark, d):
    one = lambda name, df, e: df.agg(F.lit(name).alias("artifact"), e.alias("n")).select("artifact", "n")
    k = v.kb(spark, d)
    parts = [one("queries", v.query_log(spark, d), F.count("*")), one("entries", k, F.count("*")), one("modules", k, F.countDistinct("module")), one("runs", v.cost_log(spark, d), F.count("*")), one("documents", v.table(spark, d, "documents"), F.count("*"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("str_time_ago", """WITH a AS (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM a""")
def str_time_ago(spark, d):
    """Age at a fixed anchor in its largest whole unit."""
    s = F.floor(F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.expr("cast(cast(ts as timestamp) as double)")).cast("long")
    e = v.table(spark, d, "events").select("event_id", s.alias("s"))
    part = lambda unit, letter: F.concat(F.expr(f"s div {unit}").cast("string"), F.lit(f"{letter} ago"))
    return e.select("event_id", F.when(F.col("s") < 60, part(1, "s")).when(F.col("s") < 3600, part(60, "m")).when(F.col("s") < 86400, part(3600, "h")).otherwise(part(86400, "d")).alias("ago"))


@query("agg_eval_summary", """WITH q AS (SELECT doc_id, length(text) % 7 AS a, length(text) % 5 AS b FROM documents)
    SELECT count(*) AS questions, avg(CAST(a AS DOUBLE)) AS avg_a, avg(CAST(b AS DOUBLE)) AS avg_b, count(*) FILTER (a > b) AS wins_a, count(*) FILTER (b > a) AS wins_b, count(*) FILTER (a = b) AS ties, count(*) FILTER (a = 0) AS zero_results FROM q""")
def agg_eval_summary(spark, d):
    q = v.table(spark, d, "documents").select((F.length("text") % 7).alias("a"), (F.length("text") % 5).alias("b"))
    return q.agg(F.count("*").alias("questions"), F.avg(F.col("a").cast("double")).alias("avg_a"), F.avg(F.col("b").cast("double")).alias("avg_b"), F.count_if(F.col("a") > F.col("b")).alias("wins_a"), F.count_if(F.col("b") > F.col("a")).alias("wins_b"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") == 0).alias("zero_results"))


@query("str_blend_winner", """WITH q AS (SELECT doc_id, (length(text) % 100) / 100.0::DOUBLE AS a, (length(text) % 97) / 97.0::DOUBLE AS b FROM documents)
    SELECT doc_id, CASE WHEN a > b + 0.05::DOUBLE THEN 'A' WHEN b > a + 0.05::DOUBLE THEN 'B' ELSE 'tie' END AS winner FROM q""")
def str_blend_winner(spark, d):
    n = F.length("text")
    a, b = (n % 100) / F.lit(100.0), (n % 97) / F.lit(97.0)
    return v.table(spark, d, "documents").select("doc_id", F.when(a > b + 0.05, "A").when(b > a + 0.05, "B").otherwise("tie").alias("winner"))


@query("agg_confidence", """WITH c AS (SELECT avg(quality * 0.8::DOUBLE + 0.1::DOUBLE) AS mean, count(*) FILTER (toxic = 1) AS open FROM labels)
    SELECT greatest(0.0::DOUBLE, mean - least(0.3::DOUBLE, 0.03::DOUBLE * open)) AS confidence, (SELECT count(*) FROM labels) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS coverage FROM c""")
def agg_confidence(spark, d):
    """Mean module confidence less 0.03 for each open question (0.3 at most); coverage is what has been read of all."""
    c = v.table(spark, d, "labels").agg(F.avg(F.col("quality") * 0.8 + 0.1).alias("mean"), F.count_if(F.col("toxic") == 1).alias("open"), F.count("*").alias("read"))
    n = v.table(spark, d, "documents").agg(F.count("*").alias("all"))
    return c.crossJoin(n).select(F.greatest(F.lit(0.0), F.col("mean") - F.least(F.lit(0.3), F.col("open") * 0.03)).alias("confidence"), (F.col("read") / F.col("all")).alias("coverage"))
