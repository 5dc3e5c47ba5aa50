"""Usage, savings, cost and status metrics of a knowledge base (all map-side combinable aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dollars per million input and output tokens by model; token estimates of a question.
MODEL_COSTS = {"claude-sonnet": (3.00, 15.00), "claude-opus": (15.00, 75.00), "claude-haiku": (0.25, 1.25), "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60), "default": (3.00, 15.00)}
FILE_READ, SEARCH, REASONING, CALL_OVERHEAD, DEFAULT_ANSWER = 3000, 500, 500, 200, 500


def tokens_without(num_results: Column, n_files: Column) -> Column:
    """Tokens a question would cost without the knowledge base."""
    return F.when(num_results == 0, F.lit(SEARCH + 2 * FILE_READ)).otherwise(F.greatest(n_files, F.lit(2)) * FILE_READ + SEARCH + REASONING).cast("long")


def tokens_with(approx_tokens: Column) -> Column:
    return (F.coalesce(approx_tokens, F.lit(DEFAULT_ANSWER)) + CALL_OVERHEAD).cast("long")


def dollars(tokens: Column, model: str = "default", direction: str = "mixed") -> Column:
    """Cost of tokens; mixed is 60 % input and 40 % output."""
    rate_in, rate_out = MODEL_COSTS.get(model, MODEL_COSTS["default"])
    rate = {"input": rate_in, "output": rate_out}.get(direction)
    if rate is not None:
        return tokens * F.lit(rate) / F.lit(1e6)
    return tokens * F.lit(0.6) * F.lit(rate_in) / F.lit(1e6) + tokens * F.lit(0.4) * F.lit(rate_out) / F.lit(1e6)


def costed(log: DataFrame) -> DataFrame:
    return log.withColumn("without_kb", tokens_without(F.col("num_results"), F.col("n_files"))).withColumn("with_kb", tokens_with(F.col("approx_tokens")))


def savings(log: DataFrame) -> DataFrame:
    """One row of totals over a query log (num_results, n_files, approx_tokens)."""
    t = costed(log).agg(
        F.count("*").alias("total_queries"),
        F.count_if(F.col("num_results") == 0).alias("zero_results"),
        F.sum("without_kb").alias("total_without"),
        F.sum("with_kb").alias("total_with"),
    )
    n = F.greatest("total_queries", F.lit(1))
    saved = F.col("total_without") - F.col("total_with")
    return t.select(
        "*",
        saved.alias("saved"),
        F.expr("total_without div greatest(total_queries, 1)").alias("avg_without"),
        F.expr("total_with div greatest(total_queries, 1)").alias("avg_with"),
        ((F.col("total_queries") - F.col("zero_results")).cast("double") / n * 100).alias("answerable_pct"),
        F.coalesce(F.try_divide(saved * 100.0, F.col("total_without")), F.lit(0.0)).alias("reduction_pct"),
    )


def by_label(log: DataFrame, column: str, missing: str) -> DataFrame:
    """{without, with, count} for each label; an empty or null one counts as `missing`."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)).alias(column)
    return costed(log).groupBy(label).agg(F.sum("without_kb").alias("without_kb"), F.sum("with_kb").alias("with_kb"), F.count("*").alias("n"))


def by_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


def top_queries(log: DataFrame, k: int = 10, width: int = 80) -> DataFrame:
    """The k most frequent queries, cut to width; ties by first appearance."""
    return log.groupBy(F.substring("query", 1, width).alias("query")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def index_cost(log: DataFrame) -> DataFrame:
    """Token sums and runs for each agent with any, and its last run."""
    g = log.groupBy("agent").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.count("*").alias("runs"), F.max("ts").alias("last_run"))
    return g.withColumn("total", F.col("prompt") + F.col("completion")).filter("total > 0")


def roi(costs: DataFrame, saved: DataFrame, model: str = "default") -> DataFrame:
    """One row: what indexing cost, what was saved, their ratio, and queries until break-even."""
    c = costs.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("index_tokens"))
    one = c.crossJoin(saved.select("saved", "total_queries"))  # a row each
    one = one.withColumn("index_dollars", dollars(F.col("index_tokens"), model)).withColumn("saved_dollars", dollars(F.col("saved"), model))
    per_query = F.try_divide("saved_dollars", F.col("total_queries").cast("double"))
    return one.withColumn("ratio", F.try_divide("saved_dollars", "index_dollars")).withColumn("break_even", F.try_divide(F.col("index_dollars"), per_query).cast("long"))


def token_phases(log: DataFrame) -> DataFrame:
    """Sums for each phase and, with phase 'total', for all."""
    g = log.rollup("phase").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.count("*").alias("calls"))
    return g.withColumn("phase", F.coalesce("phase", F.lit("total")))


def projection(stats: DataFrame, teams: tuple[int, ...] = (5, 10, 20), per_day: int = 25, days: int = 22, model: str = "default") -> DataFrame:
    """Monthly queries, tokens and dollars saved for teams of these sizes."""
    sizes = stats.select("*", F.explode(F.array(*map(F.lit, teams)).cast("array<long>")).alias("team"))
    queries = F.col("team") * per_day * days
    tokens = queries * F.expr("saved div greatest(total_queries, 1)")
    return sizes.select("team", queries.alias("queries"), tokens.alias("tokens"), dollars(tokens, model).alias("dollars"))


def format_tokens(n: Column) -> Column:
    """1.2M, 3.4K or the plain number."""
    def scaled(unit: float) -> Column:
        t = F.floor(n / F.lit(unit) * 10 + 0.5).cast("long")
        return F.concat(F.floor(t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))
    return F.when(n >= 1_000_000, F.concat(scaled(1e6), F.lit("M"))).when(n >= 1_000, F.concat(scaled(1e3), F.lit("K"))).otherwise(n.cast("string"))


def store_counts(rows: DataFrame, types: tuple[str, ...] = ("code", "doc", "ticket")) -> DataFrame:
    """(source_type, n): a store's rows of each type, 0 included, and in all as total."""
    of = [F.count_if(F.col("source_type") == t).alias(t) for t in types]
    counts = rows.agg(*of, F.count("*").alias("total"))
    return counts.unpivot([], [*types, "total"], "source_type", "n")


COST = "agent string, phase string, prompt long, completion long, ts timestamp"


def append_cost(calls: DataFrame, path: str) -> None:
    """Append calls (agent, phase, prompt, completion, ts) to the cost log, a JSON line each."""
    calls.select("agent", "phase", F.col("prompt").cast("long"), F.col("completion").cast("long"), "ts").write.mode("append").json(path)


def read_cost(spark: SparkSession, path: str) -> DataFrame:
    """The cost log; lines that cannot be parsed are dropped."""
    return spark.read.schema(COST).option("mode", "DROPMALFORMED").json(path)
