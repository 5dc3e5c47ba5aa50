"""Structured Streaming: ingest with deduplication, hourly windows, review queue, high-water marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n) over tumbling windows of event time; rows later than `late` are dropped, and windows that old leave the state."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def latest_counts(updates: DataFrame) -> DataFrame:
    """(hour, event_type, n) of the updates (hour, event_type, n, batch) that hourly() gave: the last count of each window."""
    return updates.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): queries of one user with pauses below the gap."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withWatermark("ts", gap) if stream.isStreaming else s
    return s.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


STORY = "user_id long, start timestamp, end timestamp, n long, ended string"
_OPEN = "starts array<long>, ends array<long>, counts array<long>"


def session_stories(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", last: str | None = None) -> DataFrame:
    """STORY: the sessions of a stream (user_id, ts, kind) as they close; rows later than ``late`` are dropped.

    A session goes on while pauses are below the gap; end is that of its last row.  It
    closes once the watermark is a gap behind its last row (ended: gap), or, where
    last is given, with a row of that kind (ended: last), with what came until then.  Rows may come in any order within
    ``late``: they open, stretch and join sessions.  The state of a user holds the open
    sessions only, and leaves with the last of them; a timer closes them when no row
    of theirs comes any more.
    """
    width = pd.Timedelta(gap).value // 1000
    names = [x.split(" ")[0] for x in STORY.split(", ")]

    def closed(user: int, sessions: list[list], ended: str) -> pd.DataFrame:
        rows = [(user, pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), n, ended) for a, b, n, _ in sessions]
        return pd.DataFrame(rows, columns=names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = [[*x, False] for x in zip(*state.get, strict=True)] if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:  # a user's rows come in parts, so no user needs to fit in memory
                batch = batch.sort_values("ts")
                at = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
                sessions = joined(sessions, at, width, (batch["kind"] == last).to_numpy() if last is not None else None)
        if done := [x for x in sessions if x[3]]:
            yield closed(key[0], done, "last")
            sessions = [x for x in sessions if not x[3]]
        passed = state.getCurrentWatermarkMs() * 1000
        if over := [x for x in sessions if x[1] + width <= passed]:
            yield closed(key[0], over, "gap")
        sessions = [x for x in sessions if x[1] + width > passed]
        if sessions:
            state.update(tuple(list(x) for x in zip(*(x[:3] for x in sessions), strict=True)))
            state.setTimeoutTimestamp(-(-(min(x[1] for x in sessions) + width) // 1000))
        elif state.exists:
            state.remove()

    rows = stream.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("kind").cast("string").alias("kind")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(step, STORY, _OPEN, "append", "EventTimeTimeout")


def joined(sessions: list[list], at: np.ndarray, width: int, ends: np.ndarray | None = None) -> list[list]:
    """sessions [first, last, rows, ended] with the rows at ascending times, of which ends says which end their session; others are apart by width at least."""
    if not len(at):
        return sessions
    ends = np.zeros(len(at), bool) if ends is None else ends
    cut = np.flatnonzero((np.diff(at) >= width) | ends[:-1]) + 1
    new = [[int(x[0]), int(x[-1]), len(x), bool(e[-1])] for x, e in zip(np.split(at, cut), np.split(ends, cut), strict=True)]
    out: list[list] = []
    for a, b, n, ended in sorted([*sessions, *new]):
        if out and not out[-1][3] and a < out[-1][1] + width:
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + n, ended]
        else:
            out.append([a, b, n, ended])
    return out


def reviewed(suggestions: DataFrame, decisions: DataFrame, within: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(id, ts, decision) of suggestions (id, ts) with the decision (id, ts, decision) that comes no earlier and within the time; without one, decision is pending.

    As streams both sides' state ends with that time: a suggestion waits for its
    decision that long, and is given out as pending once the watermarks have passed it.
    """
    s = suggestions.select("id", F.col("ts").cast("timestamp").alias("ts"))
    j = decisions.select(F.col("id").alias("_of"), F.col("ts").cast("timestamp").alias("_at"), "decision")
    if s.isStreaming:
        s, j = s.withWatermark("ts", late), j.withWatermark("_at", late)
    met = s.join(j, (F.col("id") == F.col("_of")) & (F.col("_at") >= F.col("ts")) & (F.col("_at") <= F.col("ts") + F.expr(f"INTERVAL {within}")), "left_outer")
    return met.select("id", "ts", F.coalesce("decision", F.lit("pending")).alias("decision"))


def deduplicate(stream: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key, for good: the state keeps every key; with ts only as long as duplicates may come late."""
    if ts is None or not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what there is into Parquet files, exactly once for each checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table).awaitTermination()


def process_queue(spark: SparkSession, source: DataFrame, judge, table: str, checkpoint: str, every: str | None = None) -> None:
    """Pending rows of a stream through judge (DataFrame to DataFrame with status) and into table, batch by batch.

    Each batch has its own folder, so one that is run again after a failure
    replaces what it had written.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        judge(batch.filter("status = 'pending'")).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if not every:
        query.awaitTermination()


def high_watermark(rows: DataFrame, column: str = "updated") -> DataFrame:
    """One row: the newest day, from which the next run reads again."""
    return rows.agg(F.date_trunc("day", F.max(column)).cast("date").alias("since"))


def read_since(rows: DataFrame, state: str, column: str = "updated") -> DataFrame:
    """The rows from the day on that the last run has saved in the folder state (all, if none has); saves the newest day for the next run.

    That day is read again, which idempotent writes make harmless.  A state that
    cannot be parsed counts as none; a run without rows leaves it as it is.
    """
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    last = spark.read.schema("since date").option("mode", "DROPMALFORMED").json(state).agg(F.max("since").alias("since")).first()["since"] if there else None
    new = rows.filter(F.col(column) >= F.lit(last)) if last else rows
    if (since := high_watermark(new, column).first()["since"]) is not None:
        spark.createDataFrame([(since,)], "since date").coalesce(1).write.mode("overwrite").json(state)
    return new
