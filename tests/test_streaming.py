"""Streams against the same question asked of the whole table."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.streaming import flows


def stream_of(spark, folder, df, parts):
    df.repartition(parts).write.mode("overwrite").parquet(str(folder / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_duplicates_across_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "event_type").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    for name, ts in (("late", "ts"), ("good", None)):
        (tmp_path / name).mkdir()
        flows.run_available(flows.deduplicate(stream_of(spark, tmp_path / name, e, 4), ["user_id", "event_type"], ts), str(tmp_path / name / "out"), str(tmp_path / name / "check"))
        found = spark.read.parquet(str(tmp_path / name / "out"))
        assert found.count() == e.select("user_id", "event_type").distinct().count()


def test_queue_runs_pending_rows_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, "pending" if k % 3 == 0 else "indexed") for k in range(30)], "id int, status string")
    source = stream_of(spark, tmp_path, rows, 3)
    for _ in range(2):
        flows.process_queue(spark, source, lambda b: b.withColumn("status", F.lit("indexed")), str(tmp_path / "out"), str(tmp_path / "check"))
    found = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in found.collect()) == list(range(0, 30, 3))


def test_sessions_close_at_gaps(spark):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-01 10:00:00")], "user_id int, ts string")
    found = flows.sessions(e).groupBy("user_id").agg(F.count("*").alias("k"), F.sum("n").alias("n")).orderBy("user_id").collect()
    assert [tuple(r) for r in found] == [(1, 2, 3), (2, 1, 1)]


def test_high_watermark_of_nothing(spark):
    assert flows.high_watermark(spark.createDataFrame([], "updated timestamp")).first()["since"] is None


def test_reading_goes_on_from_the_saved_day(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-02 23:00:00")], "id int, updated string").withColumn("updated", F.col("updated").cast("timestamp"))
    state = f"file://{tmp_path}/state"
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(flows.read_since(rows.filter("false"), state)) == [] and ids(flows.read_since(rows.filter("id < 3"), state)) == [1, 2]
    assert ids(flows.read_since(rows, state)) == [2, 3] and ids(flows.read_since(rows.filter("id = 1"), state)) == []
    assert ids(flows.read_since(rows, state)) == [2, 3]


def steps(spark, folder, schema, batches, start):
    """Run a stream over batches that land one by one, each run a restart; the rows that come out of each."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = []
        q = start(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.outputMode("append").foreachBatch(lambda b, _, g=got: g.extend(tuple(r) for r in b.collect()))
        q.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(got))
    return out


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_sessions_of_a_stream(spark, tmp_path):
    """Rows out of order, late ones, a session that later rows join, timers, restarts, a last kind of row."""
    batches = [
        [(1, at(0), "a"), (1, at(20), "a"), (2, at(5), "a"), (1, at(60), "a")],  # watermark 50
        [(1, at(85), "a"), (1, at(52), "a"), (3, at(90), "a"), (1, at(10), "a")],  # at(10) is late; 52, 60 and 85 are one session
        [(4, at(200), "a")],  # a row of another user lets time pass
        [(4, at(210), "end"), (4, at(215), "a"), (5, at(400), "a")],
        [(6, at(500), "a")],
    ]
    found = steps(spark, f"file://{tmp_path}", "user_id long, ts timestamp, kind string", batches, lambda s: flows.session_stories(s, last="end"))
    every = [x for part in found for x in part]
    assert sorted(every) == [
        (1, at(0), at(20), 2, "gap"), (1, at(52), at(85), 3, "gap"), (2, at(5), at(5), 1, "gap"), (3, at(90), at(90), 1, "gap"),
        (4, at(200), at(210), 2, "last"), (4, at(215), at(215), 1, "gap"), (5, at(400), at(400), 1, "gap"),
    ]
    assert found[0] and all(x[0] in (1, 2) for x in found[0])  # their time is over with the first batch's watermark


def test_joined_sessions_are_those_of_a_sort():
    pick = random.Random(4)
    for _ in range(200):
        times = [pick.randint(0, 300) for _ in range(pick.randint(1, 40))]
        sessions = []
        for k in range(0, len(times), 7):
            sessions = flows.joined(sessions, np.array(sorted(times[k : k + 7])), 10)
        sessions = [x[:3] for x in sessions]
        want = []
        for t in sorted(times):
            if want and t < want[-1][1] + 10:
                want[-1] = [want[-1][0], t, want[-1][2] + 1]
            else:
                want.append([t, t, 1])
        assert sessions == want


def test_decisions_meet_suggestions_in_time(spark, tmp_path):
    """Decisions before, within, at and beyond the bound, none, and one that comes after a restart."""
    asked = [[(1, at(0)), (2, at(0)), (3, at(0)), (4, at(0)), (5, at(10))], [(6, at(20))], [(-1, at(600))]]
    told = [[(1, at(5), "approve"), (2, at(30), "reject"), (3, at(31), "approve"), (5, at(9), "approve")], [(6, at(45), "edit"), (9, at(50), "approve")], [(-1, at(600), "")]]
    got = []
    for s, j in zip(asked, told, strict=True):
        spark.createDataFrame(s, "id int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        spark.createDataFrame(j, "id int, ts timestamp, decision string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/told")
        a, b = spark.readStream.schema("id int, ts timestamp").parquet(f"{tmp_path}/asked"), spark.readStream.schema("id int, ts timestamp, decision string").parquet(f"{tmp_path}/told")
        q = flows.reviewed(a, b).writeStream.outputMode("append").foreachBatch(lambda x, _: got.extend((r["id"], r["decision"]) for r in x.collect()))
        q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    want = [(1, "approve"), (2, "reject"), (3, "pending"), (4, "pending"), (5, "pending"), (6, "edit")]
    assert sorted(x for x in got if x[0] > 0) == want
    batch = flows.reviewed(spark.createDataFrame([x for s in asked for x in s], "id int, ts timestamp"), spark.createDataFrame([x for j in told for x in j], "id int, ts timestamp, decision string"))
    assert sorted((r["id"], r["decision"]) for r in batch.filter("id > 0").collect()) == want


def test_sketches_union_over_runs(spark, tmp_path):
    rows = [(f"s{k % 3}", f"f{k % (50 * (1 + k % 3))}") for k in range(3000)]
    runs = [rows[:2000], rows[1000:]]
    for run in runs:
        graph.sketch_callers(spark.createDataFrame(run, "symbol string, path string"), f"{tmp_path}/sketches")
    exact = {s: len({p for x, p in rows if x == s}) for s in ("s0", "s1", "s2")}
    found = {r["symbol"]: r["n_files"] for r in graph.estimated_callers(spark.read.parquet(f"{tmp_path}/sketches")).collect()}
    assert found.keys() == exact.keys() and all(abs(found[s] - exact[s]) <= 1 + 0.05 * exact[s] for s in exact)
