"""Windows of functions are made once, and what is named already is not parsed again."""

from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.operators import build
from lodestone.operators import sequences as seq
from lodestone.plans import catalog_graph


def test_windows_are_kept(spark, sf):
    chunks = catalog_graph._grouped(spark, sf, "path", "chunk_index", "island", "name")
    plan = chunks._jdf.queryExecution().toString()
    assert "documents" not in plan and "Window" not in plan
    assert chunks.count() > 0 and chunks.columns == ["path", "chunk_index", "island", "name"]


def test_contexts_by_known_names(spark):
    rows = [("a", 0, 1, "def one(x):\n  y"), ("a", 1, 1, "  z"), ("a", 2, 2, "plain"), ("a", 3, 2, "void two(int x) {\n}")]
    chunks = spark.createDataFrame(rows, "path string, chunk_index long, island long, chunk string")
    answers = spark.createDataFrame([("a", 1, '{"summary": "s"}')], "path string, island long, answer string")
    named = chunks.select("path", "chunk_index", "island", x.function_name(F.col("chunk")).alias("name"))
    want = sorted(map(tuple, build.function_contexts(chunks, answers).collect()))
    assert sorted(map(tuple, build.function_contexts(named, answers).collect())) == want and len(want) == 3


def test_names_where_a_signature_can_be(spark):
    heads = ["def f(x):", "fn g<T>()", "pub fn h<", "words only\nand more", None, "a\nb\nc\nd\ne\ndef late(x):", "int k(a) {", "if (x) {"]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, h string")
    assert [r[0] for r in df.orderBy("k").select(x.function_name(F.col("h"))).collect()] == ["f", "g", "h", None, None, None, "k", None]


def test_windows_hold_their_own_text(spark):
    files = spark.createDataFrame([("a", "\n".join(f"l{k}" for k in range(130))), ("b", ""), ("c", None), ("d", "x")], "path string, content string")
    windows = seq.line_windows(files)
    got = {(r["path"], r["chunk_index"]): r["text"].split("\n") for r in windows.collect()}
    assert {k: (t[0], len(t)) for k, t in got.items()} == {("a", 0): ("l0", 70), ("a", 1): ("l60", 70), ("a", 2): ("l120", 10), ("d", 0): ("x", 1)}
    generate = [line for line in windows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(generate) == 1 and "slice(" in generate[0]  # cut before rows are made of it, not carried whole by each
