"""Functions over several chunks: grouping against a plain loop, cards, contexts."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.operators import build
from lodestone.operators import sequences as seq


def groups(chunks, name, overlap):
    """The island of each chunk."""
    out, island = [], 0
    for i, c in enumerate(chunks):
        goes_on = False
        if i:
            head = "\n".join(c.splitlines()[:overlap]).strip()
            tail = "\n".join(chunks[i - 1].splitlines()[-overlap:])
            rest = c.splitlines()[overlap:]
            goes_on = bool(name(c) and name(c) == name(chunks[i - 1])) or bool(head and head in tail and rest and rest[0].startswith((" ", "\t")))
        island += not goes_on
        out.append(island)
    return out


def named(chunk):
    for line in chunk.splitlines()[:5]:
        if line.startswith("def "):
            return line[4:].split("(")[0]
    return None


def test_groups_are_those_of_a_loop(spark):
    pick = random.Random(3)
    rows, want = [], {}
    for f in range(40):
        lines = [pick.choice([f"def f{pick.randint(0, 2)}(x):", "    a", "    b", "  ", "c", "\tt", "    a"]) for _ in range(pick.randint(1, 60))]
        step, length, overlap = pick.choice([(6, 9, 3), (5, 8, 3), (4, 4, 3)])
        chunks = ["\n".join(lines[i : i + length]) + pick.choice(["", "\n"]) for i in range(0, len(lines), step)]
        rows += [(f"p{f}", i, c) for i, c in enumerate(chunks)]
        want |= {(f"p{f}", i): k for i, k in enumerate(groups(chunks, named, 3))}
    df = spark.createDataFrame(rows, "path string, chunk_index int, text string").repartition(5)
    found = seq.function_groups(df, x.function_name(F.col("text")), ["path"], "chunk_index", overlap=3)
    assert found.columns == ["path", "chunk_index", "text", "island"]
    assert {(r["path"], r["chunk_index"]): r["island"] for r in found.collect()} == want
    assert len(set(want.values())) > 3 and sum(want[k] == want.get((k[0], k[1] - 1)) for k in want) > 20


def test_no_window_and_nulls(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, ""), (None, 0, "def f(x):\n    y"), (None, 1, "def f(x):\n    y")], "path string, chunk_index int, text string")
    found = {(r["path"], r["chunk_index"]): r["island"] for r in seq.function_groups(df, x.function_name(F.col("text")), ["path"], "chunk_index").collect()}
    assert found == {("a", 0): 1, ("a", 1): 2, (None, 0): 1, (None, 1): 1}
    assert seq.function_groups(df.filter("false"), x.function_name(F.col("text")), ["path"], "chunk_index").collect() == []


def test_contexts(spark):
    chunks = [("p", 0, 1, "def f(x):\n    a"), ("p", 1, 1, "    b"), ("p", 2, 1, "    c"), ("p", 3, 2, "def g(x):"), ("q", 0, 1, "def h(x):"), ("q", 1, 1, "    z"), ("r", 0, 1, "1"), ("r", 1, 1, "2"), ("s", 0, 1, "def k(x):"), ("s", 1, 1, "  1")]
    answers = [
        ("p", 1, json.dumps({"summary": "adds", "params": ["x: one", "y: two"], "chunk_questions": [["why", "when"], "who"]})),
        ("q", 1, "no JSON"), ("s", 1, "```json\n" + json.dumps({"params": []}) + "\n```"),
    ]
    found = build.function_contexts(spark.createDataFrame(chunks, "path string, chunk_index int, island int, chunk string"), spark.createDataFrame(answers, "path string, island int, answer string"))
    assert {(r["path"], r["chunk_index"]): r["context"] for r in found.collect()} == {
        ("p", 0): "[Function: f] adds\nParameters: x: one; y: two\nFocus on: why; when",
        ("p", 1): "[Continuation of f()] adds\nParameters: x: one; y: two\nFocus on: who",
        ("p", 2): "[Continuation of f()] adds\nParameters: x: one; y: two",
        ("q", 1): "[Continuation of h()]",
        ("r", 1): "[Continuation of unknown()]",
        ("s", 0): "[Function: k] k: unknown purpose",
        ("s", 1): "[Continuation of k()] k: unknown purpose",
    }
