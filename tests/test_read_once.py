"""Texts are parsed once, and many small files or pages share a task."""

import pytest

from lodestone.operators import graph as g
from lodestone.plans.catalog import QUERIES
from lodestone.sources import files, paged


def test_trees_of_many_files(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}" / f"{k}.md").write_text(f"text {k}")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")  # each file has a partition of its own
    try:
        read = files.read_tree(spark, f"file://{tmp_path}")
        assert read.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
        assert {r["content"] for r in read.collect()} == {f"text {k}" for k in range(300)}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_references_are_parsed_once(spark, sf):
    found = QUERIES["str_cross_refs"](spark, sf)
    assert "documents" not in found._jdf.queryExecution().toString()


def test_heads_that_are_known(spark):
    tree = spark.createDataFrame([("a.h", "x" * 30 + "\ny\n"), ("b.h", "short"), ("c.py", "\n".join(["long line of code"] * 50))], "path string, content string")
    chunks = spark.createDataFrame([(1, "c.py", ["a.h", "b.h", "c.py"])], "id int, path string, refs array<string>")
    heads = tree.select("path", g.head_of(tree["content"]).alias("head"))
    want = g.reference_context(chunks, tree).collect()
    assert g.reference_context(chunks, heads).collect() == want and want[0]["context"].endswith("(10 more lines)")


@pytest.mark.parametrize("skip", [0, 1])
def test_pages_of_a_stream_share_tasks(tmp_path, skip):
    for k in range(20):
        (tmp_path / f"page={k}").mkdir()
        (tmp_path / f"page={k}" / "part-0").write_text(f"{k}a\n{k}b\n")
    options = {"url": f"file://{tmp_path}", "perpartition": "4"}
    stream = paged.PagedStream(options)
    end = stream.latestOffset()
    parts = stream.partitions({"cursor": "", "items": skip}, end)
    assert len(parts) <= 7  # not one for each page
    assert sorted(x[2] for p in parts for x in stream.read(p)) == sorted([f"{k}{x}" for k in range(20) for x in "ab"][skip:])


def test_a_bucket_of_a_batch_is_one_file(spark, tmp_path):
    from lodestone.operators.ledger import Ledger

    store = Ledger(spark, f"file://{tmp_path}/store", ["key"], buckets=5)
    rows = spark.range(400).selectExpr("id % 200 AS key", "id AS n").repartition(8)
    store.upsert(rows, "n")
    assert len(list((tmp_path / "store" / "data").glob("*/*/part-*"))) == 5
    assert {(r["key"], r["n"]) for r in store.read().collect()} == {(k, k + 200) for k in range(200)}
