"""Documents written as files of a tree and read back: no row is lost, changed or taken for another."""

import duckdb
import pytest

from lodestone.plans.catalog import ORACLE_SQL, QUERIES
from lodestone.sources import files

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = {
    "nulls": [(1, None, "web"), (10, None, "web"), (2, "a", None), (None, "b", "web"), (None, None, None), (3, "c", "web")],
    "empty texts": [(1, "", "web"), (10, "", "web"), (2, "b", "web")],
    "equal paths": [(1, "a", "web"), (1, "b", "web"), (1, "b", "web"), (1, "", "web"), (1, None, "web")],
    "sources": [(10, str(k), x) for k, x in enumerate(["build", "x/vendor/y", "node_modules", "_web", ".web", "..", ".", "", "/web/", "x//y", "w b", "w%20b", "w+b", "w:b", "a\\b", "a\nb", "ü漢", "s-a/s-b", "WEB", "web", "x" * 300, "x" * 200])],
    "ids and texts": [(-10, "﻿a\r\n\tb\0c", "web"), (-(2**63), "\U0001f600", "web"), (2**63 - 1, " \n", "web")],
    "no rows": [],
}


@pytest.mark.parametrize("case", ROWS)
def test_query_and_sql(spark, tmp_path, case):
    spark.createDataFrame([(i, t, "en", s, 9) for i, t, s in ROWS[case]], DOCUMENTS).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(f"WITH documents AS (FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')) {ORACLE_SQL['src_docs_local']}").fetchall()
    ours = QUERIES["src_docs_local"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, ours), key=repr) == sorted(want, key=repr) and len(want) == len(ROWS[case])


@pytest.mark.parametrize("uri", ["file://{}", "file:{}/", "{}"])
def test_files_of_no_bytes(spark, tmp_path, uri):
    root = tmp_path / "a b%20"
    (root / "d" / ".git").mkdir(parents=True)
    for name, text in (("a.md", "a"), ("d/b.md", ""), ("c.txt", ""), ("d/.git/d.md", "")):
        (root / name).write_text(text)
    found = files.read_documents(spark, uri.format(root)).collect()
    assert sorted((r.path, r.content, r.size) for r in found) == sorted((f"file:{root}/{k}", x, len(x)) for k, x in (("a.md", "a"), ("d/b.md", ""), ("c.txt", "")))
    assert all(abs(r.modified.timestamp() - found[0].modified.timestamp()) < 600 for r in found)


def test_directories_above_the_root(spark, tmp_path):
    """Only what lies below the root is skipped for the names of its directories."""
    root = tmp_path / "build" / "tree"
    for name in ("a.md", "d/b.md", "build/c.md", "d/out/d.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    assert {r.content for r in files.read_documents(spark, f"file://{root}").collect()} == {"a.md", "d/b.md"}


def test_tasks_that_run_twice(spark, tmp_path):
    """What another attempt at the same tasks has left, or still writes, is not read."""
    rows = spark.createDataFrame([(f"d/{k}.md", f"text {k}") for k in range(20)], "path string, content string").repartition(3)
    left = files.write_tree(rows.selectExpr("path", "'' AS content"), f"file://{tmp_path}")
    folders = files.write_tree(rows, f"file://{tmp_path}")
    assert len(set(left + folders)) == len(left) + len(folders)
    read = files.read_tree(spark, f"file://{tmp_path}", folders).collect()
    assert sorted(r.content for r in read) == sorted(f"text {k}" for k in range(20))
