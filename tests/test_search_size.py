"""What a search by text writes and shuffles does not grow with the documents that its queries match."""

from lodestone.operators import search, textindex
from lodestone.plans import catalog_store


def test_matches_are_not_written_out(spark, tmp_path):
    """Forty queries that all of 3,000 documents match alike."""
    store = spark.createDataFrame([(k, f"same words here {'more ' * (k % 3)}") for k in range(3000)], "doc_id long, text string")
    queries = spark.createDataFrame([(k, "same words more") for k in range(40)], "query_id long, text string")
    index = textindex.TextIndex.build(store, f"file://{tmp_path}/index", buckets=3)
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in index.search(queries, 5).collect()}
    assert got == {(r["query_id"], r["rank"], r["doc_id"]) for r in search.text_rank(store, queries, 5).collect()}
    kept = [spark.read.parquet(str(p)).count() for p in (tmp_path / "index" / "searches").glob("*/*")]
    assert sum(kept) <= 40 * (3 + 1)  # terms and a score each, not 120,000 matches


def test_a_part_passes_on_its_best_only(spark, tmp_path):
    store = spark.createDataFrame([(k, "a b") for k in range(500)], "doc_id long, text string")
    index = textindex.TextIndex.build(store, f"file://{tmp_path}/index", buckets=2)
    asked, reach = index._asked(spark.createDataFrame([(1, "a b"), (2, "b")], "query_id long, text string"), 4)
    assert index._met(asked, 4, reach).count() <= 2 * 2 * 4


def test_rows_of_one_id(spark, tmp_path):
    """Rows that share an id are scored as where terms are counted by grouping; rows without one are left out."""
    store = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a c d"), (2, "a"), (3, None), (4, "b b b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "query_id long, text string")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    assert rows(textindex.TextIndex.build(store, f"file://{tmp_path}/a").search(queries, 3)) == rows(search.text_rank(store, queries, 3))
    with_none = store.union(spark.createDataFrame([(None, "a b")], "doc_id long, text string"))
    assert rows(textindex.TextIndex.build(with_none, f"file://{tmp_path}/b").search(queries, 3)) == rows(search.text_rank(store, queries, 3))


def test_texts_are_joined_once(spark, sf):
    store = catalog_store.texts(spark, sf)
    assert "Join" not in store._jdf.queryExecution().toString()
    assert store.count() == spark.read.parquet(f"{sf}/embeddings.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS vec_id"), "vec_id").count()
