"""Queries against their SQL on tables where the small ones do not bite."""

import duckdb

from lodestone.plans.catalog import ORACLE_SQL, QUERIES


def both(spark, at, name, **tables):
    """The rows of a query and of its SQL over tables (rows, schema)."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{at}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, f"file://{at}")
    result = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    return sorted(tuple(r[n] for n in names) for r in df.collect()), sorted(result.fetchall())


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_of_one_id_stay_apart(spark, tmp_path):
    """Ids are 32 bits of a hash: these pairs have equal ones, and no row of a pair may take the place of the other or go with it."""
    ids = (25302, 82945, 3447, 102617, 13914, 135365, 94092, 171607, 125234, 173228, 1, 2, 3)
    ours, theirs = both(spark, tmp_path, "snk_create_or_replace", documents=([(i, f"text {i}", "en", "web", 9) for i in ids], DOCUMENTS))
    assert ours == theirs


def test_doc_code_lists_hits_of_any_similarity(spark, tmp_path):
    """No document loses its hits for being far from all code."""
    rows = [(50 * k, [1.0, 0.0], 1) for k in range(1, 4)] + [(k, [0.1 * k, 1.0], 0) for k in range(1, 8)]
    ours, theirs = both(spark, tmp_path, "jn_doc_code", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert ours == theirs
    assert len(ours) == 9 and {r[3] for r in ours} == {True}

    far = tmp_path / "far"
    ours, theirs = both(spark, far, "jn_doc_code", embeddings=([(50, [1.0, 0.0], 1), *[(k, [-0.1 * k, 1.0], 0) for k in range(1, 8)]], "vec_id long, embedding array<float>, label int"))
    assert ours == theirs
    assert len(ours) == 3 and {r[3] for r in ours} == {False}
