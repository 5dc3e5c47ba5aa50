"""The pipeline against the stages' operators said plainly, on a small table."""

import re

from conftest_llm import WORDS, awkward_rows, prose  # noqa: I001
from test_dedup import brute_components
from test_others import norm

SF = "/root/testdata/sf0.001"


def brute(rows, benchmark):
    """What exact dedup, near dedup and decontamination leave of rows (doc_id, text)."""
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, True, 0)), (-len(t or ""), i is None, i or 0))
    stay = {(None if gone else i) for _, gone, i in best.values()}
    rows = [r for r in rows if r[0] in stay and best[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")][1:] == (r[0] is None, r[0] or 0)]
    roots = brute_components(rows)
    rows = [r for r in rows if r[0] is None or roots[r[0]] == r[0]]
    windows = {tuple(w[k : k + 13]) for t in benchmark for w in [norm(t)] for k in range(len(w) - 12)}
    windows |= {tuple(w) for t in benchmark for w in [norm(t)] if 0 < len(w) < 13}

    def contaminated(text):
        w = norm(text)
        hit = {q for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for q in range(k, k + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    return [(i, t) for i, t in rows if i is None or not contaminated(t)]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    clean = p.without_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    kept = {r[0] for r in clean.select("doc_id").collect()}
    rows = [r for r in docs if r[0] in kept]
    expected = dict(brute(rows, [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]))
    found = p.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in found} == expected and len(found) == len(expected)
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in found)
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "sentencepiece"]


def test_pipeline_of_awkward_rows(spark, awkward, nothing, tmp_path):
    """Nulls, empties, ties, repeats, clashing names and a text of 50 MB; then no rows at all; and a run that goes on."""
    import corpus_pipeline as p

    huge = " ".join(f"{w}{k % 89}" for k, w in enumerate(WORDS * 370_000))
    rows = [*awkward_rows(), (50, huge, "en", "s", None), (51, prose(30, 30), "en", "s", None)]
    more = spark.createDataFrame([(*r, *["clash"] * (len(awkward.columns) - 5)) for r in rows[-2:]], awkward.schema)
    assert len(huge) > 50_000_000
    labels = spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3, 9)] + [(13, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(30, 20)), (2, None)], "item_id long, text string")
    for name, docs in (("some", awkward.union(more)), ("none", nothing)):
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/none").collect() == []
    found = p.run(spark, f"{tmp_path}/some", f"file://{tmp_path}/out")
    assert found.columns == [c for c in awkward.columns if c not in ("ids", "round_trip")] + ["ids", "round_trip", "n_tokens"]
    key = lambda r: (str(r[0]), r[1] or "")
    expected = brute([r[:2] for r in rows if r[0] != 50], [prose(30, 20)])  # nothing is called toxic, and the huge text stands alone
    assert sorted({key(tuple(r)) for r in found.filter("doc_id <> 50 OR doc_id IS NULL").select("doc_id", "text").collect()}) == sorted({key(r) for r in expected})
    assert found.filter("doc_id = 50").selectExpr("round_trip", "length(text)").first()[:] == (True, len(huge)) and found.filter("doc_id = 51").isEmpty()
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["stage-4"]
    assert p.run(spark, "nowhere/at/all", f"file://{tmp_path}/out").count() == found.count()
