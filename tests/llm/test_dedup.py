"""Near, exact and substring deduplication against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import awkward_rows, prose  # noqa: I001
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.exact import ExactIndex, differing, exact_duplicates, first_copies
from lodestone.llm.minhash import deal, near_duplicates
from lodestone.llm.scratch import Scratch
from lodestone.llm.substring import FingerprintIndex, remove_repeats


def documents(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1)))}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i, _ in sets}


def check_near(found, rows):
    expected = brute_components(rows)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingles(t)))
    assert len(found) == len(rows)
    for r in found:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_on_a_table(spark, sf):
    docs = documents(spark, sf)
    check_near(near_duplicates(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_of_awkward_rows(awkward):
    check_near(near_duplicates(awkward).collect(), [r[:2] for r in awkward_rows()])


def test_near_duplicates_in_a_chain_and_a_crowd(spark):
    words = prose(9, 60).split()
    rows = []
    for k in range(12):  # each links with the next ones only
        words[4 * k] = f"w{k}"
        rows.append((k, " ".join(words)))
    base = prose(8, 100).split()
    for k in range(300):  # a crowd around one text, at a distance from each other
        own = list(base)
        for j in (k % 90, (k * 7 + 3) % 97):
            own[j] = f"v{k}_{j}"
        rows.append((100 + k, " ".join(own)))
    half = prose(6, 70)
    rows += [(1000 + k, half + " " + prose(50 + k, 45)) for k in range(60)]  # share a passage, but too little
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_near(found, rows)


def test_a_crowd_with_one_stray_is_dealt_in_proportion(spark):
    """100,000 members of one component and a stray: no pairs of blocks of the crowd."""
    rows = spark.range(100_000).selectExpr("7L AS band", "id AS rep", "if(id = 99, 99L, 0L) AS component")
    dealt = deal(rows, Scratch(spark, "test"))
    assert dealt.count() < 2 * 100_000 and dealt.groupBy("i", "j").count().agg({"count": "max"}).first()[0] < 700
    met = dealt.filter("component = 0").join(dealt.filter("component = 99").selectExpr("i", "j", "rep AS stray"), ["i", "j"])
    assert met.select("rep").distinct().count() == 99_999
    assert deal(rows.withColumn("component", F.lit(0)), Scratch(spark, "test")).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id are one document: it links by any of its texts."""
    rows = [(1, prose(1, 40)), (2, prose(2, 40)), (2, prose(1, 40)), (3, prose(2, 40)), (2, ""), (3, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found if r["n_shingles"]} == {(1, 1), (2, 1), (3, 1)}


def test_near_duplicates_of_nothing(nothing):
    assert near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, None), (52, 50)], [(9, 1), (9, 2), (3, 1), (3, 9)]])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for s in sorted(near):
        todo = [s] if s not in expected else []
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = s
                todo += near[x]
    assert {r["id"]: r["component"] for r in found} == expected and len(found) == len(expected)


def check_exact(found, rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i))
    best = {k: min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for k, g in groups.items()}
    expected = sorted((str(i), str(best[squeeze(t)]), len(groups[squeeze(t)]), i == best[squeeze(t)], hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in found) == expected


def test_exact_duplicates(spark, sf, awkward):
    docs = documents(spark, sf)
    check_exact(exact_duplicates(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    check_exact(exact_duplicates(awkward).collect(), [r[:2] for r in awkward_rows()])


def test_exact_duplicates_over_several_batches(spark, sf):
    docs = documents(spark, sf)
    one = sorted(map(tuple, exact_duplicates(docs).collect()))
    assert sorted(map(tuple, exact_duplicates(docs.repartition(6), files_per_batch=1).drop("locator").collect())) == [r[:-1] for r in one]


def test_exact_state_lasts(spark, sf, tmp_path):
    """Two calls on one state folder, the second by an index opened anew, give what one call gives; a call made again adds nothing."""
    documents(spark, sf).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    scratch = Scratch(spark, "test")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    ExactIndex(spark, scratch.path("index")).add(first, scratch, "a")
    ExactIndex(spark, scratch.path("index")).add(second, Scratch(spark, "test"), "b")
    index = ExactIndex(spark, scratch.path("index"))
    both = [r for name, part in (("a", first), ("b", second)) for r in index.add(part, Scratch(spark, "test"), name).collect()]
    check_exact(both, rows)
    assert index.groups().agg({"group_size": "sum"}).first()[0] == len(rows)


def test_exact_state_compares_earlier_texts(spark, tmp_path):
    """A text is compared with that of an earlier call, which its locator names; one that has changed there is noticed."""
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "old"))
    scratch = Scratch(spark, "test")
    ExactIndex(spark, scratch.path("index")).add(spark.read.parquet(str(tmp_path / "old")), scratch)
    index = ExactIndex(spark, scratch.path("index"))
    found = index.add(spark.createDataFrame([(3, "ab"), (4, "d")], "doc_id long, text string"), Scratch(spark, "test")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == [(3, 1, 2), (4, 4, 1)]
    rows = spark.createDataFrame([("d", "x"), ("d", "x"), ("e", "x"), ("e", "y")], "digest string, content string")
    assert [r[0] for r in differing(rows).collect()] == ["e"]


def test_first_copies_keep_columns(awkward, nothing):
    kept = first_copies(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {6, 12} <= set(ids) and not {1, 2, 4, 5} & set(ids)
    assert first_copies(nothing).collect() == []
    assert exact_duplicates(nothing).collect() == []


def check_removed(found, rows, width=13):
    first = {}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    expected = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        expected.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == sorted(expected)


def test_remove_repeats(spark, sf, awkward):
    docs = documents(spark, sf)
    check_removed(remove_repeats(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    check_removed(remove_repeats(awkward).collect(), [r[:2] for r in awkward_rows()])


@pytest.mark.parametrize("history", [0.0, 0.9])
def test_remove_repeats_is_the_same_for_any_split(spark, sf, history):
    docs = documents(spark, sf)
    check_removed(remove_repeats(docs, history=history).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_remove_repeats_by_hash_alone(awkward):
    hashed = {(r["doc_id"], r["kept_sha256"]) for r in remove_repeats(awkward, text=False).collect()}
    assert hashed == {(r["doc_id"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in remove_repeats(awkward).collect()}


def test_remove_repeats_of_nothing(nothing):
    assert remove_repeats(nothing).collect() == []


def test_index_compaction(spark, sf):
    """Several batches, compacted three times in between and opened anew for each, judge as one."""
    docs = documents(spark, sf)
    scratch = Scratch(spark, "test")
    hits, cuts = None, (0, 20, 50, 70, 90, 10_000)
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        index = FingerprintIndex(spark, scratch.path("index"), 13, 16)
        assert len(index.runs) == min(k, 1)
        new = index.ingest(docs.filter(f"doc_id >= {low} AND doc_id < {high}"), scratch, f"b{k}")
        hits = new if hits is None else hits.union(new)
        if 0 < k < 4:
            index.compact()
            assert len(index.runs) == 1
    assert index.runs[0] < index.runs[1] == 7
    check_removed(index.apply(docs, hits, scratch).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    with pytest.raises(ValueError):
        FingerprintIndex(spark, scratch.path("index"), 12)
    index.drop()


def test_index_reads_history_where_it_lies(spark, sf):
    """A batch is dealt to buckets; the runs it is merged with are not."""
    docs = documents(spark, sf)
    scratch = Scratch(spark, "test")
    index = FingerprintIndex(spark, scratch.path("index"), 13, 16)
    for k in (0, 1):
        index.ingest(docs.filter(f"doc_id % 2 = {k}"), scratch, f"b{k}")
    plan = index.merge(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    index.drop()


@pytest.mark.parametrize("bits", [6, 12])
def test_remove_repeats_does_not_depend_on_the_hash(spark, sf, awkward, bits):
    """Windows of one hash are told apart by their words."""
    docs, rows = (documents(spark, sf), None) if bits > 6 else (awkward, [r[:2] for r in awkward_rows()])
    check_removed(remove_repeats(docs, bits=bits).collect(), rows or [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_a_window_of_every_document_is_dealt_out_once_a_task(spark):
    """Its hits bypass the bucket: what is dealt out does not grow with the documents."""
    from lodestone.llm import substring, textscan

    passage = prose(1, 13)
    ids = pa.array(range(3000), pa.int64())
    texts = pa.array([f"a{k} {passage} b{k}" for k in range(3000)])
    batches = [pa.RecordBatch.from_arrays([ids.slice(k, 100), texts.slice(k, 100)], names=["doc_id", "text"]) for k in range(0, 3000, 100)]
    rows = [b.to_pylist() for b in substring._scanner(13, 64, (1 << 64) - 1)(iter(batches))]
    one = textscan.Texts(np.frombuffer(passage.encode(), np.uint8), np.array([0, len(passage)]), 0)
    hot = substring.window_hashes(one, 13, (1 << 64) - 1)[2][0]
    count = lambda kind: sum(int((np.frombuffer(r["hashes"], np.uint64) == hot).sum()) for b in rows for r in b if r["kind"] == kind)
    assert count(substring.NEW) == 1 and count(substring.HIT) == 2999
