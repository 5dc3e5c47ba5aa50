"""Packing, periodic runs and hard negatives against brute force."""

import hashlib
import math
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import awkward_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import negatives, packing, periodic, queries
from lodestone.llm import textscan as ts


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.BYTE_TOKENIZER, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_TOKENIZER)


@pytest.mark.parametrize("part", [8, 24, 64])
def test_ids_are_those_of_the_library(vocabulary, library, part):
    encoder = packing.Encoder(vocabulary, part)
    pick = random.Random(part)
    alphabet = ["ab", "aé", "  \n", "'s r", "01", "x", "ß日本 a", "<|endoftext|>", ".,!'", "  a", "\t \n", "½¼1", "áb"]
    for _ in range(1500):
        letters = "".join(pick.sample(alphabet, pick.randint(1, 4)))
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 200)))
        assert list(array("I", encoder.encode(text))) == library.encode(text, add_special_tokens=False).ids, text


def test_ids_of_a_long_text_without_a_space(vocabulary, library):
    pick = random.Random(3)
    encoder = packing.Encoder(vocabulary, 4096)
    for letters in ("ab", "x", "日本語", "abc012+/", "\n"):
        text = "".join(pick.choice(letters) for _ in range(60_000))
        assert list(array("I", encoder.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with open("/opt/tokenizers/word_bpe_49k.json", "rb") as f, pytest.raises(ValueError):
        packing.Encoder(f.read())


@given(st.integers(0, 9000), st.sampled_from([2048, 1000, 7]), st.integers(1, 7))
def test_pieces_add_up(n, capacity, grain):
    pieces = list(packing.cut(n, packing.shares(capacity, grain)))
    assert sum(x for _, x in pieces) == n and all(k * x <= capacity for k, x in pieces)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_bins_are_powers_of_two_long(sizes):
    bins, rows = packing.Bins(3), []
    for d, n in enumerate(sizes):
        start = 0
        for k, length in packing.cut(n, packing.shares(64)):
            rows += bins.add(k, (d, start, length, n, b"\0" * 4 * length))
            start += length
    rows += bins.close()
    filled = {}
    for _, _, length, _, sequence, offset, _ in rows:
        assert filled.get(sequence, 0) == offset  # gapless, in order
        filled[sequence] = offset + length
    assert all(n <= 64 and n & (n - 1) == 0 for n in filled.values())
    assert sum(filled.values()) == sum(sizes) and sum(n < 64 for n in filled.values()) <= 21


def check_pieces(rows, docs, library, capacity=2048):
    """docs: (doc_id, text), with different ids or none."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            own = array("I", ids[at : at + r["length"]]).tobytes()
            assert zlib.crc32(own) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0


def test_packing_of_a_table(spark, sf, library):
    rows = queries.op11_harmonic(spark, sf).collect()
    check_pieces(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], library)


def test_packing_of_awkward_rows(spark, awkward, nothing, vocabulary, library):
    from pyspark.sql import functions as F

    docs = [(k, t) for k, (_, t, *_) in enumerate(awkward_rows())]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), vocabulary).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces(rows.collect(), docs, library)
    ids = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in awkward_rows()]
    assert packing.pack(awkward, vocabulary).agg(F.sum("length")).first()[0] == sum(ids)
    assert packing.pack(nothing, vocabulary).collect() == []
    padded = packing.pack(awkward, vocabulary, capacity=100, end=None, grain=10).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert padded[0] <= 100 and padded[1] == sum(ids) - len(ids)


def runs_of(words, shortest=24, times=3):
    """Every stretch of every period, the least period of each."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(pick):
    out = []
    for _ in range(pick.randint(0, 6)):
        block = [pick.choice("abc"[: pick.randint(1, 3)]) for _ in range(pick.choice([1, 2, 3, 5, 8, 13, 20, 40]))]
        out += (block * pick.randint(1, 12))[: pick.randint(1, 150)]
        out += [str(pick.randint(0, 9)) for _ in range(pick.randint(0, 8))]
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def searched(texts, shortest=24, times=3):
    return periodic._searched(pa.array(range(len(texts)), pa.int64()), next(ts.chunks(pa.array(texts, pa.string()))), shortest, times, True).to_pylist()


def check_runs(docs, found, shortest=24, times=3):
    for words, row in zip(docs, found, strict=True):
        want = runs_of(words, shortest, times)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
        text = collapsed(words, want)
        assert (row["kept_text"], row["kept_sha256"], row["n_words"]) == (text, hashlib.sha256(text.encode()).hexdigest(), len(words))


@pytest.mark.parametrize("shortest,times", [(24, 3), (10, 3), (12, 4), (6, 3)])
def test_runs_of_repetitive_words(shortest, times):
    pick = random.Random(shortest)
    for k in range(40):
        docs = [repetitive(pick) for _ in range(pick.randint(1, 5))] + ([fibonacci(pick.randint(10, 300)), []] if k % 5 == 0 else [])
        check_runs(docs, searched([pick.choice([" ", "\n", " \t "]).join(d) for d in docs], shortest, times), shortest, times)


def test_runs_of_one_period_over_a_long_text(monkeypatch):
    """Many periods of one middle are looked at in rounds; multiples of a known period are not searched again."""
    monkeypatch.setattr(periodic, "PAIRS", 64)
    for words in (["a"] * 5000, [str(i % 7) for i in range(3000)], [str(i % 701) for i in range(4000)], fibonacci(700)):
        check_runs([words], searched([" ".join(words)]))


def test_runs_when_hashes_collide(monkeypatch):
    """Words that hash alike are told apart before a run is reported."""
    real = ts.word_hashes
    monkeypatch.setattr(ts, "word_hashes", lambda t, w, fold=None: real(t, w, fold) % np.uint64(3))
    pick = random.Random(9)
    docs = [[str(pick.randint(0, 50)) for _ in range(200)] + ["x", "y"] * 20 for _ in range(3)]
    check_runs(docs, searched([" ".join(d) for d in docs]))


def test_overlap_bounds_every_run():
    assert periodic.overlap(24, 3) == 16
    for shortest in range(3, 60):
        for times in (3, 4, 5):
            k = periodic.overlap(shortest, times)
            assert k == min(n - q for q in range(1, 80) for n in [max(shortest, times * q)])


def planted(doc_id, text):
    words = (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def check_periodic_query(rows, docs):
    want = []
    for doc_id, text in docs:
        words = planted(doc_id, text)
        runs = runs_of(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[n] for n in names) for r in rows), key=repr) == sorted(want, key=repr)


def test_periodic_query(spark, tmp_path):
    pick = random.Random(4)
    docs = [(k, pick.choice([" ", "\n"]).join(repetitive(pick) or ["w"])) for k in range(120)] + [(None, "a " * 40), (500, None), (501, ""), (502, "b " * 30), (502, "b " * 30), (503, " \n")]
    docs += [(k, " ".join(str(x) for x in range(k))) for k in range(600, 640)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, runs string").write.parquet(path)
    rows = queries.op12_periodic(spark, str(tmp_path)).collect()
    check_periodic_query(rows, docs)
    assert any(r["n_runs"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_runs_of_awkward_rows(spark, awkward, nothing):
    want = []
    for i, t, *_ in awkward_rows():
        words = (t or "").split()
        q = next((q for q in range(1, len(words) // 3) if words[q : 20_000] == words[: min(len(words), 20_000) - q]), None) if len(words) > 1000 else None
        runs = [(0, 20_000, q)] if q else runs_of(words) if len(words) <= 1000 else []
        want.append((i, runs, collapsed(words, runs)))
    rows = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in periodic.collapse(awkward).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr) and sum(bool(r) for _, r, _ in want) == 2
    assert periodic.collapse(nothing).collect() == [] and periodic.collapse(awkward, text=False).schema == periodic.collapse(awkward).schema


def mined(rows, anchor, positives, negatives_, low, high, scale):
    """rows: (vec_id, label, embedding)."""
    good = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted({i for i, _, _ in good if anchor(i)}):
        label, own = min((y, v) for i, y, v in good if i == a)
        alike, others = {}, {}
        for i, y, v in good:
            if i != a:
                to = alike if y == label else others
                to[i] = max(to.get(i, -(10**30)), dot(own, v))
        first = lambda d: sorted(d.items(), key=lambda x: (-x[1], x[0]))
        for p, s in first(alike)[:positives]:
            fits = [(i, x) for i, x in first(others) if low * s <= 100 * x <= high * s]
            out += [(a, p, k + 1, i, s, x) for k, (i, x) in enumerate(fits[:negatives_])]
    return sorted(out)


def as_rows(found):
    return sorted(tuple(r[n] for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())


def test_negatives_of_a_table(spark, sf):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, v, y in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert as_rows(queries.op13_negatives(spark, sf)) == mined(rows, lambda i: i % 100 == 0, 5, 5, 80, 100, 256)


@pytest.mark.parametrize("round_bytes", [1 << 20, 100])
def test_negatives_of_awkward_rows(spark, round_bytes):
    """Nulls, infinities, ties, repeated rows, vectors of other lengths; many rounds."""
    from pyspark.sql import functions as F

    pick = random.Random(2)
    rows = [(i, pick.randint(0, 2), [float(pick.randint(-3, 9)) for _ in range(4)]) for i in range(120)]
    rows += [(i, pick.randint(0, 2), [5.0, 5.0, 5.0, 5.0]) for i in range(120, 260)]  # ties
    rows += [rows[3], rows[3], rows[10], (10, 1, [1.0]), (20, 0, [9.0, 9.0])]
    rows += [(300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 1.0, 1.0]), (303, 1, [float("nan")] * 4), (310, 1, [float("inf")] + [1.0] * 3), (None, 1, [9.0] * 4), (320, 1, []), (330, 7, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({n: F.lit("x") for n in ("is_anchor", "score", "rank", "slot", "round")})
    found = negatives.mine(table.repartition(5), F.col("vec_id") % 10 == 0, 4, 3, 50, 100, round_bytes=round_bytes)
    assert as_rows(found) == mined(rows, lambda i: i % 10 == 0, 4, 3, 50, 100, 1)
    assert negatives.mine(table, F.lit(False)).collect() == [] and negatives.mine(table.filter("false"), F.lit(True)).collect() == []


def test_products_of_large_components_are_exact():
    pick = random.Random(1)
    a = np.array([[float(pick.randint(-(10**p), 10**p)) for _ in range(5)] for p in (1, 3, 8, 9, 9)])
    b = np.array([[float(pick.randint(-(10**p), 10**p)) for _ in range(3)] for p in (2, 9, 7, 12)])
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=False)) for v in b] for u in a]
    want = [[max(min(x, 2**63 - 1), -(2**63) + 1) for x in row] for row in want]
    assert negatives.products(a, b).tolist() == want

