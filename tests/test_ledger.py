"""The store that persists: upserts, purges, conflicts, failed writers, history, against a dictionary."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators.ledger import Conflict, Ledger

SCHEMA = "id string, part int, value string"


def rows(spark, items):
    return spark.createDataFrame(list(items), SCHEMA)


def content(ledger, version=None):
    return sorted((tuple(r) for r in ledger.read(version).collect()), key=repr)


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/kb", ["id"], buckets=8)


def test_changes_are_those_of_a_dictionary(spark, ledger):
    pick, want, history = random.Random(1), {}, {}
    for step in range(8):
        if step % 3 == 2:
            gone = [f"k{pick.randint(0, 30)}" for _ in range(6)]
            at = ledger.purge(spark.createDataFrame([(g,) for g in gone], "id string"))
            want = {k: x for k, x in want.items() if k not in gone}
        else:
            batch = {f"k{pick.randint(0, 30)}": (pick.randint(0, 3), f"s{step}") for _ in range(8)} | ({None: (0, "null")} if step == 1 else {})
            at = ledger.upsert(rows(spark, [(k, *x) for k, x in batch.items()]))
            want |= batch
        history[at.version] = sorted(((k, *x) for k, x in want.items()), key=repr)
        assert content(ledger) == history[at.version]
    assert all(content(ledger, n) == x for n, x in history.items())  # former versions stay readable
    ledger.purge(spark.createDataFrame([(1,)], "part int"), by=["part"])
    assert content(ledger) == sorted(((k, *x) for k, x in want.items() if x[0] != 1), key=repr)
    ledger.clear()
    assert content(ledger) == []
    ledger.upsert(rows(spark, [("a", 1, "x")]))
    assert content(ledger) == [("a", 1, "x")]
    assert ledger.vacuum() > 0 and content(ledger) == [("a", 1, "x")]


def test_only_touched_buckets_are_rewritten(spark, ledger):
    before = ledger.upsert(rows(spark, [(f"k{i}", i, "old") for i in range(200)])).folders
    after = ledger.upsert(rows(spark, [("k7", 7, "new")]))
    assert len(before) == 8 and len(after.touched) == 1
    assert {b for b in before if before[b] != after.folders[b]} == set(after.touched)
    purged = ledger.purge(spark.createDataFrame([("k8",)], "id string"))
    assert len(purged.touched) == 1 and ledger.read().count() == 199
    assert ledger.purge(spark.createDataFrame([("absent",)], "id string")).touched == []
    assert [tuple(r) for r in ledger.lookup(spark.createDataFrame([("k7",), ("k8",)], "id string")).collect()] == [("k7", 7, "new")]


def test_last_of_equal_keys_and_new_columns(spark, ledger):
    ledger.upsert(rows(spark, [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "b")]), order="part")
    assert content(ledger) == [("a", 3, "z"), ("b", 1, "b")]
    ledger.upsert(rows(spark, [("c", 1, "c")]).withColumn("more", F.lit(5)))
    assert content(ledger) == [("a", 3, "z", None), ("b", 1, "b", None), ("c", 1, "c", 5)]
    ledger.upsert(rows(spark, [("b", 9, "b")]))
    assert content(ledger)[1] == ("b", 9, "b", None)
    ledger.upsert(rows(spark, []))
    assert len(content(ledger)) == 3


def test_a_failed_writer_leaves_no_trace(spark, ledger, monkeypatch):
    ledger.upsert(rows(spark, [("a", 1, "x"), ("b", 2, "y")]))
    before = content(ledger)
    real = Ledger._create

    def broken(self, name, text):
        raise OSError("lost")

    monkeypatch.setattr(Ledger, "_create", broken)
    with pytest.raises(OSError):
        ledger.upsert(rows(spark, [("a", 9, "lost"), ("c", 9, "lost")]))
    monkeypatch.setattr(Ledger, "_create", real)
    assert content(ledger) == before
    ledger.upsert(rows(spark, [("a", 9, "again"), ("c", 9, "again")]))  # the run that comes again
    assert content(ledger) == [("a", 9, "again"), ("b", 2, "y"), ("c", 9, "again")]
    assert ledger.vacuum() > 0 and len(content(ledger)) == 3


def test_a_writer_that_comes_late_merges_with_the_newer_commit(spark, ledger, monkeypatch):
    """Another writer commits between the merge and the commit: to other buckets, to the same ones, and each time."""
    ledger.upsert(rows(spark, [(f"k{i}", 0, "base") for i in range(40)]))
    by_bucket = {}
    for r in ledger.read().withColumn("b", ledger.bucket(F.col("id"))).collect():
        by_bucket.setdefault(r["b"], []).append(r["id"])
    mine, other = (ids[0] for ids in list(by_bucket.values())[:2])
    same = by_bucket[next(iter(by_bucket))][1]
    real, todo, merges = Ledger._write, [other], []

    def racing(self, rows_):
        out = real(self, rows_)
        merges.append(1)
        if todo:
            rival = todo.pop()
            monkeypatch.setattr(Ledger, "_write", real)
            Ledger(spark, self.root, ["id"]).upsert(rows(spark, [(rival, 1, "rival")]))
            monkeypatch.setattr(Ledger, "_write", racing)
        return out

    monkeypatch.setattr(Ledger, "_write", racing)
    ledger.upsert(rows(spark, [(mine, 2, "mine")]))
    assert len(merges) == 1  # no bucket in common: the merge stands
    todo.append(same)
    ledger.upsert(rows(spark, [(mine, 3, "mine")]))
    assert len(merges) == 3
    found = {r["id"]: (r["part"], r["value"]) for r in ledger.read().collect()}
    assert (found[mine], found[other], found[same], len(found)) == ((3, "mine"), (1, "rival"), (1, "rival"), 40)
    todo += [same] * 20
    with pytest.raises(Conflict):
        ledger.upsert(rows(spark, [(mine, 4, "mine")]))


def test_writers_at_the_same_time(spark, ledger):
    failed = []

    def write(k):
        try:
            Ledger(spark, ledger.root, ["id"]).upsert(rows(spark, [(f"w{k}-{i}", k, "x") for i in range(5)] + [("shared", k, "x")]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and ledger.read().count() == 21 and len(ledger.versions()) == 4


def test_a_table_keeps_its_keys_and_buckets(spark, ledger):
    ledger.upsert(rows(spark, [("a", 1, "x")]))
    assert Ledger(spark, ledger.root, ["id"], buckets=99).buckets == 8
    with pytest.raises(ValueError):
        Ledger(spark, ledger.root, ["part"])
    with pytest.raises(ValueError):
        Ledger(spark, f"{ledger.root}-other", ["id"]).read()
