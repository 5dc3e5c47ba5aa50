"""What a change of the ledger rewrites."""

import pytest

from lodestone.operators import ledger as lg


@pytest.fixture
def ledger(spark, tmp_path):
    return lg.Ledger(spark, f"file://{tmp_path}/table", ["id"], buckets=4)


def rows(spark, ids, value):
    return spark.createDataFrame([(i, value) for i in ids], "id string, value string")


def test_rows_with_new_keys_are_added_and_nothing_is_rewritten(spark, ledger, monkeypatch):
    first = ledger.upsert(rows(spark, [f"a{i}" for i in range(40)], "first"))
    monkeypatch.setattr(lg.Ledger, "_write", lambda *_: pytest.fail("rewritten"))
    second = ledger.upsert(rows(spark, [f"b{i}" for i in range(40)], "second"))
    assert all(second.folders[b][:1] == first.folders[b] for b in first.folders)
    assert ledger.read().count() == 80 and ledger.read(version=1).count() == 40
    assert ledger.vacuum() == 0 and ledger.read().count() == 80


def test_replaced_rows_go_and_buckets_do_not_come_in_ever_more_parts(spark, ledger, monkeypatch):
    monkeypatch.setattr(lg, "PARTS", 2)
    for k in range(5):
        ledger.upsert(rows(spark, [None, *(f"{k}-{i}" for i in range(20))], str(k)))
    assert max(map(len, ledger.snapshot().folders.values())) <= 3
    found = {r["id"]: r["value"] for r in ledger.read().collect()}
    assert ledger.read().count() == len(found) == 101 and found[None] == "4" and found["0-3"] == "0"
    ledger.purge(rows(spark, [None, "0-3"], ""))
    assert ledger.read().count() == 99
