"""Paged interfaces in batches and as streams: folders, numbered pages and cursors over http, restarts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lodestone.operators.ledger import Ledger
from lodestone.sources import paged, tickets


class Server(BaseHTTPRequestHandler):
    """Items 0 to total - 1, by cursor tokens at /tokens and by numbers at /numbers; the first answer is a fault."""

    total, asked, faults = 23, [], [503]

    def do_GET(self):
        at = urlparse(self.path)
        q = {k: x[0] for k, x in parse_qs(at.query).items()}
        Server.asked.append((at.path, q, self.headers.get("Authorization")))
        if Server.faults:
            self.send_response(Server.faults.pop())
            self.end_headers()
            return
        size = int(q["maxResults"])
        start = int(q.get("startAt") or q.get("nextPageToken", "t0")[1:])
        items = [{"key": f"T-{k}", "é": k} for k in range(start, min(start + size, Server.total))]
        page = {"issues": items}
        if at.path == "/numbers":
            page["total"] = Server.total
        elif start + size < Server.total:
            page["nextPageToken"] = f"t{start + size}"
        body = json.dumps(page).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def keys(df):
    return [json.loads(r["value"])["key"] for r in df.collect()]


def test_cursors_over_http(spark, server, monkeypatch):
    monkeypatch.setenv("PAGES_TOKEN", "secret")
    Server.asked, Server.faults = [], [503]
    df = tickets.fetch_pages(spark, f"{server}/tokens", size="5", tokenEnv="PAGES_TOKEN", parameters=json.dumps({"jql": "project = X"}))
    assert keys(df) == [f"T-{k}" for k in range(23)] and df.rdd.getNumPartitions() == 1
    assert all(q["jql"] == "project = X" for _, q, _ in Server.asked)
    some = tickets.fetch_pages(spark, f"{server}/tokens", size="5", **{"from": "t15"})
    assert keys(some) == [f"T-{k}" for k in range(15, 23)]


def test_numbered_pages_are_fetched_side_by_side(spark, server):
    df = tickets.fetch_pages(spark, f"{server}/numbers", size="5", total="total", cursor="startAt", perPartition="2")
    assert df.rdd.getNumPartitions() == 3 and keys(df) == [f"T-{k}" for k in range(23)]
    assert [(r["cursor"], r["place"]) for r in df.collect()][5:7] == [("5", 0), ("5", 1)]


def test_faults_of_the_interface(spark, server, monkeypatch):
    monkeypatch.setattr(paged, "WAIT", 0.01)
    Server.faults = [404]
    with pytest.raises(RuntimeError, match="404"):
        paged.HttpPages({"url": f"{server}/tokens"}).fetch("")
    Server.faults = [500] * 3
    assert len(paged.HttpPages({"url": f"{server}/tokens"}).fetch("")[0]) == 23
    Server.faults = [500] * 4
    with pytest.raises(RuntimeError, match="500"):
        paged.HttpPages({"url": f"{server}/tokens"}).fetch("")


def land(spark, folder, pages):
    rows = [(page, json.dumps({"key": k, "fields": {"summary": title, "updated": updated}})) for page, items in pages.items() for k, title, updated in items]
    spark.createDataFrame(rows, "page int, value string").repartition(2).write.mode("append").partitionBy("page").text(folder)


def run(spark, url, where, store, number, **options):
    def keep(batch, _):
        tickets.keep_changed(tickets.normalise(batch).select("key", "title", "updated"), store, run=F.lit(number))

    q = tickets.follow_pages(spark, url, **options).writeStream.foreachBatch(keep).option("checkpointLocation", where).start()
    q.processAllAvailable()
    q.stop()
    return sum(p["numInputRows"] for p in q.recentProgress)


def test_a_stream_goes_on_from_its_cursor(spark, tmp_path):
    url, where, state = (f"file://{tmp_path}/{n}" for n in ("pages", "checkpoint", "state.json"))
    store = Ledger(spark, f"file://{tmp_path}/store", ["key"], 4)
    land(spark, url, {0: [("A", "a", "1"), ("B", "b", "1")], 1: [("C", "c", "2")], 2: [("D", "d", "3")]})
    assert run(spark, url, where, store, 1, state=state, maxPages="2") == 4
    land(spark, url, {2: [("E", "e", "3")], 3: [("A", "a", "1"), ("B", "new", "4")], 4: [("F", "f", "5"), ("F", "later", "6")]})
    assert run(spark, url, where, store, 2, state=state, maxPages="2") == 5  # the rest of page 2, and pages 3 and 4
    assert json.loads((tmp_path / "state.json").read_text())["cursor"] in ("2", "3", "4")  # a batch is noted when the next one is planned
    assert run(spark, url, where, store, 3, state=state) == 0
    found = sorted(tuple(r) for r in store.read().select("key", "title", "run").collect())
    assert found == [("A", "a", 1), ("B", "new", 2), ("C", "c", 1), ("D", "d", 1), ("E", "e", 2), ("F", "later", 2)]
    land(spark, url, {5: [("G", "g", "7")]})
    assert run(spark, url, where, store, 4) == 1  # without the note it walks to the end, and reads what is new


def test_empty_folders(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    assert tickets.fetch_pages(spark, f"file://{tmp_path}/pages").collect() == []
    store = Ledger(spark, f"file://{tmp_path}/store", ["key"], 4)
    assert run(spark, f"file://{tmp_path}/pages", f"file://{tmp_path}/c", store, 1) == 0
