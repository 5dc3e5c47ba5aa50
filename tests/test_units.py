"""Operators on inline rows with results worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.api import KnowledgeBase, call_tool
from lodestone.functions import text as x
from lodestone.operators import explore, graph, metrics, models, modules, review, search, sequences, store
from lodestone.sources import files, tickets
from lodestone.sources.html_sections import sections


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tickets(spark):
    schema = "key string, title string, status string, resolution string, comments array<struct<author: string, body: string>>"
    two = [("a", "x"), ("b", "y")]
    rows = [("T-1", "one", "Done", "Fixed", two), ("T-2", "two", "Open", None, two), ("T-3", "three", "Done", None, two[:1]), ("T-4", "four", "Closed", "Won't Fix", two), ("X-5", "five", "Open", None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in values(review.structural_filter(df, "^T-").select("key"))] == ["T-1", "T-2"]
    text = df.filter("key = 'T-1'").select(x.ticket_context(F.col("key"), F.col("title"), F.lit(""), F.col("resolution"), F.col("comments"))).first()[0]
    assert text == "Ticket: T-1 — one\n\nResolution: Fixed\n\nRecent comments:\n  [a]: x\n  [b]: y"


def test_issue_json(spark):
    issue = {"key": "K-1", "fields": {"summary": "S", "status": {"name": "Done"}, "labels": ["l"], "comment": {"comments": [{"author": {"emailAddress": "m@x"}, "body": "hi"}]}, "issuelinks": [{"outwardIssue": {"self": "http://h/pull/3"}}]}}
    r = tickets.normalise(spark.createDataFrame([(json.dumps(issue),), ("{}",)], "value string")).collect()
    assert (r[0]["key"], r[0]["status"], r[0]["resolution"], r[0]["comments"][0]["author"], r[0]["linked_prs"]) == ("K-1", "Done", "", "m@x", ["http://h/pull/3"])
    assert r[1]["key"] == "" and r[1]["labels"] == []


def test_rich_text():
    node = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "paragraph", "content": []}]}
    assert tickets.rich_text(json.dumps(node)) == "a\nb" and tickets.rich_text("plain") == "plain" and tickets.rich_text(None) == ""


def test_query_language(spark):
    make = lambda p, since, st: spark.range(1).select(tickets.jql(F.array(*map(F.lit, p)).cast("array<string>"), F.lit(since), F.array(*map(F.lit, st)).cast("array<string>"))).first()[0]
    assert make(["A", "B"], "-5d", ["Done", "Closed"]) == "project in (A, B) AND status in (Done, Closed) AND updated >= -5d"
    assert make(["A"], "", []) == "project = A" and make([], None, []) == ""


@pytest.mark.parametrize("path,expected", [("src/a.py", False), ("tests/a.py", True), ("jtest/a", True), ("latest/a", False), ("contest/a", False), ("x/testutil/a", True), ("mock_x/a", True), ("a/unittest/b", True)])
def test_paths_of_tests(spark, path, expected):
    assert spark.range(1).select(files.is_test_path(F.lit(path))).first()[0] is expected


def test_read_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name in ("a.md", "b.py", "node_modules/c.md"):
        (tmp_path / name).write_text("# t\nü")
    found = files.read_documents(spark, f"file://{tmp_path}").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["a.md"] and found[0]["content"] == "# t\nü"


def test_sections(spark):
    md = "---\ntitle: t\n---\nintro\n# One\nalpha\n## Two\nbeta"
    r = spark.range(1).select(x.sections(F.lit(md))).first()[0]
    assert [(s["heading"], s["level"], s["content"]) for s in r] == [("", 0, "intro"), ("One", 1, "alpha"), ("Two", 2, "beta")]
    assert sections("<h1>A</h1><script>x</script><p>b</p>") == [("A", 1, "b")] and sections(None) == []


def test_paragraphs(spark):
    pack = lambda t, n: spark.range(1).select(sequences.pack_paragraphs(F.lit(t), n)).first()[0]
    assert pack("aa\n\nbb\n\ncccccccc\n \n\n dd ", 6) == ["aa\n\nbb", "cccccc", "cc\n\ndd"]
    assert pack("", 5) == [] and pack("abc", 5) == ["abc"]


def test_chunks_of_whole_documents(spark, tmp_path):
    """Every document's chunks against a packer in plain Python."""
    from lodestone.plans.catalog import QUERIES

    def pack(text, most=4000):
        done, now = [], ""
        for p in filter(None, (p.strip() for p in text.strip().split("\n\n"))):
            if now and len(now) + len(p) + 2 > most:
                done.append(now)
                now = ""
            while len(p) > most:
                done.append(p[:most])
                p = p[most:]
            now = f"{now}\n\n{p}" if now else p
        return max(1, len(done) + bool(now))

    para = lambda n: "word " * (n // 5)
    texts = ["", " \n\n ", None, "short", "x" * 4000, "x" * 4001, "x" * 9000, para(30_000), "\n\n".join(map(para, [1500, 2400, 100, 90, 3900, 8100, 5])), "\n \n".join([para(3000)] * 3), "\n\n \n\n".join([para(1999)] * 9) + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_chunks"] for r in QUERIES["str_chunk_document"](spark, str(tmp_path)).collect()}
    assert found == {k: pack(t or "") for k, t in enumerate(texts)} and max(found.values()) > 3


def test_calls(spark):
    code = "Foo::run(a(b(c(1)))); if (x) String(y); MACRO_X(z); o.method(1); later(2)"
    assert spark.range(1).select(x.calls_from_code(F.lit(code))).first()[0] == ["Foo::run", "later"]
    nested = spark.range(1).select(x.calls_from_code(F.lit("one_fn(two_fn(three_fn("))).first()[0]
    assert nested == ["one_fn", "two_fn", "three_fn"]


def test_call_graph(spark):
    lines = spark.createDataFrame([(f"f{k}", "  x.helper(1) + LOG(2) + helper(3)") for k in range(6)] + [("f0", "helper(4)")], "path string, line string")
    assert values(graph.caller_frequency(lines)) == [("helper", 6)]
    assert values(graph.caller_frequency(spark.createDataFrame([], "path string, line string"))) == []
    edges = graph.call_edges(spark.createDataFrame([("a", "t", 1), ("a", "t", 2), *[(f"c{k}", "t", 1) for k in range(6)], ("t", "t", 1)], "caller string, callee string, ord int"))
    said = graph.called_by_suffix(spark.createDataFrame([("t", "does "), ("u", "other")], "symbol string, summary string"), edges)
    assert values(said) == [("t", "does Called by: a, c0, c1, c2, c3 and 2 more."), ("u", "other")]


def test_modules(spark):
    f = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("z.py",)], "path string")
    m = spark.createDataFrame([("a", "A", 2), ("a/b", "B", 1)], "dir string, module string, ord int")
    assert values(modules.assign_exclusive(f, m)) == [("a/b/x.py", "B"), ("a/y.py", "A")]
    assert values(modules.orphan_prefix(f, m)) == [("a/b/x.py", "B", 3), ("a/y.py", "B", 1), ("z.py", "other", 0)]
    assert values(modules.tree_counts(f)) == [("a", 1, 2, 1), ("a/b", 1, 1, 0)]


def test_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0])]
    s = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = s.filter("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    assert values(search.top_k(s, q, 2).select("doc_id", "rank")) == [(1, 1), (4, 2)]
    assert values(search.top_k(s, q, 1, exclude_self=True).select("doc_id", "score")) == [(4, 1.0)]
    assert values(search.top_k(s, q.filter("false"), 2)) == [] and values(search.top_k(s.filter("false"), q, 2)) == []


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], "id string, v int")
    once = store.upsert(old, new, ["id"], "v")
    assert values(once) == [("a", 1), ("b", 2), ("c", 3)] == values(store.upsert(once, new, ["id"], "v"))


def test_savings_of_nothing(spark):
    log = spark.createDataFrame([], "num_results long, n_files long, approx_tokens long")
    r = metrics.savings(log).first()
    assert r["total_queries"] == 0 and r["reduction_pct"] == 0.0


def test_model_boundary(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "a quota")], "id int, t string").coalesce(1)

    def call(texts):
        if any(t.startswith("b") for t in texts):
            raise ValueError("no")
        if any("quota" in t for t in texts):
            raise ValueError("quota exceeded")
        return [t.upper() for t in texts]

    assert [r[1:] for r in values(models.call_model(rows, "t", call).select("id", "answer", "status"))] == [("GOOD", "ok"), (None, "failed"), ("", "ok"), (None, "skipped")]


def test_knowledge_base(spark):
    rows = spark.createDataFrame([(1, "x", "code", "m", "f", [1.0, 0.0]), (2, "y", "doc", "m", "g", [0.0, 1.0])], "doc_id long, text string, source_type string, module string, source_file string, embedding array<double>")
    kb = KnowledgeBase(spark, rows)
    assert [r["doc_id"] for r in kb.search([1.0, 0.1], 1).collect()] == [1]
    assert [r["doc_id"] for r in kb.search([1.0, 0.1], 1, ["doc"]).collect()] == [2]
    kb = kb.add(rows.filter("doc_id = 2").withColumn("text", F.lit("z")))
    assert kb.rows.filter("doc_id = 2").first()["text"] == "z" and kb.rows.count() == 2
    assert kb.remove(rows.select("doc_id").filter("doc_id = 1")).rows.count() == 1
    with pytest.raises(ValueError):
        call_tool(kb, "drop_everything")


def test_search_in_blocks_is_that_at_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for k in range(150)]  # many ties
    s = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = s.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    for exclude in (False, True):
        once = values(search.top_k(s, q, 4, exclude))
        monkeypatch.setattr(search, "QUERY_BLOCK", 20)
        monkeypatch.setattr(search, "STORE_BLOCK", 40)
        assert values(search.top_k(s, q, 4, exclude)) == once and len(once) == 200
        monkeypatch.undo()


def test_text_ranking(spark):
    rows = [(1, "the cat sat"), (2, "the dog sat on the Cat"), (3, None), (4, "dogs"), (5, "the cat sat")]
    s = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(10, "CAT, cat!"), (11, "nothing here"), (12, None)], "query_id long, text string")
    found = search.text_rank(s, q, 2).collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in found) == [(10, 1, 1), (10, 5, 2)]
    both = search.hybrid(s.withColumn("embedding", F.array(F.lit(1.0))), q.withColumn("embedding", F.array(F.lit(1.0))), 3).collect()
    assert {r["query_id"] for r in both} == {10, 11, 12}


def test_probes_of_other_sources(spark):
    rows = [(1, "code", [1.0, 0.0]), (2, "code", [0.9, 0.1]), (3, "doc", [0.5, 0.5]), (4, "ticket", [0.0, 1.0])]
    s = spark.createDataFrame(rows, "doc_id long, source_type string, embedding array<double>")
    q = s.filter("doc_id = 1").select(F.col("doc_id").alias("query_id"), "embedding")
    hits = search.top_k(s, q, 2).join(s, "doc_id")
    assert [(r["source_type"], r["doc_id"]) for r in search.cross_source_probe(hits, s, q).collect()] == [("doc", 3)]
    kb = KnowledgeBase(spark, s.withColumn("text", F.lit("t")).withColumn("chunk_type", F.lit("raw_code")).withColumn("source_file", F.lit("f")).withColumn("module", F.lit("m")))
    answer = kb.search_codebase(q.withColumn("query", F.lit("?")), 2).first()
    assert answer["num_results"] == 2 and answer["result_files"] == ["f"] and answer["answer"].endswith("**Related knowledge in other sources:**\n- **Documentation**: `f`") and "```\nt\n```" in answer["answer"]
    assert kb.search_codebase(q.limit(0).withColumn("query", F.lit("?"))).collect() == []


def test_store_keys(spark):
    old = spark.createDataFrame([(None, 1), ("a", 1)], "id string, v int")
    new = spark.createDataFrame([(None, 2)], "id string, v int")
    assert values(store.upsert(store.upsert(old, new, ["id"]), new, ["id"])) == [("a", 1), (None, 2)]
    assert spark.range(1).select(store.metadata(b=F.lit("x"), a=F.lit(""), c=F.lit(None), d=F.lit(3))).first()[0] == {"b": "x", "d": "3"}


def test_tool_loop():
    said = []

    def speak(messages, tools):
        said.append(len(messages[0]["content"]))
        if len(messages[0]["content"]) > 80:
            raise ValueError("maximum context length")
        return "", [("accept", {"x": 1})] if len(messages) > 1 else [("fail", {}), ("none", {"y": 2})]

    def fail():
        raise ValueError("no")

    talk, end = models.tool_loop(speak, [{"role": "user", "content": "w" * 100}], {"accept": lambda x: models.ACCEPTED, "fail": fail}, max_rounds=4, trim=0.3)
    assert end == {"x": 1} and [m["content"] for m in talk if m["role"] == "tool"] == ["error: no", "error: unknown tool none", models.ACCEPTED]
    assert said[:3] == [100, 110, 80]  # as it is, then cut by 30 and 60 per cent, with a mark
    with pytest.raises(ValueError):
        models.tool_loop(lambda m, t: fail(), [], {})
    assert models.tool_loop(lambda m, t: ("hi", []), [], {})[1] is None


def test_reviews(spark):
    rows = spark.createDataFrame([(1, "weak"), (2, "x" * 300), (3, "weaker")], "doc_id int, summary string")
    say = lambda ts: ['{"keep": false, "improved": " better "}' if t == "weak" else "no JSON" for t in ts]
    found = models.reviewed(rows, x.review_score(F.col("summary")), say)
    assert values(found.select("doc_id", "edited", F.substring("summary", 1, 6))) == [(1, True, "better"), (2, False, "xxxxxx"), (3, False, "weaker")]
    staged = spark.createDataFrame([(k, f"s{k}", [p], s) for k, p, s in ((1, "a/b", "pending"), (2, "a/../../b", "pending"), (3, "a", "indexed"), (4, None, "pending"))], "id int, summary string, source_files array<string>, status string")
    decided = review.decide(staged, F.lit('{"decision": "edit", "final_summary": "new"}'))
    assert values(decided.select("id", "decision", "summary", "status")) == [(1, "edit", "new", "edit"), (2, "reject", "s2", "rejected"), (3, None, "s3", "indexed"), (4, "edit", "new", "edit")]


def test_trees(spark):
    paths = ["setup.py", "README.md", "src/__init__.py", "src/Deep/er/and/more/still/x.py", ".git/config", "docs/README", "zz/index.js", "build/README"]
    files_ = spark.createDataFrame([(p, "x" * 60) for p in paths], "path string, content string")
    lines = [r["line"] for r in files.tree_lines(files_).orderBy("place").collect()]
    assert lines[:8] == ["docs/", "  README", "src/", "  Deep/", "    er/", "      and/", "        more/", "  __init__.py"] and lines[-2:] == ["README.md", "setup.py"]
    text = files.bundle_text(files_).first()[0]
    titles = [p.split("\n")[0] for p in text.split("\n\n---\n\n")]
    assert titles == ["## Directory Tree", "## setup.py", "## README.md", "## docs/README", "## src/__init__.py", "## zz/index.js"]
    assert sorted(r[0] for r in files.module_files(files_.select("path"), ".").collect()) == ["README.md", "setup.py"]
    assert [r[0] for r in files.module_files(files_.select("path"), "./docs/").collect()] == ["docs/README"]
    many = spark.range(300).select(F.concat(F.lit("a/b"), (F.col("id") % 3).cast("string"), F.lit("/c/f"), F.col("id").cast("string")).alias("path"))
    view = [r["line"] for r in modules.tree_view(many, 2, ("a/b1",)).orderBy("place").collect()]
    assert view == ["  a/", "    b0/  (100 files, 1 subdirs)", "    b1/", "      c/\n        (100 files here)", "    b2/  (100 files, 1 subdirs)"]
    assert modules.tree_view(files_.select("path")).count() == len(paths)


def test_headers_of_classes(spark):
    owners = spark.createDataFrame([("FooBar",), ("Gone",)], "name string")
    headers = spark.createDataFrame([("inc/foo_bar.h", "// FooBar\nclass FooBar {\n};"), ("inc/foobar.hpp", "struct Other {};"), ("gone.h", "class Went {};")], "path string, content string")
    found = graph.header_classes(owners, headers).collect()
    assert [(r["name"], r["path"], r["snippet"].split("\n")[0]) for r in found] == [("FooBar", "inc/foo_bar.h", "// FooBar")]


def test_explorer(spark):
    tree = spark.createDataFrame([("src/a.py", "one\ntwo"), ("src/b/c.py", "three"), ("top.md", "four")], "path string, content string")
    e = explore.Explorer(tree)
    assert values(e.act("list_dir", ".")) == [("src", True, 2), ("top.md", False, 1)]
    assert [r["window"] for r in e.act("read_files", ["src/a.py", "else/c.py", "../x", "no.py"]).orderBy("path").collect()] == ["[error: path traversal blocked: ../x]", "three", "[file not found: no.py]", "one\ntwo"]
    assert values(e.act("search", "t[wh]")) == [("src/a.py", 2, "two"), ("src/b/c.py", 1, "three")]
    assert [r["path"] for r in e.act("done").collect()] == [".", "../x", "else/c.py", "no.py", "src/a.py"]
    with pytest.raises(ValueError):
        e.act("delete")
    one = lambda *xs: spark.createDataFrame([(q,) for q in xs], "question string")
    assert values(explore.apply_questions(one("Where is A?", "why b"), one("why b", "", "new"), one("is a"))) == [("new",), ("why b",)]
    gate = explore.coverage_gate(spark.createDataFrame([("a", 40), ("b", 40), ("c", 2)], "top string, n int"), spark.createDataFrame([("b",)], "top string"), F.lit(False))
    assert [r["top"] for r in gate.filter("blocks").collect()] == ["a"]


def test_paged_tickets(spark):
    raw = spark.createDataFrame([('{"key": "A-1"}',), ('{"key": "A-2"}',), ('{"key": "A-3"}',)], "value string")
    now = tickets.normalise(raw).withColumn("_fetched_at", F.lit("now"))
    stored = now.filter("key <> 'A-3'").withColumn("_fetched_at", F.lit("then")).withColumn("title", F.when(F.col("key") == "A-1", "old").otherwise(F.col("title")))
    assert sorted(r["key"] for r in tickets.changed_tickets(now, stored).collect()) == ["A-1", "A-3"]
    assert tickets.newest(now).first()["last_updated"] is None
