"""Queries on the store, change capture and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import render
from lodestone.operators import build, search
from lodestone.operators import store as st
from lodestone.operators.ledger import Ledger, create_or_replace
from lodestone.operators.models import lesson_allowed
from lodestone.operators.textindex import TextIndex
from lodestone.operators.vectorindex import VectorIndex
from lodestone.plans import views as v
from lodestone.plans.registry import folder, query
from lodestone.streaming import flows

KIND = "CASE WHEN chunk_category = 'contract' THEN 'specification' WHEN chunk_category = 'error_handling' THEN 'operational' WHEN chunk_type = 'function_card' THEN 'specification' WHEN chunk_type IN ('file_overview', 'class_overview') THEN 'overview' ELSE 'reference' END"
SKIP = "(chunk_category = 'boilerplate' AND search_value = 'low')"


@query("flt_skip_index", f"WITH {v.ENTRIES} SELECT doc_id, {SKIP} AS skip FROM en")
def flt_skip_index(spark, d):
    return v.entries(spark, d).select("doc_id", st.skip_index(F.col("chunk_category"), F.col("search_value")).alias("skip"))


@query("snk_code_entry", f"""WITH {v.ENTRIES}, k AS (SELECT *, {KIND} AS kind FROM en WHERE NOT {SKIP} AND trim(summary) <> '')
    SELECT doc_id, chunk_type, kind AS source_kind, trim(summary) AS text FROM k UNION ALL SELECT doc_id, 'raw_code', '', trim(raw_code) FROM k WHERE length(trim(raw_code)) > 30""")
def snk_code_entry(spark, d):
    return st.entry_rows(v.entries(spark, d)).select("doc_id", "chunk_type", "source_kind", "text")


_META = "array_to_string(list_filter(['chunk_type=' || chunk_type, 'module=' || nullif(module, ''), 'search_value=' || nullif(search_value, ''), 'source_file=' || source_file, 'source_kind=' || kind, 'source_type=code'], lambda y: y IS NOT NULL), ',')"


@query("snk_upsert_local", f"""WITH {v.ENTRIES}, k AS (SELECT *, {KIND} AS kind FROM en WHERE NOT {SKIP} AND trim(summary) <> ''), r AS (SELECT DISTINCT substr(sha256(trim(summary) || '|' || {_META}), 1, 24) AS id, source_file, doc_id % 3 = 0 AS late FROM k)
    SELECT id, min(source_file) AS source_file, 3 - CAST(bool_or(late) AS INTEGER) AS version FROM r GROUP BY 1""")
def snk_upsert_local(spark, d):
    """Entries put into a store that persists, of which a third comes again: the later version takes the place of the earlier one, in the buckets that it touches, and nothing is there twice."""
    kb = Ledger(spark, folder(spark), ["id"])
    rows = lambda e, version: st.knowledge_rows(e, "code").select("id", "text", "meta", F.lit(version).alias("version"))
    kb.upsert(rows(v.entries(spark, d), 3))
    late = rows(v.entries(spark, d).filter("doc_id % 3 = 0"), 2)
    kb.upsert(late)
    kb.upsert(late)
    return kb.read().select("id", F.col("meta")["source_file"].alias("source_file"), "version")


@query("snk_doc_chunks", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'summary of ' || doc_id END AS text, 'documentation' AS module, 'doc_summary' AS chunk_type FROM documents")
def snk_doc_chunks(spark, d):
    i = F.col("doc_id")
    summary = F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("summary of "), i.cast("string")))
    return v.table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(summary, F.lit("")), F.col("text")).alias("text"), F.lit("documentation").alias("module"), F.lit("doc_summary").alias("chunk_type"))


@query("snk_ticket_entries", f"""WITH {v.TICKETS}, c AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN 'root_cause' WHEN 1 THEN 'workaround' WHEN 2 THEN 'design_decision' WHEN 3 THEN 'pattern' ELSE 'bug_report' END AS category FROM tk)
    SELECT key, concat_ws(chr(10), nullif(title, ''), 'Solution: ' || nullif(resolution, '')) AS text, category AS module, CASE WHEN category IN ('root_cause', 'design_decision') THEN 'rationale' WHEN category = 'workaround' THEN 'operational' ELSE 'reference' END AS source_kind FROM c WHERE title <> '' OR resolution <> ''""")
def snk_ticket_entries(spark, d):
    cat = F.element_at(F.array(*map(F.lit, ("root_cause", "workaround", "design_decision", "pattern", "bug_report"))), (F.col("conv_id") % 5 + 1).cast("int"))
    t = v.tickets(spark, d).filter("title <> '' OR resolution <> ''").withColumn("category", cat)
    text = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Solution: "), F.nullif(F.col("resolution"), F.lit(""))))
    return t.select("key", text.alias("text"), F.col("category").alias("module"), st.ticket_kind(F.col("category")).alias("source_kind"))


#: Contributions: documents, rejected where they are labelled toxic, approved where they are labelled good.
_CONTRIBUTED = "lb AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1), cb AS (SELECT d.*, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' END AS status FROM documents AS d LEFT JOIN lb USING (doc_id))"


def _contributed(spark, d):
    labels = v.table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return v.table(spark, d, "documents").join(labels, "doc_id", "left").withColumn("status", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved"))


@query("snk_user_entries", f"""WITH {_CONTRIBUTED} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[' || lang || '] ' ELSE '' END || trim(text) AS text, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE source END AS source_file
    FROM cb WHERE coalesce(status, '') <> 'rejected' AND trim(text) <> ''""")
def snk_user_entries(spark, d):
    """Contributions that were not rejected, with their topic and their first source file."""
    i = F.col("doc_id")
    files = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    e = _contributed(spark, d).select("doc_id", "status", F.when(i % 2 == 0, F.col("lang")).otherwise(F.lit("")).alias("topic"), F.trim("text").alias("s"), files.alias("files"))
    kept = e.filter("(status IN ('indexed', 'approved') OR status IS NULL) AND s <> ''")
    return kept.select("doc_id", F.when(F.col("topic") != "", F.concat(F.lit("["), "topic", F.lit("] "), "s")).otherwise(F.col("s")).alias("text"), F.coalesce(F.get("files", F.lit(0)), F.lit("unknown")).alias("source_file"))


_UID = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '-0000-4000-8000-000000000000'"


@query("snk_create_or_replace", f"SELECT CASE doc_id % 3 WHEN 0 THEN 'new' || doc_id ELSE {_UID} END AS id, text FROM documents UNION ALL SELECT 'new' || doc_id, text FROM documents WHERE doc_id % 3 = 1")
def snk_create_or_replace(spark, d):
    """Every document is created anew: for a third that fails, as they exist under another id, which goes; a third is new; a third fails for another reason and stays as it is."""
    i = F.col("doc_id")
    uid = F.concat(F.substring(F.md5(i.cast("string")), 1, 8), F.lit("-0000-4000-8000-000000000000"))
    docs = v.table(spark, d, "documents").select("doc_id", uid.alias("uid"), F.concat(F.lit("new"), i.cast("string")).alias("new"), "text")
    kb = Ledger(spark, folder(spark), ["id", "doc_id"])  # ids have 32 bits of the hash: among many documents some are equal
    kb.upsert(docs.select(F.col("uid").alias("id"), "doc_id", "text"))
    error = F.when(i % 3 == 0, F.concat(F.lit("Document "), "uid", F.lit(" already exists"))).when(i % 3 == 2, "timeout")
    errors = docs.select(F.col("new").alias("id"), "doc_id", error.alias("error")).filter("error IS NOT NULL")
    create_or_replace(kb, docs.select(F.col("new").alias("id"), "doc_id", "text"), errors, st.replacement_id)
    return kb.read().select("id", "text")


@query("snk_purge", f"WITH {v.ENTRIES} SELECT doc_id, source_file FROM en WHERE source_file NOT IN (SELECT DISTINCT source_file FROM en WHERE doc_id % 10 = 0)")
def snk_purge(spark, d):
    """The entries of files that were indexed again go from the store, and only the buckets that hold some are rewritten."""
    e = v.entries(spark, d).select("doc_id", "source_file", "summary")
    kb = Ledger(spark, folder(spark), ["source_file", "doc_id"])
    kb.upsert(e)
    kb.purge(e.filter("doc_id % 10 = 0"), by=["source_file"])
    return kb.read().select("doc_id", "source_file")


@query("snk_purge_orphans", """SELECT doc_id, source_file FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'drafts/' || doc_id || '.md' ELSE source || '/' || doc_id END AS source_file, doc_id % 2 = 1 AS contributed FROM documents)
    WHERE NOT contributed OR source_file IS NULL OR source_file IN (SELECT source || '/' || doc_id FROM documents)""")
def snk_purge_orphans(spark, d):
    """Contributions whose source file is gone leave the store; those without a file, and what was no contribution, stay."""
    i = F.col("doc_id")
    file = F.when(i % 4 == 1, F.concat(F.lit("drafts/"), i.cast("string"), F.lit(".md"))).when(i % 4 != 0, F.concat_ws("/", "source", i.cast("string")))
    kind = F.when(i % 2 == 1, "user_contribution").otherwise("reference")
    kb = Ledger(spark, folder(spark), ["doc_id"])
    kb.upsert(v.table(spark, d, "documents").select("doc_id", file.alias("source_file"), kind.alias("source_kind"), "text"))
    contributed = kb.read().filter("source_kind = 'user_contribution' AND source_file <> ''")
    kb.purge(contributed.join(v.current(spark, d).select(F.col("path").alias("source_file")), "source_file", "left_anti"))
    return kb.read().select("doc_id", "source_file")


@query("snk_add_to_kb", """SELECT doc_id, source AS source_file, 'indexed' AS status, '[' || lang || '] ' || text AS text, 'function_summary' AS chunk_type FROM documents
    UNION ALL SELECT doc_id, source, 'indexed', text, 'raw_code' FROM documents WHERE doc_id % 2 = 0 AND length(trim(text)) > 30""")
def snk_add_to_kb(spark, d):
    """Contributions, indexed at once, and a line each in the audit log, which is read back."""
    i = F.col("doc_id")
    c = v.table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic"), F.col("text").alias("summary"), F.array("source").alias("source_files"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("raw_code"))
    log = folder(spark)
    st.audit(c.select("doc_id", "topic", "source_files"), log)
    seen = spark.read.schema("doc_id long, status string").json(log)
    return st.add_to_kb(c).drop("status").join(seen, "doc_id").select("doc_id", "source_file", "status", "text", "chunk_type")


@query("snk_lesson_md", f"""WITH {v.TICKETS} SELECT key, '---' || chr(10) || 'ticket: ' || key || chr(10) || 'title: "' || title || '"' || chr(10) || 'category: ' || CASE WHEN conv_id % 2 = 0 THEN 'root_cause' ELSE 'general' END || chr(10) || 'date: ' || CASE conv_id % 3 WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2023-01-02' ELSE '' END
    || chr(10) || '---' || chr(10) || chr(10) || '# Lesson from ' || key || ': ' || title || chr(10) || chr(10) || description || chr(10) AS md FROM tk WHERE title <> '' AND resolution <> '' AND length(description) >= 30""")
def snk_lesson_md(spark, d):
    """Lessons as Markdown files, one each, written and read back."""
    i = F.col("conv_id")
    t = v.tickets(spark, d).filter(lesson_allowed(F.col("title"), F.col("resolution"), F.col("description")))
    md = render.lesson_md(F.col("key"), F.col("title"), F.when(i % 2 == 0, "root_cause").otherwise(""), F.when(i % 3 == 0, "2024-05-06T07:08:09Z").otherwise(""), F.when(i % 3 == 1, "2023-01-02 10:00").otherwise(""), F.col("description"))
    at = folder(spark)
    t.select("key", md.alias("md")).write.parquet(at)
    return spark.read.schema("key string, md string").parquet(at)


@query("snk_manifest_queue", f"WITH {v.MANIFEST} SELECT path, hash, CAST(doc_id % 3 AS INTEGER) AS n_ids FROM cur")
def snk_manifest_queue(spark, d):
    """A manifest that is not there is empty; the one that a run saves is what it has seen: deleted files vanish from it."""
    at = folder(spark)
    first = st.load_manifest(spark, f"{at}/manifest")
    now = v.current(spark, d).select("path", "hash", (F.col("doc_id") % 3).cast("int").alias("n_ids"))
    st.save_manifest(now.unionByName(first), f"{at}/manifest")
    return st.load_manifest(spark, f"{at}/manifest")


@query("snk_bulk_load", f"""WITH {v.ENTRIES}, {v.TICKETS}, {_CONTRIBUTED}, k AS (SELECT *, {KIND} AS kind FROM en WHERE NOT {SKIP} AND trim(summary) <> '') SELECT 'code' AS source_type, count(DISTINCT substr(sha256(trim(summary) || '|' || {_META}), 1, 24)) AS n FROM k
    UNION ALL SELECT 'doc', count(DISTINCT (text, source)) FROM documents UNION ALL SELECT 'ticket', count(DISTINCT (concat_ws(chr(10), nullif(title, ''), 'Solution: ' || nullif(resolution, '')), key)) FROM tk WHERE title <> '' OR resolution <> ''
    UNION ALL SELECT 'user', count(DISTINCT (text, source)) FROM cb WHERE coalesce(status, '') <> 'rejected'""")
def snk_bulk_load(spark, d):
    """Code, documents, tickets and contributions in one store, by content: how many rows each source has there."""
    docs = v.table(spark, d, "documents")
    row = lambda text, place, kind: (st.stable_id(text, place, F.lit(kind)).alias("id"), text.alias("text"), F.lit(kind).alias("source_type"))
    code = st.knowledge_rows(v.entries(spark, d), "code").select("id", "text", F.lit("code").alias("source_type"))
    t = v.tickets(spark, d).filter("title <> '' OR resolution <> ''")
    solved = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Solution: "), F.nullif(F.col("resolution"), F.lit(""))))
    parts = [code, docs.select(*row(F.col("text"), F.col("source"), "doc")), t.select(*row(solved, F.col("key"), "ticket")), _contributed(spark, d).filter("coalesce(status, '') <> 'rejected'").select(*row(F.col("text"), F.col("source"), "user"))]
    store = Ledger(spark, folder(spark), ["id"])
    for part in parts:
        store.upsert(part)
    return store.read().groupBy("source_type").agg(F.count("*").alias("n"))


@query("snk_index_replay", f"WITH {v.ENTRIES}, k AS (SELECT *, {KIND} AS kind FROM en WHERE NOT {SKIP} AND trim(summary) <> '') SELECT source_file, count(DISTINCT substr(sha256(trim(summary) || '|' || {_META}), 1, 24)) AS entries FROM k GROUP BY 1")
def snk_index_replay(spark, d):
    """Saved summaries indexed again without a model: what a file had before goes, what it has now comes."""
    e = v.entries(spark, d)
    old = e.filter("doc_id % 2 = 0").select(F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("id"), "source_file")
    new = st.knowledge_rows(e, "code").select("id", F.col("meta")["source_file"].alias("source_file"))
    return st.upsert(st.purge(old, e.select("source_file").distinct(), ["source_file"]), new, ["id"]).groupBy("source_file").agg(F.count("*").alias("entries"))


@query("set_union_sources", """SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents UNION ALL SELECT 'page', CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT 'item', CAST(item_id AS VARCHAR) FROM benchmark""")
def set_union_sources(spark, d):
    one = lambda t, k, i: v.table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).cast("string").alias("id"))
    return one("documents", "doc", "doc_id").unionByName(one("pages", "page", "page_id")).unionByName(one("benchmark", "item", "item_id"))


@query("flt_ticket_structural", f"WITH {v.TICKETS} SELECT key FROM tk WHERE regexp_matches(key, '^CONV-') AND (lower(status) NOT IN ('done', 'closed', 'resolved', 'fixed', 'complete', 'verified') OR (lower(resolution) NOT IN ('won''t fix', 'wontfix', 'duplicate', 'cannot reproduce', 'incomplete', 'not a bug') AND n_comments >= 2))")
def flt_ticket_structural(spark, d):
    from lodestone.operators.review import structural_filter

    return structural_filter(v.tickets(spark, d), "^CONV-").select("key")


@query("flt_changed_files", f"WITH {v.MANIFEST} SELECT path, cur.hash AS hash FROM cur LEFT JOIN old USING (path) WHERE coalesce(old.hash, '') <> cur.hash")
def flt_changed_files(spark, d):
    return st.changed(v.current(spark, d), v.manifest(spark, d)).select("path", "hash")


@query("flt_changed_docs", f"WITH {v.MANIFEST} SELECT path FROM cur LEFT JOIN old USING (path) WHERE coalesce(old.hash, '') <> cur.hash OR old.n_ids = 0")
def flt_changed_docs(spark, d):
    """A document is skipped only if its hash is known and it had been indexed."""
    done = v.manifest(spark, d).filter("n_ids > 0").select("path", "hash")
    return v.current(spark, d).join(done, ["path", "hash"], "left_anti").select("path")


_TICKET_HASH = "substr(sha256(title || '|' || substr(description, 1, 500) || '|' || n_comments || '|' || resolution || '|' || status || '|'), 1, 16)"


@query("flt_changed_tickets", f"WITH {v.TICKETS} SELECT key, {_TICKET_HASH} AS hash FROM tk WHERE conv_id % 4 = 0")
def flt_changed_tickets(spark, d):
    t = v.tickets(spark, d)
    h = F.substring(F.sha2(F.concat_ws("|", "title", F.substring("description", 1, 500), F.size("comments").cast("string"), "resolution", "status", F.lit("")), 256), 1, 16)
    now = t.select("key", "conv_id", h.alias("hash"))
    old = now.select("key", F.when(F.col("conv_id") % 4 == 0, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return st.changed(now, old, "key").select("key", "hash")


@query("flt_metadata", f"WITH {v.KB} SELECT doc_id FROM kb WHERE source_type IN ('code', 'doc') AND module = 'm3'")
def flt_metadata(spark, d):
    return v.kb(spark, d).filter(F.col("source_type").isin("code", "doc") & (F.col("module") == "m3")).select("doc_id")


@query("flt_orphan_audit_doc", "SELECT doc_id FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 0")
def flt_orphan_audit_doc(spark, d):
    """Documents that an audit looks at: summaries of documents."""
    i = F.col("doc_id")
    kinds = v.table(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, "code").when(i % 3 == 1, "doc").otherwise("ticket").alias("source_type"), F.when(i % 2 == 0, "doc_summary").otherwise("raw_code").alias("chunk_type"))
    return kinds.filter("source_type = 'doc' AND chunk_type = 'doc_summary'").select("doc_id")


_STAGED = "sg AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'indexed' WHEN 2 THEN 'index_error' ELSE 'rejected' END AS status FROM conversations)"


def staged(spark, d):
    t = F.col("turn") % 4
    return v.table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(t == 0, "pending").when(t == 1, "indexed").when(t == 2, "index_error").otherwise("rejected").alias("status"))


@query("flt_pending", f"WITH {_STAGED} SELECT conv_id, turn, status FROM sg WHERE status IN ('pending', 'index_error')")
def flt_pending(spark, d):
    return staged(spark, d).filter(F.col("status").isin("pending", "index_error")).select("conv_id", "turn", "status")


_KNN = """q AS (SELECT doc_id AS query_id, embedding AS qe FROM kb WHERE doc_id % 50 = 0), s AS (SELECT query_id, doc_id, source_type, module, source_file, floor(greatest(0, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5) / 1e6 AS score FROM q, kb {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _queries(spark, d):
    """The stated query set: every row whose id is divisible by 50."""
    return v.kb(spark, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def hits(spark, d, k, store=None):
    store = v.kb(spark, d) if store is None else store
    meta = store.select("doc_id", "source_type", "module", "source_file", "label")
    return search.top_k(store, _queries(spark, d), k).join(meta, "doc_id")


@query("top_vector_search", f"WITH {v.KB}, {_KNN.format(where='')} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def top_vector_search(spark, d):
    return search.top_k(v.kb(spark, d), _queries(spark, d), 10).select("query_id", "doc_id", "score", "rank")


@query("top_ann_search", f"WITH {v.KB}, {_KNN.format(where='')} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def top_ann_search(spark, d):
    """The same through inverted lists, with the exact finish."""
    index = VectorIndex.build(v.kb(spark, d), folder(spark))
    return index.search(_queries(spark, d), 10).select("query_id", "doc_id", "score", "rank")


@query("top_batch_search", f"WITH {v.KB}, {_KNN.format(where='')} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def top_batch_search(spark, d):
    return search.top_k(v.kb(spark, d), _queries(spark, d), 5).select("query_id", "doc_id", "score", "rank")


@query("win_rank_hits", f"""WITH {v.KB}, {_KNN.format(where="WHERE source_type = 'code'")} SELECT query_id, doc_id, rank, '## Result ' || rank || '  [code/function_summary]' AS header FROM r WHERE rank <= 3""")
def win_rank_hits(spark, d):
    code = v.kb(spark, d).filter("source_type = 'code'")
    block = render.result_block(F.col("rank"), F.lit(""), F.col("score"), F.lit("code"), F.lit(""), F.lit("function_summary"), F.lit("f"), F.lit("m"))
    return search.top_k(code, _queries(spark, d), 3).select("query_id", "doc_id", "rank", F.split(block, "  \\(score")[0].alias("header"))


#: The store with its texts, and queries: the texts' first sentences.
_TEXTS = "ts AS (SELECT kb.doc_id, text FROM kb JOIN documents USING (doc_id)), qt AS (SELECT doc_id AS query_id, string_split(text, '.')[1] AS text FROM ts WHERE doc_id % 50 = 0)"
#: BM25 over ASCII words, said in SQL.
_BM25 = """dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms FROM ts), sz AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM dw), tf AS (SELECT doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM dw) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM qt)),
    b AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), sz GROUP BY 1, 2),
    br AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b)"""


def texts(spark, d):
    """(doc_id, text, embedding, ...): the store's rows with the texts of the documents of their ids, joined once and kept."""
    store, at = v.kb(spark, d), f"{folder(spark)}/texts"
    # of the documents only those of the store go with their texts where its ids are few enough to be sent to every task
    docs = v.table(spark, d, "documents").select("doc_id", "text").join(store.select("doc_id"), "doc_id", "left_semi")
    made = store.join(docs, "doc_id")
    made.write.parquet(at)
    return spark.read.schema(made.schema).parquet(at)


def text_queries(store):
    return store.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.split("text", r"\.")[0].alias("text"), "embedding")


@query("top_text_search", f"WITH {v.KB}, {_TEXTS}, {_BM25} SELECT query_id, doc_id, rank FROM br WHERE rank <= 5")
def top_text_search(spark, d):
    """The full-text half of the hybrid search, by the stored index."""
    store = texts(spark, d)
    return TextIndex.build(store, folder(spark)).search(text_queries(store), 5).select("query_id", "doc_id", "rank")


@query("top_hybrid_search", f"""WITH {v.KB}, {_TEXTS}, {_BM25}, q AS (SELECT doc_id AS query_id, embedding AS qe FROM kb JOIN ts USING (doc_id) WHERE doc_id % 50 = 0), s AS (SELECT query_id, doc_id, floor(greatest(0, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5) / 1e6 AS score FROM q, (SELECT kb.* FROM kb JOIN ts USING (doc_id))),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), u AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM br WHERE rank <= 20),
    f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY 1, 2) SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 5""")
def top_hybrid_search(spark, d):
    """Reciprocal-rank fusion of the rankings by vector and by text (BM25), the latter by the stored index."""
    store = texts(spark, d)
    asked = text_queries(store)
    return search.hybrid(store, asked, 5, by_text=TextIndex.build(store, folder(spark)).search(asked, 20)).select("query_id", "doc_id", "rank")


@query("jn_cross_source", f"""WITH {v.KB}, {_KNN.format(where='')}, h AS (SELECT query_id, min(source_type) AS only_type FROM r WHERE rank <= 2 GROUP BY 1 HAVING count(DISTINCT source_type) = 1),
    o AS (SELECT query_id, s.source_type, arg_max(doc_id, (score, -doc_id)) AS doc_id, max(score) AS score FROM s JOIN h USING (query_id) WHERE s.source_type <> only_type GROUP BY 1, 2) SELECT query_id, source_type, doc_id, score FROM o WHERE score > 0.3""")
def jn_cross_source(spark, d):
    """Where all hits have one source type, the best row of each other type, if it is close."""
    return search.cross_source_probe(hits(spark, d, 2), v.kb(spark, d), _queries(spark, d))


@query("jn_doc_code", f"""WITH {v.KB}, q AS (SELECT doc_id AS query_id, embedding AS qe FROM kb WHERE source_type = 'doc' AND doc_id % 50 = 0), s AS (SELECT query_id, doc_id, floor(greatest(0, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5) / 1e6 AS score FROM q, kb WHERE source_type = 'code'),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, score >= 0.3 AS close FROM r WHERE rank <= 3""")
def jn_doc_code(spark, d):
    """The 3 best code hits of each document of the stated query set (ids divisible by 50), and whether each is close enough for the audit."""
    k = v.kb(spark, d)
    docs = k.filter("source_type = 'doc' AND doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return search.top_k(k.filter("source_type = 'code'"), docs, 3).select("query_id", "doc_id", "score", (F.col("score") >= 0.3).alias("close"))


@query("jn_ticket_dedup", f"""WITH {v.KB}, q AS (SELECT doc_id AS query_id, embedding AS qe FROM kb WHERE source_type = 'ticket' AND doc_id % 50 = 0), st AS (SELECT * FROM kb WHERE source_type <> 'ticket' OR doc_id % 4 = 0), s AS (SELECT query_id, max(floor(greatest(0, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5) / 1e6) AS best FROM q, st GROUP BY 1) SELECT query_id, best <= 0.85 AS new FROM s""")
def jn_ticket_dedup(spark, d):
    """Whether each ticket is new: without a close entry in the store, which has some of them already."""
    k = v.kb(spark, d)
    new = k.filter("source_type = 'ticket' AND doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    best = search.top_k(k.filter("source_type <> 'ticket' OR doc_id % 4 = 0"), new, 1)
    known = best.filter("score > 0.85").select("query_id", F.lit(False).alias("new"))
    return new.select("query_id").join(known, "query_id", "left").select("query_id", F.coalesce("new", F.lit(True)).alias("new"))


@query("top_list_documents", f"WITH {v.KB} SELECT doc_id, source_type, module, source_file FROM kb")
def top_list_documents(spark, d):
    return v.kb(spark, d).select("doc_id", "source_type", "module", "source_file")


@query("set_result_files", f"WITH {v.KB}, {_KNN.format(where='')}, f AS (SELECT query_id, source_file, min(rank) AS first FROM r WHERE rank <= 8 GROUP BY 1, 2) SELECT query_id, string_agg(source_file, ',' ORDER BY first) AS files FROM f GROUP BY 1")
def set_result_files(spark, d):
    g = hits(spark, d, 8).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_file"))).alias("h"))
    return g.select("query_id", F.array_join(F.array_distinct(F.transform("h", lambda h: h["source_file"])), ",").alias("files"))


@query("set_file_overlap", f"""WITH {v.KB}, {_KNN.format(where='')}, a AS (SELECT query_id, list(DISTINCT source_file) AS a FROM r WHERE rank <= 8 GROUP BY 1), b AS (SELECT query_id, list(DISTINCT source_file) AS b FROM r WHERE rank BETWEEN 4 AND 12 GROUP BY 1)
    SELECT query_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS overlap, CAST(len(list_filter(b, lambda y: NOT list_contains(a, y))) AS INTEGER) AS new, CAST(len(list_filter(a, lambda y: NOT list_contains(b, y))) AS INTEGER) AS lost FROM a JOIN b USING (query_id)""")
def set_file_overlap(spark, d):
    """The files that two sets of hits of one query share, and that only one has."""
    h = hits(spark, d, 12).groupBy("query_id").agg(F.collect_set(F.when(F.col("rank") <= 8, F.col("source_file"))).alias("a"), F.collect_set(F.when(F.col("rank") >= 4, F.col("source_file"))).alias("b"))
    return h.filter("size(b) > 0").select("query_id", F.size(F.array_intersect("a", "b")).alias("overlap"), F.size(F.array_except("b", "a")).alias("new"), F.size(F.array_except("a", "b")).alias("lost"))


@query("set_dedup_queries", f"WITH {v.QUERY_LOG} SELECT query, min(event_id) AS first_seen FROM qlog WHERE query <> '' GROUP BY 1")
def set_dedup_queries(spark, d):
    return v.query_log(spark, d).filter("query <> ''").groupBy("query").agg(F.min("event_id").alias("first_seen"))


@query("stm_dedup", "SELECT substr(sha256(coalesce(text, '') || '|' || coalesce(source, '')), 1, 24) AS id FROM documents GROUP BY 1")
def stm_dedup(spark, d):
    """Entries that come as a stream, in two runs of one checkpoint: of equal ids the first stays, for good."""
    at = folder(spark)
    for _ in range(2):
        stream = spark.readStream.schema(v.table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")
        flows.run_available(flows.deduplicate(stream.select(st.stable_id(F.coalesce("text", F.lit("")), F.col("source")).alias("id")), ["id"]), f"{at}/out", f"{at}/check")
    return spark.read.schema("id string").parquet(f"{at}/out")


@query("jn_existing_summaries", f"WITH {v.ENTRIES}, new AS (SELECT source_file, chunk_index, max(doc_id) AS doc_id FROM en WHERE doc_id % 3 = 0 GROUP BY 1, 2), old AS (SELECT source_file, chunk_index, max(doc_id) AS doc_id FROM en WHERE doc_id % 2 = 0 GROUP BY 1, 2) SELECT * FROM new UNION ALL SELECT * FROM old WHERE (source_file, chunk_index) NOT IN (SELECT (source_file, chunk_index) FROM new)")
def jn_existing_summaries(spark, d):
    e = v.entries(spark, d).select("source_file", "chunk_index", "doc_id")
    last = lambda x: x.groupBy("source_file", "chunk_index").agg(F.max("doc_id").alias("doc_id"))
    return st.upsert(last(e.filter("doc_id % 2 = 0")), last(e.filter("doc_id % 3 = 0")), ["source_file", "chunk_index"])


@query("jn_review_writeback", f"WITH {v.ENTRIES} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'better ' || summary ELSE summary END AS summary FROM en")
def jn_review_writeback(spark, d):
    e = v.entries(spark, d).select("doc_id", "summary")
    fixed = e.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("better "), "summary").alias("fixed"))
    return e.join(fixed, "doc_id", "left").select("doc_id", F.coalesce("fixed", "summary").alias("summary"))


@query("jn_stale_chunks", f"""WITH {v.MANIFEST} SELECT path, CASE WHEN old.path IS NULL THEN 'new' WHEN old.hash = cur.hash THEN 'reuse' ELSE 'redo' END AS action FROM cur LEFT JOIN old USING (path)""".replace("old.path IS NULL", "old.hash IS NULL"))
def jn_stale_chunks(spark, d):
    old = v.manifest(spark, d).select("path", F.col("hash").alias("old"))
    return v.current(spark, d).join(old, "path", "left").select("path", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "reuse").otherwise("redo").alias("action"))


@query("jn_chunk_summary", f"WITH {v.ENTRIES}, c AS (SELECT doc_id % 40 AS island, 'f' || (doc_id % 8) AS path, doc_id AS chunk_index, summary FROM en) SELECT path, island, list('Chunk ' || chunk_index || ': ' || summary ORDER BY chunk_index) AS summaries FROM c WHERE chunk_index % 3 > 0 GROUP BY 1, 2")
def jn_chunk_summary(spark, d):
    """The summaries of each function's chunks, looked up by file and chunk, in order."""
    i = F.col("doc_id")
    e = v.entries(spark, d).select(F.concat(F.lit("f"), (i % 8).cast("string")).alias("path"), i.alias("chunk_index"), (i % 40).alias("island"), F.col("raw_code").alias("chunk"), "summary")
    said = e.filter("chunk_index % 3 > 0").select("path", "chunk_index", "summary")
    return build.function_cards(e.drop("summary"), said, least=1).select("path", "island", "summaries")
