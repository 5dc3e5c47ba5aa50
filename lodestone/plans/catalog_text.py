"""Queries on texts and code: scores, symbols, references, rendering, hashes, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import answers
from lodestone.functions import render as r
from lodestone.functions import text as x
from lodestone.operators import graph as g
from lodestone.operators import sequences as seq
from lodestone.plans import views as v
from lodestone.plans.registry import folder, query

_Q = lambda s: s.replace("'", "''")
_contained = lambda low, parts: " + ".join(f"CAST(contains({low}, '{_Q(p)}') AS INTEGER)" for p in parts)
_IN = lambda xs: ", ".join(f"'{k}'" for k in xs)

#: Documents as summaries, some with vague and generic phrases put before them.
SUMMARY = "sm AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'It presumably delegates to another component. ' WHEN 1 THEN 'This function handles errors, likely. ' WHEN 2 THEN 'Unclear. ' ELSE '' END || text AS summary FROM documents)"


def summaries(spark, d):
    i = F.col("doc_id")
    lead = F.when(i % 9 == 0, "It presumably delegates to another component. ").when(i % 9 == 1, "This function handles errors, likely. ").when(i % 9 == 2, "Unclear. ").otherwise("")
    return v.table(spark, d, "documents").select("doc_id", F.concat(lead, "text").alias("summary"))


@query("flt_vague", f"WITH {SUMMARY} SELECT doc_id, CASE {' '.join(f'WHEN contains(lower(summary), {chr(39)}{m}{chr(39)}) THEN {chr(39)}{m}{chr(39)}' for m in x.VAGUE)} END AS marker FROM sm")
def flt_vague(spark, d):
    return summaries(spark, d).select("doc_id", x.vague_marker(F.col("summary")).alias("marker"))


_REVIEW = f"""least(1.0::DOUBLE, CASE WHEN length(summary) < 100 THEN 0.4::DOUBLE WHEN length(summary) < 200 THEN 0.2::DOUBLE ELSE 0::DOUBLE END
    + least(0.4::DOUBLE, ({_contained('lower(summary)', x.VAGUE)}) * 0.15::DOUBLE) + least(0.2::DOUBLE, ({_contained('lower(summary)', x.GENERIC)}) * 0.05::DOUBLE))"""


@query("str_review_score", f"WITH {SUMMARY} SELECT doc_id, {_REVIEW} AS score, {_REVIEW} >= 0.15::DOUBLE AS review FROM sm")
def str_review_score(spark, d):
    return summaries(spark, d).withColumn("score", x.review_score(F.col("summary"))).select("doc_id", "score", (F.col("score") >= 0.15).alias("review"))


_ANSWER = "an AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'No results found' WHEN 1 THEN '## Result 1 ' || text WHEN 2 THEN 'class A and struct B ## Result ## Result ' || text WHEN 3 THEN 'not found ' || text ELSE text END AS answer FROM documents)"
_count = lambda part: f"CAST((length(answer) - length(replace(answer, '{_Q(part)}', ''))) / {len(part)} AS INTEGER)"


@query(
    "str_answer_quality",
    f"""WITH {_ANSWER}, r AS (SELECT doc_id, answer, least(1.0::DOUBLE, length(answer) / 2000.0::DOUBLE) * 0.2::DOUBLE + least(1.0::DOUBLE, ({' + '.join(_count(p) for p in x.SPECIFIC)}) / 10.0::DOUBLE) * 0.4::DOUBLE
        + least(1.0::DOUBLE, {_count('## Result')} / 3.0::DOUBLE) * 0.4::DOUBLE - least(0.5::DOUBLE, ({_contained('lower(answer)', x.UNSURE)}) * 0.2::DOUBLE) AS raw FROM an)
        SELECT doc_id, CASE WHEN answer = '' OR answer LIKE 'No results found%' THEN 0::DOUBLE ELSE floor(greatest(0::DOUBLE, least(1::DOUBLE, raw)) * 1000 + 0.5::DOUBLE) / 1000 END AS quality FROM r""",
)
def str_answer_quality(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    a = F.when(i % 6 == 0, "No results found").when(i % 6 == 1, F.concat(F.lit("## Result 1 "), t)).when(i % 6 == 2, F.concat(F.lit("class A and struct B ## Result ## Result "), t)).when(i % 6 == 3, F.concat(F.lit("not found "), t)).otherwise(t)
    return v.table(spark, d, "documents").select("doc_id", a.alias("answer")).select("doc_id", x.answer_quality(F.col("answer")).alias("quality"))


@query(
    "str_retrieval_score",
    """WITH r AS (SELECT doc_id, ['a/f' || (doc_id % 5) || '.py', 'b/f' || (doc_id % 3) || '.py', 'c/f9.py', 'd/f9.py'] AS got, CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['x/f1.py', 'a/f2.py', 'c/f9.py'] END AS expected FROM documents),
        b AS (SELECT *, len(list_intersect(list_distinct(list_transform(got, lambda p: string_split(p, '/')[-1])), list_distinct(list_transform(expected, lambda p: string_split(p, '/')[-1])))) AS fuzzy, len(list_intersect(got, expected)) AS exact FROM r),
        s AS (SELECT *, fuzzy / 4.0::DOUBLE AS p, fuzzy / 3.0::DOUBLE AS q FROM b WHERE len(expected) > 0)
        SELECT doc_id, floor(p * 1000 + 0.5) / 1000 AS precision, floor(q * 1000 + 0.5) / 1000 AS recall, CASE WHEN p + q > 0 THEN floor(2 * p * q / (p + q) * 1000 + 0.5) / 1000 ELSE 0 END AS f1, CAST(exact AS INTEGER) AS exact, CAST(fuzzy AS INTEGER) AS fuzzy FROM s""",
)
def str_retrieval_score(spark, d):
    i = F.col("doc_id")
    f = lambda top, k: F.concat(F.lit(f"{top}/f"), (i % k).cast("string"), F.lit(".py"))
    got = F.array(f("a", 5), f("b", 3), F.lit("c/f9.py"), F.lit("d/f9.py"))
    expected = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("x/f1.py", "a/f2.py", "c/f9.py"))))
    return v.table(spark, d, "documents").select("doc_id", x.retrieval_score(got, expected).alias("s")).filter("s IS NOT NULL").select("doc_id", "s.*")


@query("str_prefix_summary", f"WITH {SUMMARY}, y AS (SELECT doc_id, summary, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE split_part(summary, ' ', CAST(doc_id % 3 AS INTEGER) * 4) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'X' END END AS symbol FROM sm) SELECT doc_id, CASE WHEN symbol IS NULL OR symbol = '' OR contains(substr(summary, 1, 80), symbol) THEN summary ELSE symbol || ' — ' || summary END AS summary FROM y")
def str_prefix_summary(spark, d):
    i = F.col("doc_id")
    word = F.split_part(F.col("summary"), F.lit(" "), ((i % 3) * 4).cast("int"))
    y = summaries(spark, d).withColumn("symbol", F.when(i % 3 != 0, F.concat(word, F.when(i % 2 == 0, F.lit("")).otherwise(F.lit("X")))))
    return y.select("doc_id", x.prefix_summary(F.col("summary"), F.col("symbol")).alias("summary"))


#: Code chunks of several languages around a word of the document.
_WORD = "coalesce(nullif(regexp_extract(text, '[a-z]{3,8}', 0), ''), 'none')"
CHUNKS = f"""ck AS (SELECT doc_id, w, CASE doc_id % 9 WHEN 0 THEN 'class ' || w || '(Base):' || chr(10) || '    pass' WHEN 1 THEN 'def ' || w || '(a, b):' || chr(10) || '    return a' WHEN 2 THEN 'int Foo::' || w || '(int a) {{' || chr(10) || '  return Bar::run(a);'
    WHEN 3 THEN 'struct ' || w || ' {{' WHEN 4 THEN '#include <' || w || '.h>' || chr(10) || 'x = Foo::' || w || '(helper(1))' WHEN 5 THEN 'import a.' || w || chr(10) || 'if (x) run_' || w || '(1)' WHEN 6 THEN w || ' = 1' WHEN 7 THEN 'enum class ' || w || ' {{' ELSE 'A::x(1); B::y(1); B::' || w || '(2)' END AS chunk
    FROM (SELECT doc_id, {_WORD} AS w FROM documents))"""


def chunks(spark, d):
    i, w, nl = F.col("doc_id"), F.col("w"), F.lit("\n")
    c = lambda *p: F.concat(*[q if not isinstance(q, str) else F.lit(q) for q in p])
    kinds = (
        c("class ", w, "(Base):", nl, "    pass"), c("def ", w, "(a, b):", nl, "    return a"), c("int Foo::", w, "(int a) {", nl, "  return Bar::run(a);"), c("struct ", w, " {"), c("#include <", w, ".h>", nl, "x = Foo::", w, "(helper(1))"),
        c("import a.", w, nl, "if (x) run_", w, "(1)"), c(w, " = 1"), c("enum class ", w, " {"), c("A::x(1); B::y(1); B::", w, "(2)"),
    )
    chunk = F.coalesce(*[F.when(i % 9 == k, x) for k, x in enumerate(kinds)])
    return v.table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.regexp_extract("text", "[a-z]{3,8}", 0), F.lit("")), F.lit("none")).alias("w")).select("doc_id", "w", chunk.alias("chunk"))


# what the patterns find in these chunks, said independently: the classes' and functions' names are the chunk's word
_KEY = f"w IN ({_IN(x.KEYWORDS)})"
_CLASS = f"CASE WHEN doc_id % 9 IN (0, 3) AND NOT {_KEY} THEN w END"
_FN = f"CASE WHEN {_KEY} THEN NULL WHEN doc_id % 9 = 1 THEN w WHEN doc_id % 9 = 2 THEN 'Foo::' || w END"
_OWNER = "CASE doc_id % 9 WHEN 2 THEN 'Foo' WHEN 4 THEN 'Foo' WHEN 8 THEN 'B' END"


@query("str_class_name", f"WITH {CHUNKS} SELECT doc_id, {_CLASS} AS name FROM ck")
def str_class_name(spark, d):
    return chunks(spark, d).select("doc_id", x.class_name(F.col("chunk")).alias("name"))


@query("str_function_name", f"WITH {CHUNKS} SELECT doc_id, {_FN} AS name FROM ck")
def str_function_name(spark, d):
    return chunks(spark, d).select("doc_id", x.function_name(F.col("chunk")).alias("name"))


@query("str_classify_chunk", f"""WITH {CHUNKS}, n AS (SELECT doc_id, {_CLASS} AS c, {_FN} AS f, {_OWNER} AS o FROM ck)
    SELECT doc_id, CASE WHEN c IS NOT NULL THEN 'class_definition' WHEN f LIKE '%::%' THEN 'method_implementation' WHEN f IS NOT NULL THEN 'function_implementation' WHEN o IS NOT NULL THEN 'method_implementation' ELSE 'file_level_code' END AS kind, coalesce(c, f, o) AS symbol FROM n""")
def str_classify_chunk(spark, d):
    return chunks(spark, d).select("doc_id", x.classify_chunk(F.col("chunk")).alias("c")).select("doc_id", "c.kind", "c.symbol")


@query("str_chunk_functions", f"""WITH {CHUNKS} SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN CASE WHEN length(w) >= 4 THEN [w] ELSE [] END WHEN 2 THEN ['Foo::' || w, 'Bar::run'] WHEN 8 THEN ['A::x'] ELSE [] END AS names FROM ck""")
def str_chunk_functions(spark, d):
    return chunks(spark, d).select("doc_id", x.chunk_functions(F.col("chunk")).alias("names"))


_SAYS = f"sy AS (SELECT doc_id, w, 'It calls `Foo::' || w || '()` and invokes run_' || w || ', via Gate::in_' || w || '; uses open_' || w || '() and uses the cache.' AS summary FROM ck)"


@query("str_calls_from_summary", f"WITH {CHUNKS}, {_SAYS} SELECT doc_id, CASE WHEN w IN ({_IN(x.KEYWORDS)}) THEN ['run_' || w, 'Gate::in_' || w, 'open_' || w] ELSE ['Foo::' || w, 'run_' || w, 'Gate::in_' || w, 'open_' || w] END AS calls FROM sy")
def str_calls_from_summary(spark, d):
    w = F.col("w")
    says = F.concat(F.lit("It calls `Foo::"), w, F.lit("()` and invokes run_"), w, F.lit(", via Gate::in_"), w, F.lit("; uses open_"), w, F.lit("() and uses the cache."))
    return chunks(spark, d).select("doc_id", x.calls_from_summary(says).alias("calls"))


@query("str_calls_from_code", f"""WITH {CHUNKS} SELECT doc_id, list_concat(CASE WHEN {_KEY} THEN [] WHEN doc_id % 9 IN (0, 1) THEN [w] WHEN doc_id % 9 IN (2, 4) THEN ['Foo::' || w] WHEN doc_id % 9 = 8 THEN ['B::' || w] ELSE [] END,
    CASE doc_id % 9 WHEN 2 THEN ['Bar::run'] WHEN 4 THEN ['helper'] WHEN 5 THEN ['run_' || w] ELSE [] END) AS calls FROM ck""")
def str_calls_from_code(spark, d):
    return chunks(spark, d).select("doc_id", x.calls_from_code(F.col("chunk")).alias("calls"))


@query("str_cross_refs", rf"""WITH {v.TREE}, r AS (SELECT path, list_concat(list_concat(regexp_extract_all(content, '#include\s*[<"]([^>"]+)[>"]', 1), list_transform(regexp_extract_all(content, '(?:from|import)\s+([\w.]+)', 1), lambda r: replace(r, '.', '/'))), regexp_extract_all(content, '(\w+)::\w+', 1)) AS refs FROM tr),
    u AS (SELECT path, i, refs[i] AS ref FROM (SELECT *, unnest(generate_series(1, least(6, len(refs)))) AS i FROM r) WHERE list_position(refs, refs[i]) = i),
    dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS key FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS n FROM tr)),
    nm AS (SELECT string_split(path, '/')[-1] AS key, min(path) AS target FROM tr GROUP BY 1),
    c AS (SELECT path, i, ref, k, CASE WHEN k = 0 THEN ref WHEN k < 4 THEN regexp_replace(regexp_extract(path, '^(.*)/', 1) || '/' || ref || ['', '.h', '.hpp'][k], '[^/]+/[.][.]/', '') ELSE string_split(ref, '/')[-1] || ['', '.h', '.hpp'][k - 3] END AS key FROM (SELECT *, unnest(generate_series(0, 6)) AS k FROM u)),
    h AS (SELECT c.path, i, k, coalesce(dirs.key, nm.target) AS target FROM c LEFT JOIN dirs ON k < 4 AND dirs.key = c.key LEFT JOIN nm ON k >= 4 AND nm.key = c.key),
    b AS (SELECT path, i, arg_min(target, k) AS target FROM h WHERE target IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT path AS target, array_to_string(string_split(regexp_replace(content, '\n$', ''), chr(10))[1:40], chr(10)) || CASE WHEN len(string_split(regexp_replace(content, '\n$', ''), chr(10))) > 40 THEN chr(10) || '... (' || (len(string_split(regexp_replace(content, '\n$', ''), chr(10))) - 40) || ' more lines)' ELSE '' END AS head FROM tr),
    t AS (SELECT path, target, head, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM b JOIN s USING (target)),
    x AS (SELECT path, string_agg('[' || target || ']' || chr(10) || head, chr(10) || chr(10) ORDER BY k) AS context FROM t WHERE k <= 3 GROUP BY 1)
    SELECT r.path, refs, context FROM r LEFT JOIN x ON x.path = r.path""")
def str_cross_refs(spark, d):
    """The references of each source file, and the heads of the files that they mean."""
    at = f"{folder(spark)}/tree"
    made = v.tree(spark, d).select("path", x.cross_references(F.col("content")).alias("refs"), g.head_of(F.col("content")).alias("head"))
    made.write.parquet(at)  # each text is parsed once
    files = spark.read.schema(made.schema).parquet(at)
    chunks = files.select(F.col("path").alias("id"), "path", "refs")
    context = g.reference_context(chunks, files)
    return chunks.join(context, "id", "left").select("path", "refs", "context")


@query("str_struct_features", rf"""WITH {CHUNKS}, l AS (SELECT doc_id, string_split(chunk, chr(10)) AS lines FROM ck)
    SELECT doc_id, CAST(len(list_filter(lines, lambda y: regexp_matches(y, '\b(if|else|switch|case)\b'))) AS INTEGER) AS branches, CAST(len(list_filter(lines, lambda y: regexp_matches(y, '\b(for|while)\b'))) AS INTEGER) AS loops,
    CAST(len(list_filter(lines, lambda y: regexp_matches(y, '\b(try|catch|except)\b'))) AS INTEGER) AS tries, CAST(len(list_filter(lines, lambda y: regexp_matches(y, '\breturn\b'))) AS INTEGER) AS returns, substr(array_to_string(lines[1:2], ' '), 1, 120) AS preview FROM l""")
def str_struct_features(spark, d):
    return chunks(spark, d).select("doc_id", x.struct_features(F.col("chunk")).alias("f")).select("doc_id", "f.*")


@query("str_mention_sentence", r"""WITH m AS (SELECT doc_id, text, upper(regexp_extract(text, '[a-z]{5,9}', 0)) AS name FROM documents), s AS (SELECT doc_id, text, trim(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: contains(lower(y), lower(name)))[1]) AS hit FROM m WHERE name <> '')
    SELECT doc_id, CASE WHEN hit IS NULL THEN substr(text, 1, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END WHEN length(hit) > 200 THEN substr(hit, 1, 200) || '...' ELSE hit END AS sentence FROM s""")
def str_mention_sentence(spark, d):
    m = v.table(spark, d, "documents").select("doc_id", "text", F.upper(F.regexp_extract("text", "[a-z]{5,9}", 0)).alias("name")).filter("name <> ''")
    return m.select("doc_id", x.mention_sentence(F.col("text"), F.col("name")).alias("sentence"))


@query("hash_all", "SELECT doc_id, substr(sha256(text), 1, 16) AS file_hash, substr(sha256(text), 1, 12) AS chunk_hash, substr(sha256(trim(text)), 1, 16) AS signature, substr(sha256(substr(text, 1, 2000) || '|' || source), 1, 24) AS stable_id FROM documents")
def hash_all(spark, d):
    t = F.col("text")
    cut = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    return v.table(spark, d, "documents").select("doc_id", cut(t, 16).alias("file_hash"), cut(t, 12).alias("chunk_hash"), cut(F.trim(t), 16).alias("signature"), cut(F.concat(F.substring(t, 1, 2000), F.lit("|"), "source"), 24).alias("stable_id"))


@query("str_split_markdown", r"""WITH md AS (SELECT doc_id, ['Alpha', 'Beta', 'Gamma'] AS h, length(text) AS n FROM documents) SELECT doc_id, unnest(['', 'Alpha', 'Beta']) AS heading, unnest([0, 1, 2]) AS level, unnest(['intro', 'one ' || n, 'two']) AS content FROM md""")
def str_split_markdown(spark, d):
    md = F.concat(F.lit("---\ntitle: x\n---\nintro\n# Alpha\none "), F.length("text").cast("string"), F.lit("\n## Beta\ntwo\n"))
    t = v.table(spark, d, "documents").select("doc_id", F.explode(x.sections(md)).alias("s")).select("doc_id", "s.heading", "s.level", F.regexp_replace("s.content", r"\s+$", "").alias("content"))
    return t


@query("str_parse_html", r"""SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '&amp;?', '&', 'g'), '&quot;', '"'), '\s+', ' ', 'g')) AS heading FROM pages""")
def str_parse_html(spark, d):
    """Headings by the standard library's HTML parser, page by page in Arrow batches."""
    from lodestone.sources.html_sections import parse_pages

    s = parse_pages(v.table(spark, d, "pages").select("page_id", "html"))
    return s.filter("level = 1").select("page_id", "heading")


@query("str_parse_plain", r"""WITH f AS (SELECT doc_id, string_split(replace(replace(source || '-' || doc_id, '_', ' '), '-', ' '), ' ') AS words, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM documents)
    SELECT doc_id, array_to_string(list_transform(words, lambda y: upper(substr(y, 1, 1)) || lower(substr(y, 2))), ' ') AS title, content FROM f""")
def str_parse_plain(spark, d):
    """Plain texts: one section, a title from the file's name."""
    stem = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    return v.table(spark, d, "documents").select("doc_id", F.initcap(F.translate(stem, "_-", "  ")).alias("title"), seq.stripped(F.col("text")).alias("content"))


@query("str_safe_trim_prompt", "SELECT doc_id, 'be short' AS system, CASE WHEN length(text) >= 5 THEN substr(text, 1, CAST(floor(length(text) * 0.85::DOUBLE) AS INTEGER)) || chr(10) || '[...truncated to fit context window...]' ELSE text END AS question, CASE WHEN length(text) >= 5 THEN 'hint' ELSE 'hin' || chr(10) || '[...truncated to fit context window...]' END AS hint FROM documents")
def str_safe_trim_prompt(spark, d):
    """Of a conversation only the longest user message is cut."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    talk = F.array(say("system", F.lit("be short")), say("user", F.lit("hint")), say("user", F.col("text")))
    m = v.table(spark, d, "documents").select("doc_id", r.trim_messages(talk).alias("m"))
    return m.select("doc_id", *[F.col("m")[k]["content"].alias(n) for k, n in ((0, "system"), (2, "question"), (1, "hint"))])


@query("flt_error_class", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'quota' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'overflow' ELSE 'other' END AS kind FROM documents")
def flt_error_class(spark, d):
    i = F.col("doc_id")
    msg = F.when(i % 4 == 0, "Error: insufficient_quota for key").when(i % 4 == 1, "HTTP 429 Too Many Requests").when(i % 4 == 2, "maximum context length is 8192 tokens").otherwise("connection reset")
    return v.table(spark, d, "documents").select("doc_id", x.error_class(msg).alias("kind"))


@query("js_json_strip_fence", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'n/a' ELSE 'S' || doc_id END AS summary FROM documents")
def js_json_strip_fence(spark, d):
    """Fenced JSON answers; what cannot be parsed gets a default record."""
    i = F.col("doc_id")
    body = F.concat(F.lit('{"summary": "S'), i.cast("string"), F.lit('"}'))
    raw = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 3 == 1, body).otherwise("no json here")
    return v.table(spark, d, "documents").select("doc_id", F.coalesce(F.from_json(x.strip_fence(raw), "summary string")["summary"], F.lit("n/a")).alias("summary"))


@query("js_llm_defaults", """SELECT doc_id, doc_id % 4 = 0 AS useful, CASE WHEN doc_id % 4 = 0 THEN 'S' || doc_id ELSE '' END AS summary, '' AS solution, CASE doc_id % 4 WHEN 0 THEN 'c' || doc_id WHEN 3 THEN '' ELSE 'general' END AS category,
    CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'edit' ELSE 'reject' END AS decision FROM documents""")
def js_llm_defaults(spark, d):
    """Answers of several kinds as typed rows."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.when(i % 4 == 0, F.concat(F.lit('```json\n{"useful": true, "summary": "S'), s, F.lit('", "category": "c'), s, F.lit('"}\n```'))).when(i % 4 == 1, "{}").when(i % 4 == 2, '{"useful": null, "summary": null}').otherwise("sorry, no JSON")
    said = F.when(i % 3 == 0, '{"decision": " Approved "}').when(i % 3 == 1, '{"decision": "please EDIT or reject"}').otherwise("?")
    return v.table(spark, d, "documents").select("doc_id", answers.extraction(raw).alias("e"), answers.decision(said).alias("decision")).select("doc_id", "e.*", "decision")


@query("dt_parse_iso", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN DATE '2024-06-01' ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def dt_parse_iso(spark, d):
    """ISO texts; what cannot be parsed becomes a fixed anchor."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return v.table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).cast("date"), F.lit("2024-06-01").cast("date")).alias("day"))


@query("dt_staleness", "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '1998-09-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age_days, floor((epoch(TIMESTAMP '1998-09-01') - epoch(o_orderdate)) / 86400) > 90 AS stale FROM orders")
def dt_staleness(spark, d):
    age = F.floor((F.lit("1998-09-01").cast("timestamp").cast("double") - F.col("o_orderdate").cast("timestamp").cast("double")) / 86400).cast("long")
    return v.table(spark, d, "orders").select("o_orderkey", age.alias("age_days"), F.coalesce(age > 90, F.lit(True)).alias("stale"))


@query("win_line_chunks", """WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), w AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines), 4)) AS start FROM f),
    t AS (SELECT CAST(doc_id AS VARCHAR) AS path, (start - 1) // 4 AS chunk_index, substr(array_to_string(lines[start:start + 5], chr(10)), 1, 4000) AS text FROM w) SELECT * FROM t WHERE trim(text) <> ''""")
def win_line_chunks(spark, d):
    f = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return seq.line_windows(f, step=4, length=6)


@query("str_chunk_code_ast", """WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), w AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines), 60)) AS start FROM f),
    t AS (SELECT CAST(doc_id AS VARCHAR) AS path, (start - 1) // 60 AS chunk_index, substr(array_to_string(lines[start:start + 69], chr(10)), 1, 4000) AS text FROM w) SELECT path, chunk_index, length(text) AS n_chars FROM t WHERE trim(text) <> ''""")
def str_chunk_code_ast(spark, d):
    """The line fallback of the code splitter: a parser can be plugged in before it."""
    f = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return seq.line_windows(f).select("path", "chunk_index", F.length("text").cast("long").alias("n_chars"))


@query("win_paragraph_pack", r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS ps FROM documents),
    pc AS (SELECT doc_id, flatten(list_transform(ps, lambda y: list_transform(generate_series(0, (length(y) - 1) // 300), lambda i: substr(y, i * 300 + 1, 300)))) AS xs FROM p),
    step AS (SELECT doc_id, xs, 1 AS pos, 1 AS chunk, length(xs[1]) AS used FROM pc WHERE len(xs) > 0
        UNION ALL SELECT doc_id, xs, pos + 1, CASE WHEN used + 2 + length(xs[pos + 1]) <= 300 THEN chunk ELSE chunk + 1 END, CASE WHEN used + 2 + length(xs[pos + 1]) <= 300 THEN used + 2 + length(xs[pos + 1]) ELSE length(xs[pos + 1]) END FROM step WHERE pos < len(xs)),
    sized AS (SELECT doc_id, chunk, max(used) AS n FROM step GROUP BY 1, 2)
    SELECT doc_id, list(CAST(n AS INTEGER) ORDER BY chunk) AS sizes FROM sized GROUP BY doc_id""")
def win_paragraph_pack(spark, d):
    """The sizes of each document's chunks of at most 300 characters."""
    packed = v.table(spark, d, "documents").select("doc_id", seq.pack_paragraphs(F.col("text"), 300).alias("c"))
    return packed.filter(F.size("c") > 0).select("doc_id", F.transform("c", lambda y: F.length(y)).alias("sizes"))


@query("str_chunk_document")
def str_chunk_document(spark, d):
    """The number of chunks of every document, and of the characters in them: sections that fit are one chunk, longer ones are packed."""
    chunks = seq.document_chunks(x.sections(F.col("text")), F.coalesce("text", F.lit("")))
    return v.table(spark, d, "documents").select("doc_id", F.coalesce(chunks, F.array(F.struct(F.lit("").alias("heading"), F.lit("").alias("text")))).alias("c")).select("doc_id", F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0), lambda n, y: n + F.length(y["text"])).alias("n_chars"))


@query("win_chunk_dedup", r"""WITH s AS (SELECT doc_id, substr(sha256(trim(text)), 1, 16) AS h, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, len(string_split(text, chr(10))) AS l FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h, n, l) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY h, n, l) AS is_duplicate FROM s""")
def win_chunk_dedup(spark, d):
    return seq.dedup_chunks(v.table(spark, d, "documents"), "text", "doc_id").select("doc_id", "first_id", "is_duplicate")


@query("win_function_groups", f"WITH {v.FUNCTIONS} SELECT path, chunk_index, island FROM fng")
def win_function_groups(spark, d):
    """Windows of source files that go on with the function of the window before, by its name or by what they share with it."""
    return seq.function_groups(v.functions(spark, d), x.function_name(F.col("text")), ["path"], "chunk_index").select("path", "chunk_index", "island")


@query("win_recent_comments", """WITH c AS (SELECT conv_id, turn, substr(text, 1, 300) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE turn > 0)
    SELECT 'CONV-' || conv_id AS key, string_agg(body, chr(10) ORDER BY turn) AS recent FROM c WHERE back <= 5 GROUP BY conv_id""")
def win_recent_comments(spark, d):
    c = F.slice("comments", F.greatest(F.size("comments") - 4, F.lit(1)), F.lit(5))
    return v.tickets(spark, d).filter(F.size("comments") > 0).select("key", F.array_join(F.transform(c, lambda y: F.substring(y["body"], 1, 300)), "\n").alias("recent"))


@query("win_running_budget", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)
    SELECT l_orderkey, CAST(count(*) FILTER (t <= 100) AS BIGINT) AS kept, bool_or(t > 100) AS cut FROM (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM r) GROUP BY 1""")
def win_running_budget(spark, d):
    li = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    r = seq.running_budget(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "size"], "size", 100)
    return r.groupBy("l_orderkey").agg(F.count_if("within").alias("kept"), F.bool_or(~F.col("within")).alias("cut"))


@query("win_first_def", "SELECT l_partkey AS symbol, min(l_orderkey) AS first_file FROM lineitem GROUP BY 1")
def win_first_def(spark, d):
    """The first chunk that defines a symbol; a minimum combines before the shuffle, a ranking would not."""
    return v.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.min("l_orderkey").alias("first_file"))


@query("str_ticket_context", r"""WITH """ + v.TICKETS + r""", c AS (SELECT conv_id, string_agg('  [' || role || ']: ' || substr(text, 1, 300), chr(10) ORDER BY turn) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE turn > 0) WHERE back <= 5 GROUP BY conv_id)
    SELECT key, substr('Ticket: ' || key || ' — ' || title || CASE WHEN description <> '' THEN chr(10) || chr(10) || 'Description:' || chr(10) || substr(description, 1, 500) ELSE '' END || CASE WHEN resolution <> '' THEN chr(10) || chr(10) || 'Resolution: ' || resolution ELSE '' END
        || CASE WHEN lines IS NOT NULL THEN chr(10) || chr(10) || 'Recent comments:' || chr(10) || lines ELSE '' END, 1, 3000) AS context FROM tk LEFT JOIN c USING (conv_id)""")
def str_ticket_context(spark, d):
    return v.tickets(spark, d).select("key", x.ticket_context(*map(F.col, ("key", "title", "description", "resolution", "comments"))).alias("context"))


@query("str_format_results", f"""WITH {v.ENTRIES} SELECT doc_id, '## Result ' || (doc_id % 5 + 1) || '  [code/' || CASE WHEN doc_id % 2 = 0 THEN 'reference' ELSE CASE WHEN doc_id % 3 = 0 THEN 'raw_code' ELSE chunk_type END END || ']  (score: 0.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ')' || chr(10)
    || '**File**: `' || source_file || '`  |  **Module**: `' || module || '`' || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '**Source code**:' || chr(10) || '```' || chr(10) || raw_code || chr(10) || '```' ELSE '**Summary**:' || chr(10) || summary END AS text FROM en""")
def str_format_results(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "raw_code").otherwise(F.col("chunk_type"))
    block = r.result_block(i % 5 + 1, F.col("summary"), (i % 1000) / 1000, F.lit("code"), F.when(i % 2 == 0, "reference"), kind, F.col("source_file"), F.col("module"))
    return v.entries(spark, d).select("doc_id", block.alias("text"))


@query("str_func_card_text", """SELECT p_partkey, '[Function card: ' || p_name || ' in f.py]' || chr(10) || 'Purpose: unknown' || chr(10) || 'Parameters: ' || array_to_string(list_transform(generate_series(1, least(p_size, 8)), lambda i: 'p' || i), '; ') || chr(10) || 'Returns: ' || p_size
    || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Phases: ' || array_to_string(list_transform(generate_series(1, least(p_size, 6)), lambda i: 'n' || i || ': ?'), ' → ') ELSE '' END
    || chr(10) || 'Called by: ' || array_to_string(list_transform(generate_series(1, least(p_size, 5)), lambda i: 'c' || i), ', ') || chr(10) || 'Complexity: high' AS text FROM part""")
def str_func_card_text(spark, d):
    n = F.col("p_size")
    some = lambda letter, c=None: F.transform(F.sequence(F.lit(1), n if c is None else c), lambda i: F.concat(F.lit(letter), i.cast("string")))
    phases = F.when(n % 2 == 0, F.transform(some("n"), lambda p: F.struct(p.alias("name"), F.lit(None).cast("string").alias("description"))))
    contract = F.struct(some("p").alias("params"), n.cast("string").alias("returns"))
    card = F.from_json(F.to_json(F.struct(F.col("p_name").alias("name"), contract.alias("contract"), phases.alias("phases"), F.lit("high").alias("complexity"))), r.CARD)
    parts = v.table(spark, d, "part").select("p_partkey", "p_name", "p_size").repartition("p_partkey")  # a small file of many rows is one task's
    return parts.select("p_partkey", r.function_card(card, F.lit("f.py"), some("c"), F.array().cast("array<string>")).alias("text"))


@query("str_detect_classes", f"""WITH {CHUNKS} SELECT doc_id, {_CLASS} AS name, chunk AS snippet FROM ck WHERE doc_id % 9 IN (0, 3) AND NOT {_KEY}""")
def str_detect_classes(spark, d):
    """Classes that chunks declare, with up to 30 lines from the declaration on."""
    return g.declared_classes(chunks(spark, d).select("doc_id", "chunk"), "doc_id").select("doc_id", "name", "snippet")


@query("str_pass2_prompt", f"""WITH {SUMMARY} SELECT doc_id, 'Project: P' || chr(10) || 'Module: m — about m' || chr(10) || chr(10) || 'Questions that the module answers:' || chr(10) || '- q1' || chr(10) || '- q2' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Context:' || chr(10) || 'file does x' ELSE '' END
    || chr(10) || chr(10) || 'Source file: f.py' || chr(10) || '```' || chr(10) || summary || chr(10) || '```' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Called from many files:' || chr(10) || '- h' ELSE '' END || chr(10)
    || chr(10) || 'Summarise what the code does, in the project''s words; say its category and how useful it is to search for.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Also answer:' || chr(10) || '- why ' || doc_id ELSE '' END AS prompt FROM sm""")
def str_pass2_prompt(spark, d):
    i, one = F.col("doc_id"), lambda *xs: F.array(*map(F.lit, xs))
    context = F.when(i % 2 == 0, F.concat(F.lit("file does x\nFocus on: why "), i.cast("string")))
    hints = F.when(i % 3 == 0, one("h")).otherwise(F.array().cast("array<string>"))
    return summaries(spark, d).select("doc_id", r.chunk_prompt(F.lit("P"), F.lit("m"), F.lit("about m"), one("q1", "q2"), F.lit("f.py"), F.col("summary"), context, hints).alias("prompt"))


@query("flt_diff_source", "SELECT page_id, '  a' || page_id || '.py' || chr(10) || '+line 1' || chr(10) || '   deep' || chr(10) || '  CMakeLists.txt' || chr(10) || '+x' || chr(10) || '  c.hpp' || CASE WHEN page_id % 3 = 0 THEN chr(10) || url ELSE '' END AS diff FROM pages")
def flt_diff_source(spark, d):
    """Of a diff the sections whose header names a source file."""
    diff = F.concat(F.lit("lead\n  a"), F.col("page_id").cast("string"), F.lit(".py\n+line 1\n   deep\n  b.md\n+line 2\n  CMakeLists.txt\n+x\n  notes.txt\n-y\n  c.hpp"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\n"), "url")).otherwise(""))
    return v.table(spark, d, "pages").select("page_id", x.diff_source(diff).alias("diff"))
