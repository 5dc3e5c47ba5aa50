"""Queries on call graphs, module maps and curation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.operators import build, explore, review
from lodestone.operators import graph as g
from lodestone.operators import modules as m
from lodestone.operators import sequences as seq
from lodestone.plans import catalog_text as t
from lodestone.plans import views as v
from lodestone.plans.registry import folder, query

_FREQ = f"{v.CODE}, fq AS (SELECT 'handler_' || l_partkey AS symbol, count(DISTINCT path) AS n_files FROM code GROUP BY 1)"


@query("agg_caller_freq", f"WITH {_FREQ} SELECT symbol, n_files FROM fq WHERE n_files >= 35")
def agg_caller_freq(spark, d):
    return g.caller_frequency(v.code_lines(spark, d), least_files=35)


@query("top_frequent_calls", f"WITH {_FREQ} SELECT symbol, n_files FROM fq ORDER BY n_files DESC, symbol LIMIT 5")
def top_frequent_calls(spark, d):
    return g.caller_frequency(v.code_lines(spark, d), least_files=1).orderBy(F.desc("n_files"), "symbol").limit(5)


EDGES = "ed AS (SELECT 'order_' || l_orderkey AS caller, 'part_' || l_partkey AS callee, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2)"


def edges(spark, d):
    calls = v.table(spark, d, "lineitem").select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("callee"), F.col("l_linenumber").alias("ord"))
    return g.call_edges(calls)


@query("agg_caller_sketch", f"""WITH {_FREQ} SELECT symbol, n_files, true AS within FROM fq""")
def agg_caller_sketch(spark, d):
    """Two runs over overlapping halves of the files store their sketches; whether the estimate over both is within three standard errors of the exact count."""
    at = folder(spark)
    calls = v.code_lines(spark, d).select(F.regexp_extract("line", r"(\w+)\(", 1).alias("symbol"), "path", "l_orderkey")
    for mine in ("l_orderkey % 3 < 2", "l_orderkey % 3 > 0"):
        g.sketch_callers(calls.filter(mine), at)
    exact = calls.groupBy("symbol").agg(F.countDistinct("path").alias("n_files"))
    about = g.estimated_callers(spark.read.parquet(at)).select("symbol", F.col("n_files").alias("about"))
    error = 3 * 1.04 / 2 ** (g.REGISTERS / 2)
    return exact.join(about, "symbol").select("symbol", "n_files", (F.abs(F.col("about") - F.col("n_files")) <= F.col("n_files") * error + 1).alias("within"))


@query("agg_call_graph", f"""WITH l AS (SELECT 'order_' || l_orderkey AS caller, 'part_' || l_partkey AS callee, l_linenumber AS ord, l_linenumber % 2 AS chunk FROM lineitem), last AS (SELECT caller, max(chunk) AS chunk FROM l GROUP BY 1),
    e AS (SELECT caller, callee, min(ord) AS ord FROM l JOIN last USING (caller, chunk) GROUP BY 1, 2), {EDGES}
    SELECT 'calls' AS kind, caller AS symbol, count(*) AS n, list(callee ORDER BY ord, callee) AS names FROM e GROUP BY 2 UNION ALL SELECT 'called_by', callee, count(*), list(caller ORDER BY caller)[1:5] FROM ed GROUP BY 2""")
def agg_call_graph(spark, d):
    """What each caller calls (of several chunks the last counts), and who calls each symbol, the first five by name."""
    li = v.table(spark, d, "lineitem")
    calls = li.select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("callee"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") % 2).alias("chunk"))
    last = calls.groupBy("caller").agg(F.max("chunk").alias("chunk"))
    own = g.calls_of(calls.groupBy("caller", "callee", "chunk").agg(F.min("ord").alias("ord")), last).select(F.lit("calls").alias("kind"), F.col("caller").alias("symbol"), F.size("callees").cast("long").alias("n"), F.col("callees").alias("names"))
    by = g.first_callers(edges(spark, d)).select(F.lit("called_by").alias("kind"), F.col("callee").alias("symbol"), F.col("n_callers").alias("n"), F.col("callers").alias("names"))
    return own.unionByName(by)


@query("agg_called_by_suffix", f"""WITH {EDGES}, r AS (SELECT callee, caller, row_number() OVER (PARTITION BY callee ORDER BY caller) AS i, count(*) OVER (PARTITION BY callee) AS n FROM ed), t AS (SELECT callee, string_agg(caller, ', ' ORDER BY caller) AS names, max(n) AS n FROM r WHERE i <= 5 GROUP BY 1)
    SELECT p_partkey, CASE WHEN t.callee IS NULL THEN p_name ELSE rtrim(p_name) || ' Called by: ' || names || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END || '.' END AS summary FROM part LEFT JOIN t ON t.callee = 'part_' || p_partkey""")
def agg_called_by_suffix(spark, d):
    s = v.table(spark, d, "part").select("p_partkey", F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("summary"))
    return g.called_by_suffix(s, edges(spark, d)).select("p_partkey", "summary")


_SYMBOLS = "sy AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'C' || n_regionkey || '::run' || (n_nationkey % 4) ELSE 'run' || (n_nationkey % 6) END AS symbol, 'f' || (n_nationkey % 3) AS file, n_nationkey AS ord FROM nation)"


@query("jn_call_resolve", f"""WITH {_SYMBOLS}, ca AS (SELECT s_suppkey AS call_id, 'f' || (s_suppkey % 3) AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'C1::run' || (s_suppkey % 5) ELSE 'run' || (s_suppkey % 7) END AS callee FROM supplier),
    r AS (SELECT call_id, callee, symbol, row_number() OVER (PARTITION BY call_id ORDER BY symbol = callee DESC, sy.file <> ca.file DESC, ord) AS i FROM ca JOIN sy ON string_split(callee, '::')[-1] = string_split(symbol, '::')[-1]) SELECT call_id, callee, symbol FROM r WHERE i = 1""")
def jn_call_resolve(spark, d):
    n, k, r = v.table(spark, d, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    s = lambda *p: F.concat(*[F.lit(q) if isinstance(q, str) else q.cast("string") for q in p])
    symbols = n.select(F.when(k % 2 == 0, s("C", r, "::run", k % 4)).otherwise(s("run", k % 6)).alias("symbol"), s("f", k % 3).alias("file"), k.alias("ord"))
    i = F.col("s_suppkey")
    calls = v.table(spark, d, "supplier").select(i.alias("call_id"), s("f", i % 3).alias("file"), F.when(i % 2 == 0, s("C1::run", i % 5)).otherwise(s("run", i % 7)).alias("callee"))
    return g.resolve_calls(calls, symbols)


@query("jn_file_resolve", f"""WITH {v.FILES}, x AS (SELECT path, file_id, string_split(path, '/')[-1] AS base FROM fl), b AS (SELECT base, min(path) AS path FROM x GROUP BY 1), w AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN path ELSE base END AS name, base FROM x)
    SELECT file_id, coalesce(f.path, b.path) AS resolved FROM w LEFT JOIN (SELECT DISTINCT path FROM x) f ON f.path = w.name LEFT JOIN b ON b.base = w.base""")
def jn_file_resolve(spark, d):
    """A name's own path, else the first path with its base name."""
    f = v.files(spark, d).withColumn("base", F.element_at(F.split("path", "/"), -1))
    first = f.groupBy("base").agg(F.min("path").alias("by_base"))
    wanted = f.select("file_id", "base", F.when(F.col("file_id") % 2 == 0, F.col("path")).otherwise(F.col("base")).alias("name"))
    exact = f.select(F.col("path").alias("name")).distinct().withColumn("exact", F.col("name"))
    return wanted.join(exact, "name", "left").join(first, "base", "left").select("file_id", F.coalesce("exact", "by_base").alias("resolved"))


@query("jn_class_context", f"""WITH {v.ENTRIES}, c AS (SELECT module, source_file, chunk_category AS class, summary FROM en WHERE chunk_type = 'class_overview'), loc AS (SELECT source_file, class, max(summary) AS s FROM c GROUP BY 1, 2), glo AS (SELECT class, arg_max(summary, (length(summary), summary)) AS s FROM c GROUP BY 1)
    SELECT en.doc_id, coalesce(loc.s, glo.s) AS context FROM en LEFT JOIN loc ON loc.source_file = en.source_file AND loc.class = en.chunk_category LEFT JOIN glo ON glo.class = en.chunk_category""")
def jn_class_context(spark, d):
    """A chunk's class: of its own file first, else the longest summary anywhere."""
    e = v.entries(spark, d)
    c = e.filter("chunk_type = 'class_overview'").select("source_file", "chunk_category", "summary")
    local = c.groupBy("source_file", "chunk_category").agg(F.max("summary").alias("local"))
    everywhere = c.groupBy("chunk_category").agg(F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("anywhere"))
    return e.join(local, ["source_file", "chunk_category"], "left").join(everywhere, "chunk_category", "left").select("doc_id", F.coalesce("local", "anywhere").alias("context"))


@query("jn_usage_hints", f"""WITH {_FREQ}, f AS (SELECT p_partkey, n_files FROM part JOIN fq ON symbol = 'handler_' || p_partkey WHERE p_partkey % 5 > 0)
    SELECT p_partkey AS chunk_id, [CASE WHEN p_partkey % 2 = 0 THEN 'Ns::' ELSE '' END || 'handler_' || p_partkey || ' is called from ' || n_files || ' different files' || CASE WHEN p_partkey % 3 = 0 THEN '. Documentation says: see ' || p_partkey ELSE '' END] AS hints FROM f""")
def jn_usage_hints(spark, d):
    """Functions that chunks define, by their whole or last name, with how many files call them."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("handler_"), k.cast("string"))
    part = v.table(spark, d, "part")
    functions = part.select(k.alias("chunk_id"), F.lit(0).alias("ord"), F.when(k % 5 == 0, F.lit("unknown_fn")).when(k % 2 == 0, F.concat(F.lit("Ns::"), name)).otherwise(name).alias("fn"))
    mentions = part.filter("p_partkey % 3 = 0").select(name.alias("symbol"), F.concat(F.lit("see "), k.cast("string")).alias("snippet"))
    return g.usage_hints(functions, g.caller_frequency(v.code_lines(spark, d), least_files=1), mentions)


@query("jn_doc_mentions", """WITH s AS (SELECT DISTINCT 'Ns::' || upper(regexp_extract(text, '[a-z]{5,9}', 0)) AS symbol FROM documents WHERE doc_id % 50 = 0 AND regexp_extract(text, '[a-z]{5,9}', 0) <> ''), h AS (SELECT symbol, doc_id, text FROM s JOIN documents ON contains(lower(text), lower(substr(symbol, 5)))), f AS (SELECT symbol, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM h GROUP BY 1),
    m AS (SELECT symbol, doc_id, trim(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: contains(lower(y), lower(substr(symbol, 5))))[1]) AS hit FROM f) SELECT symbol, '[d' || doc_id || '] ' || CASE WHEN length(hit) > 200 THEN substr(hit, 1, 200) || '...' ELSE hit END AS snippet FROM m""")
def jn_doc_mentions(spark, d):
    """For each symbol (a word of the documents whose ids are divisible by 50) the first document that names it, with the sentence."""
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    word = F.regexp_extract("text", "[a-z]{5,9}", 0)
    symbols = docs.filter("doc_id % 50 = 0").select(F.concat(F.lit("Ns::"), F.upper(word)).alias("symbol"), word.alias("name")).filter("name <> ''").distinct()
    first = g.first_mentions(symbols, docs).join(symbols, "name").join(docs, "doc_id")
    return g.doc_mentions(symbols, first.select("symbol", F.col("doc_id").alias("rank"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_file"), "text"))


MODULES = "md AS (SELECT 'd' || (n_nationkey % 7) AS sub, n_nationkey AS ord, 'M' || n_regionkey AS module, CASE n_nationkey % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' ELSE 'core' END AS top FROM nation), mod AS (SELECT CASE WHEN ord % 4 = 0 THEN top ELSE top || '/' || sub END AS dir, module, ord FROM md)"


def modules(spark, d):
    k = F.col("n_nationkey")
    top = F.when(k % 3 == 0, "src").when(k % 3 == 1, "lib").otherwise("core")
    sub = F.concat(F.lit("d"), (k % 7).cast("string"))
    return v.table(spark, d, "nation").select(F.when(k % 4 == 0, top).otherwise(F.concat_ws("/", top, sub)).alias("dir"), F.concat(F.lit("M"), F.col("n_regionkey").cast("string")).alias("module"), k.alias("ord"))


_ASSIGNED = f"""{v.FILES}, {MODULES}, asg AS (SELECT path, arg_min(module, (ord, module)) AS module FROM fl JOIN mod ON starts_with(path, dir || '/') GROUP BY 1)"""


@query("jn_assign_exclusive", f"WITH {_ASSIGNED} SELECT path, module FROM asg")
def jn_assign_exclusive(spark, d):
    return m.assign_exclusive(v.files(spark, d), modules(spark, d))


#: The module's own directories, and deeper ones that no file is in.
_DEEP = "deep AS (SELECT dir, module, ord FROM mod UNION ALL SELECT dir || '/d1/x' || ord, 'D' || ord, ord + 100 FROM mod UNION ALL SELECT 'tests/d' || (ord % 7) || '/deep', 'T' || ord, ord + 200 FROM mod)"
_NEAREST = """sc AS (SELECT path, module, ord, CASE WHEN path = dir OR starts_with(path, dir || '/') THEN length(dir) ELSE
        coalesce(list_position(list_transform(list_zip(string_split(path, '/'), string_split(dir, '/')), lambda z: z[1] = z[2] AND z[1] IS NOT NULL AND z[2] IS NOT NULL), false), 1) - 1 END AS score FROM (SELECT DISTINCT path FROM fl), deep),
    best AS (SELECT path, arg_max(module, (score, -ord, module)) AS module, max(score) AS score FROM sc WHERE score > 0 GROUP BY 1)"""


def _deep(spark, d):
    own, o = modules(spark, d), F.col("ord")
    under = own.select(F.concat("dir", F.lit("/d1/x"), o.cast("string")).alias("dir"), F.concat(F.lit("D"), o.cast("string")).alias("module"), (o + 100).alias("ord"))
    tests = own.select(F.concat(F.lit("tests/d"), (o % 7).cast("string"), F.lit("/deep")).alias("dir"), F.concat(F.lit("T"), o.cast("string")).alias("module"), (o + 200).alias("ord"))
    return own.unionByName(under).unionByName(tests)


@query("jn_orphan_prefix", f"WITH {v.FILES}, {MODULES}, {_DEEP}, {_NEAREST} SELECT path, coalesce(module, 'other') AS module, coalesce(CAST(score AS INTEGER), 0) AS score FROM (SELECT DISTINCT path FROM fl) LEFT JOIN best USING (path)")
def jn_orphan_prefix(spark, d):
    """Files to the module whose directory is above them, else to the one with the most leading components in common."""
    return m.orphan_prefix(v.files(spark, d), _deep(spark, d))


@query("jn_map_merge", f"WITH {_ASSIGNED}, new AS (SELECT path, 'N' || length(path) % 3 AS module FROM fl WHERE file_id % 5 = 0) SELECT module, count(*) AS n_files FROM (SELECT path, module FROM new UNION ALL SELECT path, module FROM asg WHERE path NOT IN (SELECT path FROM new)) GROUP BY 1")
def jn_map_merge(spark, d):
    """A new map wins for its files; old modules keep the others, and empty ones vanish."""
    new = v.files(spark, d).filter("file_id % 5 = 0").select("path", F.concat(F.lit("N"), (F.length("path") % 3).cast("string")).alias("module"))
    old = m.assign_exclusive(v.files(spark, d), modules(spark, d))
    return new.unionByName(old.join(new.select("path"), "path", "left_anti")).groupBy("module").agg(F.count("*").alias("n_files"))


@query("agg_module_coverage", f"WITH {_ASSIGNED} SELECT module, count(*) AS n_files, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM asg) AS pct FROM asg GROUP BY 1")
def agg_module_coverage(spark, d):
    return m.coverage(m.assign_exclusive(v.files(spark, d), modules(spark, d)))


_ANC = f"{v.FILES}, an AS (SELECT path, array_to_string(p[1:n], '/') AS dir, n = len(p) - 1 AS own FROM (SELECT path, string_split(path, '/') AS p, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM fl))"


@query("agg_dir_tree_counts", f"WITH {_ANC}, c AS (SELECT DISTINCT dir FROM an), k AS (SELECT array_to_string(string_split(dir, '/')[1:-2], '/') AS dir, count(*) AS subdirs FROM c WHERE contains(dir, '/') GROUP BY 1) SELECT an.dir, count(*) FILTER (own) AS direct, count(*) AS total, coalesce(max(subdirs), 0) AS subdirs FROM an LEFT JOIN k ON k.dir = an.dir GROUP BY 1")
def agg_dir_tree_counts(spark, d):
    return m.tree_counts(v.files(spark, d))


@query("flt_module_files", f"WITH {v.FILES} SELECT path FROM fl WHERE starts_with(path, 'src/d1/')")
def flt_module_files(spark, d):
    from lodestone.sources.files import module_files

    return module_files(v.files(spark, d).select("path"), "./src/d1/")


@query("set_unexplored", f"WITH {v.FILES}, c AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, count(*) AS n FROM fl GROUP BY 1) SELECT dir FROM c WHERE n >= 30 AND NOT starts_with(dir, 'src') ")
def set_unexplored(spark, d):
    dirs = v.files(spark, d).groupBy(F.substring_index("path", "/", 2).alias("dir")).agg(F.count("*").alias("n")).filter("n >= 30").select("dir")
    explored = dirs.filter(F.col("dir").startswith("src"))
    return dirs.exceptAll(explored)


@query("grp_coverage_gate", f"WITH {v.FILES}, c AS (SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM fl GROUP BY 1), e AS (SELECT DISTINCT split_part(path, '/', 1) AS top FROM fl WHERE file_id % 1000 = 1) SELECT top, n, top IN (SELECT top FROM e) AS explored, n >= 30 AND top NOT IN (SELECT top FROM e) AS blocks FROM c")
def grp_coverage_gate(spark, d):
    """Large directories block until a file of theirs has been read."""
    f = v.files(spark, d)
    top = F.substring_index("path", "/", 1).alias("top")
    return explore.coverage_gate(f.groupBy(top).agg(F.count("*").alias("n")), f.filter("file_id % 1000 = 1").select(top), F.lit(False))


@query("grp_fallback_map", f"WITH {v.FILES} SELECT split_part(path, '/', 1) AS module, count(*) AS n_files FROM fl GROUP BY 1")
def grp_fallback_map(spark, d):
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("."))
    return v.files(spark, d).groupBy(top.alias("module")).agg(F.count("*").alias("n_files"))


@query("grp_import_map", f"WITH {_ASSIGNED}, p AS (SELECT coalesce(asg.module, 'other') AS module, count(*) AS n FROM (SELECT DISTINCT path FROM fl) LEFT JOIN asg USING (path) GROUP BY 1), d AS (SELECT DISTINCT module FROM mod UNION SELECT module FROM p) SELECT module, coalesce(n, 0) AS n_files, (SELECT CAST(sum(n) FILTER (module <> 'other') AS BIGINT) * 100 // CAST(sum(n) AS BIGINT) FROM p) AS coverage FROM d LEFT JOIN p USING (module)")
def grp_import_map(spark, d):
    f = v.files(spark, d)
    return build.import_map(f, m.assign_exclusive(f, modules(spark, d)), modules(spark, d))


@query("grp_discover", f"WITH {_ASSIGNED}, {_DEEP}, {_NEAREST}, o AS (SELECT DISTINCT path FROM fl WHERE path NOT IN (SELECT path FROM asg)) SELECT module, count(*) AS n_files FROM (SELECT module FROM asg UNION ALL SELECT coalesce(module, 'other') FROM o LEFT JOIN best USING (path)) GROUP BY 1")
def grp_discover(spark, d):
    """Assign, give orphans to the nearest module, else to "other"; persist as a map."""
    f = v.files(spark, d)
    done = m.assign_exclusive(f, modules(spark, d))
    rest = m.orphan_prefix(f.join(done.select("path"), "path", "left_anti"), _deep(spark, d)).select("path", "module")
    return done.unionByName(rest).groupBy("module").agg(F.count("*").alias("n_files"))


@query("grp_validate_modules", f"WITH {MODULES}, t AS (SELECT module, count(DISTINCT split_part(dir, '/', 2)) AS n_top FROM mod GROUP BY 1) SELECT module, n_top, n_top > 13 * 0.4::DOUBLE AS catch_all, (SELECT count(*) FROM t) < 6 AS too_few FROM t")
def grp_validate_modules(spark, d):
    claims = modules(spark, d).select("module", F.coalesce(F.nullif(F.split_part(F.col("dir"), F.lit("/"), F.lit(2)), F.lit("~")), F.lit("")).alias("top"))
    return m.validate(claims, 501, 13)


@query("grp_flag_large", f"""WITH {_ASSIGNED}, s AS (SELECT module, count(DISTINCT split_part(path, '/', 2)) AS n_dirs, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM asg) AS pct, count(*) AS n_files FROM asg GROUP BY 1)
    SELECT module, n_dirs, n_files, concat_ws(',', CASE WHEN n_dirs >= 3 THEN 'dirs' END, CASE WHEN pct > 25 THEN 'share' END, CASE WHEN n_files > 60 THEN 'files' END) AS why, n_dirs >= 3 OR pct > 25 OR n_files > 60 AS too_large FROM s""")
def grp_flag_large(spark, d):
    a = m.assign_exclusive(v.files(spark, d), modules(spark, d))
    s = a.groupBy("module").agg(F.countDistinct(F.split_part(F.col("path"), F.lit("/"), F.lit(2))).alias("n_dirs"), F.count("*").alias("n_files"))
    s = s.withColumn("pct", F.col("n_files") * 100.0 / F.sum("n_files").over(Window.partitionBy()))
    return m.flag_large(s).select("module", "n_dirs", "n_files", "why", "too_large")


@query("top_file_samples", f"""WITH {v.FILES}, f AS (SELECT path, split_part(path, '/', 1) AS module, split_part(path, '/', 2) AS dir FROM fl), s AS (SELECT module, count(*) AS n, count(DISTINCT dir) AS dirs FROM f GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY module, dir ORDER BY path) AS i FROM f JOIN s USING (module)), p AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY dir, i) AS place FROM r WHERE n <= 40 OR i <= greatest(3, 30 // greatest(dirs, 1))) SELECT module, dir, path FROM p WHERE place <= 40""")
def top_file_samples(spark, d):
    part = lambda k: F.split_part(F.col("path"), F.lit("/"), F.lit(k))
    return m.file_samples(v.files(spark, d).select(part(1).alias("module"), part(2).alias("dir"), "path"))


@query("set_known_classes", f"WITH {v.ENTRIES} SELECT DISTINCT module AS name FROM en UNION SELECT DISTINCT chunk_category FROM en")
def set_known_classes(spark, d):
    e = v.entries(spark, d)
    return e.select(F.col("module").alias("name")).union(e.select("chunk_category")).distinct()


@query("agg_class_owner", f"WITH {t.CHUNKS} SELECT doc_id, {t._OWNER} AS owner FROM ck")
def agg_class_owner(spark, d):
    """The commonest qualifier of each chunk; ties to the first seen."""
    return t.chunks(spark, d).select("doc_id", x.class_owner(F.col("chunk")).alias("owner"))


@query("agg_kb_gap", f"WITH {v.ENTRIES} SELECT module, count(*) AS entries, CAST(sum(length(summary)) AS BIGINT) AS total_len, CAST(sum(length(summary)) // count(*) AS BIGINT) AS avg_len, count(DISTINCT source_file) AS files, count(*) FILTER (length(summary) < 80) AS weak FROM en GROUP BY 1")
def agg_kb_gap(spark, d):
    return m.gaps(v.entries(spark, d))


@query("agg_category_counts", f"WITH {v.ENTRIES} SELECT coalesce(chunk_category, '*') AS category, coalesce(search_value, '*') AS value, count(*) AS n FROM en GROUP BY GROUPING SETS ((chunk_category), (search_value), ())")
def agg_category_counts(spark, d):
    c, y = F.col("chunk_category"), F.col("search_value")
    grouped = v.entries(spark, d).groupingSets([[c], [y], []], c, y).agg(F.count("*").alias("n"))
    return grouped.select(F.coalesce(c, F.lit("*")).alias("category"), F.coalesce(y, F.lit("*")).alias("value"), "n")


_WORK = f"""{t.CHUNKS}, w AS (SELECT 'f' || (doc_id % 20) AS path, doc_id AS chunk_index, chunk, doc_id % 3 AS known, CASE WHEN doc_id % 9 IN (0, 3) AND NOT {t._KEY} THEN w ELSE {t._OWNER} END AS class FROM ck), todo AS (SELECT * FROM w WHERE known <> 1),
    u AS (SELECT *, row_number() OVER (PARTITION BY trim(chunk) ORDER BY path, chunk_index) AS i FROM todo)"""


@query("grp_work_items", f"""WITH {_WORK} SELECT path, chunk_index, concat_ws(chr(10), CASE WHEN path <> 'f3' THEN 'file ' || path END, CASE WHEN class IN ('Foo', 'B') THEN 'Class ' || class || ': ' || CASE WHEN class = 'Foo' AND path = 'f2' THEN 'own' ELSE 'about ' || class END END, CASE WHEN chunk_index % 2 = 0 THEN 'c' || chunk_index END) AS context FROM u WHERE i = 1""")
def grp_work_items(spark, d):
    """New and changed chunks, once each, with the context that a model gets."""
    i = F.col("doc_id")
    path = F.concat(F.lit("f"), (i % 20).cast("string"))
    every = t.chunks(spark, d).select(path.alias("path"), i.alias("chunk_index"), "chunk")
    done = every.filter("chunk_index % 3 > 0").select("path", "chunk_index", F.when(F.col("chunk_index") % 3 == 1, build.chunk_hash(F.col("chunk"))).otherwise(F.lit("stale")).alias("hash"))
    files = every.select("path").distinct().filter("path <> 'f3'").select("path", F.concat(F.lit("file "), "path").alias("summary"))
    classes = spark.createDataFrame([("h", "Foo", "about Foo"), ("f2", "Foo", "own"), ("h", "B", "about B")], "path string, class string, summary string")
    own = every.filter("chunk_index % 2 = 0").select("path", "chunk_index", F.concat(F.lit("c"), F.col("chunk_index").cast("string")).alias("context"))
    return build.work_items(every, done, files, classes, own).select("path", "chunk_index", "context")


@query("grp_overview_rows", f"WITH {v.ENTRIES} SELECT source_file, -1 AS chunk_index, 'file_overview' AS chunk_type, min(module) AS module FROM en GROUP BY 1 UNION ALL SELECT source_file, -2, 'class_overview', min(module) FROM en WHERE chunk_type = 'class_overview' GROUP BY 1")
def grp_overview_rows(spark, d):
    e = v.entries(spark, d)
    row = lambda x, i, k: x.groupBy("source_file").agg(F.lit(i).alias("chunk_index"), F.lit(k).alias("chunk_type"), F.min("module").alias("module")).select("source_file", "chunk_index", "chunk_type", "module")
    return row(e, -1, "file_overview").unionByName(row(e.filter("chunk_type = 'class_overview'"), -2, "class_overview"))


def _grouped(spark, d, *columns):
    """The columns of the windows of functions, made once and kept: path, chunk_index, island, chunk, name."""
    at = f"{folder(spark)}/windows"
    made = seq.function_groups(v.functions(spark, d), x.function_name(F.col("text")), ["path"], "chunk_index", named="name").withColumnRenamed("text", "chunk").select(*columns)
    made.write.parquet(at)
    return spark.read.schema(made.schema).parquet(at)


@query("grp_function_cards", f"""WITH {v.FUNCTIONS}, k AS (SELECT path, island, coalesce(first(name ORDER BY chunk_index), 'unknown') AS name, string_agg(text, chr(10) ORDER BY chunk_index) AS code, list('Chunk ' || chunk_index || ': s' ORDER BY chunk_index) FILTER (chunk_index % 4 < 3) AS summaries, count(*) AS n FROM fng GROUP BY 1, 2)
    SELECT path, island, CASE WHEN name IS NULL THEN 'unknown' ELSE name END AS name, -3 AS chunk_index, summaries, CASE WHEN length(code) > 6000 THEN substr(code, 1, 3000) || chr(10) || chr(10) || '... [truncated] ...' || chr(10) || chr(10) || right(code, 2000) ELSE code END AS code FROM k WHERE n > 1 AND summaries IS NOT NULL""")
def grp_function_cards(spark, d):
    """A card for each function of several windows, of which a quarter has no summary."""
    chunks = _grouped(spark, d, "path", "chunk_index", "island", "chunk")
    said = chunks.filter("chunk_index % 4 < 3").select("path", "chunk_index", F.lit("s").alias("summary"))
    return build.function_cards(chunks, said)


@query("grp_func_prepass", f"""WITH {v.FUNCTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY path, island ORDER BY chunk_index) AS i, first_value(coalesce(name, 'unknown')) OVER (PARTITION BY path, island ORDER BY chunk_index) AS fn, count(*) OVER (PARTITION BY path, island) AS n FROM fng)
    SELECT path, chunk_index, CASE WHEN island % 3 = 0 THEN CASE WHEN i = 1 THEN '[Function: ' || fn || '] ' ELSE '[Continuation of ' || fn || '()] ' END || 'reads ' || path || chr(10) || 'Parameters: x: input; y: output' || CASE i WHEN 1 THEN chr(10) || 'Focus on: what is checked' WHEN 2 THEN chr(10) || 'Focus on: when it ends; what is left' ELSE '' END
        ELSE '[Continuation of ' || fn || '()]' END AS context FROM r WHERE n > 1 AND (i > 1 OR island % 3 = 0)""")
def grp_func_prepass(spark, d):
    """What the windows of a function should know; a model has spoken of a third of the functions, of another third in no JSON."""
    chunks = _grouped(spark, d, "path", "chunk_index", "island", "name")
    told = F.to_json(F.struct(F.concat(F.lit("reads "), "path").alias("summary"), F.array(F.lit("x: input"), F.lit("y: output")).alias("params"), F.array(F.array(F.lit("what is checked")), F.array(F.lit("when it ends"), F.lit("what is left"))).alias("chunk_questions")))
    answer = F.when(F.col("island") % 3 == 0, F.concat(F.lit("```json\n"), told, F.lit("\n```"))).otherwise("I cannot tell")
    return build.function_contexts(chunks, chunks.filter("island % 3 < 2").select("path", "island", answer.alias("answer")).distinct())


@query("grp_explorer_state", """WITH s AS (SELECT n_regionkey AS k, list('f' || n_nationkey ORDER BY 'f' || n_nationkey) AS files FROM nation WHERE n_nationkey < 15 GROUP BY 1)
    SELECT 'M' || k AS module, CASE WHEN k % 2 = 0 THEN list_sort(list_distinct(list_concat(files, ['f0', 'x' || k]))) ELSE files END AS files, CASE WHEN k % 2 = 0 THEN least(0.95::DOUBLE, 0.5::DOUBLE + CASE WHEN k = 0 THEN 0.1::DOUBLE ELSE k / 4.0::DOUBLE END) ELSE 0.5::DOUBLE END AS confidence FROM s
    UNION ALL SELECT 'N' || r_regionkey, ['a', 'b'], 0.2::DOUBLE FROM region UNION ALL SELECT DISTINCT 'Where is ' || n_name || '?', NULL::VARCHAR[], NULL::DOUBLE FROM nation WHERE NOT EXISTS (SELECT * FROM region WHERE contains(lower(n_name), lower(substr(r_name, 1, 2))))""")
def grp_explorer_state(spark, d):
    """Known modules grow by what an update says, new ones come in with little confidence, unknown ones' updates are dropped; questions stay until one that they contain is resolved."""
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    state = n.filter("n_nationkey < 15").groupBy(name("M", "n_regionkey").alias("module")).agg(F.array_sort(F.collect_list(name("f", "n_nationkey"))).alias("files")).withColumn("confidence", F.lit(0.5))
    new = r.select(name("N", "r_regionkey").alias("module"), F.array(F.lit("b"), F.lit("a")).alias("files")).union(state.select("module", F.array(F.lit("not there")).alias("files")))
    k = F.col("r_regionkey")
    known = r.filter(k % 2 == 0).select(name("M", "r_regionkey").alias("module"), F.array(F.lit("f0"), name("x", "r_regionkey")).alias("additional_files"), F.when(k > 0, k / 4.0).alias("confidence_delta"))
    unknown = r.select(name("U", "r_regionkey").alias("module"), F.array(F.lit("f0")).alias("additional_files"), F.lit(0.1).alias("confidence_delta"))
    asked = n.select("n_nationkey", F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"))
    left = explore.apply_questions(asked.filter("n_nationkey < 20"), asked.filter("n_nationkey > 5"), r.select(F.substring("r_name", 1, 2).alias("question")))
    return explore.apply_updates(state, new, known.union(unknown)).unionByName(left.withColumnRenamed("question", "module"), allowMissingColumns=True)


@query("grp_review_queue", """WITH s AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'indexed' WHEN 2 THEN 'index_error' ELSE 'rejected' END AS status FROM conversations), j AS (SELECT *, CASE WHEN status <> 'pending' THEN NULL WHEN conv_id % 5 = 0 THEN 'reject' WHEN conv_id % 5 = 1 THEN 'approve' WHEN conv_id % 5 = 2 THEN 'edit' ELSE 'reject' END AS decision FROM s),
    a AS (SELECT *, CASE WHEN decision IS NULL THEN status WHEN decision = 'reject' THEN 'rejected' ELSE decision END AS after FROM j) SELECT CASE WHEN after IN ('pending', 'index_error') THEN 'queue' WHEN after IN ('indexed', 'approve', 'edit') THEN 'log' ELSE 'rejected' END AS route, after AS status, decision, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def grp_review_queue(spark, d):
    """Pending rows are judged, the rest go where their status says; a path that leaves the tree is rejected."""
    from lodestone.plans.catalog_store import staged

    k = F.col("conv_id") % 5
    rows = staged(spark, d).withColumn("summary", F.col("text")).withColumn("source_files", F.array(F.when(k == 0, "../etc/passwd").otherwise("a/b.py")))
    answer = F.when(k == 1, '{"decision": "approve"}').when(k == 2, '{"decision": "EDIT it", "final_summary": "better"}').when(k == 0, '{"decision": "approve"}').otherwise("no JSON")
    return review.route(review.decide(rows, answer)).groupBy("route", "status", "decision").agg(F.count("*").alias("n"))


@query("grp_audit", f"""WITH {v.KB}, q AS (SELECT doc_id AS query_id, embedding AS qe FROM kb WHERE source_type = 'doc' AND doc_id % 50 = 0), s AS (SELECT query_id, doc_id, floor(greatest(0, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5) / 1e6 AS score FROM q, kb WHERE source_type = 'code'),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), p AS (SELECT *, query_id % 100 = 0 AS stale FROM r WHERE rank <= 3 AND score >= 0.05)
    SELECT count(DISTINCT query_id) AS docs, count(*) AS pairs, count(*) FILTER (stale) AS suspects, count(*) FILTER (stale AND doc_id % 3 > 0) AS conflicts FROM p""")
def grp_audit(spark, d):
    """Documents of the stated set (ids divisible by 50) with close code: old ones are shown to a judge, who finds conflicts."""
    from lodestone.functions import answers
    from lodestone.operators import search

    k = v.kb(spark, d)
    docs = k.filter("source_type = 'doc' AND doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    pairs = search.top_k(k.filter("source_type = 'code'"), docs, 3).filter("score >= 0.05").withColumn("stale", F.col("query_id") % 100 == 0)
    said = F.when(F.col("doc_id") % 3 == 0, '{"consistent": true}').when(F.col("doc_id") % 3 == 1, '{"consistent": false, "explanation": "x"}').otherwise("no JSON")
    return review.audit_report(pairs, answers.verdict(said))
