"""Call graphs: how often symbols are called, edges, resolution of names, enrichment of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import class_name, mention_sentence
from lodestone.operators.modules import ancestors

# Names too common to count as calls.
NOISE = (
    "if", "for", "while", "switch", "return", "sizeof", "typeof", "decltype", "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast", "new", "delete", "throw",
    "catch", "try", "get", "set", "put", "add", "end", "begin", "size", "push", "pop", "find", "erase", "clear", "empty", "front", "back", "insert", "remove", "open",
    "close", "read", "write", "lock", "unlock", "printf", "sprintf", "fprintf", "snprintf", "scanf", "sscanf", "malloc", "calloc", "realloc", "free", "memcpy", "memset",
    "memmove", "memcmp", "strlen", "strcmp", "strncmp", "strcpy", "strncpy", "strcat", "assert", "abort", "exit", "make_shared", "make_unique", "make_pair", "make_tuple",
    "move", "forward", "swap", "len", "str", "int", "float", "bool", "list", "dict", "tuple", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "print",
    "type", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "super", "property", "classmethod", "staticmethod", "append", "extend", "update", "items",
    "keys", "values", "join", "split", "strip", "replace", "format", "encode", "decode", "log", "error", "warn", "info", "debug", "then", "finally", "resolve", "reject",
    "splice", "slice", "concat", "forEach", "reduce", "toString", "valueOf", "constructor", "define", "undef", "include", "ifdef", "ifndef", "endif", "elif", "LOG",
    "ASSERT", "CHECK", "DCHECK", "VLOG", "TRACE",
)
#: foo(, Foo::bar(, obj.method(, obj->method(
CALL = r"((?:\w+(?:::|\.|->))?\w+)\s*\("


def caller_frequency(lines: DataFrame, least_files: int = 5, least_length: int = 4) -> DataFrame:
    """(symbol, n_files): in how many distinct files (path) lines call a symbol; short, noisy and all-capital names do not count.

    Each (symbol, file) is reduced to one row before files are counted, so a call
    repeated a million times costs no more than one.
    """
    def named(call):
        name, qualifier = F.regexp_extract(call, r"(\w+)$", 1), F.regexp_extract(call, r"^(\w+)(?:::|\.|->)", 1)
        return F.struct(name.alias("name"), F.when(F.length(qualifier) >= 2, F.concat(qualifier, F.lit("::"), name)).otherwise(name).alias("symbol"))

    # each call is taken apart once, and filtered within its line's array
    found = F.transform(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)), named)
    kept = F.filter(found, lambda c: (F.length(c["name"]) >= least_length) & ~c["name"].isin(*NOISE) & (c["name"] != F.upper(c["name"])))
    # outer: an inferred filter below the generator would match every line twice
    called = lines.select("path", F.explode_outer(F.array_distinct(F.transform(kept, lambda c: c["symbol"]))).alias("symbol")).filter("symbol IS NOT NULL")
    return called.distinct().groupBy("symbol").agg(F.count("*").alias("n_files")).filter(F.col("n_files") >= least_files)


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee, ord): ord is the first place of the call; a caller does not call itself."""
    return calls.filter("caller <> callee").groupBy("caller", "callee").agg(F.min("ord").alias("ord"))


def calls_of(edges: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(caller, callees): what each caller calls, in order; last (caller, chunk), if given with edges that have chunk, keeps only a caller's last chunk."""
    kept = edges if last is None else edges.join(last, ["caller", "chunk"], "left_semi")
    return kept.groupBy("caller").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "callee"))), lambda e: e["callee"]).alias("callees"))


def registry(symbols: DataFrame) -> DataFrame:
    """(symbol, file, module): where each symbol is defined first (by ord)."""
    return symbols.groupBy("symbol").agg(F.min(F.struct("ord", "file", "module")).alias("first")).select("symbol", "first.file", "first.module")


def called_by(edges: DataFrame) -> DataFrame:
    """(callee, n_callers)."""
    return edges.groupBy("callee").agg(F.count("*").alias("n_callers"))


def first_callers(edges: DataFrame, k: int = 5) -> DataFrame:
    """(callee, callers, n_callers): the first k callers by name; later ones are only counted.

    The rank is a window over a callee's distinct callers, which bounds what is
    gathered to k names whatever the number of callers.
    """
    w = Window.partitionBy("callee").orderBy("caller")
    ranked = edges.select("callee", "caller").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k)
    names = ranked.groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))
    return names.join(called_by(edges), "callee")


def called_by_suffix(summaries: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """summaries (symbol, summary) with " Called by: a, b and n more." unless they say so already."""
    j = summaries.join(first_callers(edges, k), summaries["symbol"] == F.col("callee"), "left")
    more = F.when(F.col("n_callers") > k, F.concat(F.lit(" and "), (F.col("n_callers") - k).cast("string"), F.lit(" more"))).otherwise("")
    said = F.contains(F.col("summary"), F.lit("Called by:"))
    new = F.concat(F.rtrim("summary"), F.lit(" Called by: "), F.array_join("callers", ", "), more, F.lit("."))
    return j.withColumn("summary", F.when(F.col("callee").isNotNull() & ~said, new).otherwise(F.col("summary"))).drop("callee", "callers", "n_callers")


def _first_two(symbols: DataFrame, key: str) -> DataFrame:
    """(key, first, second) of symbols (key, ord, file, symbol): the first one, and the first in another file than that."""
    by_file = symbols.groupBy(key, "file").agg(F.min(F.struct("ord", "file", "symbol")).alias("s"))
    ranked = by_file.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("s"))).filter("i <= 2")
    return ranked.groupBy(key).agg(F.min("s").alias("first"), F.max(F.when(F.col("i") == 2, F.col("s"))).alias("second"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (call_id, file, callee) with the known symbol (symbol, file, ord) that they mean.

    Exact names first; else the only one of that base name; else one in another
    file, then the first.  Unknown callees are dropped.  A name's symbols are folded
    to two before the join, so it gives no more rows than there are calls.
    """
    bare = lambda c: F.element_at(F.split(c, "::"), -1)
    known = symbols.select("symbol", "file", "ord", bare(F.col("symbol")).alias("base"))
    exact = _first_two(known.withColumn("callee", F.col("symbol")), "callee").select("callee", F.struct("first", "second").alias("_exact"))
    alike = _first_two(known, "base").select("base", F.struct("first", "second").alias("_alike"))
    j = calls.withColumn("base", bare(F.col("callee"))).join(exact, "callee", "left").join(alike, "base", "left")
    found = F.coalesce("_exact", "_alike")
    meant = F.when((found["first"]["file"] != F.col("file")) | found["second"].isNull(), found["first"]["symbol"]).otherwise(found["second"]["symbol"])
    return j.select("call_id", "callee", meant.alias("symbol")).filter("symbol IS NOT NULL")


def declared_classes(chunks: DataFrame, key: str) -> DataFrame:
    """(key, name, snippet) of chunks (key, chunk) that declare a class: up to 30 lines from the first one that names it with class or struct."""
    lines = F.split("chunk", "\n")
    named = chunks.select(key, "chunk", class_name(F.col("chunk")).alias("name")).filter("name IS NOT NULL")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.col("name")) & (F.contains(x, F.lit("class ")) | F.contains(x, F.lit("struct ")))), True)
    return named.withColumn("at", at.cast("int")).filter("at > 0").select(key, "name", F.array_join(F.slice(lines, F.col("at"), 30), "\n").alias("snippet"))


def header_classes(owners: DataFrame, headers: DataFrame) -> DataFrame:
    """(name, path, snippet): for classes (name) whose methods are seen, the declaration in a header of their name.

    headers (path, content) are tried as Name.h, Name.hpp, name.h, name.hpp,
    class_name.h and class_name.hpp, the first that declares the class wins.
    """
    low = F.lower("name")
    snake = F.lower(F.regexp_replace("name", "(?<!^)(?=[A-Z])", "_"))
    bases = F.transform(F.array(F.col("name"), low, snake), lambda n: F.array(F.concat(n, F.lit(".h")), F.concat(n, F.lit(".hpp"))))
    wanted = owners.select("name").distinct().select("name", F.posexplode(F.array_distinct(F.flatten(bases))).alias("ord", "base"))
    found = wanted.join(headers.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("base")), "base")
    declares = F.rlike("content", F.concat(F.lit(r"(?m)^\s*(?:class|struct)\s+"), F.col("name"), F.lit(r"\b")))
    lines = F.split("content", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.col("name"))), True).cast("int")
    best = found.filter(declares).groupBy("name").agg(F.min(F.struct("ord", "path", F.array_join(F.slice(lines, at, 30), "\n").alias("snippet"))).alias("b"))
    return best.select("name", "b.path", "b.snippet")


def usage_hints(functions: DataFrame, freq: DataFrame, mentions: DataFrame) -> DataFrame:
    """(chunk_id, hints): for each function (chunk_id, ord, fn) that freq (symbol, n_files) knows, by its name or else its last part, how many files call it, and what documents (symbol, snippet) say."""
    bare = F.when(F.contains(F.col("fn"), F.lit("::")), F.element_at(F.split("fn", "::"), -1))
    f = functions.withColumn("bare", bare)
    by = lambda key, n: freq.select(F.col("symbol").alias(key), F.col("n_files").alias(n))
    said = lambda key, n: mentions.select(F.col("symbol").alias(key), F.col("snippet").alias(n))
    j = f.join(by("fn", "n_fn"), "fn", "left").join(by("bare", "n_bare"), "bare", "left").join(said("fn", "said_fn"), "fn", "left").join(said("bare", "said_bare"), "bare", "left")
    n = F.coalesce("n_fn", "n_bare")
    snippet = F.coalesce(F.when(F.col("n_fn").isNull(), F.col("said_bare")), F.col("said_fn"))
    hint = F.concat("fn", F.lit(" is called from "), n.cast("string"), F.lit(" different files"), F.coalesce(F.concat(F.lit(". Documentation says: "), snippet), F.lit("")))
    rows = j.filter(n.isNotNull()).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("ord", hint.alias("hint")))).alias("h"))
    return rows.select("chunk_id", F.transform("h", lambda x: x["hint"]).alias("hints"))


def doc_mentions(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """(symbol, snippet): of a symbol's hits (symbol, rank, source_file, text) the first that contains its last part in any case, with the sentence that does."""
    bare = F.element_at(F.split("symbol", "::"), -1)
    met = symbols.select("symbol").distinct().join(hits, "symbol").filter(F.contains(F.lower("text"), F.lower(bare)))
    snippet = F.concat(F.lit("["), F.coalesce("source_file", F.lit("docs")), F.lit("] "), mention_sentence(F.col("text"), bare))
    return met.groupBy("symbol").agg(F.min(F.struct("rank", snippet.alias("snippet"))).alias("first")).select("symbol", "first.snippet")


#: Letters of a gram by which names meet words.
GRAM = 3


def grams(word: Column, sizes: list[int]) -> Column:
    """array<string>: the distinct substrings of a word of these sizes."""
    of = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def first_mentions(names: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, doc_id) for each of names (name) that some document (doc_id, text) contains in any case, also within words: the first one.

    A name of letters, digits and underscores lies within one such word of a text.  So
    the documents are folded to their words with the first document of each, and names
    meet words, not texts: by the gram of a name that the fewest words have.  A name of
    other characters is looked for by its longest word, then in the texts that have it;
    one without any in no text.
    """
    low = names.select("name", F.lower("name").alias("low")).distinct()
    longest = F.array_max(F.transform(F.regexp_extract_all("low", F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    low = low.withColumn("probe", longest).filter("probe IS NOT NULL")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    vocabulary = words.groupBy("word").agg(F.min("doc_id").alias("doc_id"))

    sizes = sorted(r[0] for r in low.select(F.least(F.length("probe"), F.lit(GRAM))).distinct().collect()) or [GRAM]  # GRAM numbers at most
    met = vocabulary.select("word", "doc_id", F.explode(grams(F.col("word"), sizes)).alias("gram"))
    asked = low.select("name", "low", "probe", F.explode(grams(F.col("probe"), sizes)).alias("gram")).filter(F.length("gram") == F.least(F.length("probe"), F.lit(GRAM)))
    counted = met.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counted, "gram").groupBy("name", "low", "probe").agg(F.min(F.struct("n", "gram")).alias("r")).select("name", "low", "probe", "r.gram")
    found = met.join(rarest, "gram").filter(F.contains("word", "probe")).select("name", "low", "probe", "word", "doc_id")
    plain = found.filter("low = probe").select("name", "doc_id")
    rest = found.filter("low <> probe").select("name", "low", "word").join(words, "word").select("name", "low", "doc_id").distinct()
    rest = rest.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains(F.lower("text"), "low")).select("name", "doc_id")
    return plain.unionByName(rest).groupBy("name").agg(F.min("doc_id").alias("doc_id"))


def normal_path(path: Column) -> Column:
    """A path without empty, "." and ".." parts; what leads above the root is null."""
    none = F.array().cast("array<string>")
    step = lambda a, p: F.when(p.isin("", "."), a).when(p != "..", F.array_append(a, p)).when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))
    return F.aggregate(F.split(path, "/"), none, step, lambda a: F.array_join(a, "/"))


def resolve_references(references: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("", ".h", ".hpp")) -> DataFrame:
    """(path, ref, target): the file or directory that each reference (path, ref) of a file means; without one none.

    Tried in this order: the reference as a path, the reference beside the file with
    each suffix, the first file of its base name with each suffix.  Lookups are by
    equality, each pair of directory and reference once.
    """
    asked = references.select("path", "ref", F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/", 1), F.lit("")), F.lit("")).alias("home"))
    pairs = asked.select("home", "ref").distinct()
    base = F.element_at(F.split("ref", "/"), -1)
    beside = F.concat_ws("/", F.nullif(F.col("home"), F.lit("")), "ref")
    tries = [(normal_path(F.col("ref")), False), *((normal_path(F.concat(beside, F.lit(s))), False) for s in suffixes), *((F.concat(base, F.lit(s)), True) for s in suffixes)]
    each = pairs.select("home", "ref", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("key"), F.lit(by).alias("by_name")) for k, (t, by) in enumerate(tries)])))
    paths = files.select("path").distinct()
    places = paths.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("key")).distinct().select("key", F.col("key").alias("target"))
    names = paths.groupBy(F.element_at(F.split("path", "/"), -1).alias("key")).agg(F.min("path").alias("target"))
    index = places.withColumn("by_name", F.lit(False)).unionByName(names.withColumn("by_name", F.lit(True)))
    best = each.join(index, ["key", "by_name"]).groupBy("home", "ref").agg(F.min(F.struct("k", "target")).alias("b"))
    return asked.join(best, ["home", "ref"]).select("path", "ref", "b.target")


def head_of(content: Column, lines: int = 40) -> Column:
    """The first lines of a file, and how many more it has."""
    split = F.split(F.regexp_replace(content, r"\n$", ""), "\n")
    more = F.when(F.size(split) > lines, F.concat(F.lit("\n... ("), (F.size(split) - lines).cast("string"), F.lit(" more lines)"))).otherwise("")
    return F.concat(F.array_join(F.slice(split, 1, lines), "\n"), more)


def reference_context(chunks: DataFrame, files: DataFrame, most: int = 3, first: int = 6, lines: int = 40) -> DataFrame:
    """(id, context) of chunks (id, path, refs): the heads of the files that a chunk's references mean.

    Of the first references, each once, up to ``most`` whose file (path, content, or
    head where that is known already) says more than 20 characters give its first
    lines, and how many more it has.
    """
    numbered = chunks.select("id", "path", F.posexplode(F.array_distinct(F.slice("refs", 1, first))).alias("i", "ref"))
    meant = resolve_references(numbered.select("path", "ref").distinct(), files)
    head = F.col("head") if "head" in files.columns else head_of(F.col("content"), lines)
    heads = files.select(F.col("path").alias("target"), head.alias("head")).filter(F.length(F.regexp_replace("head", r"(?U)^\s+|\s+$", "")) > 20)
    told = numbered.join(meant, ["path", "ref"]).join(heads.select("target"), "target", "left_semi")
    kept = told.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("i"))).filter(F.col("k") <= most)
    part = F.concat(F.lit("["), "target", F.lit("]\n"), "head")
    return kept.join(heads, "target").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", part.alias("part")))).alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("context"))


#: log2 of the registers of a sketch: its standard error is 1.04 / sqrt(2 ** REGISTERS), 1.6 %.
REGISTERS = 12


def sketch_callers(calls: DataFrame, path: str) -> None:
    """Append one run's sketches to a table: of each symbol of calls (symbol, path) the files that call it, in a few kilobytes whatever their number."""
    calls.groupBy("symbol").agg(F.hll_sketch_agg("path", F.lit(REGISTERS)).alias("files")).write.mode("append").parquet(path)


def estimated_callers(sketches: DataFrame) -> DataFrame:
    """(symbol, n_files): about how many different files of all runs call each symbol; a file of several runs counts once."""
    return sketches.groupBy("symbol").agg(F.hll_sketch_estimate(F.hll_union_agg("files")).alias("n_files"))
