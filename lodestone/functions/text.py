"""Column functions on texts, summaries and code: scores, classifications, extraction, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of vague summaries, in the order in which they are looked for, and generic terms.
VAGUE = ("calls an external", "delegates to", "uses a helper", "defined elsewhere", "another component", "not shown here", "presumably", "likely", "unclear", "unknown function", "some kind of", "appears to", "seems to")
GENERIC = ("function", "method", "class", "handles", "processes", "implements", "this code", "this function", "this method")
# What speaks for and against an answer.
SPECIFIC = ("`::", "class ", "function ", "struct ", "#include", "score: 0.", "**File**:", "```")
UNSURE = ("unknown", "no results", "search failed", "not found", "no matches")
# Words that are no function names.
KEYWORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "return", "break", "continue", "try", "catch", "throw", "new", "delete", "class", "struct", "enum", "typedef",
    "namespace", "using", "template", "typename", "const", "static", "virtual", "override", "final", "auto", "register", "volatile", "extern", "inline", "sizeof", "true",
    "false", "null", "nullptr", "this", "self", "import", "from", "with", "as", "in", "is", "not", "and", "or", "var", "let", "elif", "except", "finally", "raise",
    "yield", "lambda", "pass", "assert", "global", "nonlocal", "del",
)
# Signatures of classes and of functions by language, in the order in which they are tried.
CLASS_SIGNATURES = (
    r"(?m)^\s*(?:class|struct)\s+(\w+)\s*(?:final\s*)?(?::\s*(?:public|protected|private)\s+[\w:]+\s*(?:,\s*(?:public|protected|private)\s+[\w:]+\s*)*)?\s*\{",
    r"(?m)^\s*class\s+(\w+)\s*(?:\([^)]*\))?\s*:",
    r"(?m)^\s*(?:public|private|protected)?\s*(?:abstract|final|static)?\s*class\s+(\w+)",
    r"(?m)^\s*(?:pub\s+)?(?:struct|impl|trait|enum)\s+(\w+)",
    r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
)
FUNCTION_SIGNATURES = (
    r"(?m)^\s*(?:[\w:*&<>,\s]+?)\s+(\w[\w:]*)\s*\([^)]*\)\s*(?:const)?\s*\{?\s*$",
    r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    r"(?m)^\s*(?:pub(?:lic)?\s+)?(?:static\s+)?(?:func|fn)\s+(\w+)\s*[(<]",
    r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    r"(?m)^\s*(?:public|private|protected)\s+[\w<>\[\],\s]+\s+(\w+)\s*\(",
)
# Verbs by which a summary tells what is called, without the optional ends of the patterns, which match nothing that is kept.
CALL_PHRASES = (
    r"(?i)(?:calls?|invokes?|delegates?\s+to|forwards?\s+to)\s+`?(\w[\w:]*)",
    r"(?i)(?:via|through)\s+`?(\w[\w:]*)",
    r"(?i)(?:uses)\s+`?(\w[\w:]*)\s*\(\)",
)
# Qualified and plain calls in code; the owner in a qualified one; includes, imports and namespaces.
QUALIFIED_CALL, PLAIN_CALL, OWNER = r"(?<![.\w])(\w[\w:]*(?:::\w+)+)\s*\(", r"(?<![.\w:])([a-zA-Z_]\w{2,})\s*\(", r"(\w+)::\w+\s*\("
INCLUDE, IMPORT, NAMESPACE = r'#include\s*[<"]([^>"]+)[>"]', r"(?:from|import)\s+([\w.]+)", r"(\w+)::\w+"
# Definitions on one line: a method with its class, a free function, def, function; words that no free function is named.
METHOD_LINE, FREE_LINE = r"^(?:\w[\w:<>*&\s]*?\s+)?(\w+)::(\w+)\s*\(", r"^(?:\w[\w:<>*&\s]*?\s+)(\w{4,})\s*\([^)]*\)\s*(?:\{|const|override|=)"
DEF_LINE, FUNCTION_LINE = r"^def\s+(\w{4,})\s*\(", r"^(?:export\s+)?(?:async\s+)?function\s+(\w{4,})\s*\("
NO_FREE = ("if", "for", "while", "switch", "return", "class", "struct")
# Source files in a diff, by suffix or name.
SOURCE_SUFFIXES = (
    ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".c++", ".h++", ".java", ".scala", ".kt", ".kts", ".py", ".pyx", ".pxd", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".rb", ".php", ".swift", ".m", ".mm",
    ".cs", ".vb", ".fs", ".fsx", ".sh", ".bash", ".zsh", ".fish", ".sql", ".pl", ".pm", ".r", ".R", ".ml", ".mli", ".hs", ".lhs", ".elm", ".ex", ".exs", ".mk", "Makefile", ".cmake", "CMakeLists.txt",
)


def count_of(text: Column, part: str) -> Column:
    """How often part occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def n_contained(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in parts])


def vague_marker(summary: Column) -> Column:
    """The first marker of vagueness in a summary, null if there is none."""
    low = F.lower(summary)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in VAGUE])


def review_score(summary: Column) -> Column:
    """0 to 1: how much a summary needs a review, by its length, vagueness and generic terms."""
    low, n = F.lower(summary), F.length(summary)
    short = F.when(n < 100, F.lit(0.4)).when(n < 200, F.lit(0.2)).otherwise(F.lit(0.0))
    vague = F.least(F.lit(0.4), n_contained(low, VAGUE) * F.lit(0.15))
    generic = F.least(F.lit(0.2), n_contained(low, GENERIC) * F.lit(0.05))
    return F.least(F.lit(1.0), short + vague + generic)


def round3(x: Column) -> Column:
    """Three decimals, halves up: the same in every engine."""
    return F.floor(x * 1000 + 0.5).cast("double") / 1000


def answer_quality(answer: Column) -> Column:
    """0 to 1 by length, specific names and results, less vagueness; 0 without an answer."""
    specific = reduce(lambda a, b: a + b, [count_of(answer, s) for s in SPECIFIC])
    unsure = n_contained(F.lower(answer), UNSURE)
    raw = F.least(F.lit(1.0), F.length(answer) / 2000) * 0.2 + F.least(F.lit(1.0), specific / 10) * 0.4 + F.least(F.lit(1.0), count_of(answer, "## Result") / 3) * 0.4 - F.least(F.lit(0.5), unsure * 0.2)
    none = answer.isNull() | (answer == "") | answer.startswith("No results found")
    return F.when(none, F.lit(0.0)).otherwise(round3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))


def retrieval_score(retrieved: Column, expected: Column) -> Column:
    """struct<precision, recall, f1, exact, fuzzy>: base names match; distinct hits over raw counts; null without expectations."""
    base = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda p: F.element_at(F.split(p, "/"), -1)), lambda b: b != ""))
    fuzzy = F.size(F.array_intersect(base(retrieved), base(expected)))
    p, r = F.coalesce(F.try_divide(fuzzy, F.size(retrieved)), F.lit(0.0)), F.try_divide(fuzzy, F.size(expected))
    f1 = F.when(p + r > 0, round3(2 * p * r / (p + r))).otherwise(F.lit(0.0))
    made = F.struct(round3(p).alias("precision"), round3(r).alias("recall"), f1.alias("f1"), F.size(F.array_intersect(retrieved, expected)).alias("exact"), fuzzy.alias("fuzzy"))
    return F.when(F.size(expected) > 0, made)


def prefix_summary(summary: Column, symbol: Column) -> Column:
    """"symbol — summary" unless the symbol is among the first 80 characters."""
    named = symbol.isNull() | (symbol == "") | (F.instr(F.substring(summary, 1, 80), symbol) > 0)
    return F.when(named, summary).otherwise(F.concat(symbol, F.lit(" — "), summary))


def _head(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def _first_named(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern's name that is no keyword."""
    names = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*[F.when((n != "") & ~F.lower(F.element_at(F.split(n, "::"), -1)).isin(*KEYWORDS), n) for n in names])


def class_name(chunk: Column) -> Column:
    """The class that the first ten lines declare; keywords are no names."""
    return _first_named(_head(chunk, 10), CLASS_SIGNATURES)


def function_name(chunk: Column) -> Column:
    """The function that the first five lines declare; keywords are no names."""
    head = _head(chunk, 5)
    # every signature has one of the two; the patterns walk back and forth over lines without
    return F.when(F.contains(head, F.lit("(")) | F.contains(head, F.lit("<")), _first_named(head, FUNCTION_SIGNATURES))


def class_owner(chunk: Column) -> Column:
    """The most frequent qualifier of a chunk's qualified calls and definitions, the first of equal ones; null without any."""
    names = F.filter(F.regexp_extract_all(chunk, F.lit(OWNER), F.lit(1)), lambda n: ~F.lower(n).isin(*KEYWORDS))
    counted = F.transform(F.array_distinct(names), lambda d: F.struct(F.size(F.filter(names, lambda n: n == d)).alias("n"), (-F.array_position(names, d)).alias("place"), d.alias("name")))
    return F.array_max(counted)["name"]


def classify_chunk(chunk: Column) -> Column:
    """struct<kind, symbol>: a class definition, a method, a function or file-level code."""
    cls, fn, owner = class_name(chunk), function_name(chunk), class_owner(chunk)
    kind = F.when(cls.isNotNull(), "class_definition").when(F.contains(fn, F.lit("::")), "method_implementation").when(fn.isNotNull(), "function_implementation").when(owner.isNotNull(), "method_implementation").otherwise("file_level_code")
    return F.struct(kind.alias("kind"), F.coalesce(cls, fn, owner).alias("symbol"))


def chunk_functions(chunk: Column) -> Column:
    """array<string>: the functions that a chunk's lines define, a line one at most, in order and with repeats."""

    def named(line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        one = lambda p, k=1: F.nullif(F.regexp_extract(bare, p, k), F.lit(""))
        free = one(FREE_LINE)
        return F.coalesce(F.concat(one(METHOD_LINE), F.lit("::"), one(METHOD_LINE, 2)), F.when(~free.isin(*NO_FREE), free), one(DEF_LINE), one(FUNCTION_LINE))

    return F.filter(F.transform(F.split(chunk, "\n"), named), lambda n: n.isNotNull())


def calls_from_summary(summary: Column) -> Column:
    """array<string>: what a summary says is called, distinct, in order of the phrases."""
    found = F.concat(*[F.regexp_extract_all(summary, F.lit(p), F.lit(1)) for p in CALL_PHRASES])
    bare = lambda n: F.element_at(F.split(n, "::"), -1)
    return F.array_distinct(F.filter(found, lambda n: (F.length(bare(n)) >= 2) & ~F.lower(bare(n)).isin(*KEYWORDS)))


def calls_from_code(code: Column) -> Column:
    """array<string>: qualified calls, then plain ones; no keywords, no capitalised names, no macros."""
    bare = lambda n: F.element_at(F.split(n, "::"), -1)
    qualified = F.filter(F.regexp_extract_all(code, F.lit(QUALIFIED_CALL), F.lit(1)), lambda n: ~F.lower(bare(n)).isin(*KEYWORDS) & (F.length(bare(n)) >= 2))
    plain = F.filter(F.regexp_extract_all(code, F.lit(PLAIN_CALL), F.lit(1)), lambda n: ~F.lower(n).isin(*KEYWORDS) & ~n.rlike("^[A-Z]") & (n != F.upper(n)))
    return F.array_distinct(F.concat(qualified, plain))


def cross_references(code: Column) -> Column:
    """array<string>: includes, imports (dots as slashes), namespaces, in this order and with repeats."""
    imports = F.transform(F.regexp_extract_all(code, F.lit(IMPORT), F.lit(1)), lambda x: F.replace(x, F.lit("."), F.lit("/")))
    return F.concat(F.regexp_extract_all(code, F.lit(INCLUDE), F.lit(1)), imports, F.regexp_extract_all(code, F.lit(NAMESPACE), F.lit(1)))


def mention_sentence(text: Column, name: Column) -> Column:
    """The first sentence with the name in any case (200 characters at most), else the text's first 150."""
    hit = F.trim(F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.instr(F.lower(s), F.lower(name)) > 0), F.lit(0)))
    cut = lambda t, n: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
    return F.coalesce(cut(hit, 200), cut(text, 150))


def diff_source(diff: Column, max_chars: int = 6000) -> Column:
    """The sections of a diff whose header (two spaces and a path) names a source file, cut with a mark."""
    ends = "|".join(x.replace(".", r"\.").replace("+", r"\+") for x in SOURCE_SUFFIXES)
    header = lambda line: line.rlike(r"^  (?! )")
    state = lambda on, kept: F.struct(on.alias("on"), kept.alias("kept"))

    def step(s: Column, line: Column) -> Column:
        on = F.when(header(line), F.rtrim(line).rlike(f"(?:{ends})$")).otherwise(s["on"])
        return state(on, F.when(on, F.array_append(s["kept"], line)).otherwise(s["kept"]))

    kept = F.aggregate(F.split(diff, "\n"), state(F.lit(False), F.array().cast("array<string>")), step, lambda s: F.array_join(s["kept"], "\n"))
    return F.when(F.length(kept) > max_chars, F.concat(F.substring(kept, 1, max_chars), F.lit("\n  ... (diff truncated)"))).otherwise(kept)


def struct_features(code: Column) -> Column:
    """struct of line counts: branches, loops, tries, returns; and a preview of the first two lines."""
    lines = F.split(code, "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return F.struct(n(r"\b(if|else|switch|case)\b").alias("branches"), n(r"\b(for|while)\b").alias("loops"), n(r"\b(try|catch|except)\b").alias("tries"), n(r"\breturn\b").alias("returns"), F.substring(F.array_join(F.slice(lines, 1, 2), " "), 1, 120).alias("preview"))


def strip_html(html: Column) -> Column:
    """Tags to spaces, four entities decoded, three or more white-space characters to a blank line."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s{3,}", "\n\n"))


def sections(markdown: Column) -> Column:
    """array<struct<heading, level, content>>: cut before headings; text before the first one has level 0."""
    body = F.regexp_replace(markdown, r"(?s)\A---\n.*?\n---\n", "")
    parts = F.split(body, r"(?m)\n(?=#{1,6}\s)")
    head = lambda p: F.regexp_extract(p, r"^(#{1,6})\s+([^\n]*)", 2)
    made = F.transform(parts, lambda p: F.struct(head(p).alias("heading"), F.length(F.regexp_extract(p, r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_replace(p, r"^#{1,6}\s+[^\n]*\n?", "")).alias("content")))
    return F.filter(made, lambda s: (s["heading"] != "") | (s["content"] != ""))


def ticket_context(key: Column, title: Column, description: Column, resolution: Column, comments: Column, max_chars: int = 3000) -> Column:
    """A ticket in brief: description to 500, the last 5 comments to 300 characters each, all to max_chars."""
    recent = F.slice(comments, F.greatest(F.size(comments) - 4, F.lit(1)), F.lit(5))
    lines = F.transform(recent, lambda c: F.concat(F.lit("  ["), F.coalesce(c["author"], F.lit("?")), F.lit("]: "), F.substring(F.coalesce(c["body"], F.lit("")), 1, 300)))
    parts = F.concat(
        F.array(F.concat(F.lit("Ticket: "), key, F.lit(" — "), title)),
        F.when(description != "", F.array(F.concat(F.lit("\nDescription:\n"), F.substring(description, 1, 500)))).otherwise(F.array().cast("array<string>")),
        F.when(resolution != "", F.array(F.concat(F.lit("\nResolution: "), resolution))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(comments) > 0, F.concat(F.array(F.lit("\nRecent comments:")), lines)).otherwise(F.array().cast("array<string>")),
    )
    return F.substring(F.array_join(parts, "\n"), 1, max_chars)


def strip_fence(text: Column) -> Column:
    """Model output without a surrounding code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def error_class(message: Column) -> Column:
    """quota, rate_limit, overflow or other."""
    low = F.lower(message)
    return F.when(low.rlike("insufficient_quota|quota exceeded|billing"), "quota").when(low.rlike(r"rate.?limit|429|too many requests"), "rate_limit").when(low.rlike("context.length|maximum context|too many tokens"), "overflow").otherwise("other")
