"""Texts that are put together from columns: results, cards, prompts, headers, diffs, lessons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a search without hits says, and what lies between two hits.
NO_RESULTS, BETWEEN = "No results found in the knowledge base.", "\n\n---\n\n"


def _or(c: Column, missing: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(missing))


def thousandths(x: Column) -> Column:
    """A number of 0 or more with three decimals, halves up."""
    t = F.floor(x * 1000 + 0.5).cast("long")
    return F.concat(F.floor(t / 1000).cast("long").cast("string"), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"))


def result_block(rank: Column, text: Column, score: Column, source_type: Column, source_kind: Column, chunk_type: Column, source_file: Column, module: Column) -> Column:
    """A hit as Markdown: its kind says more than its chunk type; raw code is fenced."""
    kind = F.coalesce(F.nullif(source_kind, F.lit("")), F.nullif(chunk_type, F.lit("")))
    tag = _or(F.concat_ws("/", F.nullif(source_type, F.lit("")), kind), "unknown")
    header = F.concat(F.lit("## Result "), rank.cast("string"), F.lit("  ["), tag, F.lit("]  (score: "), thousandths(score), F.lit(")"))
    where = F.concat(F.lit("**File**: `"), F.coalesce(source_file, F.lit("unknown")), F.lit("`  |  **Module**: `"), F.coalesce(module, F.lit("unknown")), F.lit("`"))
    is_code = F.coalesce(chunk_type == "raw_code", F.lit(False))
    body = F.when(is_code, F.concat(F.lit("**Source code**:\n```\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))).otherwise(F.concat(F.lit("**Summary**:\n"), F.coalesce(text, F.lit(""))))
    return F.concat_ws("\n", header, where, F.lit(""), body)


def results_text(blocks: Column) -> Column:
    """All hits' blocks, in order, as one answer."""
    return F.when(F.size(blocks) > 0, F.array_join(blocks, BETWEEN)).otherwise(NO_RESULTS)


#: A function card, as a model answers it.
CARD = (
    "struct<name: string, purpose: string, contract: struct<params: array<string>, returns: string, preconditions: array<string>, postconditions: array<string>, throws: array<string>, side_effects: array<string>>, "
    "phases: array<struct<name: string, description: string>>, key_decisions: array<string>, complexity: string>"
)


def function_card(card: Column, path: Column, callers: Column, callees: Column) -> Column:
    """A card as text: at most 8 parameters, 6 phases, 5 decisions, callers and callees; what it lacks has no line."""
    # bound by a lambda, so a card that is parsed from JSON is parsed once and not for each field
    return F.get(F.transform(F.array(card), lambda c: _card_text(c, path, callers, callees)), F.lit(0))


def _card_text(card: Column, path: Column, callers: Column, callees: Column) -> Column:
    contract = card["contract"]

    def listed(title: str, xs: Column, sep: str, most: int | None = None) -> Column:
        some = F.slice(xs, 1, most) if most else xs
        return F.when(F.size(xs) > 0, F.concat(F.lit(f"{title}: "), F.array_join(some, sep)))

    phases = F.transform(card["phases"], lambda p: F.concat(F.coalesce(p["name"], F.lit("?")), F.lit(": "), F.coalesce(p["description"], F.lit("?"))))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Function card: "), F.coalesce(card["name"], F.lit("?")), F.lit(" in "), path, F.lit("]")),
        F.concat(F.lit("Purpose: "), F.coalesce(card["purpose"], F.lit("unknown"))),
        listed("Parameters", contract["params"], "; ", 8),
        F.when(contract["returns"] != "", F.concat(F.lit("Returns: "), contract["returns"])),
        listed("Preconditions", contract["preconditions"], "; "),
        listed("Postconditions", contract["postconditions"], "; "),
        listed("Throws", contract["throws"], "; "),
        listed("Side effects", contract["side_effects"], "; "),
        listed("Phases", phases, " → ", 6),
        listed("Key decisions", card["key_decisions"], "; ", 5),
        listed("Called by", callers, ", ", 5),
        listed("Calls", callees, ", ", 5),
        F.concat(F.lit("Complexity: "), F.coalesce(card["complexity"], F.lit("unknown"))),
    )


def head_and_tail(code: Column, longest: int = 6000, head: int = 3000, tail: int = 2000) -> Column:
    """Code that is too long for a card: its beginning, a mark and its end."""
    return F.when(F.length(code) > longest, F.concat(F.substring(code, 1, head), F.lit("\n\n... [truncated] ...\n\n"), F.right(code, F.lit(tail)))).otherwise(code)


def chunk_prompt(project: Column, module: Column, about: Column, questions: Column, path: Column, code: Column, context: Column, hints: Column) -> Column:
    """The prompt for a chunk's summary, in our words.

    Of the context's lines those that begin with "Focus on:" become questions of
    their own at the end; hints say which of the chunk's functions are called often.
    """
    lines = F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: x != "")
    focus = F.transform(F.filter(lines, lambda x: x.startswith("Focus on:")), lambda x: F.concat(F.lit("- "), F.trim(F.substring(x, 10, 1 << 30))))
    rest = F.filter(lines, lambda x: ~x.startswith("Focus on:"))
    bullets = lambda xs: F.array_join(F.transform(xs, lambda q: F.concat(F.lit("- "), q)), "\n")
    section = lambda title, xs, text: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n{title}\n"), text))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Project: "), project),
        F.concat(F.lit("Module: "), module, F.lit(" — "), about),
        section("Questions that the module answers:", questions, bullets(questions)),
        section("Context:", rest, F.array_join(rest, "\n")),
        F.concat(F.lit("\nSource file: "), path, F.lit("\n```\n"), code, F.lit("\n```")),
        section("Called from many files:", hints, bullets(hints)),
        F.lit("\nSummarise what the code does, in the project's words; say its category and how useful it is to search for."),
        section("Also answer:", focus, F.array_join(focus, "\n")),
    )


def usage_hints(functions: Column, counts: Column, mentions: Column) -> Column:
    """array<string>: for each function of a chunk that is called from several files, how many, and what documents say.

    counts: map of symbol to files, mentions: map of symbol to a snippet; a
    qualified name that is not there is looked up by its last part.
    """

    def hint(fn: Column) -> Column:
        bare = F.when(F.contains(fn, F.lit("::")), F.element_at(F.split(fn, "::"), -1))
        n = F.coalesce(F.try_element_at(counts, fn), F.try_element_at(counts, bare))
        said = F.coalesce(F.when(F.try_element_at(counts, fn).isNull(), F.try_element_at(mentions, bare)), F.try_element_at(mentions, fn))
        text = F.concat(fn, F.lit(" is called from "), n.cast("string"), F.lit(" different files"))
        return F.when(said.isNotNull(), F.concat(text, F.lit(". Documentation says: "), said)).otherwise(text)

    return F.filter(F.transform(functions, hint), lambda h: h.isNotNull())


def trim_messages(messages: Column, fraction: float = 0.15) -> Column:
    """array<struct<role, content>> with the longest message of a user or human cut by fraction, and a mark; the first of equally long ones."""
    mine = lambda m: m["role"].isin("user", "human")
    sizes = F.transform(messages, lambda m, i: F.when(mine(m), F.struct(F.length(F.coalesce(m["content"], F.lit(""))).alias("n"), (-i).alias("at"))))
    longest = -F.array_max(sizes)["at"]

    def cut(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        short = F.concat(F.substring(content, F.lit(1), F.floor(F.length(content) * (1 - fraction)).cast("int")), F.lit("\n[...truncated to fit context window...]"))
        return F.struct(m["role"].alias("role"), F.when(i.eqNullSafe(longest), short).otherwise(m["content"]).alias("content"))

    return F.transform(messages, cut)


def lesson_md(key: Column, title: Column, category: Column, resolved: Column, created: Column, lesson: Column) -> Column:
    """A lesson as a Markdown file with front matter; its date is the first ten characters of when the ticket was resolved, else created."""
    day = F.substring(F.coalesce(F.nullif(resolved, F.lit("")), created, F.lit("")), 1, 10)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("ticket: "), key), F.concat(F.lit('title: "'), title, F.lit('"')), F.concat(F.lit("category: "), _or(category, "general")), F.concat(F.lit("date: "), day), F.lit("---"))
    return F.concat(head, F.lit("\n\n# Lesson from "), key, F.lit(": "), title, F.lit("\n\n"), lesson, F.lit("\n"))


def safe_filename(title: Column, page_id: Column) -> Column:
    """<page_id>_<title>.md with nothing but word characters in the title, 60 at most."""
    safe = F.regexp_replace(F.trim(F.regexp_replace(title, r"[^\w\s-]", "")), r"[\s-]+", "_")
    return F.concat(page_id.cast("string"), F.lit("_"), F.substring(safe, 1, 60), F.lit(".md"))


def page_header(site: str, space: Column, page_id: Column, title: Column, version: Column, modified: Column, by: Column, ancestors: Column, labels: Column, now: Column) -> Column:
    """A wiki page's front matter; labels have a line only if there are any."""
    i = page_id.cast("string")
    crumbs = F.array_join(F.concat(ancestors, F.array(title)), " > ")
    field = lambda k, v: F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("")))
    return F.concat_ws(
        "\n", F.lit("---"), field("confluence_id", i), field("confluence_url", F.concat(F.lit(f"{site}/wiki/spaces/"), space, F.lit("/pages/"), i)), field("space", space), field("title", title), field("version", F.coalesce(version.cast("string"), F.lit("?"))),
        field("last_modified", modified), field("last_modified_by", F.coalesce(by, F.lit("unknown"))), field("breadcrumb", crumbs), F.when(F.size(labels) > 0, field("labels", F.array_join(labels, ", "))), field("downloaded_at", now), F.lit("---"),
    )


def request_text(mark: str, number: Column, title: Column, body: Column, files: Column, max_chars: int = 4000, most: int = 20, patch_chars: int = 800) -> Column:
    """A merge request in brief: of its files (array<struct<filename, additions, deletions, patch>>) at most 20 with patches cut, until the first that would pass max_chars."""
    line = lambda f: F.concat(F.lit("  "), F.coalesce(f["filename"], F.lit("?")), F.lit(" (+"), F.coalesce(f["additions"], F.lit(0)).cast("string"), F.lit("/-"), F.coalesce(f["deletions"], F.lit(0)).cast("string"), F.lit(")\n"), F.substring(F.coalesce(f["patch"], F.lit("")), 1, patch_chars))
    state = lambda used, kept, over: F.struct(used.alias("used"), kept.alias("kept"), over.alias("over"))

    def step(s: Column, x: Column) -> Column:
        over = s["over"] | (s["used"] + F.length(x) > max_chars)
        kept = F.when(s["over"], s["kept"]).when(over, F.array_append(s["kept"], F.lit("  ... (diff truncated)"))).otherwise(F.array_append(s["kept"], x))
        return state(s["used"] + F.when(over, 0).otherwise(F.length(x)), kept, over)

    diff = F.aggregate(F.transform(F.slice(files, 1, most), line), state(F.lit(0), F.array().cast("array<string>"), F.lit(False)), step, lambda s: F.array_join(s["kept"], "\n"))
    return F.concat(F.lit(mark), number.cast("string"), F.lit(": "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 300), F.lit("\nChanged files:\n"), diff)
