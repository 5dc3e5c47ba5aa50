"""Main-text extraction by equivalence-class template deduction.

Tokens are the element paths of a page (tag and class names; inline elements do
not count) and its texts, each with the path in which it stands.  All pages of a
host are scanned for how often each token occurs on each; tokens with equal
occurrence vectors form an equivalence class.  Vectors are compared by a 64-bit sum
over (page, count), so they build up by partial aggregation and no host is ever
gathered.  Classes of paths that occur on enough pages and nest in one another make
the host's template; a text with the vector of such a class belongs to it.  What
lies between the template's tokens are the slots: the template path whose slots hold
the changing text is the article, and all that stands below it is its text, whether
other pages say the same or not.

Names (nav, class="comments") only say what within the article is none of it, and
which paths the article is not looked for in; they never count for the article's own
ancestors.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textscan as ts
from lodestone.llm.scratch import Scratch

#: Quotes mean something at the start of a value only; a comment may be <!--> or <!--->, and end with --!>.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]*=)?(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
#: Elements whose content is no text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "title", "head", "select", "option", "button", "annotation", "annotation-xml"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas stand in a line of text.
INLINE |= set("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose mfenced mmultiscripts".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements and words in class, id and role that mark what is no article.
NO_ARTICLE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
NO_ARTICLE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "social share sharing comment comments commentlist reply replies disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead related recommended popup modal overlay "
    "login signup signin search widget pagination pager toolbar skip copyright complementary contentinfo".split()
)
#: Words that may stand beside those in a name of the same meaning: "comment-list" is what "comment" is, "related-work" is not what "related" is.
AFFIXES = set(
    "area bar block bottom box buttons center column container content fixed inner item items left link links list main outer page panel post posts primary reader right secondary section site sticky text top unit user wrap wrapper".split()
)
ARTICLE_WORDS = {"article", "main"}
#: Elements that hold the article whatever their names say.
WHOLE = {"html", "body", "main", "article"}
#: Elements of RAW that end a block; the others stand in a line of text.
RAW_BLOCK = {"head", "title"}
#: Elements deeper than this stand in the path of the last one above.
DEPTH = 256
#: Elements of RAW whose content is markup; where the end tag is missing, a block element ends them.
RAW_MARKUP = {"noscript", "template", "svg", "canvas", "object", "select", "option", "button", "annotation-xml"}
_BREAKOUT = r"</?(?:address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul{more})(?=[\s/>])"


@dataclass
class Block:
    path: str
    text: str
    hidden: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tokens: Counter = field(default_factory=Counter)


def _words(names: str) -> set[str]:
    return set(re.split(r"[^a-z]+", names)) - {""}


def says_no_article(name: str) -> bool:
    """Whether a class, id or role, in lower case with its words apart, is the name of what is no article."""
    words = _words(name)
    return bool(words & NO_ARTICLE_WORDS) and words <= NO_ARTICLE_WORDS | AFFIXES


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """(tag with its class names, followed by .! if a name marks it as no article, whether it is hidden)."""
    marked, classes, hidden = False, "", False
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id", "role"):
            marked = marked or any(says_no_article(re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower()) for n in value.split())
            if key != "id":
                classes += "".join(f".{n}" for n in sorted(re.sub(r"[\d/!.]+", "", value).lower().split()))
        elif key in ("hidden", "aria-hidden") and value in ("true", "hidden"):
            hidden = name not in ("html", "body")
    return name + classes + (".!" if marked and name not in WHOLE else ""), hidden


def _after_raw(source: str, at: int, name: str) -> int:
    """Where the content of a RAW element that begins at ``at`` ends."""
    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
    if name not in RAW_MARKUP:
        return end.end() if end else len(source)
    again = re.compile(rf"<{name}(?=[\s/>])", re.I).search(source, at, end.start() if end else len(source))
    if end and not again:
        return end.end()
    block = re.compile(_BREAKOUT.format(more="|option|optgroup|select|datalist" if name == "option" else ""), re.I).search(source, at, again.end() + 1 if end else len(source))
    # an end tag after another start tag is this element's own only if no block element lies between
    return block.start() if block else end.end() if end else len(source)


def parse(page: str | None) -> Page:
    """Blocks of text in page order with their element paths; a null page has none."""
    out = Page()
    stack: list[tuple[str, str, bool]] = []  # (tag, path, hidden)
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                _, path, hidden = stack[-1] if stack else ("", "", False)
                out.blocks.append(Block(path, words, hidden))

    source, at, skipping = page or "", 0, ""
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "img"):
                text.append(" ")
            continue
        closing = bool(m[1])
        if name in RAW and name not in RAW_BLOCK and closing:
            continue  # an end tag without its start
        if not closing and name in RAW:
            if name in RAW_BLOCK:
                flush()
            if name == "head":
                out.tokens["head"] += 1
                continue
            if not m[3].rstrip().endswith("/"):
                at = _after_raw(source, at, name)
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in VOID:
            continue
        else:
            if name in CLOSED_BY_SAME:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "div", "article", "section", "main", "body"):
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()  # a block element ends an open paragraph
            label, hidden = _label(name, m[3])
            path = label if not stack else f"{stack[-1][1]}/{label}" if len(stack) < DEPTH else stack[-1][1]
            stack.append((name, path, hidden or (bool(stack) and stack[-1][2])))
            out.tokens[path] += 1
            if m[3].rstrip().endswith("/"):
                stack.pop()
    if at < len(source):
        text.append(source[at:])
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def text_key(block: Block) -> int:
    """A 64-bit name, with a sign, of a text in its path."""
    return int(np.array(xxhash.xxh64_intdigest(f"{block.path}\t{block.text}"), np.uint64).view(np.int64))


TOKENS = "host string, kind int, token string, text long, pages long, occurrences long, vector long, chars long"
#: Kinds of rows: a path, a text in a path, the host itself.
PATH, TEXT, HOST = 0, 1, 2


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, html) to partial sums for each host and token of a batch."""
    for batch in batches:
        sums: dict[tuple[str, int, str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])

        def add(key: tuple[str, int, str, int], n: int, own: int, chars: int) -> None:
            s = sums[key]
            s[0] += 1
            s[1] += n
            s[2] += own * (2 * n + 1)
            s[3] += chars

        for page_id, url, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            host, page = host_of(url), parse(source)
            own = xxhash.xxh64_intdigest(str(page_id))
            sums[host, HOST, "", 0][0] += 1
            chars: Counter = Counter()
            texts: Counter = Counter()
            for b in page.blocks:
                chars[b.path] += len(b.text)
                texts[b.path, text_key(b), len(b.text)] += 1
            for path in page.tokens.keys() | chars.keys():
                add((host, PATH, path, 0), page.tokens[path], own, chars[path])
            for (path, key, length), n in texts.items():
                add((host, TEXT, path, key), n, own, n * length)
        keys, rows = list(sums), list(sums.values())
        vector = np.array([v & (2**64 - 1) for _, _, v, _ in rows], np.uint64).view(np.int64)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.int64())]
        columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(vector), pa.array([r[3] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "kind", "token", "text", "pages", "occurrences", "vector", "chars"])


def ancestors(path: Column) -> Column:
    """array of a path's beginnings, itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def template_paths(sums: DataFrame, hosts: DataFrame, support: float) -> DataFrame:
    """(host, path, low, high, n): paths in valid equivalence classes.

    They occur on at least ``support`` of the host's pages, so they are at most
    1 / support times as many as an average page has; and where a class has
    several, each lies above or below another one.
    """
    paths = sums.filter((F.col("kind") == PATH) & (F.col("occurrences") > 0)).join(hosts, "host")
    often = paths.filter(F.col("n") >= F.col("pages") * F.lit(support)).select("host", F.col("token").alias("path"), "low", "high", "n")
    vector = ["host", "low", "high", "n"]
    above = often.select(*vector, F.col("path").alias("below"), F.explode(F.slice(ancestors(F.col("path")), 1, F.size(F.split("path", "/")) - 1)).alias("path")).join(often, [*vector, "path"])
    linked = above.select(*vector, "path").union(above.select(*vector, "below")).distinct()
    alone = often.groupBy(*vector).agg(F.min("path").alias("path"), F.count("*").alias("members")).filter("members = 1").drop("members")
    return linked.unionByName(alone).select("host", "path", "low", "high", "n")


def templates(pages: DataFrame, support: float = 0.5, least_pages: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(host, root, spared, fixed): the template of each host, as far as extraction needs it.

    root: the path of the article, null if the host shows none.  spared: marked
    paths that hold the article all the same.  fixed: names of the template's texts,
    those that have the vector of a valid class; a host of fewer than
    ``least_pages`` pages has none.  All three are bounded by the size of a page.
    Pages without a host in their url make one host; null html is an empty page;
    no pages have no templates.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    rows = pages.select("page_id", "url", "html").mapInArrow(ts.thrifty(occurrences), TOKENS)
    # vectors are sums modulo 2 ** 64, which Spark's checked addition would refuse: add the halves; tokens of one vector come in the same batches, so theirs are equal
    low, high = F.col("vector").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("vector", 32)
    summed = rows.groupBy("host", "kind", "token", "text").agg(F.sum("pages").alias("n"), F.sum("occurrences").alias("occurrences"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("chars").alias("chars"))
    sums = scratch.save(summed, "sums", like=pages)
    hosts = scratch.save(sums.filter(F.col("kind") == HOST).select("host", F.col("n").alias("pages")), "hosts")
    template = scratch.save(template_paths(sums, hosts, support), "template", like=sums)

    vectors = template.select("host", "low", "high", "n").distinct()
    fixed = sums.filter((F.col("kind") == TEXT) & (F.col("n") >= least_pages)).join(vectors, ["host", "low", "high", "n"], "left_semi")
    fixed = scratch.save(fixed.select("host", "token", "text", "chars"), "fixed", like=sums)
    repeated = fixed.groupBy("host", "token").agg(F.sum("chars").alias("repeated"))
    slots = sums.filter((F.col("kind") == PATH) & (F.col("chars") > 0)).join(repeated, ["host", "token"], "left")
    slots = slots.select("host", F.col("token").alias("path"), "chars", (F.col("chars") - F.coalesce("repeated", F.lit(0))).alias("changing"))
    # a slot counts for the deepest template path above it, and is marked by those of its marked beginnings that are template paths
    known = template.select("host", F.col("path").alias("above"), F.lit(True).alias("known"))
    near = slots.select("*", F.posexplode(ancestors(F.col("path"))).alias("depth", "above")).join(known, ["host", "above"], "left")
    is_marked = F.element_at(F.split("above", "/"), -1).rlike(MARKED)
    near = near.groupBy("host", "path", "chars", "changing").agg(
        F.max(F.when(F.col("known"), F.struct("depth", "above"))).alias("deepest"), F.sort_array(F.collect_list(F.when(F.col("known") & is_marked, F.col("above")))).alias("marks"), F.bool_or(F.col("known").isNull() & is_marked).alias("off")
    )
    folded = near.filter("NOT off").groupBy("host", F.coalesce("deepest.above", F.lit("")).alias("path"), "marks").agg(F.sum("chars").alias("chars"), F.sum("changing").alias("changing"))
    every = template.select("host", "path", F.array().cast("array<string>").alias("marks"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("changing"))
    roots = scratch.save(folded.unionByName(every).groupBy("host").applyInArrow(_root_of_host, "host string, root string, spared array<string>"), "roots", like=template)
    texts = fixed.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("fixed"))
    return hosts.select("host").join(roots, "host", "left").join(texts, "host", "left")


#: A label of an element that is no article.
MARKED = r"^(?:" + "|".join(sorted(NO_ARTICLE)) + r")(?:\.|$)|\.!$"
_MARKED = re.compile(MARKED)


def _marks(path: str) -> list[str]:
    """The beginnings of a path that end in a marked element."""
    parts = path.split("/")
    return ["/".join(parts[: k + 1]) for k, label in enumerate(parts) if _MARKED.search(label)]


def _is_article(path: str) -> bool:
    return not ARTICLE_WORDS.isdisjoint(_words(path.rsplit("/", 1)[-1]))


Slot = tuple[str, list[str], int, int]


def spared_paths(slots: list[Slot]) -> set[str]:
    """Paths that are marked as no article, but hold most of the host's changing text.

    slots: (path, marked paths at or above it, characters, changing characters).  A
    host with an article elsewhere spares none: long comments are no article.
    """
    total = sum(c for *_, c in slots)
    weighed = [(p, marks, c) for p, marks, _, c in slots] if total else [(p, marks, n) for p, marks, n, _ in slots]
    total = sum(c for *_, c in weighed)
    named = sum(c for p, marks, c in weighed if not marks and any(_is_article(x) for x in p.split("/")))
    below: Counter = Counter()
    for _, marks, c in weighed:
        for q in marks:
            below[q] += c
    return set() if 10 * named > total else {q for q, c in below.items() if 2 * c > total}


def article_path(slots: list[Slot], spared: set[str]) -> str | None:
    """The template path whose slots are the article.

    Of the template's article and main elements the one with most text; without
    any, the deepest template path below which 70 % of the changing text lies.
    """
    kept = [(p, n, c) for p, marks, n, c in slots if spared.issuperset(marks)]
    if not sum(c for *_, c in kept):  # a host of copies of one page
        kept = [(p, n, n) for p, n, _ in kept]
    known = sorted({p for p, *_ in slots if p and spared.issuperset(_marks(p))})
    below: dict[str, list[int]] = {p: [0, 0] for p in known}
    for p, n, c in kept:
        parts = p.split("/")
        for k in range(len(parts)):
            if (q := "/".join(parts[: k + 1])) in below:
                below[q][0] += n
                below[q][1] += c
    named = [p for p in known if _is_article(p)]
    if named:
        best = max(named, key=lambda p: (below[p][0], -p.count("/")))
        # the article in a main element, if that holds other things too
        inner = [p for p in named if p.startswith(best + "/") and "article" in _words(p.rsplit("/", 1)[-1]) and 2 * below[p][0] >= below[best][0]]
        return min(inner, key=lambda p: (p.count("/"), p), default=best)
    enough = [p for p in known if below[p][1] >= 0.7 * sum(c for *_, c in kept) > 0]
    # a path of a single block kind (its paragraphs) is too deep: the container holds headings too
    enough = [p for p in enough if p.rsplit("/", 1)[-1].split(".")[0] not in CLOSED_BY_SAME | HEADINGS | {"blockquote", "pre"}]
    return max(enough, key=lambda p: (p.count("/"), below[p][1])) if enough else None


def _root_of_host(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A host's folded slots, some for each template path, to its root and spared paths."""
    slots = list(zip(*(rows[c].to_pylist() for c in ("path", "marks", "chars", "changing"))))
    spared = spared_paths(slots)
    root = article_path(slots, spared)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "root": pa.array([root], pa.string()), "spared": pa.array([sorted(spared)], pa.list_(pa.string()))})


def _own_text(block: Block, root: str) -> bool:
    """Whether a block at or below root is article text: none of the elements between is marked.

    The headings in an article element's own header are.
    """
    between = block.path[len(root) :].strip("/").split("/")
    marks = [x for x in between if _MARKED.search(x)]
    heading = _is_article(root) and not HEADINGS.isdisjoint(x.split(".")[0] for x in between)
    return all(heading and x.split(".")[0] == "header" and not x.endswith(".!") for x in marks)


def main_text(source: str | None, root: str | None, spared: frozenset[str] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    """The text of the article: all blocks below root that are not marked within it.

    A page without that path is read by its own article or main element with most
    text, and without any of these by all that is neither marked nor template text.
    """
    page = parse(source)
    shown = [b for b in page.blocks if not b.hidden]

    def under(path: str) -> list[Block]:
        return [b for b in shown if (b.path == path or b.path.startswith(path + "/")) and _own_text(b, path)]

    found = under(root) if root else []
    if not found:
        own = sorted(p for p in page.tokens if _is_article(p) and not any(m != p and not _is_article(m) for m in _marks(p)))
        found = max((under(p) for p in own), key=lambda bs: sum(len(b.text) for b in bs), default=[])
    if not found:
        left = [b for b in shown if spared.issuperset(_marks(b.path))]
        found = [b for b in left if text_key(b) not in fixed] or left
    if not found:  # of a page whose blocks are all marked, names do not tell the article; elements do
        left = [b for b in shown if NO_ARTICLE.isdisjoint(x.split(".")[0] for x in b.path.split("/"))]
        found = [b for b in left if text_key(b) not in fixed] or left
    return "\n\n".join(b.text for b in found)


EXTRACTED = "page_id long, url string, text string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[tuple, tuple[frozenset, frozenset]] = {}
    for batch in batches:
        texts = []
        for host, source, root, spared, fixed in zip(*(batch.column(i) for i in range(2, 7))):
            name = host.as_py()
            if name not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[name] = (frozenset(spared.as_py() or []), frozenset(fixed.as_py() or []))
            texts.append(main_text(source.as_py(), root.as_py(), *sets[name]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html, ...).

    A null or empty page has an empty text.  Pages without a host in their url make
    one host.  A host with few pages has no template texts.  Rows that repeat a
    page_id are pages like others.  Other columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    found = scratch.save(templates(pages, scratch=scratch), "templates", like=pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    # a broadcast only if the table of templates is measured to be small
    return own.join(found, "host", "left").select("page_id", "url", "host", "html", "root", "spared", "fixed").mapInArrow(ts.thrifty(_extract), EXTRACTED)
