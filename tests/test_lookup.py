"""Joins that look up by equality what is told by nearness, containment or a search order: against plain loops."""

import posixpath
import random

from lodestone.operators import graph, modules


def nearest(path, dirs):
    """dirs: (dir, module, ord) in order."""
    best, found = 0, "other"
    for d, module, _ in dirs:
        if path == d or path.startswith(d + "/"):
            score = len(d)
        else:
            score = 0
            for a, b in zip(path.split("/"), d.split("/"), strict=False):
                if a != b:
                    break
                score += 1
        if score > best:
            best, found = score, module
    return path, found, best


def test_orphans_go_to_the_nearest_module(spark):
    pick = random.Random(5)
    make = lambda n: "/".join(pick.choice(["a", "b", "cc", "x.y"]) for _ in range(pick.randint(1, n)))
    for _ in range(4):
        paths = sorted({make(6) for _ in range(60)})
        dirs = [(make(5), f"M{k % 7}", k) for k in range(pick.choice([1, 6, 25]))]
        found = modules.orphan_prefix(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(dirs, "dir string, module string, ord int"))
        assert sorted(tuple(r) for r in found.collect()) == sorted(nearest(p, dirs) for p in paths)
    none = modules.orphan_prefix(spark.createDataFrame([("a/b",)], "path string"), spark.createDataFrame([], "dir string, module string, ord int"))
    assert [tuple(r) for r in none.collect()] == [("a/b", "other", 0)]


def meaning(call, symbols):
    _, file, callee = call
    base = lambda n: n.split("::")[-1]
    fits = [s for s in symbols if s[0] == callee] or [s for s in symbols if base(s[0]) == base(callee)]
    return min(fits, key=lambda s: (s[1] == file, s[2]))[0] if fits else None


def test_calls_mean_one_symbol_each(spark):
    pick = random.Random(2)
    name = lambda: pick.choice(["", "A::", "B::"]) + pick.choice(["run", "get", "put"])
    for n in (0, 3, 30):
        symbols = [(name(), f"f{pick.randint(0, 3)}", k) for k in range(n)]
        calls = [(k, f"f{pick.randint(0, 3)}", name()) for k in range(50)]
        found = graph.resolve_calls(spark.createDataFrame(calls, "call_id int, file string, callee string"), spark.createDataFrame(symbols, "symbol string, file string, ord int"))
        want = [(c[0], c[2], meaning(c, symbols)) for c in calls]
        assert sorted(tuple(r) for r in found.collect()) == sorted(w for w in want if w[2])


def test_mentions_are_found_within_words(spark):
    pick = random.Random(8)
    word = lambda n: "".join(pick.choice("abAB1_") for _ in range(n))
    docs = [(k, pick.choice([" ", ", ", "-"]).join(word(pick.randint(1, 9)) for _ in range(pick.randint(0, 30)))) for k in range(60)] + [(99, None), (100, ""), (101, "operator+ é")]
    names = sorted({word(pick.randint(1, 6)) for _ in range(40)} | {"operator+", "a, b", "é", "zzz", "++", "ab-ab"})
    found = graph.first_mentions(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(4))
    want = {n: min((k for k, t in docs if n.lower() in (t or "").lower()), default=None) for n in names}
    want = {n: k for n, k in want.items() if k is not None and any(c.isascii() and (c.isalnum() or c == "_") for c in n)}
    assert {r["name"]: r["doc_id"] for r in found.collect()} == want and len(want) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def target(path, ref, files):
    dirs = {p for f in files for p in (f[:i] for i, c in enumerate(f) if c == "/")}
    exists = lambda p: p in files or p in dirs
    home = posixpath.dirname(path)
    for at in [ref, *(posixpath.join(home, ref + s) for s in ("", ".h", ".hpp"))]:
        norm = posixpath.normpath(at)
        if not norm.startswith("..") and norm != "." and exists(norm):
            return norm
    for s in ("", ".h", ".hpp"):
        same = sorted(f for f in files if posixpath.basename(f) == posixpath.basename(ref) + s)
        if same:
            return same[0]
    return None


def test_references_mean_files(spark):
    pick = random.Random(6)
    part = lambda: pick.choice(["a", "b", "c"])
    files = sorted({"/".join([*[part() for _ in range(pick.randint(0, 2))], part() + pick.choice(["", ".h", ".hpp", ".py"])]) for _ in range(40)})
    files = [f for f in files if not any(g.startswith(f + "/") for g in files)]
    refs = [(pick.choice(files), r) for r in ("a", "b.h", "a/b", "../a", "../../../a", "./c.hpp", "b/../c", "c/a.h", "zz", "a/b/c.py", "..", "x/b") for _ in range(6)]
    found = graph.resolve_references(spark.createDataFrame(refs, "path string, ref string"), spark.createDataFrame([(f, "") for f in files], "path string, content string"))
    want = sorted({(p, r, t) for p, r in refs if (t := target(p, r, files))})
    assert sorted({tuple(r) for r in found.collect()}) == want and len(want) > 10


def test_context_of_references(spark):
    long = "\n".join(f"line {k}" for k in range(50)) + "\n"
    files = [("a.h", long), ("b.h", "short"), ("c.h", "c" * 30), ("d.h", "d" * 30), ("e.h", "e" * 30), ("dir/f.h", "f" * 30)]
    chunks = [(1, "m.py", ["a", "b", "a", "c", "d", "e"]), (2, "m.py", ["dir", "zz"]), (3, "m.py", ["zz"] * 6 + ["c"]), (4, "m.py", ["1", "2", "3", "4", "5", "6", "c"]), (5, "m.py", []), (6, "m.py", None)]
    found = graph.reference_context(spark.createDataFrame(chunks, "id int, path string, refs array<string>"), spark.createDataFrame(files, "path string, content string"))
    head = "\n".join(f"line {k}" for k in range(40)) + "\n... (10 more lines)"
    assert {r["id"]: r["context"] for r in found.collect()} == {1: f"[a.h]\n{head}\n\n[c.h]\n{'c' * 30}\n\n[d.h]\n{'d' * 30}"}
