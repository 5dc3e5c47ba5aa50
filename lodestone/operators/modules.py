"""Module maps: assignment of files to modules, coverage, validation, flags, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """array<string> of the directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def assign_exclusive(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the first module (by ord) that has one of the path's directories.

    Prefixes are matched by exploding a path's ancestors: an equi-join instead of
    a comparison of every file with every directory.
    """
    near = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    j = near.join(modules.select("dir", "module", "ord"), "dir")
    return j.groupBy("path").agg(F.min(F.struct("ord", "module")).alias("m")).select("path", "m.module")


def orphan_prefix(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module, score): the module (dir, module, ord) that is nearest to each path; "other" and 0 where none is near.

    A directory that is the path or one above it scores its characters; any other
    scores the leading components that it has in common with the path.  The highest
    score wins, then the smallest ord.  Both are looked up by equality: the first
    among a path's ancestors, the second in a trie of the directories, a table with a
    row for each directory's ancestors that names the first directories below it,
    of two different children, as one of them may be on the path's own way.
    """
    whole = F.concat(ancestors(F.col("path")), F.array("path"))
    paths = files.select("path").distinct()
    near = paths.select("path", F.posexplode(whole).alias("i", "dir"))
    first = modules.groupBy("dir").agg(F.min(F.struct("ord", "module")).alias("m"))
    above = near.join(first, "dir").select("path", F.length("dir").alias("score"), "m.ord", "m.module")

    steps = modules.select(F.posexplode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("n", "child"), "dir", "ord", "module")
    below = steps.filter("n > 0").select(F.regexp_replace("child", "/[^/]*$", "").alias("node"), "child", "ord", "module")
    least = below.groupBy("node", "child").agg(F.min(F.struct("ord", "module")).alias("m"))
    ranked = least.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("m", "child"))).filter("k <= 2")
    trie = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "child", "m"))).alias("least"))
    way = paths.select("path", whole.alias("way")).select("path", F.posexplode("way").alias("i", "node"), "way")
    other = F.get(F.filter("least", lambda x: ~x["child"].eqNullSafe(F.get("way", F.col("i") + 1))), F.lit(0))
    beside = way.join(trie, "node").select("path", (F.col("i") + 1).alias("score"), other.alias("x")).filter("x IS NOT NULL").select("path", "score", "x.m.ord", "x.m.module")

    best = above.unionByName(beside).groupBy("path").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "module")).alias("b"))
    return paths.join(best, "path", "left").select("path", F.coalesce("b.module", F.lit("other")).alias("module"), F.coalesce("b.score", F.lit(0)).alias("score"))


def coverage(assigned: DataFrame) -> DataFrame:
    """(module, n_files, pct) of all files."""
    n = assigned.groupBy("module").agg(F.count("*").alias("n_files"))
    return n.withColumn("pct", F.col("n_files") * 100.0 / F.sum("n_files").over(Window.partitionBy()))


def tree_counts(files: DataFrame) -> DataFrame:
    """(dir, direct, total, subdirs): files directly in each directory and below it, and its immediate subdirectories; each file counts once an ancestor."""
    above = ancestors(F.col("path"))
    each = files.select(F.element_at(above, -1).alias("parent"), F.posexplode(above).alias("i", "dir"), above.alias("above"))
    child = F.get("above", F.col("i") + 1)
    return each.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("parent")).alias("direct"), F.count("*").alias("total"), F.countDistinct(child).alias("subdirs"))


def tree_view(files: DataFrame, depth: int = 3, expand: tuple[str, ...] = (), small: int = 200) -> DataFrame:
    """(place, line): the tree as text, sorted by place: up to so many files all of them, else directories to a depth, where the rest is counted.

    A directory above or below one of expand is shown two levels deeper.
    """
    n = files.count()
    if n <= small:
        return files.select(F.col("path").alias("place"), F.concat(F.repeat(F.lit("  "), F.size(F.split("path", "/"))), F.element_at(F.split("path", "/"), -1)).alias("line"))
    level, d = F.size(F.split("dir", "/")), F.col("dir")
    deep = F.lit(depth)
    for e in expand:
        deep = F.when(d.startswith(e) | F.startswith(F.lit(e), d), F.lit(depth + 2)).otherwise(deep)
    name = F.concat(F.repeat(F.lit("  "), level), F.element_at(F.split("dir", "/"), -1), F.lit("/"))
    more = F.concat(F.lit("  ("), F.col("total").cast("string"), F.lit(" files"), F.when(F.col("subdirs") > 0, F.concat(F.lit(", "), F.col("subdirs").cast("string"), F.lit(" subdirs"))).otherwise(""), F.lit(")"))
    here = F.when(F.col("direct") > 0, F.concat(F.lit("\n"), F.repeat(F.lit("  "), level), F.lit("  ("), F.col("direct").cast("string"), F.lit(" files here)"))).otherwise("")
    shown = tree_counts(files).withColumn("deep", deep).filter(level <= F.col("deep"))
    return shown.select(F.replace(d, F.lit("/"), F.lit("\x01")).alias("place"), F.when((level >= F.col("deep")) & (F.col("total") > F.col("direct")), F.concat(name, more)).otherwise(F.concat(name, here)).alias("line"))


def flag_large(stats: DataFrame, dirs: int = 3, pct: float = 25.0, files: int = 60) -> DataFrame:
    """stats (module, n_dirs, pct, n_files) with too_large and why; catch-all modules are never flagged."""
    other = F.lower("module").isin("other", "miscellaneous", "misc", "unknown")
    why = F.array_join(F.array_compact(F.array(F.when(F.col("n_dirs") >= dirs, "dirs"), F.when(F.col("pct") > pct, "share"), F.when(F.col("n_files") > files, "files"))), ",")
    return stats.withColumn("why", why).withColumn("too_large", ~other & (F.col("why") != ""))


def validate(claims: DataFrame, total_files: int, top_dirs: int) -> DataFrame:
    """claims (module, top) to (module, n_top, catch_all, too_few).

    catch_all: a module over 40 % of the top directories, if there are more than 4.
    too_few: more than 500 files and fewer modules than half the top directories,
    which asks for 3 at least and 8 at most.
    """
    g = claims.groupBy("module").agg(F.countDistinct("top").alias("n_top"))
    least = max(3, min(top_dirs // 2, 8))
    n = g.agg(F.count("*").alias("modules"))
    return g.crossJoin(F.broadcast(n)).select("module", "n_top", ((F.col("n_top") > top_dirs * 0.4) & F.lit(top_dirs > 4)).alias("catch_all"), ((F.col("modules") < least) & F.lit(total_files > 500)).alias("too_few"))  # one row


def file_samples(files: DataFrame, most: int = 40) -> DataFrame:
    """(module, dir, path): all files (module, dir, path) of a module of at most 40, else a quota of each directory, 3 or 30 shared out, until there are 40."""
    size = files.groupBy("module").agg(F.count("*").alias("n"), F.countDistinct("dir").alias("dirs"))
    quota = F.greatest(F.lit(3), F.floor(F.lit(30) / F.greatest("dirs", F.lit(1))))
    i = F.row_number().over(Window.partitionBy("module", "dir").orderBy("path"))
    some = files.join(size, "module").withColumn("i", i).filter((F.col("n") <= most) | (F.col("i") <= quota))
    place = F.row_number().over(Window.partitionBy("module").orderBy("dir", "i"))
    return some.withColumn("place", place).filter(F.col("place") <= most).select("module", "dir", "path")


def gaps(entries: DataFrame, short: int = 80) -> DataFrame:
    """(module, entries, total_len, avg_len, files, weak): where summaries are thin."""
    n = F.length("summary")
    return entries.groupBy(F.coalesce("module", F.lit("unknown")).alias("module")).agg(
        F.count("*").alias("entries"), F.sum(n).alias("total_len"), F.expr("sum(length(summary)) div count(*)").alias("avg_len"), F.countDistinct("source_file").alias("files"), F.count_if(n < short).alias("weak")
    )
