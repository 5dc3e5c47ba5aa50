"""Exploration of a source tree: actions on it, and the state that grows with what they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import modules
from lodestone.operators.graph import GRAM, grams
from lodestone.sources import files as source

#: What a module is known by at first, and at most.
FIRST, MOST = 0.2, 0.95


def apply_updates(state: DataFrame, new: DataFrame, updates: DataFrame) -> DataFrame:
    """state (module, files, confidence) after new modules (module, files) and updates (module, additional_files, confidence_delta).

    New modules come in with little confidence unless they are there; a module's
    updates add to its files and its confidence, 0.1 where no delta is given, and
    updates of unknown modules are dropped.
    """
    fresh = new.filter("module <> ''").groupBy("module").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
    fresh = fresh.join(state.select("module"), "module", "left_anti").withColumn("confidence", F.lit(FIRST))
    summed = updates.groupBy("module").agg(F.flatten(F.collect_list("additional_files")).alias("more"), F.sum(F.coalesce("confidence_delta", F.lit(0.1))).alias("delta"))
    both = state.select("module", "files", "confidence").unionByName(fresh).join(summed, "module", "left")
    files = F.array_sort(F.array_union("files", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select("module", files.alias("files"), F.when(F.col("delta").isNull(), F.col("confidence")).otherwise(F.least(F.lit(MOST), F.col("confidence") + F.col("delta"))).alias("confidence"))


def apply_questions(open_questions: DataFrame, new: DataFrame, resolved: DataFrame) -> DataFrame:
    """(question): the open ones and the new ones, once each, without those that contain a resolved one in any case.

    Both meet by a gram of the resolved one, so neither needs to be small.
    """
    every = open_questions.select("question").unionByName(new.select("question")).filter("question <> ''").distinct()
    done = resolved.select(F.lower("question").alias("done")).filter("done <> ''").distinct()
    first = done.select("done", F.substring("done", 1, GRAM).alias("gram"))
    met = every.select("question", F.explode(grams(F.lower("question"), list(range(1, GRAM + 1)))).alias("gram")).join(first, "gram")
    return every.join(met.filter(F.contains(F.lower("question"), F.col("done"))).select("question").distinct(), "question", "left_anti")


class Explorer:
    """Actions by name over a tree (path, content); each returns a DataFrame, and what has been looked at is remembered."""

    ACTIONS = ("list_dir", "read_file", "read_files", "search", "file_stats", "tree", "gap", "define_module", "summarize", "done")

    def __init__(self, files: DataFrame, entries: DataFrame | None = None) -> None:
        self.files, self.entries = files, entries
        self.dirs: set[str] = set()
        self.read: set[str] = set()

    def act(self, action: str, target: str | list[str] = "") -> DataFrame:
        """The observation of an action; an unknown one raises."""
        if action not in self.ACTIONS:
            raise ValueError(f"no action {action!r}: there are {', '.join(self.ACTIONS)}")
        return getattr(self, f"_{action}")(target)

    def _list_dir(self, target: str) -> DataFrame:
        rel = "" if target in ("", ".") else target.strip("/")
        self.dirs.add(rel or ".")
        return source.list_dir(self.files.select("path"), rel)

    def _read_file(self, target: str) -> DataFrame:
        return self._read([target], 200)

    def _read_files(self, target: list[str]) -> DataFrame:
        """At most six files, the first 120 lines of each."""
        return self._read(list(target)[:6], 120)

    def _read(self, paths: list[str], lines: int) -> DataFrame:
        self.read |= set(paths)
        return source.read_files(self.files, self.files.sparkSession.createDataFrame([(p,) for p in paths], "path string"), lines)

    def _search(self, target: str) -> DataFrame:
        return source.grep(self.files, target, 15)

    def _file_stats(self, target: str) -> DataFrame:
        return source.file_stats(self.files.filter(F.col("path") == target))

    def _tree(self, target: str) -> DataFrame:
        """Directories with the files below them, two levels deep."""
        return modules.tree_counts(self.files.select("path")).filter(F.size(F.split("dir", "/")) <= 2).select("dir", "total")

    def _gap(self, target: str) -> DataFrame:
        """Where the knowledge base is thin."""
        return modules.gaps(self.entries)

    def _define_module(self, target: str) -> DataFrame:
        """The files that a new module of that directory would have, and its first confidence."""
        return source.module_files(self.files.select("path"), target).agg(F.lit(target).alias("module"), F.array_sort(F.collect_list("path")).alias("files"), F.lit(FIRST).alias("confidence"))

    def _summarize(self, target: str) -> DataFrame:
        """A file's first 300 lines, to be summarised."""
        return self._read([target], 300)

    def _done(self, target: str) -> DataFrame:
        """What has been looked at."""
        rows = [("dir", d) for d in sorted(self.dirs)] + [("file", f) for f in sorted(self.read)]
        return self.files.sparkSession.createDataFrame(rows, "kind string, path string")


def coverage_gate(dirs: DataFrame, explored: DataFrame, fired: Column, least: int = 30) -> DataFrame:
    """dirs (top, n) with explored and blocks: directories of at least so many files must have been looked at (top); the gate blocks once only, so not when it has fired."""
    seen = explored.select("top").distinct().withColumn("seen", F.lit(True))
    j = dirs.join(seen, "top", "left").withColumn("explored", F.coalesce("seen", F.lit(False)))
    return j.withColumn("blocks", (F.col("n") >= least) & ~F.col("explored") & ~fired).drop("seen")
