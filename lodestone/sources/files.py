"""Scans of source trees and documents, as DataFrames over paths and contents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What scans skip, and languages by suffix.
SKIP_DIRS = (
    "__pycache__", ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", ".env", "build", "dist", ".mypy_cache", ".pytest_cache", ".tox",
    "third_party", "thirdparty", "3rdparty", "vendor", "external", "deps", "cmake-build-debug", "cmake-build-release", "out", ".build", "_build",
)
SKIP_SUFFIXES = (".pyc", ".pyo", ".pyd", ".so", ".dylib", ".dll", ".egg-info", ".dist-info", ".lock")
TEST_DIRS = ("test", "tests", "testing", "test_data", "testdata", "testcases", "test_fixtures", "fixtures")
TEST_PREFIXES = ("j", "k", "g", "c", "u", "e", "i", "p", "n", "js", "cs", "rs", "ts", "go", "cpp", "sys", "api", "gui", "cli", "net", "unit", "perf", "fuzz", "load", "func")
TEST_NAMES = ("test", "testing", "mock", "fake", "stub", "fixture", "harness", "benchmark")
TEST_PHRASES = ("unit test", "integration test", "test suite", "test harness", "test fixture", "mock")
LANGUAGES = {".py": "python", ".cpp": "cpp", ".cc": "cpp", ".h": "cpp", ".hpp": "cpp", ".java": "java", ".go": "go", ".rs": "rust", ".js": "javascript", ".ts": "typescript"}
DOC_SUFFIXES = (".md", ".rst", ".txt", ".html", ".htm", ".pdf")

# Fixed value: directory names of tests: test..., a known prefix with test(s), or mock-like beginnings; "latest" and "contest" are none.
TEST_DIR = r"^(?:tests?|testing)(?:[_\-s]|$|[a-z])|^(?:" + "|".join(sorted(TEST_PREFIXES, key=len, reverse=True)) + r")tests?(?:[_\-]|$)|^(?:mock|fake|stub|fixture|benchmark)"


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[A-Za-z0-9-]+)$", 1)


def language(path: Column) -> Column:
    """The language of a path's suffix, null if unknown."""
    return F.coalesce(*[F.when(suffix(path) == k, F.lit(x)) for k, x in LANGUAGES.items()])


def is_test_path(path: Column) -> Column:
    """Some part of the path is a test directory's name."""
    return F.exists(F.split(path, "/"), lambda p: F.lower(p).isin(*TEST_DIRS) | F.lower(p).rlike(TEST_DIR))


def is_test_module(name: Column, description: Column, dirs: Column) -> Column:
    """By name, by description, or because all directories (and there are some) are for tests."""
    named = F.lower(name).rlike("|".join(TEST_NAMES))
    described = F.lower(description).rlike("|".join(TEST_PHRASES))
    return named | described | ((F.size(dirs) > 0) & F.forall(dirs, is_test_path))


def source_files(paths: DataFrame, lang: str | None = None, include_tests: bool = False) -> DataFrame:
    """The paths that an index takes: no skipped directory or suffix, of the language, and no tests unless asked for."""
    p = F.col("path")
    parts = F.split(p, "/")
    kept = paths.filter(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(*map(F.lit, SKIP_DIRS))) & ~F.coalesce(suffix(p), F.lit("")).isin(*SKIP_SUFFIXES))
    kept = kept.filter(language(p) == lang) if lang else kept.filter(language(p).isNotNull())
    if not include_tests:
        name = F.element_at(parts, -1)
        kept = kept.filter(~is_test_path(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/")) & ~name.rlike(r"^test_|_test\.[a-z]+$"))
    return kept


def detect_language(paths: DataFrame, depth: int = 3) -> DataFrame:
    """One row: the language of most files at most `depth` levels down; ties go to the first name."""
    near = paths.filter(F.size(F.split("path", "/")) <= depth).withColumn("lang", language(F.col("path"))).filter("lang IS NOT NULL")
    return near.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1)


# Manifests at the root and index files, in the order of a bundle; what a bundle skips besides names with a dot.
MANIFESTS = ("package.json", "Cargo.toml", "go.mod", "setup.py", "pyproject.toml", "setup.cfg", "pom.xml", "build.gradle", "CMakeLists.txt", "pubspec.yaml", "composer.json", "Gemfile", "mix.exs", "project.clj")
INDEX_FILES = ("__init__.py", "index.ts", "index.js", "lib.rs", "mod.rs", "lib.py", "main.py", "index.py")
BUNDLE_SKIP = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".env", "target", "build", "dist", ".idea", ".vscode", "vendor", ".cache", "coverage", ".mypy_cache", ".pytest_cache", ".tox", "eggs", ".eggs", "htmlcov", ".hypothesis", "buck-out", "_build",
    ".stack-work",
)


def in_bundle(path: Column) -> Column:
    """No part of the path is skipped or begins with a dot."""
    return ~F.exists(F.split(path, "/"), lambda p: p.isin(*BUNDLE_SKIP) | p.startswith("."))


def tree_lines(paths: DataFrame, max_depth: int = 4) -> DataFrame:
    """(place, line): a directory tree to max_depth levels below the first, directories before files, each in order of lower-case names; sorting by place gives the tree."""
    parts = F.split("path", "/")
    entry = lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("at"), (n < F.size(parts)).alias("is_dir"), (n - 1).alias("depth"))
    every = paths.filter(in_bundle(F.col("path"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth + 2))), entry)).alias("e")).select("e.*").distinct()
    own = F.split("at", "/")
    # a directory sorts before the files beside it: every part but a file's own is marked 0
    place = F.array_join(F.transform(own, lambda p, i: F.concat(F.when(F.col("is_dir") | (i < F.size(own) - 1), "0").otherwise("1"), F.lower(p), F.lit("\x01"), p)), "\x00")
    name = F.concat(F.element_at(own, -1), F.when(F.col("is_dir"), "/").otherwise(""))
    return every.filter(F.col("depth") <= max_depth).select(place.alias("place"), F.concat(F.repeat(F.lit("  "), F.col("depth")), name).alias("line"))


def context_bundle(files: DataFrame) -> DataFrame:
    """(part, rank, path, body) of files (path, content): what to show of a tree: manifests, the 8 shallowest readmes, 20 of each kind of index file.

    Manifests lie at the root, are smaller than 20,000 bytes and give 3,000
    characters; readmes give 2,000, index files of more than 50 give 1,500.
    """
    name, depth = F.element_at(F.split("path", "/"), -1), F.size(F.split("path", "/"))
    kind = F.when((depth == 1) & name.isin(*MANIFESTS) & (F.octet_length("content") < 20_000), F.concat(F.lit("1 manifest "), name)).when(name.startswith("README"), "2 readme").when(name.isin(*INDEX_FILES), F.concat(F.lit("3 index "), name))
    body = F.when(kind.startswith("1"), F.substring("content", 1, 3000)).when(kind.startswith("2"), F.substring("content", 1, 2000)).otherwise(F.trim(F.substring("content", 1, 1500)))
    some = files.filter(in_bundle(F.col("path"))).select("path", kind.alias("part"), body.alias("body"), depth.alias("depth")).filter("part IS NOT NULL")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("depth", "path")).cast("long"))
    most = F.when(F.col("part") == "2 readme", 8).otherwise(20)
    return ranked.filter((F.col("rank") <= most) & (~F.col("part").startswith("3") | (F.length("body") > 50))).select("part", "rank", "path", "body")


def bundle_text(files: DataFrame) -> DataFrame:
    """One row: the tree and the parts of context_bundle() as one text; a prompt, so it is gathered."""
    fence = lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```"))
    tree = tree_lines(files.select("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("t"))
    tree = tree.select(F.lit("0").alias("part"), F.lit(0).cast("long").alias("rank"), F.concat(F.lit("## Directory Tree\n"), fence(F.col("t"))).alias("text"))
    title = F.concat(F.lit("## "), F.col("path"), F.lit("\n"))
    parts = context_bundle(files).select("part", "rank", F.concat(title, F.when(F.col("part") == "2 readme", F.col("body")).otherwise(fence(F.col("body")))).alias("text"))
    order = F.struct(F.col("part"), F.col("rank"), F.col("text"))
    return tree.unionByName(parts).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), "\n\n---\n\n").alias("bundle"))


def normal_path(path: Column) -> Column:
    """A path without ./ before it and / behind it; an empty one is "."."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), r"^\./", ""), "/+$", "")
    return F.when(bare == "", ".").otherwise(bare)


def module_files(paths: DataFrame, directory: str) -> DataFrame:
    """The paths at or below a directory, of "." those at the root only."""
    p, d = F.col("path"), normal_path(F.lit(directory))
    return paths.filter(F.when(d == ".", ~F.contains(p, F.lit("/"))).otherwise(p.startswith(F.concat(d, F.lit("/"))) | (p == d)))


def read_files(files: DataFrame, wanted: DataFrame, max_lines: int = 200) -> DataFrame:
    """(path, window) of wanted (path): the file there, else the first one of that base name, else a note that there is none.

    A path that leaves the tree is blocked.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    one = wanted.select("path").distinct().withColumn("base", base(F.col("path")))
    escapes = F.col("path").startswith("/") | F.aggregate(F.split("path", "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("least")), lambda s: s["least"] < 0)
    exact = files.select("path", F.lit(True).alias("there")).distinct()
    first = files.groupBy(base(F.col("path")).alias("base")).agg(F.min("path").alias("by_name"))
    found = one.join(exact, "path", "left").join(first, "base", "left").select("path", escapes.alias("escapes"), F.when(F.col("there"), F.col("path")).otherwise(F.col("by_name")).alias("read"))
    met = found.join(read_window(files, max_lines).withColumnRenamed("path", "read"), "read", "left")
    blocked, missing = (F.concat(F.lit(a), F.col("path"), F.lit("]")) for a in ("[error: path traversal blocked: ", "[file not found: "))
    return met.select("path", F.when(F.col("escapes"), blocked).otherwise(F.coalesce("window", missing)).alias("window"))


def list_dir(paths: DataFrame, rel: str = "") -> DataFrame:
    """(name, is_dir, n_files) of what lies directly in the directory rel."""
    prefix = f"{rel}/" if rel else ""
    rest = paths.filter(F.col("path").startswith(prefix)).withColumn("rest", F.substring("path", len(prefix) + 1, 1 << 30))
    name = F.substring_index("rest", "/", 1)
    return rest.groupBy(name.alias("name"), F.contains(F.col("rest"), F.lit("/")).alias("is_dir")).agg(F.count("*").alias("n_files"))


def read_window(files: DataFrame, max_lines: int = 200) -> DataFrame:
    """(path, window): the first lines of content, and how many are left."""
    lines = F.split("content", "\n")
    more = F.size(lines) - max_lines
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    return files.select("path", F.when(more > 0, F.concat(head, F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(head).alias("window"))


def file_stats(files: DataFrame) -> DataFrame:
    return files.select("path", F.size(F.split("content", "\n")).cast("long").alias("lines"), F.octet_length("content").cast("long").alias("size_bytes"), suffix(F.col("path")).alias("extension"))


def grep(files: DataFrame, pattern: str, max_results: int = 10, width: int = 200) -> DataFrame:
    """(path, line_no, line) of the first matching lines in path order; a top-k, not a full sort."""
    lines = files.select("path", F.posexplode_outer(F.split("content", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(pattern))
    return lines.select("path", (F.col("line_no") + 1).cast("long").alias("line_no"), F.substring("line", 1, width).alias("line")).orderBy("path", "line_no").limit(max_results)


#: Partitions of files that one task reads.
READ = 32


def read_tree(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """(path, content, modified, size) of all files below root, or below folders of it, read in parallel.

    Names that begin with _ or . are left out, as by all of Spark's readers; files of
    no bytes, which those leave out too, are listed by Arrow where it knows the store.
    """
    at = [root] if folders is None else [f"{root}/{x}" for x in folders]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at) if at else spark.createDataFrame([], FILE)
    # Spark gives a task some 32 small files at most; many of them share one, so that tasks do not cost more than files
    n = raw.rdd.getNumPartitions()
    tasks = max(1, n // READ, min(n, 8 * spark.sparkContext.defaultParallelism))
    raw = raw.unionByName(_empty_files(spark, at)).coalesce(tasks)
    return raw.select("path", F.decode(F.col("content"), "UTF-8").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


FILE = "path string, modificationTime timestamp, length long, content binary"


def _store(root: str):
    """Arrow's file system for a root, and the path there; a local path is taken as it is written, as by Spark."""
    from pyarrow import fs

    local = re.sub("^file:(?://)?(?=/)", "", root)
    return (fs.LocalFileSystem(), re.sub("/+", "/", local)) if local.startswith("/") else fs.FileSystem.from_uri(root)


def _empty_files(spark: SparkSession, at: list[str]) -> DataFrame:
    """The files of no bytes below the folders, as binaryFile would give them; a task lists a folder, a directory at a time."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for root in (x for batch in batches for x in batch.column(0).to_pylist()):
            try:
                where, base = _store(root)
            except (pa.ArrowInvalid, OSError):  # a store that Arrow does not know
                continue
            store, todo = "file:" if isinstance(where, fs.LocalFileSystem) else root.rstrip("/").removesuffix(base.rstrip("/")), [base]
            while todo:
                seen = [x for x in where.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)) if x.base_name[0] not in "_."]
                todo += [x.path for x in seen if x.type == fs.FileType.Directory]
                if found := [x for x in seen if x.is_file and x.size == 0]:
                    columns = [f"{store}{x.path}" for x in found], [x.mtime for x in found], [0] * len(found), [b""] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()))], names=["path", "modificationTime", "length", "content"])

    one_each = spark.sparkContext.parallelize([(x,) for x in at], max(1, len(at)))
    return spark.createDataFrame(one_each, "at string").mapInArrow(look, FILE)


def write_tree(files: DataFrame, root: str) -> list[str]:
    """Write files (path, content) below root by the tasks that hold them; the folders of root in which they are now, each under its path in one of them.

    A task writes into a folder of its own, and only folders of tasks that count are
    returned: what a task that failed or ran twice has left, or still writes, is in none.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _store(root)
        own = uuid.uuid4().hex
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{own}/{path}"
                if (above := target.rsplit("/", 1)[0]) not in made:
                    where.create_dir(above, recursive=True)
                    made.add(above)
                with where.open_output_stream(target) as f:
                    f.write((content or "").encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([own])], names=["folder"])

    return [x.folder for x in files.select("path", "content").mapInArrow(put, "folder string").collect()]


def as_folders(name: Column) -> Column:
    """A name of any characters as folders that every store takes and no scan skips; from_folders() gives it back."""
    return F.concat(F.lit("s-"), F.regexp_replace(F.url_encode(name), "(.{200})(?=.)", "$1/s-"))


def from_folders(folders: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(folders, "^s-", ""), F.lit("/s-"), F.lit("")))


def read_documents(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """The tree's documents: known suffixes, no skipped directories below root."""
    skip = "/(?:" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")/"
    above = re.sub("/+", "/", re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root)).rstrip("/")
    below = F.regexp_replace("path", f"^[^/]*(?://[^/]*)?{re.escape(above)}/", "/")
    return read_tree(spark, root, folders).filter(suffix(F.lower("path")).isin(*DOC_SUFFIXES) & ~below.rlike(skip))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or whole files of an object or an array; what cannot be parsed is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", not lines).option("recursiveFileLookup", True).json(path)
