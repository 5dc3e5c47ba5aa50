"""A keyed table that persists: buckets of Parquet under a log of commits.

Rows lie in buckets by the hash of their key.  A change writes its own rows and
rewrites only the buckets that hold a key of it, next to the old ones (to the others
its rows are added), and then puts down one commit: a small JSON file that says in
which folders each bucket lies now.  Readers take the last
commit, so they see a change whole or not at all, and what a writer that failed has
left behind is never read.  Commits are optimistic: a writer that
finds its number taken goes on from the newer one, and merges anew only if that
touched a bucket of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.store import latest

#: Times that a change is merged anew before it gives up.
RETRIES = 8
#: Folders of a bucket before a change rewrites it as one.
PARTS = 8


class Conflict(RuntimeError):
    """Other writers changed the same buckets each time."""


@dataclass
class Snapshot:
    """What a commit says: the folders of each bucket that has rows; action and touched say what it did."""

    version: int = 0
    schema: dict | None = None
    folders: dict[int, list[str]] = field(default_factory=dict)
    action: str = "create"
    touched: list[int] = field(default_factory=list)


class Ledger:
    """The table at root, a folder that driver and executors share; buckets is fixed when the first commit is written.

    keys name the columns that identify a row, a null being a value like others.  A
    bucket should hold some 256 MB to 1 GB: 64 for a small table, thousands at size.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        path = self._path("log")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self.buckets = self._settle(buckets)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _settle(self, buckets: int) -> int:
        """The number of buckets that the first writer has put down."""
        text = json.dumps({"buckets": buckets, "keys": self.keys})
        if self._create("table.json", text):
            return buckets
        found = json.loads(self._text("table.json"))
        if found["keys"] != self.keys:
            raise ValueError(f"the table at {self.root} has the keys {found['keys']}")
        return found["buckets"]

    def _create(self, name: str, text: str) -> bool:
        """Put down a whole file that must not be there yet; False if it is.  Safe among writers where a rename is atomic."""
        jvm = self.spark.sparkContext._jvm
        draft, path = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, path, how)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _text(self, name: str) -> str:
        path = self._path(name)
        stream = self._fs.open(path)
        try:
            return bytes(stream.readNBytes(self._fs.getFileStatus(path).getLen())).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of commits, ascending."""
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(self._path("log")))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last commit up to version."""
        number = max((n for n in self.versions() if version is None or n <= version), default=0)
        if not number:
            return Snapshot()
        found = json.loads(self._text(f"log/{number:020d}.json"))
        return Snapshot(number, found["schema"], {int(b): [f] if isinstance(f, str) else f for b, f in found["folders"].items()}, found["action"], found["touched"])

    def bucket(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    def _own_bucket(self) -> Column:
        return self.bucket(*[F.col(k) for k in self.keys])

    def read(self, version: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, the last one by default; only: of these buckets."""
        return self._rows(self.snapshot(version), only)

    def _rows(self, at: Snapshot, only: Iterable[int] | None = None) -> DataFrame:
        if at.schema is None:
            raise ValueError(f"nothing was written to {self.root}")
        schema = StructType.fromJson(at.schema)
        folders = [f for b, own in at.folders.items() if only is None or b in only for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows with wanted's keys; only their buckets are read."""
        wanted = wanted.select(*self.keys).distinct()
        only = self._buckets_of(wanted)
        rows = self.read(only=only)
        return rows.join(wanted, self._same(rows, wanted), "left_semi")

    def _same(self, left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys or self.keys])

    def _buckets_of(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._own_bucket()).distinct().collect()}  # at most as many as there are buckets

    def upsert(self, rows: DataFrame, order: str | None = None) -> Snapshot:
        """Put rows in place of those with their keys; of rows with equal keys the last by order stays, or any one."""
        dealt = rows.withColumn("_bucket", self._own_bucket()).repartition("_bucket")  # a bucket is one file, not one of every task
        new = latest(dealt, ["_bucket", *self.keys], order) if order else dealt.dropDuplicates(["_bucket", *self.keys])
        at = f"data/{uuid.uuid4().hex}"  # the batch is written once, however often it is merged
        new.write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
        touched = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(at)) if "=" in s.getPath().getName()}
        batch = self.spark.read.schema(rows.schema).parquet(*[f"{self.root}/{at}/_bucket={b}" for b in touched]) if touched else None

        def change(base: Snapshot, mine: set[int]) -> dict[int, list[str]]:
            own = {b: [f"{at}/_bucket={b}"] for b in mine}
            held = mine & set(base.folders)
            if not held:
                return own
            known = self._rows(base, held).select(*self.keys)
            full = self._buckets_of(known.join(batch, self._same(known, batch), "left_semi"))  # a key is there already
            full |= {b for b in held if len(base.folders[b]) >= PARTS}
            kept = self._write(self._without(self._rows(base, full), batch)) if full else {}
            before = {b: kept.get(b, []) if b in full else base.folders[b] for b in held}
            return {b: before.get(b, []) + f for b, f in own.items()}

        return self._commit("upsert", lambda base: rows.schema if base.schema is None else self._union(base, rows.schema), lambda base: touched, change)

    def _union(self, base: Snapshot, schema: StructType) -> StructType:
        have = StructType.fromJson(base.schema)
        return StructType([*have.fields, *(f for f in schema.fields if f.name not in have.names)])

    def purge(self, gone: DataFrame, by: list[str] | None = None) -> Snapshot:
        """Delete the rows whose columns ``by`` (the keys, by default) are those of a row of gone."""
        by = by or self.keys
        gone = gone.select(*by).distinct()

        def touched(base: Snapshot) -> set[int]:
            if base.schema is None:
                return set()
            rows = self._rows(base, self._buckets_of(gone) if by == self.keys else None)
            return self._buckets_of(rows.join(gone, self._same(rows, gone, by), "left_semi"))

        def change(base: Snapshot, mine: set[int]) -> dict[int, list[str]]:
            if not mine:
                return {}
            rows = self._rows(base, mine)
            if by == self.keys:
                return self._write(self._without(rows, gone.filter(self._own_bucket().isin(*mine))))
            return self._write(rows.join(gone, self._same(rows, gone, by), "left_anti"))

        return self._commit("purge", lambda base: base.schema and StructType.fromJson(base.schema), touched, change)

    def clear(self) -> Snapshot:
        """Delete all rows; former versions stay readable until vacuum()."""
        return self._commit("clear", lambda base: base.schema and StructType.fromJson(base.schema), lambda base: set(base.folders), lambda base, mine: {})

    def _without(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """rows, with their bucket, but for those with gone's keys: both are dealt by bucket, so rows are shuffled once until they are written."""
        marked = rows.withColumn("_gone", F.lit(False)).unionByName(gone.select(*self.keys, F.lit(True).alias("_gone")), allowMissingColumns=True)
        dealt = marked.withColumn("_bucket", self._own_bucket()).repartition("_bucket")
        return dealt.withColumn("_gone", F.max("_gone").over(Window.partitionBy("_bucket", *self.keys))).filter("NOT _gone").drop("_gone")

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        """Write whole buckets; where each lies."""
        at = f"data/{uuid.uuid4().hex}"
        own = rows if "_bucket" in rows.columns else rows.withColumn("_bucket", self._own_bucket()).repartition("_bucket")
        own.write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))]
        return {int(n.split("=")[1]): [f"{at}/{n}"] for n in names if n.startswith("_bucket=")}

    def _commit(self, action: str, schema: Callable, touched: Callable[[Snapshot], set[int]], change: Callable[[Snapshot, set[int]], dict[int, list[str]]]) -> Snapshot:
        """Apply change, which gives the folders of the touched buckets that have rows left, to the last commit."""
        base = self.snapshot()
        for _ in range(RETRIES):
            mine, kind = set(touched(base)), schema(base)
            new = change(base, mine)
            while True:
                folders = {b: f for b, f in base.folders.items() if b not in mine} | new
                version = max(self.versions(), default=0) + 1
                after = self.snapshot()
                if after.version == base.version:
                    made = Snapshot(version, kind.jsonValue() if kind is not None else None, folders, action, sorted(mine))
                    text = {"action": action, "touched": made.touched, "schema": made.schema, "folders": folders}
                    if self._create(f"log/{version:020d}.json", json.dumps(text)):
                        return made
                    after = self.snapshot()
                others = {b for v in self.versions() if base.version < v <= after.version for b in self.snapshot(v).touched}
                same_schema = after.schema == base.schema
                base = after
                if others & mine or not same_schema:
                    break  # merge anew
        raise Conflict(f"{action} on {self.root}: others changed its buckets {RETRIES} times")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` commits names, also those of failed writers; how many.

        Run it while no writer is at work: a batch that is not committed yet is in no commit.
        """
        live: set[str] = set()
        at: int | None = None
        for _ in range(keep):
            found = self.snapshot(at)
            live |= {f for own in found.folders.values() for f in own}
            at = found.version - 1
        n = 0
        data = self._path("data")
        for batch in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{batch.getPath().getName()}"
            parts = [s for s in self._fs.listStatus(batch.getPath()) if s.isDirectory()]
            dead = [s for s in parts if f"{name}/{s.getPath().getName()}" not in live]
            for s in dead:
                self._fs.delete(s.getPath(), True)
            n += len(dead)
            if len(dead) == len(parts):
                self._fs.delete(batch.getPath(), True)
        return n


def create_or_replace(ledger: Ledger, new: DataFrame, errors: DataFrame, existing: Callable[[Column], Column]) -> Snapshot:
    """Put new into the ledger; where creating a row failed with errors (its keys, error), the one that ``existing`` finds in the error goes first, and rows with other errors stay out.

    An error names the first key; the other keys of the row that goes are those of the error's own row.
    """
    key, *rest = ledger.keys
    named = errors.select(*ledger.keys, existing(F.col("error")).alias("_existing"))
    ledger.purge(named.filter("_existing IS NOT NULL").select(F.col("_existing").alias(key), *rest))
    failed = named.filter("_existing IS NULL").select(*ledger.keys)
    return ledger.upsert(new.join(failed, ledger.keys, "left_anti"))
