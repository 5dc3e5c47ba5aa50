"""Paged interfaces as a data source, in batches and as a stream: spark.read.format("paged").

A paged interface gives a page of items for a cursor, and the cursor of the next page.
Where pages are numbered, a batch is split into ranges of pages that tasks fetch side
by side; where a page alone knows the next cursor, one task walks them and hands rows
on as they come, so no page is gathered anywhere.  As a stream the offset is the cursor
of the last page read and how many of its items were: a batch is the pages between two
offsets, as many of a task as in a batch, and a query goes on from the offset that its checkpoint holds.

Options: url (a folder, or an http address), perPartition (pages of a task, 8), from (a
cursor to begin at), state (a file in which a stream notes the last offset it has
finished, so that the next run need not walk there), maxPages (of a streaming batch,
1000; the first batch without a note takes all there is; not to be lowered while a note
is kept, which may be a batch behind).
For http besides: items and next (fields of a response), cursor (the parameter), size
and sizeParameter (items of a page), total (a field that counts the items; it makes
pages numbered, the cursor being the number of items before), parameters (JSON), tokenEnv (an
environment variable with the bearer token).
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ROW = "cursor string, place int, value string"
#: Times that a fetch is tried, and seconds before it is tried again, doubled each time.
TRIES, WAIT = 4, 0.5


class FolderPages:
    """Pages that lie in a folder of any store: page=<number>/, a line of JSON for each item."""

    numbered = True

    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"].rstrip("/")

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.url)

    def count(self) -> int:
        from pyarrow import fs

        store, root = self._store()
        return sum(x.base_name.startswith("page=") for x in store.get_file_info(fs.FileSelector(root)))

    def cursors(self) -> list[str]:
        return [str(k) for k in range(self.count())]

    def fetch(self, cursor: str) -> tuple[list[str], str | None]:
        from pyarrow import fs

        store, root = self._store()
        number = int(cursor or 0)
        lines: list[str] = []
        for x in sorted(store.get_file_info(fs.FileSelector(f"{root}/page={number}", allow_not_found=True)), key=lambda x: x.path):
            if x.is_file and not x.base_name.startswith(("_", ".")):
                with store.open_input_stream(x.path) as stream:
                    lines += stream.read().decode().splitlines()
        more = store.get_file_info(f"{root}/page={number + 1}").type != fs.FileType.NotFound
        return lines, str(number + 1) if more else None


class HttpPages:
    """Pages of an http interface that answers JSON."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.size = int(options.get("size", "100"))
        self.numbered = "total" in options

    def _get(self, cursor: str) -> dict:
        o = self.options
        asked = json.loads(o.get("parameters", "{}")) | {o.get("sizeparameter", "maxResults"): self.size}
        if cursor:
            asked[o.get("cursor", "nextPageToken")] = cursor
        request = urllib.request.Request(f"{o['url']}?{urllib.parse.urlencode(asked)}", headers={"Accept": "application/json"})
        if token := os.environ.get(o.get("tokenenv", ""), ""):
            request.add_header("Authorization", f"Bearer {token}")
        for k in range(TRIES):
            try:
                with urllib.request.urlopen(request, timeout=30) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:  # too many requests and faults of the server may pass
                if k == TRIES - 1 or (e.code != 429 and e.code < 500):
                    raise RuntimeError(f"{e.code} for {request.full_url}: {e.read()[:500].decode(errors='replace')}") from e
            time.sleep(WAIT * 2**k)
        raise AssertionError

    def fetch(self, cursor: str) -> tuple[list[str], str | None]:
        page = self._get(cursor)
        items = [json.dumps(x, ensure_ascii=False) for x in page.get(self.options.get("items", "issues"), [])]
        if self.numbered:
            after = int(cursor or 0) + len(items)
            return items, str(after) if items and after < int(page[self.options["total"]]) else None
        return items, (page.get(self.options.get("next", "nextPageToken")) or None) if items else None  # an empty page ends it

    def cursors(self) -> list[str]:
        return [str(k) for k in range(0, int(self._get("").get(self.options["total"]) or 0), self.size)]


def pages_of(options: dict[str, str]) -> FolderPages | HttpPages:
    return HttpPages(options) if options["url"].startswith(("http://", "https://")) else FolderPages(options)


class Stretch(InputPartition):
    """Cursors to fetch, of each page the items from skip on up to upto; walk: go on to the end from the last one."""

    def __init__(self, cursors: list[str], skip: int = 0, upto: int | None = None, walk: bool = False) -> None:
        super().__init__(cursors)
        self.cursors, self.skip, self.upto, self.walk = cursors, skip, upto, walk


def _items(options: dict[str, str], part: Stretch) -> Iterator[tuple]:
    pages = pages_of(options)
    for k, cursor in enumerate(part.cursors):
        while True:
            items, after = pages.fetch(cursor)
            for place, value in enumerate(items[: part.upto]):
                if place >= part.skip:
                    yield cursor or "0", place, value
            if not part.walk or k < len(part.cursors) - 1 or after is None:
                break
            cursor = after


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Stretch]:
        pages, start = pages_of(self.options), self.options.get("from", "")
        if not pages.numbered:
            return [Stretch([start], walk=True)]
        every = [c for c in pages.cursors() if int(c) >= int(start or 0)]
        n = max(1, int(self.options.get("perpartition", "8")))
        return [Stretch(every[k : k + n]) for k in range(0, len(every), n)] or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return _items(self.options, partition)


class PagedStream(DataSourceStreamReader):
    """A cursor fetched again must give its page again, with more items at most if it was the last one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.seen: dict[str, tuple[int, str]] = {}  # of pages that have a next one: items, next cursor
        noted = self._noted()
        self.last, self.bounded = noted or self.initialOffset(), noted is not None

    def _noted(self) -> dict | None:
        from pyarrow import fs

        if "state" not in self.options:
            return None
        store, path = fs.FileSystem.from_uri(self.options["state"])
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("from", ""), "items": 0}

    def _page(self, cursor: str) -> tuple[int, str | None]:
        if cursor in self.seen:
            return self.seen[cursor]
        items, after = pages_of(self.options).fetch(cursor)
        if after is not None:
            self.seen[cursor] = (len(items), after)
        return len(items), after

    def latestOffset(self) -> dict:
        # Spark does not say where the query stands: without a note the end of all pages is no less
        most = int(self.options.get("maxpages", "1000")) if self.bounded else None
        cursor = self.last["cursor"]
        n, after = self._page(cursor)
        taken = int(n > self.last["items"])
        while after is not None and (most is None or taken < most):
            more, next_ = self._page(after)
            if not more:
                break
            cursor, n, after, taken = after, more, next_, taken + 1
        self.last, self.bounded = {"cursor": cursor, "items": n}, True
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out, whole, cursor, skip = [], [], start["cursor"], start["items"]
        while cursor != end["cursor"]:
            n, after = self._page(cursor)
            if n > skip and skip:
                out.append(Stretch([cursor], skip, n))
            elif n > skip:
                whole.append(cursor)
            if after is None:
                raise RuntimeError(f"no page leads from {start['cursor']!r} to {end['cursor']!r}")
            cursor, skip = after, 0
        # a page that leads to another has all its items
        some = max(1, int(self.options.get("perpartition", "8")))
        out += [Stretch(whole[k : k + some]) for k in range(0, len(whole), some)]
        if end["items"] > skip:
            out.append(Stretch([cursor], skip, end["items"]))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return _items(self.options, partition)

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        if "state" in self.options:
            store, path = fs.FileSystem.from_uri(self.options["state"])
            with store.open_output_stream(f"{path}.new") as stream:
                stream.write(json.dumps(end).encode())
            store.move(f"{path}.new", path)
        self.seen = {c: x for c, x in self.seen.items() if c == end["cursor"]}


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ROW

    def _plain(self) -> dict[str, str]:
        return {k.lower(): x for k, x in self.options.items()}

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self._plain())

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self._plain())


def register(spark: SparkSession) -> None:
    """Make format("paged") known to a session."""
    spark.dataSource.register(PagedSource)
