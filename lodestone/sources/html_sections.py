"""Sections of HTML pages by the standard library's parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Sections(HTMLParser):
    """Headings start sections; script, style and noscript hold no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = [["", 0, []]]
        self.skip, self.heading = 0, False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.found.append(["", int(tag[1]), []])
            self.heading = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = False

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            if self.heading:
                self.found[-1][0] = (self.found[-1][0] + " " + data.strip()).strip()
            else:
                self.found[-1][2].append(data.strip())


def sections(html: str | None) -> list[tuple[str, int, str]]:
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    return [(" ".join(h.split()), level, " ".join(text)) for h, level, text in parser.found if h or text]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, *s) for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, s in enumerate(sections(html))]
        ids, order, heading, level, content = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(order, pa.int64()), pa.array(heading, pa.string()), pa.array(level, pa.int64()), pa.array(content, pa.string())], names=["page_id", "section", "heading", "level", "content"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, html) to a row for each section: (page_id, section, heading, level, content)."""
    return pages.mapInArrow(_parse, "page_id long, section long, heading string, level long, content string")
