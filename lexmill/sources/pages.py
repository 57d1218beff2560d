"""HTML pages as rows: elements in document order, and tables as cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a paragraph.
PARAGRAPHS = frozenset("p div article section li ul ol h1 h2 h3 h4 h5 h6 blockquote footer header nav aside main body table tr".split())
#: Columns that a cell may span.
MOST_ACROSS = 1000
HIDDEN = frozenset("script style noscript title head".split())
SCHEMA = "seq int, kind string, text string, cells array<array<string>>, merges array<struct<r0:int,c0:int,r1:int,c1:int>>, src string"


def grid(rows: list[list[tuple[str, int, int]]]) -> tuple[list[list[str]], list[tuple[int, int, int, int]]]:
    """Cells with spans to a full matrix, with the merged areas; what a span covers is empty. Rows where no cell begins go.

    A cell spans MOST_ACROSS columns at most, as in browsers, and no more rows than there are.
    """
    owned = [r for r, row in enumerate(rows) if row]
    place = {r: i for i, r in enumerate(owned)}
    texts: dict[tuple[int, int], str] = {}
    covered: set[tuple[int, int]] = set()
    merges, width = [], 0
    for r in owned:
        c = 0
        for text, down, across in rows[r]:
            while (place[r], c) in covered:
                c += 1
            # rows that go do not count among those that a cell spans
            last = max(place[x] for x in owned if r <= x < r + down)
            across = min(across, MOST_ACROSS)
            texts[place[r], c] = text
            covered.update((i, j) for i in range(place[r], last + 1) for j in range(c, c + across))
            if last > place[r] or across > 1:
                merges.append((place[r], c, last, c + across - 1))
            c += across
            width = max(width, c)
    return [[texts.get((i, c), "") for c in range(width)] for i in range(len(owned))], merges


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.text: list[str] = []
        self.hidden = 0
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.spans = (1, 1)
        self.in_cell = False

    def flush(self) -> None:
        said = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text.clear()
        if said:
            self.out.append(("p", said, None, None, None))

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        a = dict(attributes)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            self.close_cell()
            number = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
            self.spans, self.in_cell = (number("rowspan"), number("colspan")), True
        elif tag == "img":
            self.flush()
            self.out.append(("image", None, None, None, a.get("data-src") or a.get("src")))
        elif tag == "br" or tag in PARAGRAPHS and not self.tables:
            self.flush() if not self.tables else self.text.append("\n")

    def close_cell(self) -> None:
        if self.in_cell and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((re.sub(r"\s+", " ", "".join(self.text)).strip(), *self.spans))
            self.text.clear()
            self.in_cell = False

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.tables and tag in ("td", "th", "tr"):
            self.close_cell()
        elif self.tables and tag == "table":
            self.close_cell()
            cells, merges = grid(self.tables.pop())
            if any(v for row in cells for v in row):
                self.out.append(("table", None, cells, merges, None))
        elif tag in PARAGRAPHS and not self.tables:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def read(page: str | None) -> list[tuple]:
    """(seq, kind, text, cells, merges, src) of a page in document order; none for null."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return [(i, *e) for i, e in enumerate(reader.out)]


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    @F.pandas_udf(f"array<struct<{SCHEMA.replace(' int', ':int').replace(' string', ':string').replace('cells ', 'cells:').replace('merges ', 'merges:')}>>")
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("seq", "kind", "text", "cells", "merges", "src")
        for part in parts:
            rows = [[dict(zip(names, e, strict=True)) for e in read(p)] for p in part]
            for es in rows:
                for e in es:
                    e["merges"] = e["merges"] and [dict(zip(("r0", "c0", "r1", "c1"), m, strict=True)) for m in e["merges"]]
            yield pd.Series(rows, dtype=object)

    return pages.select(key, F.explode(parsed(html)).alias("e")).select(key, "e.*")
