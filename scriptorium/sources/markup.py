"""Text blocks of HTML and XHTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
BLOCKS = frozenset("p div br li tr blockquote section article h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNREAD = frozenset(("script", "style", "head"))
PAGE = "struct<blocks:array<struct<tag:string,text:string>>,types:array<string>>"


@dataclass
class Page:
    """Blocks (tag, text) of a page in order, and the types that its body or sections declare."""

    blocks: list[tuple[str, str]]
    types: set[str]


class _Events(HTMLParser):
    """Tags and texts of a page in order: (kind, tag, attributes or text)."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, object]] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.found.append(("shut", tag, None))

    def handle_data(self, data):
        self.found.append(("text", "", data))


def leads_inside(attributes: dict) -> bool:
    """Whether a link stays within the book."""
    return bool(attributes.get("href")) and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", attributes["href"])


def text_rows(events: list[tuple]) -> Iterator[tuple[int, str, str, bool]]:
    """(number of the block, its tag, text, inside a link) of each text that is read; a block's tag, opened or shut, ends the block before."""
    number, tag, hidden, links = 0, "p", 0, 0
    for kind, name, value in events:
        if kind == "text":
            if not hidden:
                yield number, tag, value, links > 0
            continue
        turn = 1 if kind == "open" else -1
        if name in UNREAD:
            hidden = max(hidden + turn, 0)
        if name == "a" and (turn < 0 or leads_inside(value)):
            links = max(links + turn, 0)
        if name in BLOCKS:
            number, tag = number + 1, name if kind == "open" else "p"


def page_blocks(markup: str) -> Page:
    """The blocks that have text.  One of nothing but links within the book is no text, unless it is a heading."""
    events, found = _Events(markup).found, []
    for (_, tag), run in groupby(text_rows(events), key=lambda row: row[:2]):
        rows = list(run)
        text = " ".join("".join(row[2] for row in rows).split())
        if text and (tag in HEADINGS or any(row[2].strip() and not row[3] for row in rows)):
            found.append((tag, text))
    declared = [value.get("epub:type") or "" for kind, name, value in events if kind == "open" and name in ("body", "section")]
    return Page(found, set(" ".join(declared).split()))


def blocks(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """``pages(key, markup)`` to text blocks (key, pos, tag, text).  A null page has none."""

    @F.pandas_udf("array<struct<tag:string,text:string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"tag": a, "text": b} for a, b in page_blocks(t or "").blocks])

    return pages.select(key, F.posexplode(read(markup)).alias("pos", "b")).select(key, "pos", "b.tag", "b.text")
