"""Pages to markdown, in Arrow batches: headings, paragraphs, lists, links, code, tables.

Hidden elements are known by name. A head ends with its end tag, or before the first text or element that a head
can't have (authors may leave the tag out); another hidden element that is never closed ends with the page, and what
was in it is taken for text then if the page would have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_HIDDEN = {"script", "style", "noscript", "template", "title"}
#: Elements that a head may hold.
_HEAD = {"base", "link", "meta", *_HIDDEN}
_BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "li", *[f"h{i}" for i in range(1, 7)]}


class Markdown(HTMLParser):
    """Collects blocks; unknown tags are dropped, their text stays."""

    def __init__(self, show: bool = False):
        super().__init__(convert_charrefs=True)
        self.show = show
        self.head = False
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.lead = ""
        self.hidden = 0
        self.links: list[str] = []

    def _flush(self):
        text = " ".join("".join(self.line).split())
        if text:
            self.blocks.append(self.lead + text)
        self.line, self.lead = [], ""

    def handle_starttag(self, tag, attrs):
        self.head = tag == "head" or (self.head and tag in _HEAD)
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS or tag == "br":
            self._flush()
        if tag[:1] == "h" and tag[1:].isdigit():
            self.lead = "#" * int(tag[1:]) + " "
        elif tag == "li":
            self.lead = "- "
        elif tag in ("td", "th"):
            self.line.append(" | ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.line.append("[")

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.links:
            self.line.append(f"]({self.links.pop()})")
        elif tag in _BLOCKS:
            self._flush()

    def handle_data(self, data):
        if self.head and not self.hidden and data.strip():
            self.head = False  # text is no part of a head
        if self.show or not (self.hidden or self.head):
            self.line.append(data)


def _parsed(page: str, show: bool) -> tuple[str, int]:
    parser = Markdown(show)
    parser.feed(page)
    parser.close()
    parser._flush()
    return "\n\n".join(parser.blocks), parser.hidden


def markdown(page: str | None) -> str:
    """Markdown of a page; null is an empty page."""
    made, left_open = _parsed(page or "", False)
    if not made and left_open:  # all of it was in an element that nothing closed
        made = _parsed(page or "", True)[0]
    return made


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown, status) of (page_id, html); status is success, or failure for an empty page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [markdown(x) for x in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "markdown": made, "status": ["success" if m else "failure" for m in made]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, markdown string, status string")
