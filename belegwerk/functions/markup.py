"""HTML pages to Markdown in one pass: headings, lists, tables, links, code, quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSEEN = {"script", "style", "template", "head"}
LEVELS = {f"h{n}": n for n in range(1, 7)}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "a": "", "q": '"'}
LISTS = {"ul", "ol", "menu"}
CELLS = {"td", "th"}
# Elements that stand on lines of their own.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "header", "hr", "html", "li", "main", "nav", "option", "p", "pre", "section", "summary", "table", "tr", *LEVELS, *LISTS,
}
LOT = 1 << 20  # bytes of pages that are Python strings at once
BLANKS = re.compile("[ \t\n\r\f\xa0]+")


@dataclass
class Span:
    """Text of an inline element that is still open."""

    tag: str
    target: str = ""
    parts: list[str] = field(default_factory=list)


@dataclass
class Cells:
    """A table that is still open; tables inside its cells give only their text."""

    rows: list[list[str]] = field(default_factory=list)
    inner: int = 0


class Page(HTMLParser):
    """Walks the tags of a page with a stack of what is open; unclosed elements end with their block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[bool, str]] = []  # whether a list item, and its text
        self.spans = [Span("")]
        self.unseen: list[str] = []
        self.lists: list[list] = []  # tag and number of each open list
        self.bullet = ""
        self.quotes, self.level, self.pre = 0, 0, 0
        self.table: Cells | None = None
        self.cell = False

    # --- inline -------------------------------------------------------------------

    def open_span(self, tag: str, target: str) -> None:
        self.spans.append(Span(tag, target))

    def close_span(self) -> None:
        span = self.spans.pop()
        text = "".join(span.parts)
        core = text.strip()
        mark = MARKS[span.tag]
        if core and span.tag == "a" and span.target:
            core = f"[{core}]({span.target})"
        elif core and not self.pre:
            core = f"{mark}{core}{mark}"
        lead, tail = text[:len(text) - len(text.lstrip())], text[len(text.rstrip()):]
        self.spans[-1].parts.append(lead + core + (tail if text.strip() else ""))

    def inline(self) -> str:
        """All text since the last block, blanks squeezed."""
        while len(self.spans) > 1:
            self.close_span()
        text, self.spans = "".join(self.spans[0].parts), [Span("")]
        if self.pre:
            return text.strip("\n")
        lines = (re.sub(" +", " ", line).strip() for line in text.split("\n"))
        return "\n".join(line for line in lines if line)

    # --- blocks -------------------------------------------------------------------

    def block(self) -> None:
        """End the present block, if it has any text."""
        text = self.inline()
        if not text:
            return
        if self.cell:
            self.spans[0].parts.append(text + "\n")  # a cell is one block
            return
        if self.pre:
            text = f"```\n{text}\n```"
        elif self.level:
            text = "#" * self.level + " " + text.replace("\n", " ")
        first, rest = "", "  " * len(self.lists)
        if self.bullet:
            first, self.bullet = self.bullet, ""
        elif self.lists:
            first = rest
        quote = "> " * self.quotes
        lines = text.split("\n")
        self.out.append((bool(self.lists), "\n".join([quote + first + lines[0], *(quote + rest + line for line in lines[1:])])))

    def end_cell(self) -> None:
        if self.cell:
            self.cell = False
            text = self.inline().replace("\n", " ").replace("|", "\\|")
            self.table.rows[-1].append(text)

    def end_table(self) -> None:
        self.end_cell()
        rows = [r for r in self.table.rows if any(r)]
        self.table = None
        if not rows:
            return
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        lines.insert(1, "|" + " --- |" * width)
        self.out.append((False, "\n".join("> " * self.quotes + line for line in lines)))

    # --- tags ---------------------------------------------------------------------

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen and tag == "body":
            self.unseen = []  # a head that was not closed
        if tag in UNSEEN:
            self.unseen.append(tag)
        if self.unseen:
            return
        given = {k: v or "" for k, v in attrs}
        if self.table is not None and self.table_tag(tag):
            return
        if tag == "br":
            self.spans[-1].parts.append("\n")
        elif tag == "img" and given.get("alt", "").strip():
            self.spans[-1].parts.append(f"![{BLANKS.sub(' ', given['alt']).strip()}]({address(given.get('src', ''))})")
        elif tag in MARKS:
            if tag == "a" or tag not in [s.tag for s in self.spans]:
                self.open_span(tag, address(given.get("href", "")) if tag == "a" else "")
        elif tag in BLOCKS:
            self.block()
            self.level = LEVELS.get(tag, 0)
            if tag in LISTS:
                self.lists.append([tag, 0])
            elif tag == "li" and self.lists:
                kind = self.lists[-1]
                kind[1] += 1
                self.bullet = "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
            elif tag == "blockquote":
                self.quotes += 1
            elif tag == "pre":
                self.pre += 1
            elif tag == "hr":
                self.out.append((False, "---"))
            elif tag == "table":
                self.table = Cells()

    def table_tag(self, tag: str) -> bool:
        """Tags inside a table; true if nothing else is to be done."""
        if tag == "table":
            self.table.inner += 1
        if self.table.inner:
            if tag in BLOCKS or tag in CELLS:
                self.spans[-1].parts.append(" ")
            return tag in BLOCKS or tag in CELLS
        if tag == "tr":
            self.end_cell()
            self.table.rows.append([])
        elif tag in CELLS:
            self.end_cell()
            if not self.table.rows:
                self.table.rows.append([])
            self.inline()  # text between cells has no place
            self.cell = True
        elif tag in BLOCKS:
            self.spans[-1].parts.append(" ")
        else:
            return False
        return True

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                del self.unseen[self.unseen.index(tag):]
            return
        if self.table is not None and (tag in BLOCKS or tag in CELLS):
            if tag == "table" and self.table.inner:
                self.table.inner -= 1
            elif tag == "table":
                self.end_table()
            elif not self.table.inner and tag in CELLS | {"tr"}:
                self.end_cell()
            else:
                self.spans[-1].parts.append(" ")
            return
        if tag in MARKS:
            if tag in [s.tag for s in self.spans]:
                while self.spans[-1].tag != tag:
                    self.close_span()
                self.close_span()
        elif tag in BLOCKS:
            self.block()
            self.level = 0
            if tag in LISTS and self.lists:
                self.lists.pop()
                self.bullet = ""
            elif tag == "li":
                self.bullet = ""
            elif tag == "blockquote":
                self.quotes = max(0, self.quotes - 1)
            elif tag == "pre":
                self.pre = max(0, self.pre - 1)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.spans[-1].parts.append(data.replace("\xa0", " ") if self.pre else BLANKS.sub(" ", data))

    def text(self) -> str:
        if self.table is not None:
            self.end_table()
        self.block()
        parts = []
        for n, (item, text) in enumerate(self.out):
            if n:
                parts.append("\n" if item and self.out[n - 1][0] else "\n\n")
            parts.append(text)
        return "".join(parts)


def address(target: str) -> str:
    """A link target that cannot end its brackets."""
    return BLANKS.sub("%20", target.strip()).replace("(", "%28").replace(")", "%29")


def page_text(html: str) -> str:
    page = Page()
    page.feed(html)
    page.close()
    return page.text()


def lots(texts: pa.Array, most: int = LOT) -> Iterator[pa.Array]:
    """Slices of at most about ``most`` bytes of text; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield texts[lo:hi]
        lo = hi


@F.arrow_udf(T.StringType())
def _pages(html: pa.Array) -> pa.Array:
    done = [pa.array([None if h is None else page_text(h) for h in lot.to_pylist()], pa.string()) for lot in lots(html)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def page_markdown(html: Column) -> Column:
    """Markdown of whole pages: headings, nested lists, tables, links, images, code, quotes.

    Head, scripts, styles, templates and comments go; unknown tags leave their text; elements
    that are not closed end with their block; a page without text is empty, null stays null.
    """
    return _pages(html)
