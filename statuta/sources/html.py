"""Articles of HTML pages, read as a tree: a tag-stack parser over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches, text

Selector = tuple[str, str | None]

# Fixed values of HTML: elements without content, elements whose text isn't shown, and what an opening tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {tag: (frozenset({"p"}), frozenset({"div", "article", "td", "th", "body", "button"})) for tag in _BLOCKS}
_CLOSES |= {
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "div"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "div"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "div"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}

#: Statute pages: what marks an article and its parts.
STATUTE = {"block": ("div", "article"), "number": ("span", "article-number"), "title": ("span", "article-title"), "content": ("div", "article-content")}
_PARAGRAPH = re.compile(f"[{text.CIRCLED}]")


@dataclass
class Block:
    """An element that holds an article, with the texts of its parts as far as they were found."""

    parts: dict[str, list[str]] = field(default_factory=dict)


class Reader(HTMLParser):
    """Collects, for each block in document order, the texts of the first element of each part within it.

    A class may be one of several; character references are decoded; a text node is stripped by itself.
    """

    def __init__(self, block: Selector, parts: dict[str, Selector]) -> None:
        super().__init__(convert_charrefs=True)
        self.block, self.parts = block, parts
        self.blocks: list[Block] = []
        self._stack: list[tuple[str, Block | None, list[list[str]]]] = []
        self._open: list[Block] = []
        self._texts: list[list[str]] = []
        self._hidden = 0

    @staticmethod
    def _is(selector: Selector, tag: str, classes: list[str]) -> bool:
        return selector[0] == tag and (selector[1] is None or selector[1] in classes)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            while (at := next((i for i in range(len(self._stack) - 1, -1, -1) if self._stack[i][0] in closed or self._stack[i][0] in within), -1)) >= 0 and self._stack[at][0] in closed:
                self._close(at)
        classes = next((v or "" for k, v in attrs if k == "class"), "").split()
        texts: list[list[str]] = []
        for name, selector in self.parts.items():
            if self._is(selector, tag, classes):
                for one in self._open:
                    if name not in one.parts:
                        one.parts[name] = []
                        texts.append(one.parts[name])
        own = None
        if self._is(self.block, tag, classes):
            own = Block()
            self.blocks.append(own)
        if tag in _VOID:
            return
        self._stack.append((tag, own, texts))
        self._texts += texts
        self._hidden += tag in _HIDDEN
        if own:
            self._open.append(own)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(len(self._stack) - 1)

    def _close(self, at: int) -> None:
        """Closes all elements from the ``at``-th on."""
        for tag, own, texts in reversed(self._stack[at:]):
            self._hidden -= tag in _HIDDEN
            if own:
                self._open.pop()
            if texts:
                del self._texts[-len(texts) :]
        del self._stack[at:]

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self._stack) - 1, -1, -1) if self._stack[i][0] == tag), -1)
        if at >= 0:
            self._close(at)

    def handle_data(self, data: str) -> None:
        own = data.strip()
        if own and not self._hidden:
            for texts in self._texts:
                texts.append(own)


def paragraphs_of(content: str) -> list[tuple[str, str]]:
    """(number, content): a line that begins with a circled number opens a paragraph, later ones join it by a space."""
    out: list[tuple[str, list[str]]] = []
    for line in map(str.strip, content.split("\n")):
        if line and _PARAGRAPH.match(line):
            out.append((line[0], [line[1:].strip()]))
        elif line and out:
            out[-1][1].append(line)
    return [(number, " ".join(lines)) for number, lines in out]


def read_page(page: str, block: Selector, parts: dict[str, Selector], joiner: str = "") -> Iterator[tuple[int, dict[str, str]]]:
    """(place, texts by part) of each block that has a number."""
    reader = Reader(block, parts)
    reader.feed(page)
    reader.close()
    for at, one in enumerate(reader.blocks):
        if "number" in one.parts:
            yield at, {name: joiner.join(texts) for name, texts in one.parts.items()}


_ARTICLE = "at long, number string, title string, content string, paragraphs array<struct<number:string,content:string>>"


def law_pages(pages: DataFrame, key: str, column: str = "html", block: Selector = STATUTE["block"], number: Selector = STATUTE["number"], title: Selector | None = STATUTE["title"], content: Selector | None = STATUTE["content"], joiner: str = "") -> DataFrame:
    """(key, at, number, title, content, paragraphs): the articles of HTML pages.

    A selector is (tag, class or None); a class may be one of a list.  Every element that the
    block selector matches is an article, also within another; of each part the first element
    within it counts.  Texts are those of all nodes below, references decoded, each stripped,
    joined by ``joiner``; scripts, styles and comments have none.  Blocks without a number
    element go; a missing title is null, a missing content is empty.  Unclosed and stray tags
    are taken as browsers take them, to the extent of paragraphs, list items and table cells.
    A null or empty page has no articles; a page is parsed whole, however long.
    """
    parts = {name: s for name, s in (("number", number), ("title", title), ("content", content)) if s}
    struct = pa.list_(pa.struct([("number", pa.string()), ("content", pa.string())]))

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(arrived, 1):
            rows: list[int] = []
            found: list[tuple] = []
            for i, page in enumerate(batch.column(1).to_pylist()):
                for at, one in read_page(page or "", block, parts, joiner):
                    body = one.get("content", "")
                    rows.append(i)
                    found.append((at, one["number"], one.get("title"), body, [{"number": n, "content": c} for n, c in paragraphs_of(body)]))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(5)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "at", "number", "title", "content", "paragraphs"])

    rows = pages.select(F.col(key), F.col(column).cast("string").alias("_page"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {_ARTICLE}")
