"""Web pages to titles, blocks and links, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is never text of the page, and elements that end a block.
SKIP = frozenset("script style noscript template nav footer header aside form button svg iframe".split())
BLOCKS = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "tr": "table_row", "pre": "paragraph", "td": None, "th": None}
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
#: What a paragraph that only names a verse looks like, and the least length of a quotation before it.
VERSE_REFERENCE = r"\A(?:[1-3]\s*)?[A-Za-z]+(?:\s+[A-Za-z]+)?\s+\d+:\d+(?:\s*[-\u2013]\s*\d+)?\z"
QUOTED = 80
CONTAINERS = frozenset(("article", "main", "div", "section", "ul", "ol", "table", "body"))


@dataclass
class Page:
    title: str = ""
    canonical: str = ""
    #: Blocks inside each element asked for; None is the whole page.
    scoped: dict[str | None, list[tuple[str, str]]] = field(default_factory=dict)
    links: list[str] = field(default_factory=list)
    json_ld: list[dict] = field(default_factory=list)
    removed: dict[str, int] = field(default_factory=dict)

    @property
    def blocks(self) -> list[tuple[str, str]]:
        return next(iter(self.scoped.values()))


def _flat(s: str) -> str:
    return " ".join(s.replace("\u200b", "").replace("\u00ad", "").split())


class _Reader(HTMLParser):
    """Text in document order; a block ends where a block element starts or ends. Unclosed elements are closed
    by the next block; a skipped element ends at its own end tag only."""

    def __init__(self, skip_classes: frozenset[str], scopes: tuple[str | None, ...]):
        super().__init__(convert_charrefs=True)
        self.page, self.skip_classes = Page(scoped={s: [] for s in scopes}), skip_classes
        self.inside = {s: int(s is None) for s in scopes}
        self.kind, self.text, self.skipping, self.depth = "paragraph", [], None, 0
        self.in_title = self.in_ld = False
        self.title, self.ld, self.cells = [], [], None

    def put(self, kind: str, text: str, again: bool) -> None:
        for scope, found in self.page.scoped.items():
            if self.inside[scope] and (again or not found or found[-1] != (kind, text)):
                found.append((kind, text))

    def close_block(self, kind: str = "paragraph") -> None:
        text = _flat("".join(self.text))
        self.text = []
        if self.cells is not None and text:
            self.cells.append(text)
        elif text:
            self.put(self.kind, text, again=False)
        self.kind = kind

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if self.skipping:
            self.depth += tag == self.skipping and tag not in VOID
            return
        if tag == "link" and "canonical" in at.get("rel", "").split():
            self.page.canonical = self.page.canonical or at.get("href", "")
        if tag == "title":
            self.in_title = True
        elif tag == "script" and at.get("type") == "application/ld+json":
            self.in_ld, self.ld = True, []
        elif tag in SKIP or self.skip_classes & set(at.get("class", "").split()):
            if tag not in VOID:
                self.close_block(self.kind)
                self.skipping, self.depth = tag, 1
                self.page.removed[tag] = self.page.removed.get(tag, 0) + 1
            return
        if tag == "a" and at.get("href"):
            self.page.links.append(at["href"])
        if tag in self.inside:
            self.close_block()
            self.inside[tag] += 1
        if tag == "br":
            self.text.append("\n")
        elif tag == "tr":
            self.close_block("table_row")
            self.cells = []
        elif tag in HEADINGS:
            self.close_block("heading")
        elif tag in BLOCKS:
            self.close_block(BLOCKS[tag] or self.kind)
        elif tag in CONTAINERS:
            self.close_block()

    def handle_endtag(self, tag):
        if self.in_ld and tag == "script":
            self.in_ld = False
            try:
                found = json.loads("".join(self.ld))
            except ValueError:
                found = []
            for x in found if isinstance(found, list) else [found]:
                if isinstance(x, dict):
                    graph = x.get("@graph")
                    self.page.json_ld += [y for y in graph if isinstance(y, dict)] if isinstance(graph, list) else [x]
            return
        if self.skipping:
            self.depth -= tag == self.skipping
            if not self.depth:
                self.skipping = None
            return
        if tag == "title":
            self.in_title = False
        elif tag == "tr":
            self.close_block()
            cells, self.cells = self.cells or [], None
            if cells:
                self.put("table_row", " | ".join(cells), again=True)
        elif tag in BLOCKS or tag in HEADINGS or tag in CONTAINERS:
            self.close_block(self.kind if tag in ("td", "th") else "paragraph")
        if self.inside.get(tag):
            self.inside[tag] -= 1

    def handle_data(self, data):
        if self.in_ld:
            self.ld.append(data)
        elif self.in_title:
            self.title.append(data)
        elif not self.skipping:
            self.text.append(data)


def read_page(html: str | None, skip_classes: frozenset[str] = frozenset(), *scopes: str | None) -> Page:
    """One page, read once; null is an empty one. With ``scopes`` the blocks inside each of those elements; ``blocks``
    are those of the first."""
    reader = _Reader(skip_classes, scopes or (None,))
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    reader.page.title = _flat("".join(reader.title))
    return reader.page


CANDIDATES = ("article", "main", None)


def best_candidate(page: Page) -> tuple[str, str]:
    """Name of the container with the most text, the first of equals, and its text; equal blocks count once."""
    best = ("", "")
    for scope, found in page.scoped.items():
        text = "\n".join(dict.fromkeys(t for _, t in found))
        if len(text) > len(best[1]):
            best = (scope or "page", text)
    return best


def marked_title(c: Column) -> Column:
    """The first title as it is marked up, null for a null page: of its entities only those of <, > and & are replaced,
    which a title cut within one, or without its semicolon, keeps. ``read_page`` decodes all that HTML knows."""
    title = F.regexp_extract(c, r"(?s)<title>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(title, r"[\t\n\f\r ]+", " "), r"\A\p{Zs}+|\p{Zs}+\z", "")


def author_names(value: object) -> list[str]:
    """Names in a JSON-LD author: a string, an object with a name, or a list of them."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, dict):
        return author_names(value.get("name"))
    return list(dict.fromkeys(n for v in value for n in author_names(v))) if isinstance(value, list) else []


ARTICLE_TYPES = frozenset(("Article", "BlogPosting", "NewsArticle", "ScholarlyArticle", "WebPage"))


def article(objects: list[dict]) -> dict:
    """First object whose type is an article's."""
    for x in objects:
        kinds = x.get("@type")
        if ARTICLE_TYPES & set(kinds if isinstance(kinds, list) else [kinds]):
            return x
    return {}


BLOCK_SCHEMA = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("type", pa.string()), ("text", pa.string())])
PAGE_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("title", pa.string()), ("canonical", pa.string()), ("text", pa.string()), ("container", pa.string()),
     ("authors", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("removed", pa.map_(pa.string(), pa.int32()))]
)


#: Pages that a worker holds at a time as Python objects; Arrow's batches have up to 10,000.
PART = 64


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, which share their memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART):
            yield batch.slice(start, PART)


def blocks(pages: DataFrame, skip_classes: frozenset[str] = frozenset(), scope: str | None = None) -> DataFrame:
    """``(page_id, pos, type, text)`` of ``pages(page_id, html)``."""

    def run(batches):
        for batch in in_parts(batches):
            rows = [
                {"page_id": i, "pos": k, "type": kind, "text": text}
                for i, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True)
                for k, (kind, text) in enumerate(read_page(h, skip_classes, *([scope] if scope else [])).blocks)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=BLOCK_SCHEMA)

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, pos int, type string, text string")


def without_quoted_paragraphs(blocks: DataFrame, page: str = "page_id", pos: str = "pos", parent: str | None = None) -> DataFrame:
    """Blocks without long paragraphs that the next paragraph gives as a quotation, and without that reference.

    A paragraph that is a verse reference and nothing else, after one of QUOTED characters and more (of the same
    ``parent``, if the blocks name it), goes with it. Other blocks between two paragraphs do not part them."""
    own = Window.partitionBy(page, *([parent] if parent else []), F.col("type")).orderBy(pos)
    is_paragraph = F.col("type") == "paragraph"
    reference, length = F.trim("text").rlike(VERSE_REFERENCE), F.length("text")
    quoted = (length >= QUOTED) & F.coalesce(F.lead(reference).over(own), F.lit(False))
    cited = reference & F.coalesce(F.lag(length).over(own) >= QUOTED, F.lit(False))
    return blocks.withColumn("_out", is_paragraph & (quoted | cited)).filter(~F.coalesce("_out", F.lit(False))).drop("_out")


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """One row for each page, which is read once: title, canonical link, best text and its container, authors, links,
    skipped elements; ``keep`` are columns of ``pages`` that are passed on."""

    def run(batches):
        for batch in in_parts(batches):
            rows = []
            for i, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = read_page(h, frozenset(), None, *CANDIDATES[:-1])
                page.scoped = {s: page.scoped[s] for s in CANDIDATES}
                container, text = best_candidate(page)
                rows.append({
                    "page_id": i, "title": page.title, "canonical": page.canonical, "text": text, "container": container,
                    "authors": author_names(article(page.json_ld).get("author")), "links": page.links,
                    "removed": list(page.removed.items()),
                })
            out = pa.RecordBatch.from_pylist(rows, schema=PAGE_SCHEMA)
            yield pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c) for c in keep)], [*out.schema.names, *keep])

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for c in keep for f in [pages.schema[c]])
    return pages.select("page_id", "html", *keep).mapInArrow(
        run,
        "page_id long, title string, canonical string, text string, container string, authors array<string>, "
        "links array<string>, removed map<string,int>" + extra,
    )
