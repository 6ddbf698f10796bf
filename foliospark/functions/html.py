"""HTML: one tolerant parse of a page into node and cell rows, main text, metadata; the rest is built-in expressions.

The tree is built as the mark-up stands: no end tags are implied, an end tag closes up to the nearest open tag of its
name or nothing, void tags never nest. Text joins stripped pieces without separator unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import schema

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset(("header", "footer", "aside"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BODY_TAGS = ("p", "li", *HEADINGS)
#: Tags that a page's node rows are made for.
NODE_TAGS = frozenset((*BODY_TAGS, *CHROME, "strong", "b", "em", "i", "math"))
HIDDEN = frozenset(("script", "style", "template"))


class Comment(str):
    """A comment's text; a piece of the tree that get_text skips."""


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order, without recursion: pages may nest deeply."""
        stack = [iter(self.children)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, Node):
                yield x
                stack.append(iter(x.children))

    def strings(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, Node):
                stack.append(iter(() if x.tag in HIDDEN else x.children))
            elif not isinstance(x, Comment):
                yield x

    def text(self, separator: str = "") -> str:
        return separator.join(y for x in self.strings() if (y := x.strip()))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def inside(self, tags: frozenset[str]) -> bool:
        x = self.parent
        while x is not None:
            if x.tag in tags:
                return True
            x = x.parent
        return False

    def markup(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                attrs = "".join(f' {k}="{escape(v or "", quote=False).replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
                if x.tag in VOID:
                    out.append(f"<{x.tag}{attrs}/>")
                    continue
                out.append(f"<{x.tag}{attrs}>")
                stack.append(_Raw(f"</{x.tag}>"))
                stack.extend(reversed(x.children))
            else:
                out.append(f"<!--{x}-->" if isinstance(x, Comment) else x if isinstance(x, _Raw) else escape(x, quote=False))
        return "".join(out)


class _Raw(str):
    pass


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            closed, self.at = self.at, self.at.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        kids = self.at.children
        if kids and type(kids[-1]) is str:
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Comment(data))


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _find(root: Node, tag: str) -> Node | None:
    return next((x for x in root.walk() if x.tag == tag), None)


def _main(root: Node) -> Node | None:
    return next((x for x in root.walk() if "main-col" in x.classes()), None) or _find(root, "body")


def table_markdown(table: Node) -> str:
    """Rows as markdown, a rule of the first row's width after it; pipes in cells are escaped."""
    rows = [x for x in table.walk() if x.tag == "tr"]
    if not rows:
        return table.markup()
    lines = ["| " + " | ".join(c.text().replace("|", "\\|") for c in row.walk() if c.tag in ("td", "th")) + " |" for row in rows]
    width = sum(c.tag in ("td", "th") for c in rows[0].walk())
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def main_text(root: Node, tables: str = "html", drop: tuple[str, ...] = ("header", "aside"), comments: bool = False) -> str:
    """The page's text: children of the first .main-col (else of body) as blocks, without the dropped elements. Tables
    that are blocks stay mark-up ("html") or become markdown; comments that are blocks only come with `comments`."""
    for x in [x for x in root.walk() if x.tag in drop]:
        if x.parent is not None and x in x.parent.children:
            x.parent.children.remove(x)
    main = _main(root)
    blocks = []
    for x in main.children if main else ():
        if isinstance(x, str):
            block = x.strip() if comments or not isinstance(x, Comment) else ""
        elif x.tag == "table":
            block = x.markup() if tables == "html" else table_markdown(x)
        else:
            block = x.text("\n")
        if block:
            blocks.append(block)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(blocks)).strip()


def metadata(root: Node) -> tuple[str, bool, bool]:
    """(language, is_table, is_diagram): html@lang's first two letters or en; over half of the text in tables (nested
    ones count again); images and under 100 characters."""
    html = _find(root, "html")
    lang = ((html.attrs.get("lang") or "")[:2].lower() if html else "") or "en"
    main = _main(root)
    if main is None:
        return lang, False, False
    text = main.text()
    inside = sum(len(x.text()) for x in main.walk() if x.tag == "table")
    images = any(x.tag == "img" for x in main.walk())
    return lang, bool(text) and inside > len(text) * 0.5, images and len(text) < 100


PAGE = schema(
    "nodes array<struct<seq:int,tag:string,text:string,in_chrome:boolean>>, cells array<struct<table_idx:int,row_idx:int,col_idx:int,text:string,head_row:boolean>>,"
    " math array<string>, body string, main_html string, main_markdown string, lang string, is_table boolean, is_diagram boolean"
)
_ARROW = pa.struct([
    ("nodes", pa.list_(pa.struct([("seq", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("in_chrome", pa.bool_())]))),
    ("cells", pa.list_(pa.struct([("table_idx", pa.int32()), ("row_idx", pa.int32()), ("col_idx", pa.int32()), ("text", pa.string()), ("head_row", pa.bool_())]))),
    ("math", pa.list_(pa.string())), ("body", pa.string()), ("main_html", pa.string()), ("main_markdown", pa.string()), ("lang", pa.string()), ("is_table", pa.bool_()), ("is_diagram", pa.bool_()),
])


def page_of(html: str | None, drop: tuple[str, ...] = ("header", "aside"), comments: bool = False, parts: Collection[str] = PAGE.names, tags: frozenset[str] = NODE_TAGS) -> dict:
    """What the engine takes from a page, from one parse: the fields `parts` of PAGE, with nodes of `tags` only."""
    root = parse(html)
    every, page = list(root.walk()), {}
    if "nodes" in parts:
        page["nodes"] = [{"seq": i, "tag": x.tag, "text": x.text(), "in_chrome": x.inside(CHROME)} for i, x in enumerate(every) if x.tag in tags]
    if "cells" in parts:
        page["cells"] = cells = []
        for t, table in enumerate(x for x in every if x.tag == "table"):
            for r, row in enumerate(x for x in table.walk() if x.tag == "tr"):
                own = [x for x in row.walk() if x.tag in ("td", "th")]
                head = any(x.tag == "th" for x in own)
                cells += [{"table_idx": t, "row_idx": r, "col_idx": c, "text": x.text(), "head_row": head} for c, x in enumerate(own)]
    if "math" in parts:
        page["math"] = [x.text() for x in every if x.tag == "math"]
        page["math"] += [x.text() for x in every if any(re.search("MathJax|katex", c, re.I) for c in x.classes())]
    if "body" in parts:
        body = _find(root, "body")
        page["body"] = "".join(body.strings()) if body else None
    if "lang" in parts or "is_table" in parts or "is_diagram" in parts:
        page["lang"], page["is_table"], page["is_diagram"] = metadata(root)
    # These take elements off the tree, so they come last.
    if "main_html" in parts:
        page["main_html"] = main_text(root, "html", drop, comments)
    if "main_markdown" in parts:
        page["main_markdown"] = main_text(root, "markdown", drop, comments)
    for x in every:  # a tree without cycles goes at once, not when garbage is collected
        x.parent = None
    return {k: page[k] for k in parts}


#: Characters of pages and of what is taken from them that a task holds before it hands them on (one page at least).
AT_ONCE = 1 << 20


def _characters(x: object) -> int:
    if isinstance(x, str):
        return len(x)
    return sum(map(_characters, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else 1


def parse_pages(df: DataFrame, html_col: str = "html", out_col: str = "page_parts", drop: tuple[str, ...] = ("header", "aside"), comments: bool = False, parts: Collection[str] = PAGE.names, tags: Collection[str] = NODE_TAGS) -> DataFrame:
    """df with one struct column of what is taken from its HTML: each page is parsed once. It has the fields of PAGE, or
    those named in `parts`, and nodes of all NODE_TAGS, or those of `tags`."""
    kept, tags = df.drop(out_col), frozenset(tags)
    kind = T.StructType([f for f in PAGE if f.name in parts])
    at, schema = kept.columns.index(html_col), T.StructType([*kept.schema.fields, T.StructField(out_col, kind)])
    names = kind.names
    arrow = pa.struct([_ARROW.field(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, pages in _pieces(batch.column(at), lambda h: page_of(h, drop, comments, names, tags)):
                part = batch.slice(start, len(pages))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pages, arrow)], [*part.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def _pieces(htmls: pa.Array, take: Callable[[str | None], dict]) -> Iterator[tuple[int, list[dict]]]:
    """What is taken from pages, some pages at a time: (place of the first, theirs)."""
    start, pages, room = 0, [], AT_ONCE
    for h in htmls:
        raw = h.as_py()
        pages.append(take(raw))
        room -= len(raw or "") + _characters(pages[-1])
        if room <= 0:
            yield start, pages
            start, pages, room = start + len(pages), [], AT_ONCE
    if pages:
        yield start, pages


def html_of_completion(c: Column) -> Column:
    """The page in a model's answer: a block fenced as html, else a bare fence that holds tags, else null."""
    fenced = F.regexp_extract(c, r"(?s)```html\s*\n(.*?)```", 1)
    bare = F.trim(F.regexp_extract(c, r"(?s)```\s*\n(.*?)```", 1))
    clean = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")
    return F.when(c.rlike(r"(?s)```html\s*\n.*?```"), clean(fenced)).when(F.contains(bare, F.lit("<")) & F.contains(bare, F.lit(">")), clean(bare))


def viewport_css(width: Column) -> Column:
    height = F.bround(width * 1.414).cast("int").cast("string")
    w = width.cast("string")
    # The injected style's text.
    return F.concat(
        F.lit("\n<style>\n  /* Injected viewport constraints */\n  html { margin: 0 !important; padding: 0 !important; }\n  body {\n    width: "), w,
        F.lit("px !important;\n    min-height: "), height,
        F.lit("px !important;\n    overflow: visible !important;\n    box-sizing: border-box !important;\n    margin: 0 !important;\n  }\n</style>\n"),
    )


def inject_viewport(html: Column, width: Column) -> Column:
    """The page with fixed width and A4 height: the style goes before the first </head>, else before <body, else around."""
    css = viewport_css(width)
    head, body = F.instr(html, "</head>"), F.instr(html, "<body")
    split = lambda at: F.concat(F.substring(html, F.lit(1), at - 1), css, F.substring(html, at, F.length(html)))
    return F.when(head > 0, split(head)).when(body > 0, split(body)).otherwise(F.concat(F.lit("<html><head>"), css, F.lit("</head>\n"), html))


def page_document(body: Column, lang: Column, css: str = "", width: int = 800) -> Column:
    """A whole HTML document around a body; the body's script names the language where it is Bengali or Devanagari."""
    from .text import detect_script

    script = detect_script(body)
    named = F.when(script != "en", script).otherwise(F.coalesce(F.when(lang != "", lang), F.lit("en")))
    return F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), named, F.lit(f'">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width={width}">\n{css}\n</head>\n<body>\n<div class="main-col">\n'), body, F.lit("\n</div>\n</body>\n</html>"))
