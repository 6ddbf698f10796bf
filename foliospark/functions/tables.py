"""Markdown tables: found, cut out, and turned into HTML; text into HTML paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, WS, is_blank, strip

# A header row, a separator row, one or more data rows. A dot stops at line ends as Python's does.
BLOCK = r"((?-s)\|[^\n]+\|\n\|[-| :]+\|\n(?:\|[^\n]+\|\n?)+)"
SEPARATOR = r"^\|[-| :]+\|$"


def _lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")


def _cells(line: Column) -> Column:
    """Cells of a row; edge pipes go, all of them, so empty edge cells vanish."""
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)


def markdown_tables(c: Column) -> Column:
    """array<struct<table_id,headers,rows>> of the tables of a text, numbered from 1."""

    def table(block: Column, i: Column) -> Column:
        rows = F.transform(F.filter(_lines(block), lambda x: ~x.rlike(SEPARATOR)), _cells)
        return F.struct((i + 1).cast("int").alias("table_id"), F.get(rows, F.lit(0)).alias("headers"), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"))

    real = lambda b: F.size(F.filter(_lines(b), lambda x: ~x.rlike(SEPARATOR))) >= 2
    return F.transform(F.filter(F.regexp_extract_all(c, F.lit(BLOCK), F.lit(1)), real), table)


def without_tables(c: Column) -> Column:
    """The text with its tables cut out, stripped. A block counts as a table if a data row isn't another separator."""
    data = r"(?:\|[-| :]+\|\n?)*(?!\|[-| :]+\|(?:\n|$))\|[^\n]+\|\n?(?:\|[^\n]+\|\n?)*"
    return F.when(c.isNull() | (c == ""), c).otherwise(strip(F.regexp_replace(c, rf"\|[^\n]+\|\n\|[-| :]+\|\n{data}", "")))


def table_to_html(block: Column) -> Column:
    """A markdown table as an HTML table; the first line holds headers, separators go, cells aren't escaped."""
    lines = _lines(block)

    def row(line: Column, i: Column) -> Column:
        cells = F.split(line, r"\|", -1)
        inner = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0))), strip)
        tag = F.when(i == 0, "th").otherwise("td")
        shown = F.array_join(F.transform(inner, lambda x: F.concat(F.lit("<"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">"))), "")
        return F.when(line.rlike(rf"^\|[{SPACES}\-:|]+\|"), F.lit(None)).otherwise(F.concat(F.lit("  <tr>"), shown, F.lit("</tr>")))

    rows = F.array_compact(F.transform(lines, row))
    whole = F.array_join(F.concat(F.array(F.lit("<table>")), rows, F.array(F.lit("</table>"))), "\n")
    return F.when(F.size(lines) < 2, F.concat(F.lit("<p>"), block, F.lit("</p>"))).otherwise(whole)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def text_to_html(c: Column) -> Column:
    """Paragraphs (split at blank lines) as <p>, those that begin as a markdown row as tables."""
    parts = F.filter(F.transform(F.split(strip(c), r"\n{2,}"), strip), lambda p: p != "")

    def shown(p: Column) -> Column:
        flat = F.regexp_replace(F.replace(escape_html(p), F.lit("\n"), F.lit(" ")), "  +", " ")
        return F.when(p.rlike(r"^\|[^\n]*\|"), table_to_html(p)).otherwise(F.concat(F.lit("<p>"), flat, F.lit("</p>")))

    return F.when(is_blank(c), "<p><em>(No text content)</em></p>").otherwise(F.array_join(F.transform(parts, shown), "\n"))


def sentences_to_html(sentences: Column, tables: Column) -> Column:
    """Numbered sentences and tables as an HTML body; headers and cells aren't escaped."""
    paras = F.flatten(F.transform(sentences, lambda s: F.filter(F.transform(F.split(escape_html(s["text"]), r"\n{2,}"), strip), lambda p: p != "")))
    shown = F.transform(paras, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit(" ")), F.lit("</p>")))

    def line(cells: Column, tag: str) -> Column:
        return F.concat(F.lit("  <tr>"), F.array_join(F.transform(cells, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    def table(t: Column) -> Column:
        head = F.when(F.size(t["headers"]) > 0, F.array(line(t["headers"], "th"))).otherwise(F.array().cast("array<string>"))
        rows = F.transform(t["rows"], lambda r: line(r, "td"))
        return F.array_join(F.concat(F.array(F.lit("<table>")), head, rows, F.array(F.lit("</table>"))), "\n")

    return F.array_join(F.concat(shown, F.transform(F.coalesce(tables, F.array().cast("array<struct<table_id:int,headers:array<string>,rows:array<array<string>>>>")), table)), "\n")
