"""HTML pages as images or PDF files behind a replaceable renderer; a manifest says what was made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import schema
from .pdf import blank_png

#: Height over width of an A4 page (a fixed value).
A4 = 1.414
RENDERED = schema("stem string, kind string, width int, height int, content binary, error string")


class Renderer(Protocol):
    def __call__(self, html: str, width: int, height: int | None, kind: str) -> bytes: ...


class Blank:
    """An offline renderer: a blank page of the right size. kind is png or pdf."""

    def __call__(self, html: str, width: int, height: int | None, kind: str) -> bytes:
        if not html:
            raise ValueError("empty page")
        if kind == "png":
            return blank_png(width, height or round(width * A4))
        return b"%PDF-1.4\n1 0 obj <</Type /Page /MediaBox [0 0 595 842]>> endobj\n%%EOF\n"


def render_pages(pages: DataFrame, kind: str = "png", open_renderer: Callable[[], Renderer] = Blank, width: int = 1288) -> DataFrame:
    """RENDERED of pages (stem, html, width, height; nulls: `width`, and the height of an A4 page of that width). One
    renderer, such as a headless browser, is opened for a partition; a page that fails is a row with an error."""
    kinds = to_arrow_schema(RENDERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = open_renderer()
        for batch in batches:
            for r in batch.to_pylist():
                row = {"stem": r["stem"], "kind": kind, "width": (w := r["width"] or width), "height": r["height"] or round(w * A4), "content": None, "error": None}
                try:
                    row["content"] = render(r["html"] or "", row["width"], r["height"], kind)
                except Exception as e:  # noqa: BLE001  a page that fails doesn't stop the others
                    row["error"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pylist([row], kinds)

    return pages.select("stem", "html", "width", "height").mapInArrow(run, RENDERED)


def render_manifest(rendered: DataFrame, out: str) -> DataFrame:
    """Writes what was rendered as a table to `out` and returns its manifest without the contents."""
    rendered.write.mode("append").parquet(out)
    return rendered.sparkSession.read.schema(RENDERED).parquet(out).select("stem", "kind", "width", "height", "error")
