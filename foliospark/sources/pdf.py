"""PDF files behind a replaceable engine: page counts, layout, page images. The offline engine reads page sizes and the
texts and images that pages place itself; its page images are blank."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import schema
from . import pdfread

COUNTS = schema("path string, stem string, n_pages int, error string")
LAYOUT = schema("path string, stem string, page int, mediabox struct<x0:double,y0:double,x1:double,y1:double>, text_elements array<struct<text:string,x:double,y:double>>, image_elements array<struct<name:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, error string")
IMAGES = schema("path string, stem string, page int, width int, height int, png binary, error string")


class PdfEngine(Protocol):
    def pages(self, content: bytes) -> int: ...

    def layout(self, content: bytes, page: int) -> dict: ...

    def raster(self, content: bytes, page: int, longest: int) -> tuple[int, int, bytes]: ...


def fitted(width: float, height: float, longest: int) -> tuple[int, int]:
    """Whole pixels with `longest` on the longer side."""
    scale = longest / max(width, height)
    return max(1, round(width * scale)), max(1, round(height * scale))


def blank_png(width: int, height: int) -> bytes:
    """A white grey-scale image."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress((b"\0" + b"\xff" * width) * height, 9)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


class Offline:
    """Reads files through sources/pdfread.py, each parsed once; its page images are blank. What can't be read, such as an
    encrypted file, is an error."""

    def __init__(self) -> None:
        self._content: bytes | None = None

    def _open(self, content: bytes) -> tuple[pdfread.File, list[dict]]:
        if content is not self._content:
            file = pdfread.File(content)
            self._content, self._file = content, (file, file.pages())
        return self._file

    def pages(self, content: bytes) -> int:
        return len(self._open(content)[1])

    def layout(self, content: bytes, page: int) -> dict:
        file, pages = self._open(content)
        own, placed = pages[page - 1], pdfread.Placed(file)
        placed.run(file.body(own), file.get(own.get("Resources")) or {}, pdfread.State())
        return {"mediabox": dict(zip(("x0", "y0", "x1", "y1"), file.box(own), strict=True)), "text_elements": placed.texts, "image_elements": placed.images}

    def raster(self, content: bytes, page: int, longest: int) -> tuple[int, int, bytes]:
        file, pages = self._open(content)
        x0, y0, x1, y1 = file.box(pages[page - 1])
        width, height = fitted(x1 - x0, y1 - y0, longest)
        return width, height, blank_png(width, height)


def _rows(files: DataFrame, out, make: Callable[[PdfEngine, bytes], Iterator[dict]], open_engine: Callable[[], PdfEngine]) -> DataFrame:
    """Rows of `make` for each file (path, stem, content); a file that fails is one row with an error."""
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = open_engine()
        for batch in batches:
            for path, stem, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                own = {"path": path.as_py(), "stem": stem.as_py()}
                try:
                    rows = [own | {"error": None} | r for r in make(engine, content.as_py() or b"")]
                except Exception as e:  # noqa: BLE001  a file that fails doesn't stop the others
                    rows = [own | {"error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "stem", "content").mapInArrow(run, out)


def page_counts(files: DataFrame, open_engine: Callable[[], PdfEngine] = Offline) -> DataFrame:
    """(path, stem, n_pages, error) of PDF files (path, stem, content)."""
    return _rows(files, COUNTS, lambda e, c: iter([{"n_pages": e.pages(c)}]), open_engine)


def page_layouts(files: DataFrame, open_engine: Callable[[], PdfEngine] = Offline) -> DataFrame:
    """A row for each page: its media box and what stands where, as operators.layout takes it."""
    return _rows(files, LAYOUT, lambda e, c: ({"page": p} | e.layout(c, p) for p in range(1, e.pages(c) + 1)), open_engine)


def page_images(files: DataFrame, longest: int = 1288, open_engine: Callable[[], PdfEngine] = Offline) -> DataFrame:
    """A row for each page: a PNG whose longest side has `longest` pixels."""

    def make(e: PdfEngine, c: bytes) -> Iterator[dict]:
        for p in range(1, e.pages(c) + 1):
            width, height, png = e.raster(c, p, longest)
            yield {"page": p, "width": width, "height": height, "png": png}

    return _rows(files, IMAGES, make, open_engine)
