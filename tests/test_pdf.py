"""PDF files made here, in each way that files are put together."""

from __future__ import annotations

import random
import struct
import zlib

import pytest
from foliospark.operators import layout
from foliospark.plans import jobs
from foliospark.sources import pdf, pdfread, readers

BODIES = [b"BT 10 20 Td (first) Tj ET", b"BT 30 40 Td (second) Tj ET"]


def objects(bodies: list[bytes] = BODIES, about: bytes = b"") -> dict[int, bytes]:
    """A catalogue, a tree of two levels whose pages aren't in the order of their numbers, and contents."""
    n = len(bodies)
    pages = [10 + 2 * (n - k) for k in range(n)]  # falling numbers
    out = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Kids[3 0 R]/Count %d/MediaBox[0 0 600 800]>>" % n,
        3: b"<</Type/Pages/Parent 2 0 R/Kids[%s]/Count %d %s>>" % (b" ".join(b"%d 0 R" % p for p in pages), n, about),
    }
    for p, body in zip(pages, bodies, strict=True):
        out[p] = b"<</Type/Page/Parent 3 0 R/Contents %d 0 R>>" % (p + 1)
        packed = zlib.compress(body)
        out[p + 1] = b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(packed), packed)
    return out


def with_table(parts: dict[int, bytes], extra: bytes = b"") -> bytes:
    """A file with a plain cross-reference table."""
    out, places = b"%PDF-1.4\n", {}
    for n, body in parts.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at, size = len(out), max(parts) + 1
    rows = b"".join(b"%010d %05d %s \n" % ((places[k], 0, b"n") if k in places else (0, 65535, b"f")) for k in range(size))
    return out + b"xref\n0 %d\n%strailer <</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (size, rows, size, extra, at)


def with_streams(parts: dict[int, bytes], predictor: int = 12) -> bytes:
    """A file whose objects but streams are packed, with a cross-reference stream under a PNG predictor."""
    loose = {n: b for n, b in parts.items() if b"stream" in b}
    inner = {n: b for n, b in parts.items() if n not in loose}
    pack, table = max(parts) + 1, max(parts) + 2
    heads, body = [], b""
    for n, b in inner.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += b + b" "
    head = b" ".join(heads) + b" "
    packed = zlib.compress(head + body)
    loose[pack] = b"<</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(inner), len(head), len(packed), packed)
    out, places = b"%PDF-1.5\n", {}
    for n, b in loose.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    places[table] = len(out)
    order = list(inner)
    rows = [struct.pack(">BIB", *((2, pack, order.index(k)) if k in inner else (1, places[k], 0) if k in places else (0, 0, 0))) for k in range(table + 1)]
    coded, before = b"", bytes(6)
    for r in rows:
        guess = {10: lambda i, r=r: 0, 11: lambda i, r=r: r[i - 1] if i else 0, 12: lambda i, b=before: b[i]}[predictor]
        coded += bytes([predictor - 10]) + bytes((x - guess(i)) & 255 for i, x in enumerate(r))
        before = r
    packed = zlib.compress(coded)
    out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 1]/Root 1 0 R/Length %d/Filter/FlateDecode/DecodeParms<</Predictor %d/Columns 6>>>>stream\n%s\nendstream\nendobj\n" % (table, table + 1, len(packed), predictor, packed)
    return out + b"startxref\n%d\n%%%%EOF" % places[table]


def without_table(parts: dict[int, bytes]) -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in parts.items())


@pytest.mark.parametrize("make", [with_table, lambda p: with_streams(p, 10), lambda p: with_streams(p, 11), with_streams, without_table, lambda p: with_streams(p)[:-20]])
def test_pages_of_every_kind_of_file(make):
    content, engine = make(objects()), pdf.Offline()
    assert engine.pages(content) == 2
    one, two = (engine.layout(content, k) for k in (1, 2))
    assert one["mediabox"] == {"x0": 0.0, "y0": 0.0, "x1": 600.0, "y1": 800.0}
    assert one["text_elements"] == [{"text": "first", "x": 10.0, "y": 20.0}] and two["text_elements"][0]["text"] == "second"
    assert engine.raster(content, 1, 400)[:2] == (300, 400)


def test_later_tables_hold(spark, tmp_path):
    """An update at the end of a file: a new first page, the old table through Prev."""
    old = with_table(objects())
    start = int(old.split(b"startxref\n")[1].split()[0])
    body = b"BT 1 2 Td (new) Tj ET"
    at = len(old) + 1
    new = old + b"\n15 0 obj\n<</Length %d>>stream\n%s\nendstream\nendobj\n" % (len(body), body)
    new += b"xref\n15 1\n%010d 00000 n \ntrailer <</Size 16/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, start, len(new))
    assert [t["text"] for k in (1, 2) for t in pdf.Offline().layout(new, k)["text_elements"]] == ["new", "second"]
    folder = tmp_path / "HC"
    folder.mkdir()
    (folder / "packed.pdf").write_bytes(with_streams(objects()))
    (folder / "locked.pdf").write_bytes(with_table(objects(), b"/Encrypt 9 0 R") .replace(b"9 0 R", b"<<>>"))
    (folder / "empty.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    got = {r.pdf_name: (r.n_pages, r.error) for r in jobs.count_pages(spark, str(tmp_path)).collect()}
    assert got == {"packed": (2, None), "locked": (None, "the file is encrypted"), "empty": (None, "no pages")}
    rows = pdf.page_layouts(readers.read_files(spark, str(tmp_path)))
    assert {(r.stem, r.page) for r in rows.where("error is null").collect()} == {("packed", 1), ("packed", 2)}


def placed(body: bytes, parts: dict[int, bytes] | None = None, about: bytes = b"") -> tuple[list, list]:
    got = pdf.Offline().layout(with_table(objects([body], about) | (parts or {})), 1)
    return [(t["text"], t["x"], t["y"]) for t in got["text_elements"]], [(i["name"], *i["bbox"].values()) for i in got["image_elements"]]


def test_graphics_state():
    assert placed(b"q 2 0 0 2 10 10 cm 100 0 0 50 5 5 cm /Im Do Q /Im Do")[1] == [("Im", 20, 20, 220, 120), ("Im", 0, 0, 1, 1)]
    assert placed(b"0 1 -1 0 100 0 cm 10 0 0 20 0 0 cm /Im Do")[1] == [("Im", 80, 0, 100, 10)]  # a quarter turn
    assert placed(b"q 2 0 0 2 10 10 cm BT 5 5 Td (a) Tj ET Q BT 1 0 0 1 3 4 Tm (b) Tj ET")[0] == [("a", 20, 20), ("b", 3, 4)]
    assert placed(b"BT [(Hel) -20 (lo)] TJ [(two) -300 (words)] TJ <4869> Tj ET")[0] == [("Hello", 0, 0), ("two words", 0, 0), ("Hi", 0, 0)]
    lines = b"BT 14 TL 72 700 Td (a) Tj T* (b) Tj (c) ' 1 2 (d) \" 0 -10 TD (e) Tj T* (f) Tj ET"
    assert placed(lines)[0] == [("a", 72, 700), ("b", 72, 686), ("c", 72, 672), ("d", 72, 658), ("e", 72, 648), ("f", 72, 638)]
    assert placed(rb"BT (a\(b\)\\(c)\101\n\
d) Tj ET")[0] == [("a(b)\\(c)A\nd", 0, 0)]
    assert placed(b"BI /W 1 /H 1 ID \x00(Q EI BT (after) Tj ET")[0] == [("after", 0, 0)]
    with pytest.raises(ValueError, match="operands of Td"):
        placed(b"BT (x) Td ET")


def test_fonts_and_forms():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079>] endbfrange endcmap"
    stream = lambda head, body: b"<<%s/Length %d>>stream\n%s\nendstream" % (head, len(body), body)
    parts = {
        50: b"<</Type/Font/Subtype/Type0/ToUnicode 51 0 R>>", 51: stream(b"", cmap),
        52: b"<</Type/Font/Subtype/TrueType/FirstChar 97/Widths[500 250]>>",
        53: stream(b"/Subtype/Form/Matrix[1 0 0 1 7 7]/Resources<</XObject<</In 54 0 R>>>>", b"q 4 0 0 4 0 0 cm /In Do Q BT (in) Tj ET"),
        54: stream(b"/Subtype/Image", b"x"),
    }
    about = b"/Resources<</Font<</F 50 0 R/G 52 0 R>>/XObject<</Fm 53 0 R/Im 54 0 R>>>>"
    texts, images = placed(b"q BT /F 10 Tf <00010010001200200021> Tj ET Q q 2 0 0 2 0 0 cm /Fm Do Q 3 0 0 3 0 0 cm /Im Do", parts, about)
    assert texts == [("HiACxy", 0, 0), ("in", 14, 14)]
    assert images == [("In", 14, 14, 22, 22), ("Im", 0, 0, 3, 3)]
    assert placed(b"BT /G 10 Tf (ab) Tj (a) Tj [(a) 1000 (b)] TJ (b) Tj ET", parts, about)[0] == [("ab", 0, 0), ("a", 7.5, 0), ("ab", 12.5, 0), ("b", 10, 0)]


def test_predictors_and_filters():
    rng = random.Random(1)
    rows, width, pixel = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(9)], 12, 3
    coded, before = b"", bytes(width)
    for k, r in enumerate(rows):
        kind, line = k % 5, bytearray()
        for i, x in enumerate(r):
            a, b, c = (r[i - pixel] if i >= pixel else 0), before[i], (before[i - pixel] if i >= pixel else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        coded, before = coded + bytes([kind]) + line, r
    file = pdfread.File(with_table(objects()))
    data = lambda raw, **about: file.data(pdfread.Stream(about, raw))
    assert data(zlib.compress(coded), Filter=pdfread.Name("FlateDecode"), DecodeParms={"Predictor": 15, "Colors": 3, "Columns": 4}) == b"".join(rows)
    assert data(b"48 69>", Filter=["ASCIIHexDecode"]) == b"Hi" and data(b"87cURDZ~>", Filter="ASCII85Decode") == b"Hello"
    with pytest.raises(ValueError, match="filter JBIG2Decode"):
        data(b"", Filter="JBIG2Decode")


def test_broken_files_end(tmp_path):
    """Cut or changed files give an answer or a ValueError, and end."""
    whole, rng = with_streams(objects()), random.Random(3)
    for make in [lambda: whole[: rng.randrange(len(whole))], lambda: (b := bytearray(whole), b.__setitem__(rng.randrange(len(b)), rng.randrange(256)), bytes(b))[2]] * 150:
        engine, content = pdf.Offline(), make()
        try:
            for p in range(1, engine.pages(content) + 1):
                engine.layout(content, p)
        except Exception as e:  # noqa: BLE001
            assert isinstance(e, (ValueError, EOFError, TypeError, KeyError, AttributeError, zlib.error, IndexError)), e


def test_layouts_make_anchors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(with_streams(objects([b"q 200 0 0 100 50 600 cm /Im Do Q BT 72 500 Td (A line of text) Tj ET"])))
    rows = pdf.page_layouts(readers.read_files(spark, str(tmp_path)))
    assert hasattr(layout, "anchor_text") and rows.first().text_elements[0].text == "A line of text"
