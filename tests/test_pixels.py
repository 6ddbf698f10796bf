"""Images: every filter and colour type against plain loops; sizes; files that can't be read."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from foliospark.functions import pixels
from foliospark.functions.geometry import fit_size
from foliospark.sources import images, pdf
from pyspark.sql import functions as F


def png(width, height, depth, colour, rows, palette=b""):
    """A PNG of rows of bytes whose filters go round, written with plain loops."""
    pixel, body, before = max(1, pixels.CHANNELS[colour] * depth // 8), b"", bytes(len(rows[0]))
    for k, row in enumerate(rows):
        kind, line = k % 5, bytearray()
        for i, v in enumerate(row):
            a, b, c = (row[i - pixel] if i >= pixel else 0), before[i], (before[i - pixel] if i >= pixel else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        body, before = body + bytes([kind]) + bytes(line), row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    half = len(z := zlib.compress(body)) // 2  # in two chunks
    return pixels.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", z[:half]) + chunk(b"IDAT", z[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "depth"), [(0, 8), (0, 16), (0, 4), (0, 1), (2, 8), (2, 16), (3, 8), (3, 2), (4, 8), (6, 8)])
def test_decoding(colour, depth):
    rng, width, height = random.Random(colour * 20 + depth), 13, 11
    n = pixels.CHANNELS[colour]
    palette = bytes(rng.randrange(256) for _ in range(3 * (1 << min(depth, 8)))) if colour == 3 else b""
    values = [[[rng.randrange(1 << depth) for _ in range(n)] for _ in range(width)] for _ in range(height)]
    rows = []
    for line in values:
        bits = "".join(f"{v:0{depth}b}" for p in line for v in p)
        bits += "0" * (-len(bits) % 8)
        rows.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    plain = lambda v: v >> 8 if depth == 16 else v * (255 // ((1 << depth) - 1))
    want = [[tuple(palette[3 * p[0] : 3 * p[0] + 3]) if colour == 3 else tuple(plain(v) for v in (p[:3] if n > 2 else p[:1] * 3)) for p in line] for line in values]
    got = pixels.decoded(png(width, height, depth, colour, rows, palette))
    assert [[tuple(int(v) for v in p) for p in line] for line in got] == want
    assert (pixels.decoded(pixels.encoded(got)) == got).all()


def plain_resize(image, width, height):
    """Lanczos windows by plain loops, in double precision."""
    def weights(size, to, k):
        scale = max(1.0, size / to)
        c = (k + 0.5) * size / to - 0.5
        w = {i: np.sinc((i - c) / scale) * np.sinc((i - c) / scale / 3) for i in range(size) if abs(i - c) / scale < 3}
        total = sum(w.values())
        return {i: x / total for i, x in w.items()}

    across = [weights(image.shape[1], width, k) for k in range(width)]
    down = [weights(image.shape[0], height, k) for k in range(height)]
    rows = np.array([[sum(w * line[i].astype(float) for i, w in ws.items()) for ws in across] for line in image])
    return np.clip(np.rint([sum(w * rows[i] for i, w in ws.items()) for ws in down]), 0, 255)


def test_resizing():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (23, 31, 3), dtype=np.uint8)
    for width, height in ((10, 7), (31, 23), (30, 1)):
        assert abs(pixels.resized(image, width, height).astype(float) - plain_resize(image, width, height)).max() <= 1
    flat = np.full((50, 70, 3), 77, np.uint8)
    assert (pixels.resized(flat, 12, 9) == 77).all()


def test_images_are_fitted(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = {"wide": (1300, 40), "tall": (33, 2577), "small": (20, 10), "edge": (1288, 5)}
    for stem, (w, h) in sizes.items():
        (tmp_path / f"{stem}.png").write_bytes(pixels.encoded(rng.integers(0, 256, (h, w, 3), dtype=np.uint8)))
    (tmp_path / "blank.png").write_bytes(pdf.blank_png(3000, 1500))
    (tmp_path / "none.png").write_bytes(b"no image")
    (tmp_path / "cut.png").write_bytes(pixels.encoded(rng.integers(0, 256, (9, 9, 3), dtype=np.uint8))[:90])
    made = {r.stem: r for r in images.save_images(spark, str(tmp_path), f"{tmp_path}/out").collect()}
    assert made["none"].error == "not a PNG file" and made["cut"].error and made["none"].width is None
    frame = spark.createDataFrame([(s, *wh) for s, wh in sizes.items()], "stem string, w int, h int")
    want = {r.stem: tuple(r.s) for r in frame.select("stem", fit_size(F.col("w"), F.col("h")).alias("s")).collect()}
    assert {s: (made[s].width, made[s].height) for s in sizes} == want and (made["blank"].width, made["blank"].height) == (1288, 644)
    table = {r.stem: r.png for r in spark.read.parquet(f"{tmp_path}/out").where("error is null").collect()}
    assert all(pixels.decoded(table[s]).shape == (want[s][1], want[s][0], 3) for s in sizes) and (pixels.decoded(table["blank"]) == 255).all()
    assert (pixels.decoded(table["small"]) == pixels.decoded((tmp_path / "small.png").read_bytes())).all()


def test_limits():
    with pytest.raises(ValueError, match="pixels"):
        pixels.decoded(pixels.SIGNATURE + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 1 << 20, 1 << 20, 8, 2, 0, 0, 0) + b"\0" * 4)
    with pytest.raises(ValueError, match="isn't known"):
        pixels.decoded(pixels.SIGNATURE + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 1, 1, 8, 5, 0, 0, 0) + b"\0" * 4)
