"""Pixels of PNG images: decoded, resized, encoded, with numpy inside a task."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type (fixed values of the format).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an image that is decoded at most; a larger one is an error, not a worker's end.
MOST_PIXELS = 200_000_000


def _chunks(png: bytes) -> list[tuple[bytes, bytes]]:
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    out, at = [], len(SIGNATURE)
    while at + 8 <= len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        out.append((kind, png[at + 8 : at + 8 + size]))
        at += size + 12
    return out


def unfiltered(rows: np.ndarray, kinds: np.ndarray, pixel: int) -> np.ndarray:
    """Rows of bytes (height, bytes) with their filters undone. A byte needs those of the pixel to its left and of the row
    above, so all rows are done at once along diagonals where a row needs more than the one above."""
    height, width = rows.shape
    if not (kinds > 1).any():
        out = rows.reshape(height, -1, pixel)
        out = np.where((kinds == 1)[:, None, None], np.cumsum(out, axis=1, dtype=np.uint8), out)
        return out.reshape(height, width)
    x_count = width // pixel
    given = rows.reshape(height, x_count, pixel).astype(np.int16)
    out = np.zeros((height + 1, x_count + 1, pixel), np.int16)
    for t in range(height + x_count - 1):
        r = np.arange(max(0, t - x_count + 1), min(height, t + 1))
        x, kind = t - r, kinds[r][:, None]
        left, up, corner = out[r + 1, x], out[r, x + 1], out[r, x]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        out[r + 1, x + 1] = (given[r, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width)


def decoded(png: bytes) -> np.ndarray:
    """(height, width, 3): the colours of an image; transparency is left out, of 16 bits the upper 8 count."""
    chunks = _chunks(png)
    if not chunks or chunks[0][0] != b"IHDR":
        raise ValueError("no image header")
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunks[0][1])
    if laced or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ValueError("interlaced" if laced else f"colour type {colour} of {depth} bits isn't known")
    if width * height > MOST_PIXELS or not width * height:
        raise ValueError(f"{width} by {height} pixels")
    channels = CHANNELS[colour]
    row, pixel = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    data = np.frombuffer(zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT")), np.uint8)
    if len(data) < height * (row + 1):
        raise ValueError("pixels are missing")
    data = data[: height * (row + 1)].reshape(height, row + 1)
    plain = unfiltered(data[:, 1:], data[:, 0], pixel)
    if depth == 16:
        plain = plain[:, ::2]
    elif depth < 8:
        plain = np.unpackbits(plain, axis=1).reshape(height, -1, depth)
        plain = (plain * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, : width * channels]
        if colour != 3:
            plain = plain * np.uint8(255 // ((1 << depth) - 1))
    plain = plain.reshape(height, width, channels)
    if colour == 3:
        palette = np.frombuffer(next(body for kind, body in chunks if kind == b"PLTE"), np.uint8).reshape(-1, 3)
        return palette[plain[:, :, 0]]
    return np.repeat(plain[:, :, :1], 3, axis=2) if channels < 3 else plain[:, :, :3]


def encoded(image: np.ndarray) -> bytes:
    """A PNG of (height, width, 3); each row says how it differs from the one above."""
    height, width, _ = image.shape
    rows = image.reshape(height, -1)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, width * 3), np.uint8))
    body = np.concatenate([np.full((height, 1), 2, np.uint8), up], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def _taps(size: int, to: int, lobes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each of `to` pixels, which of `size` it is made of, and their weights: a Lanczos window as wide as the scale asks."""
    scale = max(1.0, size / to)
    centre = (np.arange(to) + 0.5) * size / to - 0.5
    first = np.ceil(centre - lobes * scale).astype(int)
    at = first[:, None] + np.arange(math.floor(2 * lobes * scale) + 1)
    x = (at - centre[:, None]) / scale
    weight = np.where(abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0) * ((at >= 0) & (at < size))
    return np.clip(at, 0, size - 1), weight / weight.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image in another size, along rows, then along columns."""
    out = image.astype(np.float32)
    for axis, to in ((1, width), (0, height)):
        at, weight = _taps(out.shape[axis], to)
        shape = [-1 if a == axis else 1 for a in range(3)]
        out = sum(np.take(out, at[:, k], axis=axis) * weight[:, k].astype(np.float32).reshape(shape) for k in range(at.shape[1]))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def fitted_png(png: bytes, most: int) -> tuple[int, int, bytes]:
    """(width, height, png) with the longer edge at most `most`, fractions of pixels cut off; an image that fits stays in
    its size. Colours only."""
    image = decoded(png)
    height, width, _ = image.shape
    longest = max(width, height)
    if longest > most:
        width, height = (max(1, math.floor(n * (most / longest))) for n in (width, height))
        image = resized(image, width, height)
    return width, height, encoded(image)
