"""Grey pages out of PNG and PGM bytes, PNG crops, and degradations. Plain numpy; one page at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The PNG signature, and luma weights scaled by 2^16.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LUMA = (19595, 38470, 7471, 32768)


def decode(data: bytes) -> np.ndarray:
    """8-bit grey samples, height x width. Reads PGM (P5) and PNG of 8 bits without interlacing."""
    if data[:2] == b"P5":
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        width, height, _ = fields
        return np.frombuffer(data, np.uint8, width * height, at + 1).reshape(height, width)
    if data[:8] != SIGNATURE:
        raise ValueError("neither PNG nor PGM")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    width, height, bits, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bits != 8 or interlace or channels is None:
        raise ValueError("only 8-bit PNG without palette or interlacing is read")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, channels)
    pixels = out.reshape(height, width, channels)
    return pixels[:, :, 0].copy() if channels < 3 else luma(pixels)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(row) + step, np.int32)  # `step` zeros stand left of the row
    up = np.concatenate([np.zeros(step, np.int32), above.astype(np.int32)])
    for i, value in enumerate(row.tolist(), step):
        left, top, corner = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (left + top) // 2
        else:
            p = left + top - corner
            guess = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
        out[i] = (value + guess) & 0xFF
    return out[step:].astype(np.uint8)


# Fixed value: bits behind the point of a filter weight.
WEIGHT_BITS = 22


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b, half = LUMA
    x = rgb.astype(np.int64)
    return ((x[:, :, 0] * r + x[:, :, 1] * g + x[:, :, 2] * b + half) >> 16).astype(np.uint8)


def encode(page: np.ndarray) -> bytes:
    """A grey PNG."""
    height, width = page.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), page], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _triangle(length: int, size: int) -> np.ndarray:
    """size x length fixed-point weights of a triangle filter that widens with the scale when it shrinks."""
    scale = length / size
    reach = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    low, high = np.maximum((centre - reach + 0.5).astype(int), 0), np.minimum((centre + reach + 0.5).astype(int), length)
    at = np.arange(length)
    weight = np.clip(1 - np.abs((at[None] - centre[:, None] + 0.5) / reach), 0, None) * ((at >= low[:, None]) & (at < high[:, None]))
    return np.floor(weight / weight.sum(axis=1, keepdims=True) * (1 << WEIGHT_BITS) + 0.5).astype(np.int64)


def resize(page: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey page scaled by an antialiased bilinear filter, columns first, rounded to 8 bits after each direction."""
    half = 1 << (WEIGHT_BITS - 1)
    out = page.astype(np.int64)
    if page.shape[1] != width:
        out = np.clip((out @ _triangle(page.shape[1], width).T + half) >> WEIGHT_BITS, 0, 255)
    if page.shape[0] != height:
        out = np.clip((_triangle(page.shape[0], height) @ out + half) >> WEIGHT_BITS, 0, 255)
    return out.astype(np.uint8)


def normalise(page: np.ndarray, size: int = 224) -> np.ndarray:
    """A page scaled to size x size as three equal planes from -1 to 1."""
    v = resize(page, size, size).astype(np.float32)
    return np.repeat(((v / 255 - 0.5) / 0.5)[None].astype(np.float32), 3, axis=0)


def degrade(page: np.ndarray, blur: float = 0.0, angle: float = 0.0, noise: float = 0.0, seed: int = 0) -> np.ndarray:
    """Blur, rotation about the centre onto the ground, and uniform noise; the same seed gives the same page."""
    out = page.astype(float)
    if blur > 0:
        reach = max(1, int(3 * blur))
        kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * blur * blur))
        kernel /= kernel.sum()
        for axis in (0, 1):
            padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            out = sum(k * np.take(padded, range(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    if angle:
        bright = np.bincount(page.ravel(), minlength=256)[128:]
        ground = 255 - int(bright[::-1].argmax())
        t = np.deg2rad(angle)
        cy, cx = (n / 2 for n in page.shape)
        yy, xx = np.mgrid[: page.shape[0], : page.shape[1]]
        sy, sx = np.rint(cy + (yy - cy) * np.cos(t) - (xx - cx) * np.sin(t)).astype(int), np.rint(cx + (yy - cy) * np.sin(t) + (xx - cx) * np.cos(t)).astype(int)
        inside = (sy >= 0) & (sy < page.shape[0]) & (sx >= 0) & (sx < page.shape[1])
        out = np.where(inside, out[np.clip(sy, 0, page.shape[0] - 1), np.clip(sx, 0, page.shape[1] - 1)], ground)
    if noise > 0:
        out = out + np.random.default_rng(seed).uniform(-1, 1, page.shape) * noise
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode_images(files: DataFrame) -> DataFrame:
    """(path, width, height, pixels, error) of (path, content)."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("width", "height", "pixels", "error")}
            for data in batch.column(1).to_pylist():
                try:
                    page = decode(data or b"")
                    row = (page.shape[1], page.shape[0], page.tobytes(), None)
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as why:
                    row = (None, None, None, str(why))
                for k, v in zip(rows, row, strict=True):
                    rows[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], ["path", *rows])

    return files.select("path", "content").mapInArrow(run, "path string, width bigint, height bigint, pixels binary, error string")


def crops(pages: DataFrame) -> DataFrame:
    """pages (key, width, height, pixels, x, y, w, h) to (key, png)."""

    def run(batches):
        for batch in batches:
            out = []
            for _, width, height, pixels, x, y, w, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = np.frombuffer(pixels, np.uint8).reshape(height, width)
                out.append(encode(page[y : y + h, x : x + w]))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["key", "png"])

    return pages.select("key", "width", "height", "pixels", "x", "y", "w", "h").mapInArrow(run, "key string, png binary")


def crops_of(where: DataFrame, page: np.ndarray) -> DataFrame:
    """where (key, x, y, w, h) on one page to (key, png); the page goes to each task once, not with each row."""

    def run(batches):
        for batch in batches:
            out = [encode(page[y : y + h, x : x + w]) for x, y, w, h in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["key", "png"])

    return where.select("key", "x", "y", "w", "h").mapInArrow(run, "key string, png binary")
