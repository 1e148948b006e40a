"""Motion-JPEG in AVI as a media column: lossless frames, RIFF indexes, and shots.

The frames are lossless JPEG (SOF3, predictor 1, 8-bit grey samples) with a Huffman table for the differences of prose.
The reader takes any table: all frames of a batch that share one are decoded side by side, a sample of each at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regionflow.llm.common import byte_rows, map_batches

WIDTH, HEIGHT, RATE = 16, 12, 25
UNIT = WIDTH * HEIGHT

# Fixed values of the formats: JPEG markers, AVI flags.
SOI, EOI, SOF3, DHT, SOS, DRI = 0xD8, 0xD9, 0xC3, 0xC4, 0xDA, 0xDD
HAS_INDEX, KEY_FRAME = 0x10, 0x10

#: How often a difference of neighbouring bytes takes 0, 1, ... 8 bits, in a thousand of prose.
COUNTS = (29, 54, 59, 169, 256, 76, 44, 297, 15)


def code_lengths(counts: tuple[int, ...]) -> dict[int, int]:
    """Huffman code length of each category; one place stays free, as a code of ones only isn't allowed."""
    heap = [(n, k, [k]) for k, n in enumerate(counts)] + [(0, -1, [-1])]
    heapq.heapify(heap)
    length = dict.fromkeys(range(-1, len(counts)), 0)
    while len(heap) > 1:
        one, other = heapq.heappop(heap), heapq.heappop(heap)
        for k in one[2] + other[2]:
            length[k] += 1
        heapq.heappush(heap, (one[0] + other[0], one[1], one[2] + other[2]))
    del length[-1]
    return length


LENGTHS = code_lengths(COUNTS)


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Category to (code, length), codes given out in order of length."""
    out, code, before = {}, 0, 0
    for category, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - before if before else 0
        out[category] = (code, length)
        code, before = code + 1, length
    return out


def _words(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each difference, at index + 255, and how many they are."""
    codes = _canonical(lengths)
    word, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        word[d + 255] = (codes[s][0] << s) | (d if d >= 0 else d + (1 << s) - 1)
        size[d + 255] = codes[s][1] + s
    return word, size


_WORD, _SIZE = _words(LENGTHS)


def _marker(kind: int, body: bytes = b"") -> bytes:
    return bytes([0xFF, kind]) + (struct.pack(">H", len(body) + 2) + body if body else b"")


def _head() -> bytes:
    by_length = [sum(x == n for x in LENGTHS.values()) for n in range(1, 17)]
    values = [s for s, _ in sorted(LENGTHS.items(), key=lambda x: (x[1], x[0]))]
    return (
        _marker(SOI)
        + _marker(DHT, bytes([0, *by_length, *values]))
        + _marker(SOF3, struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
        + _marker(SOS, bytes([1, 1, 0, 1, 0, 0]))
    )


_HEAD, _TAIL = _head(), _marker(EOI)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def pad(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of a frame's samples."""
    return data + b" " * ((-len(data)) % UNIT or UNIT * (not data))


def scans(x: np.ndarray) -> list[bytes]:
    """The entropy-coded data of frames (count x HEIGHT x WIDTH)."""
    x = x.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(len(x), -1) + 255
    word, size = _WORD[d], _SIZE[d]
    ends = np.cumsum(size, axis=1)
    many = (ends[:, -1] + 7) // 8
    begin = np.cumsum(many) - many
    at = (8 * begin[:, None] + ends - size).ravel()
    bits = word.ravel().astype(np.uint64) << (32 - size.ravel() - (at & 7)).astype(np.uint64)
    out = np.zeros(int(many.sum()) + 4)
    for k in range(4):  # samples share bytes but no bits, so sums are unions
        out += np.bincount((at >> 3) + k, ((bits >> np.uint64(24 - 8 * k)) & np.uint64(0xFF)).astype(float), len(out))
    out = out[:-4].astype(np.uint8)
    out[begin + many - 1] |= ((1 << (8 * many - ends[:, -1])) - 1).astype(np.uint8)
    raw, cuts = out.tobytes(), begin.tolist()
    return [raw[i:j].replace(b"\xff", b"\xff\0") for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def write_all(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; its frames hold the payload, one byte a sample. Lengths must be positive multiples of UNIT."""
    many = [len(p) // UNIT for p in payloads]
    coded = scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, HEIGHT, WIDTH)) if payloads else []
    ends = np.cumsum(many).tolist()
    return [_file([_HEAD + scan + _TAIL for scan in coded[end - n : end]]) for n, end in zip(many, ends, strict=True)]


def write(payload: bytes) -> bytes:
    return write_all([payload])[0]


def _file(x: list[bytes]) -> bytes:
    """The AVI file of JPEG frames."""
    chunks = [_chunk(b"00dc", frame) for frame in x]
    sizes, movi = np.array([len(frame) for frame in x]), b"".join(chunks)
    starts = np.cumsum([4, *map(len, chunks)])[:-1]
    index = np.empty((len(x), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1], index[:, 2], index[:, 3] = KEY_FRAME, starts, sizes
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, HAS_INDEX, len(x), 0, 1, int(sizes.max()), WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(x), int(sizes.max()), 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes()))


@dataclass
class Layout:
    """What the RIFF chunks say: frame places in the file, size and rate."""

    starts: np.ndarray
    sizes: np.ndarray
    width: int
    height: int
    rate: float


def parse(media: bytes) -> Layout:
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    rate, movi, index = float(RATE), -1, None
    todo = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                micros, *_ = struct.unpack_from("<I", media, at + 8)
                rate = 1e6 / micros if micros else rate
                width, height = struct.unpack_from("<2I", media, at + 8 + 32)
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + size % 2
    if movi < 0:
        raise ValueError("no movi list")
    if index is None:
        return Layout(*_walk(media, movi), width, height, rate)
    index = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    return Layout(index[:, 2].astype(np.int64) + movi + 8, index[:, 3].astype(np.int64), width, height, rate)


def _walk(media: bytes, movi: int) -> tuple[np.ndarray, np.ndarray]:
    """Frame places of a file without an index, chunk by chunk; `movi` is where the list's kind stands."""
    at, end = movi + 4, min(len(media), movi + struct.unpack_from("<I", media, movi - 4)[0])
    starts, sizes = [], []
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST":  # frames may be grouped
            at += 12
            continue
        if name == b"00dc":
            starts.append(at + 8)
            sizes.append(size)
        at += 8 + size + size % 2
    return np.array(starts, np.int64), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Head:
    """What stands before a frame's scan: its size in bytes, the samples, and the Huffman table as (code, length, category)."""

    size: int
    height: int
    width: int
    table: tuple[tuple[int, int, int], ...]


def head(jpeg: bytes) -> Head:
    """The head of any one-component lossless JPEG with predictor 1 and no restarts."""
    if jpeg[:2] != _marker(SOI):
        raise ValueError("not a JPEG frame")
    at, tables, shape = 2, {}, None
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a JPEG frame ends in its head")
        kind, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == DHT:
            while body:
                lengths = [n + 1 for n, c in enumerate(body[1:17]) for _ in range(c)]
                code, before, table = 0, lengths[0], []
                for value, length in zip(body[17:], lengths, strict=False):
                    code <<= length - before
                    table.append((code, length, value))
                    code, before = code + 1, length
                tables[body[0] & 15] = tuple(table)
                body = body[17 + len(lengths) :]
        elif kind == SOF3:
            precision, height, width, components = struct.unpack_from(">BHHB", body)
            if precision != 8 or components != 1:
                raise ValueError("frames are read with one component of 8 bits")
            shape = height, width
        elif kind == SOS:
            if shape is None or body[2] >> 4 not in tables or body[3] != 1:
                raise ValueError("a scan without a size, a table or predictor 1")
            return Head(at, *shape, tables[body[2] >> 4])
        elif kind == DRI or 0xC0 <= kind <= 0xCF:
            raise ValueError(f"marker {kind:#x} is not read")


@lru_cache(64)
def _lookup(table: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: length of the code that they begin with (0: none), and its category."""
    length, category = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    for code, n, value in table:
        low = code << (16 - n)
        length[low : low + (1 << (16 - n))], category[low : low + (1 << (16 - n))] = n, value
    return length, category


def decode(of: Head, coded: list[bytes]) -> np.ndarray:
    """Samples of frames with one head, from the data of their scans, a sample of every frame at a time."""
    length, category = _lookup(of.table)
    parts = [x.replace(b"\xff\0", b"\xff") for x in coded]
    buffer = np.frombuffer(b"".join(x + bytes(8) for x in parts), np.uint8)
    sizes = np.array([len(x) for x in parts])
    windows = np.zeros(max(len(buffer) - 7, 0), np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        windows |= buffer[k : len(windows) + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    begin = np.cumsum(sizes + 8) - sizes - 8
    at, end = 8 * begin, 8 * (begin + sizes)
    d = np.empty((of.height * of.width, len(parts)), np.int64)
    one, whole = np.uint64(1), np.uint64(64)
    for i in range(len(d)):
        bits = windows[at >> 3] << (at & 7).astype(np.uint64)
        code = (bits >> np.uint64(48)).astype(np.int64)
        n, s = length[code], category[code]
        extra = np.where(s > 0, (bits << n) >> (whole - np.maximum(s, one)), np.uint64(0)).astype(np.int64)
        span = np.int64(1) << s.astype(np.int64)
        d[i] = np.where(2 * extra >= span, extra, extra - span + 1)
        at = at + (n + s).astype(np.int64)
        if not n.all() or (at > end).any():
            raise ValueError("a scan holds no code, or ends early")
    return _samples(d.T.reshape(len(parts), of.height, of.width))


def _samples(d: np.ndarray) -> np.ndarray:
    """Undo the prediction: first column from above, the rest from the left."""
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    np.cumsum(d[:, :, 0], axis=1, out=d[:, :, 0])
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


def frames_of(media: list[bytes]) -> list[np.ndarray | ValueError]:
    """Samples of all frames of each file (count x height x width), or why it can't be read."""
    out: list[np.ndarray | ValueError] = []
    groups: dict[Head, list[tuple[int, int, bytes]]] = {}
    for i, file in enumerate(media):
        try:
            layout = parse(file)
            pieces, known, own = [], b"", None
            for k, (a, n) in enumerate(zip(layout.starts.tolist(), layout.sizes.tolist(), strict=True)):
                if own is None or not file.startswith(known, a):
                    own = head(file[a : a + n])
                    known = file[a : a + own.size]
                end = file.rfind(_TAIL, a + own.size, a + n)
                if end < 0:
                    raise ValueError("a frame without an end")
                pieces.append((own, (i, k, file[a + own.size : end])))
            if len({(x.height, x.width) for x, _ in pieces}) > 1:
                raise ValueError("frames of several sizes")
            shape = (pieces[0][0].height, pieces[0][0].width) if pieces else (layout.height, layout.width)
            out.append(np.empty((len(pieces), *shape), np.uint8))
            for own, piece in pieces:
                groups.setdefault(own, []).append(piece)
        except (ValueError, struct.error, IndexError) as why:
            out.append(ValueError(f"unreadable: {why}"))
    for own, pieces in groups.items():
        _place(own, pieces, out)
    return out


def _place(own: Head, pieces: list[tuple[int, int, bytes]], out: list[np.ndarray | ValueError]) -> None:
    """Decode pieces (file, frame, scan) into out; where a file's scans are damaged, the others are decoded without it."""
    try:
        samples = decode(own, [x for *_, x in pieces])
    except ValueError as why:
        files = {i for i, *_ in pieces}
        if len(files) == 1:
            out[files.pop()] = ValueError(f"unreadable: {why}")
            return
        for i in files:
            _place(own, [x for x in pieces if x[0] == i], out)
        return
    for (i, k, _), x in zip(pieces, samples, strict=True):
        if not isinstance(out[i], ValueError):
            out[i][k] = x


def frames(media: bytes) -> np.ndarray:
    """Samples of all frames: count x height x width."""
    found = frames_of([media])[0]
    if isinstance(found, ValueError):
        raise found
    return found


def shots(x: np.ndarray, bins: int = 16, memory: int = 24, k: float = 3.0, floor: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and each frame's histogram difference (0 to 1) from the one before.

    A cut stands where the difference exceeds `floor` and the mean of the last `memory` differences by k of
    their standard deviations, so that restless stretches need larger jumps.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    flat = x.reshape(n, -1)
    level = (flat >> (8 - int(np.log2(bins)))) + (np.arange(n) * bins)[:, None]
    h = np.bincount(level.ravel(), minlength=n * bins).reshape(n, bins)
    d = np.zeros(n)
    d[1:] = np.abs(np.diff(h, axis=0)).sum(1) / (2 * flat.shape[1])
    sums, squares = np.cumsum(np.r_[0, d]), np.cumsum(np.r_[0, d * d])
    at = np.arange(n)
    low = np.maximum(1, at - memory)
    count = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / count
    spread = np.sqrt(np.maximum((squares[at] - squares[low]) / count - mean * mean, 0))
    cut = (d > floor) & (d > mean + k * spread) & (at > 0)
    return np.r_[0, np.flatnonzero(cut)], d


def write_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media). A null text is empty; an empty one is a frame of spaces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = byte_rows(batch.column(1))
        media = pa.array(write_all([pad(b) for b in raw]), pa.binary())
        return pa.record_batch([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), media], [id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: (id, clip, first_frame, n_frames, start_s, end_s, change, mean_level, error). A null medium or one
    without frames has none; one that can't be read has a row with the error alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in ("at", "clip", "first", "n", "start", "end", "change", "level", "error")}
        media = batch.column(1).to_pylist()
        present = [i for i, x in enumerate(media) if x is not None]
        for i, x in zip(present, frames_of([media[i] for i in present]), strict=True):
            if isinstance(x, ValueError):
                found = [(i, *[None] * 7, str(x))]
            else:
                rate = parse(media[i]).rate
                first, d = shots(x)
                ends = np.r_[first[1:], len(x)]
                found = [(i, c, a, b - a, a / rate, b / rate, float(d[a]), float(x[a:b].mean()), None) for c, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=False))]
            for row in found:
                for k, v in zip(rows, row, strict=True):
                    rows[k].append(v)
        own = batch.column(0).take(pa.array(rows.pop("at"), pa.int64()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string())
        return pa.record_batch([own, *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], [id_col, "clip", "first_frame", "n_frames", "start_s", "end_s", "change", "mean_level", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, media_col), run, f"`{id_col}` {kind}, clip bigint, first_frame bigint, n_frames bigint, start_s double, end_s double, change double, mean_level double, error string")


def features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """A row for each medium: what its frames hold, read back from the stored bytes, and its shots in short. A medium that
    can't be read has a null payload, and the reason as its feature; one without frames, an empty payload."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        stored = byte_rows(batch.column(2))
        for media, x in zip(stored, frames_of(stored), strict=True):
            if isinstance(x, ValueError):
                row = (None, None, None, len(media), hashlib.sha256(media).hexdigest(), str(x))
            else:
                payload = x.tobytes()
                first, d = shots(x)
                longest = int(np.diff(np.r_[first, len(x)]).max(initial=0))
                short = f"frames={len(x)};shots={len(first)};change={d.sum():.4f};level={x.mean() if x.size else 0:.3f};longest={longest}"
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), short)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], [id_col, size_col, *out])

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, size_col, media_col), run, f"`{id_col}` {kind}, `{size_col}` bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
