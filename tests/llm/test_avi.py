from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from regionflow.llm import avi


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_round_trip(data):
    payload = avi.pad(data)
    media = avi.write(payload)
    layout = avi.parse(media)
    assert len(payload) % avi.UNIT == 0 and payload
    assert (layout.width, layout.height, layout.rate) == (avi.WIDTH, avi.HEIGHT, avi.RATE)
    assert avi.frames(media).tobytes() == payload


def test_stuffed_frames():
    payload = bytes([0, 255] * 96 * 5)  # differences of 255 need stuffing
    media = avi.write(payload)
    assert avi.frames(media).tobytes() == payload


def test_any_huffman_table_is_read():
    """A frame with another table, written bit by bit."""
    samples = np.random.default_rng(1).integers(0, 256, (4, 6))
    codes = {s: (s, 4) for s in range(9)}
    bits = ""
    for y in range(4):
        for x in range(6):
            before = 128 if x == y == 0 else samples[y - 1, 0] if x == 0 else samples[y, x - 1]
            d = int(samples[y, x] - before)
            s = abs(d).bit_length()
            bits += f"{codes[s][0]:04b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    counts = [0] * 16
    counts[3] = 9
    marker = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + marker(0xC4, bytes([0, *counts, *range(9)])) + marker(0xC3, struct.pack(">BHHB3B", 8, 4, 6, 1, 1, 0x11, 0)) + marker(0xDA, bytes([1, 1, 0, 1, 0, 0])) + scan + b"\xff\xd9"
    assert (avi.frames(avi._file([jpeg])) == samples).all()


def test_the_table_is_canonical():
    codes = avi._canonical(avi.LENGTHS)
    words = [f"{c:0{n}b}" for c, n in codes.values()]
    assert all(not b.startswith(a) for a in words for b in words if a is not b)


def test_shots_are_found():
    dark, bright = np.full((10, 12, 16), 20, np.uint8), np.full((8, 12, 16), 220, np.uint8)
    first, _ = avi.shots(np.concatenate([dark, bright, dark]))
    assert first.tolist() == [0, 10, 18]


def test_columns(hard, empty, clashing):
    media = avi.write_column(hard)
    rows = avi.features(media).collect()
    want = []
    for r in hard.collect():
        raw = (r["text"] or "").encode()
        p = avi.pad(raw)
        want.append((str(r["doc_id"]), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault((r["payload_sha256"], r["n_bytes"]), (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    clips = avi.clips(media)
    assert clips.groupBy("doc_id").sum("n_frames").count() > 5
    assert avi.features(avi.write_column(empty)).count() == 0
    assert avi.features(avi.write_column(clashing)).count() == clashing.count()


def test_the_table_follows_the_counts():
    """Prose takes fewer bits than its bytes, and a code of ones only stays free."""
    text = (b"The quick brown fox jumps over the lazy dog while seven wizards brew potions. " * 50)[: avi.UNIT * 20]
    bits = 8 * sum(len(x) for x in avi.scans(np.frombuffer(text, np.uint8).reshape(-1, avi.HEIGHT, avi.WIDTH)))
    assert bits < 8 * len(text)
    assert all(code != (1 << n) - 1 for code, n in avi._canonical(avi.LENGTHS).values())
    assert sum(2.0**-n for n in avi.LENGTHS.values()) < 1 and max(avi.LENGTHS.values()) <= 16


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=6))
def test_files_of_a_batch_are_read_side_by_side(data):
    payloads = [avi.pad(d) for d in data]
    assert [x.tobytes() for x in avi.frames_of(avi.write_all(payloads))] == payloads


def test_a_file_without_an_index_is_walked():
    payload = avi.pad(b"some words " * 200)
    media = avi.write(payload)
    bare = media[: media.index(b"idx1")]
    assert avi.frames(bare).tobytes() == payload


def test_damaged_media_end_nothing(spark):
    good = avi.write(avi.pad(b"a text of some words " * 40))
    at = avi.parse(good).starts[1]
    scan = bytearray(good)
    scan[at + len(avi._HEAD) : at + len(avi._HEAD) + 20] = b"\x00" * 20
    short = good[: len(good) // 2]
    rows = [(1, 10, good), (2, 10, b""), (3, 10, b"RIFFxxxxAVI "), (4, 10, bytes(scan)), (5, 10, short), (6, 10, good), (7, 10, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")
    found = {r["doc_id"]: r for r in avi.features(df).collect()}
    assert len(found) == 7 and found[1]["payload_sha256"] == found[6]["payload_sha256"] is not None
    assert all(found[k]["payload_sha256"] is None and found[k]["feature"].startswith("unreadable") for k in (2, 3, 5))
    clips = avi.clips(df).collect()
    assert {r["doc_id"] for r in clips if r["error"]} >= {2, 3, 5} and all(r["error"] is None for r in clips if r["doc_id"] in (1, 6))
    assert 7 not in {r["doc_id"] for r in clips}


def brute_shots(x, memory=24, k=3.0, floor=0.25):
    """Cuts by a plain loop over histograms of 16 levels."""
    hist = [np.bincount(f.ravel() >> 4, minlength=16) for f in x]
    d = [0.0] + [float(np.abs(b - a).sum()) / (2 * x[0].size) for a, b in zip(hist, hist[1:], strict=False)]
    out = [0]
    for i in range(1, len(x)):
        past = d[max(1, i - memory) : i]
        mean = sum(past) / max(len(past), 1)
        spread = (max(sum(v * v for v in past) / max(len(past), 1) - mean * mean, 0)) ** 0.5
        if d[i] > floor and d[i] > mean + k * spread + 1e-12:
            out.append(i)
    return out


def test_shots_against_a_plain_loop():
    rng = np.random.default_rng(8)
    for _ in range(20):
        levels = np.repeat(rng.integers(0, 200, 12), rng.integers(1, 40, 12))
        x = (levels[:, None, None] + rng.integers(0, 30, (len(levels), avi.HEIGHT, avi.WIDTH))).clip(0, 255).astype(np.uint8)
        assert avi.shots(x)[0].tolist() == brute_shots(x)
