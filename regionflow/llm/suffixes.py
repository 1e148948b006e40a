"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that also starts elsewhere.

Shards: of the grams in a window the one with the smallest hash is its anchor; equal windows have equal anchors.
Neighbouring windows with one anchor make a segment, and segments meet by their anchor. Where all segments of
an anchor are equal, their windows repeat and nothing is left to sort. Elsewhere the different segments of an anchor
go to a shard, a repeated one with the bytes of two of its places; each shard gets a suffix array by induced sorting, and
common prefixes in text order tell which windows occur again. An anchor with more bytes than a shard holds is
divided by further bytes of its windows, as often as it takes, and its parts are sorted in the same way.

Texts that occur more than once are repeated as a whole; each different text is worked on once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from regionflow.llm.common import cut, map_batches, mix, powers, slices, span_hashes, sweep, utf8

WINDOW, GRAM = 200, 100
WORD_BYTES = 8
#: Bytes of segments that one suffix array holds; anchors with more are divided.
SHARD_BYTES = 2 << 20
#: Windows of a segment that stay together when its anchor is divided, and when a part is divided again.
CELLS = (10, 1)
#: Segments that a task sorts before it hands them over.
HELD = 750_000

_LONGEST = 1 << 22  # positions that fit beside a hash in one sort key
_KERNEL_BYTES = 1 << 18  # text whose hashes stay in a core's cache
_AHEAD = 4096  # buckets that induction looks at together


# --- induced sorting -------------------------------------------------------------------------------------


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their successors (S), and the leftmost ones of runs of these."""
    n = len(t)
    place = np.arange(n)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    change = np.minimum.accumulate(np.where(differs, place, n - 1)[::-1])[::-1]
    s = np.ones(n, bool)
    inner = change < n - 1
    s[inner] = t[np.minimum(change[inner] + 1, n - 1)] > t[inner]
    leftmost = np.zeros(n, bool)
    leftmost[1:] = s[1:] & ~s[:-1]
    return s, np.flatnonzero(leftmost)


def induce(t: np.ndarray, s: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones, which come sorted by their first symbol at least.

    A bucket whose suffixes are all known passes on their predecessors at once, and so does a run of such buckets; a
    bucket that still receives suffixes from itself fills in waves.
    """
    n = len(t)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    chars = np.flatnonzero(sizes)
    own = t[first]
    sa[ends[own] - np.searchsorted(own, own, "right") + np.arange(len(own))] = first
    marks = ends[chars] - np.searchsorted(own, chars, "right") + np.searchsorted(own, chars)  # where these begin in each bucket
    edge, larger = starts.copy(), ~s

    def pass_on(found: np.ndarray, smaller: bool) -> None:
        j = found[found > 0] - 1
        j = j[s[j] if smaller else larger[j]]
        if not len(j):
            return
        c = t[j]
        if len(c) > 1:
            by = c.argsort(kind="stable")
            c, j = c[by], j[by]
        fresh = np.ones(len(c), bool)
        np.not_equal(c[1:], c[:-1], out=fresh[1:])
        new = fresh.nonzero()[0]
        many = np.empty_like(new)
        many[:-1] = new[1:] - new[:-1]
        many[-1] = len(c) - new[-1]
        rank = np.arange(len(c)) - new.repeat(many)
        if smaller:
            sa[edge[c] - 1 - rank] = j
            edge[c[new]] -= many
        else:
            sa[edge[c] + rank] = j
            edge[c[new]] += many

    full = starts + np.bincount(t[larger], minlength=len(sizes))  # where a bucket's larger suffixes end
    k = 0
    while k < len(chars):
        ahead = chars[k : k + _AHEAD]
        known = edge[ahead] == full[ahead]
        many = len(ahead) if known.all() else int(known.argmin())
        if many:
            pass_on(sa[starts[ahead[0]] : ends[ahead[many - 1]]], False)
        else:
            c, many = ahead[0], 1
            low = starts[c]
            while low < edge[c]:
                high = edge[c]
                pass_on(sa[low:high], False)
                low = high
            pass_on(sa[marks[k] : ends[c]], False)
        k += many
    edge = ends.copy()
    sa[0], edge[0] = n - 1, 0  # the end marker is the smallest suffix
    k = len(chars)
    while k:
        ahead = chars[max(0, k - _AHEAD) : k][::-1]
        known = edge[ahead] == full[ahead]
        many = len(ahead) if known.all() else int(known.argmin())
        if many:
            pass_on(sa[starts[ahead[many - 1]] : ends[ahead[0]]][::-1], True)
        else:
            c, many = ahead[0], 1
            high = ends[c]
            while high > edge[c]:
                low = edge[c]
                pass_on(sa[low:high][::-1], True)
                high = low
            pass_on(sa[starts[c] : full[c]][::-1], True)
        k -= many
    return sa


def _names(t: np.ndarray, order: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """For each leftmost-smaller substring, in text order, its rank among them; equal ones share a rank."""
    end = np.full(len(t), len(t), np.int64)
    end[leftmost[:-1]] = leftmost[1:] + 1
    size = end[order] - order
    same = size[1:] == size[:-1]
    left, k = np.flatnonzero(same), 0
    while len(left):
        equal = t[order[left] + k] == t[order[left + 1] + k]
        same[left[~equal]] = False
        k += 1
        left = left[equal]
        left = left[size[left] > k]
    rank = np.cumsum(np.r_[0, ~same])
    by_place = np.empty(len(t), np.int64)
    by_place[order] = rank
    return by_place[leftmost]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All suffixes of t in order; t ends with its only 0.

    The leftmost-smaller substrings are sorted by induction and named; where names repeat, the string of names is
    sorted in the same way. From their order that of all suffixes is induced.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    sizes = np.bincount(t)
    s, leftmost = classify(t)
    rough = induce(t, s, leftmost[np.argsort(t[leftmost], kind="stable")], sizes)
    marked = np.zeros(n, bool)
    marked[leftmost] = True
    order = rough[marked[rough]]
    names = _names(t, order, leftmost)
    if names.max() + 1 < len(names):
        order = leftmost[suffix_array(names)]
    return induce(t, s, order, sizes)


def common_words(raw: np.ndarray, order: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Permuted common prefixes: for each place in raw the longest prefix, in words of 8 bytes and up to `length`,
    that it shares with a neighbour in `order`. All places in `order` have `length` bytes after them."""
    words = np.ndarray(max(len(raw) - WORD_BYTES + 1, 0), "<u8", raw.tobytes(), strides=(1,))
    out = np.zeros(len(raw), np.int16)
    a, b = order[:-1], order[1:]
    for k in range(length // WORD_BYTES):
        same = words[a + WORD_BYTES * k] == words[b + WORD_BYTES * k]
        a, b = a[same], b[same]
        if not len(a):
            break
        out[a] = k + 1
        out[b] = k + 1
    return out


def repeated_windows(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment the starts of its windows that occur elsewhere in the segments."""
    size = np.array([len(x) for x in segments])
    raw = np.frombuffer(b"\0".join(segments) + bytes(WINDOW), np.uint8)
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    t = raw[: int(size.sum() + len(size))].astype(np.int64) + 2
    t[begin[1:] - 1] = 1
    t[-1] = 0
    valid = np.zeros(len(t) + 1, np.int32)
    has = size >= WINDOW
    np.add.at(valid, begin[has], 1)
    np.add.at(valid, (begin + size - WINDOW + 1)[has], -1)
    valid = np.cumsum(valid)[:-1] > 0
    order = suffix_array(t.astype(np.uint16))
    order = order[valid[order]]
    again = common_words(raw, order) >= WINDOW // WORD_BYTES
    return [np.flatnonzero(again[a : a + n]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]


def runs(starts: np.ndarray, length: int = WINDOW) -> list[tuple[int, int]]:
    """Union of [s, s + length) for sorted starts."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return list(zip(starts[new].tolist(), (starts[np.r_[new[1:] - 1, len(starts) - 1]] + length).tolist(), strict=True))


# --- anchors ---------------------------------------------------------------------------------------------


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, up, down


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, row, start in the row and length of every segment of the rows' bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    if len(data) > _LONGEST:
        return _long_segments(data, at)
    sums, _, down = _rolling(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    low = np.uint64(_LONGEST - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(key, WINDOW - GRAM + 1) & low).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    valid = np.arange(len(anchor)) + WINDOW <= at[row + 1]
    x = np.flatnonzero(valid)
    if not len(x):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    a = anchor[x]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (x[1:] != x[:-1] + 1)])
    start, end = x[new], x[np.r_[new[1:] - 1, len(x) - 1]] + WINDOW
    content = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    own = row[start]
    return grams[a[new]], content, own, start - at[own], end - start


def _long_segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in overlapping parts, so that each window lies in one of them."""
    out, step = [], _LONGEST - 2 * WINDOW
    for row, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for begin in range(low, high - WINDOW + 1, step):
            stop = min(high, begin + step + WINDOW - 1)
            g, c, own, start, size = segments(data[begin:stop], np.array([0, stop - begin]))
            out.append((g, c, own + row, start + begin - low, size))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def occurrences(texts: DataFrame) -> DataFrame:
    """Rows (anchor, content, text, start, size) of texts (text hash, bytes).

    With an anchor: segments whose anchor has several contents. Without one: stretches that are known to repeat.
    Segments travel as sorted arrays, a row for each task and range of anchors. Of equal segments a task passes on the first
    and the last, as the others repeat these; of an anchor that it saw with several contents only a note goes
    to the anchor's range. So no anchor sends more than two segments from each task there.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8 * parts
    step = (1 << 64) // ranges + 1
    columns = ["place", "kind", "anchor", "content", "text", "start", "size"]
    stretch, known, open_ = 0, 1, 2

    def pack(at, end, kind, places, *arrays):
        data = [pa.array([x[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary()) for x in arrays]
        return pa.record_batch([pa.array(places, pa.int64()), pa.array([kind] * len(at), pa.int8()), *data], columns)

    def in_chunks(kind, *arrays):
        cuts = np.arange(0, len(arrays[0]), 1 << 15)
        return pack(cuts, np.minimum(cuts + (1 << 15), len(arrays[0])), kind, (arrays[2][cuts] % ranges).astype(np.int64), *arrays)

    def hand_over(held):
        a, c, t, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((c, a))
        a, c, t, s, n = (x[by] for x in (a, c, t, s, n))
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_c = new_a | np.r_[True, c[1:] != c[:-1]]
        first = np.flatnonzero(new_c)
        ends = np.zeros(len(a), bool)
        ends[first] = ends[np.r_[first[1:], len(a)] - 1] = True
        group = np.cumsum(new_a) - 1
        several = (np.bincount(group[first]) > 1)[group]
        if not ends.all():
            yield in_chunks(stretch, *_joined(t[~ends], s[~ends], n[~ends]))
        chosen = ends & several
        if chosen.any():
            yield in_chunks(known, *(x[chosen] for x in (a, c, t, s, n)))
        chosen = (ends & ~several) | (new_a & several)
        n = np.where(several, -n, n)
        a, c, t, s, n = (x[chosen] for x in (a, c, t, s, n))
        place = a // np.uint64(step)
        at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        yield pack(at, np.r_[at[1:], len(a)], open_, place[at].astype(np.int64), a, c, t, s, n)

    def send(batches):
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, _KERNEL_BYTES):
                fresh = []
                for i, x in enumerate(part.column(0).to_pylist()):  # copies in one task count once
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                part = part.take(pa.array(fresh, pa.int64()))
                if not part.num_rows:
                    continue
                a, c, own, start, size = segments(*utf8(part.column(1)))
                if len(a):
                    held.append((a, c, part.column(0).to_numpy()[own], start.astype(np.int32), size.astype(np.int32)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from hand_over(held)
                    held.clear()
        if held:
            yield from hand_over(held)

    def rows(a, c, t, s, n, anchored):
        for k in range(0, len(t), 1 << 16):
            e = slice(k, k + (1 << 16))
            none = None if anchored else np.ones(len(t[e]), bool)
            yield pa.record_batch([pa.array(a[e].view(np.int64), mask=none), pa.array(c[e].view(np.int64), mask=none), pa.array(t[e]), pa.array(s[e]), pa.array(n[e])], columns[2:])

    def meet(batches):
        held = []
        kinds = (np.uint64, np.uint64, np.int64, np.int32, np.int32)
        for batch in batches:
            for kind, *blobs in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                arrays = [np.frombuffer(b, k) for b, k in zip(blobs, kinds, strict=True)]
                if kind == open_:
                    held.append(arrays)
                else:
                    yield from rows(*arrays, kind == known)
        if held:
            a, c, t, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((c, a))
            a, c, t, s, n = (x[by] for x in (a, c, t, s, n))
            at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            many = np.diff(at, append=len(a))
            noted = np.logical_or.reduceat(n < 0, at)
            mixed = (noted | (c[at] != c[at + many - 1])).repeat(many)
            apart = (np.minimum.reduceat(t, at) != np.maximum.reduceat(t, at)) | (np.minimum.reduceat(s, at) != np.maximum.reduceat(s, at))
            yield from rows(*(x[mixed & (n > 0)] for x in (a, c, t, s, n)), True)
            alike = ~mixed & apart.repeat(many)
            yield from rows(*(x[alike] for x in (a, c, t, s, n)), False)

    sent = texts.mapInArrow(send, "place bigint, kind tinyint, anchor binary, content binary, text binary, start binary, size binary")
    return sent.repartition(parts, "place").mapInArrow(meet, "anchor bigint, content bigint, text bigint, start int, size int")


def _joined(t: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors and contents (both 0), texts, starts and sizes of the unions of stretches."""
    by = np.lexsort((s, t))
    t, s, end = t[by], s[by], (s + n)[by]  # within a text, ends grow with starts
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] > end[:-1])])
    none = np.zeros(len(new), np.uint64)
    return none, none, t[new], s[new], end[np.r_[new[1:], len(t)] - 1] - s[new]


# --- shards ----------------------------------------------------------------------------------------------


def cells(data: np.ndarray, at: np.ndarray, anchors: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Segments divided: row, start, size, key and content of each run of windows whose distances to the anchor share a
    multiple of `width`. The key is a hash of the bytes that all windows at these distances have, so equal windows have equal keys."""
    size = np.diff(at)
    place = np.zeros(len(size), np.int64)
    if width > 1:
        sums, _, down = _rolling(data)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: max(0, len(data) - GRAM + 1)])
        row = np.repeat(np.arange(len(size)), size)[: len(grams)]
        hits = np.flatnonzero(grams == anchors[row])
        first, index = np.unique(row[hits], return_index=True)
        place[first] = hits[index] - at[first]
    windows = size - WINDOW + 1
    low, high = (place - windows + 1) // width, place // width  # of the last window and the first
    many = high - low + 1
    row = np.repeat(np.arange(len(size)), many)
    cell = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    nearest, farthest = place[row] - cell * width, place[row] - cell * width - width + 1  # starts of the cell's last and first window
    start, last = np.maximum(farthest, 0), np.minimum(nearest, windows[row] - 1)
    base = at[:-1][row]
    key = span_hashes(data, base + nearest, base + farthest + WINDOW)
    content = span_hashes(data, base + start, base + last + WINDOW)
    return row, start, last - start + WINDOW, key, content


def divided(pieces: DataFrame, width: int) -> DataFrame:
    """Rows (anchor, content, offset, key, part, body): the cells of pieces (anchor, content, copy, body)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column(3))
        row, start, size, key, content = cells(data, at, batch.column(0).to_numpy().view(np.uint64), width)
        raw, own = data.tobytes(), pa.array(row)
        low = (at[:-1][row] + start).tolist()
        body = pa.array([raw[x : x + n] for x, n in zip(low, size.tolist(), strict=True)], pa.binary())
        return pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(start.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), body], ["anchor", "content", "offset", "key", "part", "body"])

    return map_batches(pieces.select("anchor", "content", "copy", "body"), run, "anchor bigint, content bigint, offset int, key bigint, part bigint, body binary")


def sorted_shards(pieces: DataFrame) -> DataFrame:
    """Rows (anchor, content, offset, size): the stretches of pieces (anchor, content, copy, body) that occur elsewhere
    among the pieces of their anchor."""

    def run(batches):
        held, size = [], 0

        def close():
            places = repeated_windows([x[3] for x in held])
            out = [(a, c, s, e - s) for (a, c, copy, _), p in zip(held, places, strict=True) if not copy for s, e in runs(p)]
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["anchor", "content", "offset", "size"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and row[:3] == held[-1][:3]:  # a row that the table holds twice
                    continue
                if held and size + len(row[3]) > SHARD_BYTES and row[0] != held[-1][0]:
                    yield from close()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from close()

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.select("anchor", "content", "copy", "body").repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "copy")
    return ordered.mapInArrow(run, "anchor bigint, content bigint, offset int, size int")


def repeated(pieces: DataFrame, large: DataFrame, widths: tuple[int, ...] = CELLS) -> DataFrame:
    """sorted_shards(), where the anchors in `large` have more bytes than a shard holds: these are divided first.

    Parts of one window are all equal under their key, so the last division leaves nothing large.
    """
    if not widths or large.isEmpty():
        return sorted_shards(pieces)
    pieces = cut(pieces.dropDuplicates(["anchor", "content", "copy"]))
    small = sorted_shards(pieces.join(large, "anchor", "left_anti"))
    each = cut(divided(pieces.join(large, "anchor", "left_semi"), widths[0]))
    parts = each.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("low"), F.max("body").alias("high"))
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    copies = F.when(F.col("n") > 1, F.array("low", "high")).otherwise(F.array("low"))
    finer = cut(parts.join(several, "key").select(F.col("key").alias("anchor"), F.col("part").alias("content"), F.posexplode(copies).alias("copy", "body")))
    found = repeated(finer, too_large(finer.groupBy("anchor").agg(F.sum(F.octet_length("body")).alias("bytes"))), widths[1:])
    found = found.select(F.col("anchor").alias("key"), F.col("content").alias("part"), F.col("offset").alias("inner"), "size")
    back = each.select("anchor", "content", "offset", "key", "part").join(found, ["key", "part"])
    return small.unionByName(back.select("anchor", "content", (F.col("offset") + F.col("inner")).alias("offset"), "size").distinct())


def too_large(sizes: DataFrame) -> DataFrame:
    return sizes.filter(F.col("bytes") > SHARD_BYTES).select("anchor")


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(text.alias("body"), F.xxhash64(text, F.lit(17)).alias("text"))


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: (id, text, one, n_bytes, sha_all, whole), whole: the entire row goes. spans: (text, start, size), per
    text that occurs once the stretches to remove, which may overlap. `text` is a 64-bit hash of the row's text."""
    spark = df.sparkSession
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(17))
    base = cut(df.select(F.col(id_col).alias("id"), hashed.alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha_all")))
    classes = base.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("one"))
    long = _texts(df, text_col).filter(F.octet_length("body") >= WINDOW)
    met = cut(occurrences(long.select("text", "body")))
    sweep(spark)
    wanted = met.filter("anchor is not null")
    place = F.struct("text", "start", "size")
    contents = cut(wanted.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    places = contents.select("anchor", "content", F.posexplode(F.array_distinct(F.array("first", "last"))).alias("copy", "at"))
    large = too_large(places.groupBy("anchor").agg(F.sum("at.size").alias("bytes")))
    by_text = places.groupBy(F.col("at.text").alias("text")).agg(F.collect_list(F.struct("anchor", "content", "copy", F.col("at.start").alias("start"), F.col("at.size").alias("size"))).alias("wanted"))
    by_text = by_text.join(classes.select("text", "one"), "text")  # as many as the text has segments
    bodies = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), hashed.alias("text"))
    chosen = bodies.join(by_text, (bodies["text"] == by_text["text"]) & bodies["id"].eqNullSafe(by_text["one"])).select("wanted", "body")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column(1))
        raw = data.tobytes()
        out = [(w["anchor"], w["content"], w["copy"], raw[a + w["start"] : a + w["start"] + w["size"]]) for a, ws in zip(at[:-1].tolist(), batch.column(0).to_pylist(), strict=True) for w in ws]
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "content", "copy", "body"])

    pieces = map_batches(chosen, extract, "anchor bigint, content bigint, copy int, body binary")
    again = cut(repeated(pieces, large))
    sweep(spark)
    sorted_out = wanted.join(again, ["anchor", "content"]).select("text", (F.col("start") + F.col("offset")).alias("start"), again["size"])
    spans = met.filter("anchor is null").select("text", "start", "size").unionByName(sorted_out)
    rows = base.join(classes.select("text", "one", (F.col("copies") > 1).alias("again")), "text")
    rows = rows.select("id", "text", "one", "n_bytes", "sha_all", (F.col("again") & (F.col("n_bytes") >= WINDOW)).alias("whole"))
    return rows, spans


def _merged(items: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((w["start"], w["start"] + w["size"]) for w in items):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in gone for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _gone(spans: DataFrame) -> DataFrame:
    return spans.groupBy("text").agg(F.collect_list(F.struct("start", "size")).alias("gone"))  # as many as the text has segments


def _finish(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Batches (text, gone, body) to (text, n_removed, n_spans, kept_sha256)."""
    data, at = utf8(batch.column(2))
    raw, out = data.tobytes(), []
    for a, b, items in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist(), strict=True):
        stretches = _merged(items)
        out.append((sum(y - x for x, y in stretches), len(stretches), hashlib.sha256(_kept(raw[a:b], stretches)).hexdigest()))
    n, many, sha = zip(*out, strict=True)
    return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(many, pa.int64()), pa.array(sha)], ["part", "some", "many", "sha"])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of df.

    Null texts are empty. Texts of under WINDOW bytes keep all; longer texts that several rows hold, repeated
    rows included, lose all their bytes. Removed runs may cut a character.
    """
    rows, spans = removed(df, id_col, text_col)
    gone = _gone(spans).join(rows.filter(~F.col("whole")).select("text", "one"), "text")
    body = F.coalesce(F.col(text_col), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), body.alias("body"), F.xxhash64(body, F.lit(17)).alias("text"))
    joined = own.join(gone, (own["text"] == gone["text"]) & own["id"].eqNullSafe(gone["one"]))
    part = map_batches(joined.select(own["text"], "gone", "body"), _finish, "part bigint, some bigint, many bigint, sha string")
    whole = F.col("whole")
    return rows.join(part, F.col("text") == F.col("part"), "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("some", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("many", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", "sha_all")).alias("kept_sha256"),
    )


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeated bytes gone from its texts, and a boolean column `emptied` for texts that lost everything.

    A character that a cut splits goes with the cut. Other columns stay as they are.
    """
    rows, spans = removed(df, id_col, text_col)
    whole = rows.filter("whole").select("text").distinct()
    none = F.lit(None).cast("array<struct<start:int,size:int>>")
    fate = _gone(spans).join(whole, "text", "left_anti").select(F.col("text").alias("_own"), F.lit(False).alias("_whole"), F.col("gone").alias("_gone"))
    fate = fate.unionByName(whole.select(F.col("text").alias("_own"), F.lit(True).alias("_whole"), none.alias("_gone")))
    names = [c for c in df.columns if c != "emptied"]
    own = F.xxhash64(F.coalesce(df[text_col], F.lit("")), F.lit(17))
    joined = df.join(fate, own == fate["_own"], "left").select(*(df[c] for c in names), fate["_whole"], fate["_gone"])
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, emptied = batch.column(at).to_pylist(), [False] * batch.num_rows
        wholly, gone = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        for i, items in enumerate(gone):
            if wholly[i] or items:
                texts[i] = "" if wholly[i] else _kept(texts[i].encode(), _merged(items)).decode("utf-8", "ignore")
                emptied[i] = not texts[i]
        columns = [*batch.columns[:-2], pa.array(emptied, pa.bool_())]
        columns[at] = pa.array(texts, pa.string())
        return pa.record_batch(columns, [*names, "emptied"])

    schema = StructType([df.schema[c] for c in names]).add("emptied", BooleanType())
    return map_batches(joined, run, schema)
