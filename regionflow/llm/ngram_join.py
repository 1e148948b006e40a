"""N-gram Jaccard join by count-vector R-trees.

The shingles of a text are hashed into groups. The coarse counts by group are the text's point: the overlap of
two texts is at most the sum of the coordinate minima, and an R-tree over points bounds the overlap with a
whole subtree by the minima with its largest coordinates. Surviving pairs are verified on the sets themselves.

One tree over all texts can't be spread over machines, as random texts have like counts. So the fine groups
route: two texts whose sets differ in at most D shingles agree in at least one of D + 1 groups. Texts that hold
equal content in one group form a block; each block has its own tree, and no pair is lost.

Texts with equal sets are one class and stand for each other, and blocks of the same classes are one block. The first
round pairs each class with the nearest centre of its blocks, and the trees with its nearest neighbours; a last search
of the blocks that still join several components takes all pairs that the bound leaves. Two classes that share several
blocks meet in that of their smallest key only. So thousands of versions of one text mostly cost as many pairs, not
their square, and components are exact. A block of more than TILE classes is searched in tiles of two parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import cut, cut_in_loop, lower_ascii, map_batches, mix, slices, span_hashes, sweep, utf8, word_spans

#: Coordinates of a point.
COORDINATES = 128
#: Children of a tree's node.
FANOUT = 16
#: Steps between the set sizes that share one number of groups.
BAND = 1.5
#: Classes up to which the texts of blocks are found by a broadcast; beyond, texts are shuffled to them.
BROADCAST_CLASSES = 150_000
#: Rounds that link blocks' members to one of them before the trees search what is left.
STAR_ROUNDS = 1
#: Nearest members that the first tree round tries for each class.
NEAREST = 2
#: Classes of a block that one tree holds; each two parts of a larger block get a tree.
TILE = 8192
#: Smallest keys that a class carries, to tell in which block it meets another one.
LEAST = 16
#: Points that a search compares at once.
COMPARED = 100_000


@dataclass(frozen=True)
class Rule:
    """Link sets A and B when share[1] * |A and B| >= share[0] * |A or B|; shingles of `words` words."""

    words: int = 5
    share: tuple[int, int] = (80, 100)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of sizes a and b."""
        low, high = self.share
        return -((-low * (a + b)) // (low + high))

    def apart(self, size: int) -> int:
        """Most shingles in which linked sets differ if the smaller has at most `size`."""
        low, high = self.share
        return size * (high - low) // low

    def largest(self, size: int) -> int:
        """Largest set that links with one of `size`."""
        return size * self.share[1] // self.share[0]


def bands(n: int, rule: Rule) -> list[tuple[int, int, int]]:
    """(band, groups, empty groups tolerated) in which a set of size n takes part: its own, and lower ones with partners."""
    out, low, band = [], 1, 0
    while low <= n:
        high = max(low, int(low * BAND) - 1)
        if n <= high or n <= rule.largest(high):
            d = rule.apart(high)
            if d:
                spare = 3 + d // 9
                out.append((band, d + 1 + spare, spare))
        low, band = high + 1, band + 1
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII-lower-cased; a shorter text is one shingle, an empty one none."""
    data = lower_ascii(data)
    starts, ends, of = word_spans(data, at)
    w = span_hashes(data, starts, ends)
    n = np.diff(of)
    full = np.zeros(0, np.uint64)
    if len(w) >= words:
        full = np.zeros(len(w) - words + 1, np.uint64)
        for k in range(words):
            full = full * np.uint64(0x9E3779B97F4A7C15) + mix(w[k : len(w) - words + 1 + k] + np.uint64(k))
        full = mix(full)
    out = []
    for i, a, b in zip(n.tolist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
        if i >= words:
            s = np.sort(full[a : b - words + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif i:
            place = np.arange(1, i + 1, dtype=np.uint64)
            out.append(mix(mix(w[a:b] + place).sum(keepdims=True) + np.uint64(i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_EDGES = {}


def _ranges(s: np.ndarray, groups: int) -> np.ndarray:
    """Where each of `groups` equal ranges of hashes begins in the sorted set s, and its end."""
    if groups not in _EDGES:
        _EDGES[groups] = np.array([(g << 64) // groups for g in range(1, groups)], np.uint64)
    out = np.empty(groups + 1, np.int64)
    out[0], out[-1] = 0, len(s)
    out[1:-1] = np.searchsorted(s, _EDGES[groups])
    return out


def point(s: np.ndarray) -> np.ndarray:
    return np.minimum(np.diff(_ranges(s, COORDINATES)), 65_535).astype(np.uint16)


def most_common(x: np.ndarray, n_x: np.ndarray, y: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: the sum of coordinate minima, and what the coordinates could not hold."""
    beyond = np.minimum(n_x - x.sum(-1, dtype=np.int64), n_y - y.sum(-1, dtype=np.int64))
    return np.minimum(x, y).sum(-1, dtype=np.int64) + beyond


def bitmap(s: np.ndarray) -> bytes:
    """The finest groups, eight or more for each shingle, as a bit each: whether the group holds any."""
    power = max(6, (8 * len(s) - 1).bit_length())
    bits = np.zeros(1 << power, bool)
    bits[(s >> np.uint64(64 - power)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_common_by_bits(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """Upper bound of the overlap: a group that only one set has costs that set a shingle."""
    a, b = (np.unpackbits(np.frombuffer(z, np.uint8)).view(bool) for z in (x, y))
    if len(a) > len(b):
        a = a.reshape(len(b), -1).any(1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).any(1)
    both = int(np.count_nonzero(a & b))
    return min(n_x - int(np.count_nonzero(a)), n_y - int(np.count_nonzero(b))) + both


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit id of a class of equal sets."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s).sum() + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64))[0]
    return int(h.astype(np.int64))


def group_keys(s: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the groups' contents: linked sets that differ share at least one."""
    out = []
    mixed = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), out=mixed[1:])
    for band, groups, spare in bands(len(s), rule):
        r = _ranges(s, groups)
        counts = np.diff(r)
        number = np.arange(groups, dtype=np.uint64) + np.uint64(band << 40)
        keys = mix(mix(mixed[r[1:]] - mixed[r[:-1]] + counts.astype(np.uint64)) + number * np.uint64(0x9E3779B97F4A7C15))
        empty = counts == 0
        out.append(keys if empty.sum() > spare else keys[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cut_keys(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The range of each key, of 8 * parts equal ones, its first 32 bits within the range, and the key that these give."""
    step = (1 << 64) // (8 * parts) + 1
    shift = np.uint64(max(0, step.bit_length() - 32))
    place = keys // np.uint64(step)
    short = (keys - place * np.uint64(step)) >> shift
    return place, short, place * np.uint64(step) + (short << shift)


def least_keys(s: np.ndarray, rule: Rule, parts: int) -> np.ndarray:
    """The LEAST smallest of a set's keys, as blocks() has them, in order."""
    keys = np.unique(cut_keys(group_keys(s, rule), parts)[2].view(np.int64))[:LEAST]
    return np.r_[keys, np.full(LEAST - len(keys), np.iinfo(np.int64).max)]


class PointTree:
    """A packed R-tree over count vectors: each node keeps its members' largest coordinates and extreme sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*points.T[: COORDINATES // 4], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.beyond = self.sizes - self.points.sum(1, dtype=np.int64)
        top, low, high, most = self.points, self.sizes, self.sizes, self.beyond
        while len(top) > FANOUT:
            at = np.arange(0, len(top), FANOUT)
            top, low, high, most = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at)
            self.levels.append((top, low, high, most))

    def search(self, points: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of several points the members whose overlap with it could suffice: number of the point, index of the
        member as given, and the bound of the overlap."""
        small, large = -(-sizes * rule.share[0] // rule.share[1]), rule.largest(sizes)
        beyond = sizes - points.sum(1, dtype=np.int64)
        top = len(self.levels[-1][0]) if self.levels else len(self.points)
        of, node = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            most_of, low, high, most = self.levels[depth]
            of, node = (x[(low[node] <= large[of]) & (high[node] >= small[of])] for x in (of, node))
            bound = np.minimum(most_of[node], points[of]).sum(1, dtype=np.int64) + np.minimum(most[node], beyond[of])
            live = bound >= rule.overlap(np.maximum(low[node], small[of]), sizes[of])
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            of = np.repeat(of[live], FANOUT)
            node = (node[live][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            of, node = of[node < below], node[node < below]
        live = (self.sizes[node] <= large[of]) & (self.sizes[node] >= small[of])
        of, node = of[live], node[live]
        common = np.minimum(self.points[node], points[of]).sum(1, dtype=np.int64) + np.minimum(self.beyond[node], beyond[of])
        live = common >= rule.overlap(self.sizes[node], sizes[of])
        return of[live], self.order[node[live]], common[live]


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signatures(df: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, fp, text_hash) for each row of df; a set without shingles has a null fp."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*utf8(batch.column(1)), rule.words)
        fps = [fingerprint(s) if len(s) else None for s in sets]
        return pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), batch.column(2)], ["id", "n", "fp", "text_hash"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col, text_hash(text_col)), run, f"id {kind}, n bigint, fp bigint, text_hash bigint")


def blocks(df: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """Rows (key, fp, members): the classes that share a group's content with another one, and how many do. Of several keys
    that the same classes share, the smallest stays.

    Keys travel as sorted arrays, a row for each task and range of keys, by their first 32 bits within the range;
    two keys that agree in these share a block, which costs a search and loses nothing. A key that several classes of one task
    hold is settled there, and only its first class travels on, so that no key sends more rows than there are tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8 * parts

    def send(batches):
        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        held = 0

        def hand_over():
            k, f = np.concatenate(keys), np.concatenate(fps)
            k = cut_keys(k, parts)[2]
            by = np.lexsort((f, k))
            k, f = k[by], f[by]
            new_key = np.r_[True, k[1:] != k[:-1]]
            fresh = new_key | np.r_[True, f[1:] != f[:-1]]
            k, f, new_key = k[fresh], f[fresh], new_key[fresh]
            several = ~new_key
            several[:-1] |= ~new_key[1:]
            known_k, known_f = k[several], f[several]
            k, f = k[new_key], f[new_key]
            place, short, _ = cut_keys(k, parts)
            place, short = place.astype(np.int64), short.astype(np.uint32)
            at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
            end = np.r_[at[1:], len(place)]
            yield pa.record_batch(
                [pa.array(place[at]), pa.array([True] * len(at)), pa.array([(short[a:b]).tobytes() for a, b in zip(at, end, strict=True)], pa.binary()), pa.array([f[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary())],
                ["place", "open", "keys", "fps"],
            )
            cuts = range(0, len(known_k), 1 << 16)
            spread = [int(known_k[a] % np.uint64(ranges)) for a in cuts]
            yield pa.record_batch(
                [pa.array(spread, pa.int64()), pa.array([False] * len(spread), pa.bool_()), pa.array([known_k[a : a + (1 << 16)].tobytes() for a in cuts], pa.binary()), pa.array([known_f[a : a + (1 << 16)].tobytes() for a in cuts], pa.binary())],
                ["place", "open", "keys", "fps"],
            )

        for batch in batches:
            for part in slices(batch):
                for s in shingle_sets(*utf8(part.column(0)), rule.words):
                    if len(s):
                        own = group_keys(s, rule)
                        keys.append(own)
                        fps.append(np.full(len(own), fingerprint(s), np.int64))
                        held += len(own)
                if held > 750_000:
                    yield from hand_over()
                    keys.clear(), fps.clear()
                    held = 0
        if held:
            yield from hand_over()

    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        step = (1 << 64) // ranges + 1
        shift = np.uint64(max(0, step.bit_length() - 32))
        for batch in batches:
            for place, is_open, k, f in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                f = np.frombuffer(f, np.int64)
                if is_open:
                    held.append((np.uint64(place * step) + (np.frombuffer(k, np.uint32).astype(np.uint64) << shift), f))
                elif len(k):
                    k = np.frombuffer(k, np.uint64)
                    yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(f)], ["key", "fp"])
        if held:
            k, f = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(k, kind="stable")
            k, f = k[by], f[by]
            several = np.zeros(len(k), bool)
            same = k[1:] == k[:-1]
            several[1:] |= same
            several[:-1] |= same
            k, f = k[several], f[several]
            for a in range(0, len(k), 1 << 16):
                yield pa.record_batch([pa.array(k[a : a + (1 << 16)].view(np.int64)), pa.array(f[a : a + (1 << 16)])], ["key", "fp"])

    sent = df.select(text_col).mapInArrow(send, "place bigint, open boolean, keys binary, fps binary")
    met = sent.repartition(parts, "place").mapInArrow(meet, "key bigint, fp bigint")
    met = met.distinct()
    own = [F.bit_xor(F.xxhash64("fp", F.lit(seed))).alias(f"own{seed}") for seed in (1, 2)]
    several = met.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *own).filter("members > 1")
    chosen = several.groupBy("members", "own1", "own2").agg(F.min("key").alias("key")).select("key", "members")
    return met.join(chosen, "key")


def texts_of(classes: DataFrame, df: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (fp, text): a text of each class, dealt with by a broadcast of the classes while these are few."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    one = known.join(classes, "fp", "left_semi").groupBy("fp").agg(first.alias("first"))
    one = cut(one.select("fp", F.col("first.id").alias("one_id"), F.col("first.text_hash").alias("one_hash")))
    if one.count() <= BROADCAST_CLASSES:
        one = F.broadcast(one)
    texts = df.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("own_hash"))
    return texts.join(one, (F.col("own_hash") == F.col("one_hash")) & F.col("text_id").eqNullSafe(F.col("one_id"))).select("fp", "text")


def _of_class(batch: pa.RecordBatch, rule: Rule) -> tuple[pa.Array, list[np.ndarray]]:
    """Classes and sets of those texts (fp, text) that are of the class; rows can share an id."""
    found = shingle_sets(*utf8(batch.column(1)), rule.words)
    keep = [i for i, (s, fp) in enumerate(zip(found, batch.column(0).to_pylist(), strict=True)) if len(s) and fingerprint(s) == fp]
    return batch.column(0).take(pa.array(keep, pa.int64())), [found[i] for i in keep]


def points_of(texts: DataFrame, rule: Rule) -> DataFrame:
    """Rows (fp, n, point, least, bits) of texts (fp, text), dealt by fp for the joins to come; least: the class's smallest keys."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sets = _of_class(batch, rule)
        least = [least_keys(s, rule, parts).tobytes() for s in sets]
        return pa.record_batch([fps, pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s).tobytes() for s in sets], pa.binary()), pa.array(least, pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())], ["fp", "n", "point", "least", "bits"])

    return cut(map_batches(texts, run, "fp bigint, n bigint, point binary, least binary, bits binary").repartition(parts, "fp").dropDuplicates(["fp"]))


def sets_of(texts: DataFrame, rule: Rule) -> DataFrame:
    """Rows (fp, members) of texts (fp, text), dealt by fp for the joins to come."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sets = _of_class(batch, rule)
        return pa.record_batch([fps, pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "members"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(map_batches(texts, run, "fp bigint, members binary").repartition(parts, "fp").dropDuplicates(["fp"]))


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those pairs (a, b) of classes whose sets link."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            keep[i] = (large[at] == small).sum() >= rule.overlap(np.int64(len(x)), np.int64(len(y)))
        chosen = pa.array(np.flatnonzero(keep))
        return pa.record_batch([batch.column(0).take(chosen), batch.column(1).take(chosen)], ["a", "b"])

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return map_batches(both.select("a", "b", "x", "y"), check, "a bigint, b bigint")


def similarity(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the Jaccard similarity, from one of the overlap."""
    return common / np.maximum(a + b - common, 1)


def bounded(pairs: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose sum of coordinate minima could suffice, with the bound of their similarity as `near`."""
    points = points.select("fp", "n", "point")
    both = pairs.join(points.toDF("a", "n_a", "p_a"), "a").join(points.toDF("b", "n_b", "p_b"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(utf8(batch.column(i))[0].tobytes(), np.uint16).reshape(-1, COORDINATES) for i in (2, 3))
        n = [batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)]
        common = most_common(x, n[0], y, n[1])
        keep = np.flatnonzero(common >= rule.overlap(n[0], n[1]))
        chosen = pa.array(keep)
        return pa.record_batch([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(similarity(common, *n)[keep])], ["a", "b", "near"])

    return map_batches(both.select("a", "b", "p_a", "p_b", "n_a", "n_b"), run, "a bigint, b bigint, near double")


def finer(pairs: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """Those pairs (a, b) that the bitmaps leave, so that few sets are sent that don't link."""
    points = points.select("fp", "n", "bits")
    both = pairs.join(points.toDF("a", "n_a", "x"), "a").join(points.toDF("b", "n_b", "y"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [batch.column(i).to_numpy() for i in (2, 3)]
        common = [most_common_by_bits(x, i, y, j) for i, j, x, y in zip(n[0].tolist(), n[1].tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        chosen = pa.array(np.flatnonzero(np.array(common) >= rule.overlap(*n)))
        return pa.record_batch([batch.column(0).take(chosen), batch.column(1).take(chosen)], ["a", "b"])

    return map_batches(both.select("a", "b", "n_a", "n_b", "x", "y"), run, "a bigint, b bigint")


def stars(rest: DataFrame, points: DataFrame, rule: Rule, turn: int) -> DataFrame:
    """A pair (a, b) for each class in blocks (key, fp, part, degree): with the nearest of its blocks' centres.

    At first centres are the members in most blocks, as a text that others vary shares more than its versions
    share among themselves; later turns take other members.
    """
    rank = -F.col("degree") if turn == 0 else F.xxhash64("fp", F.lit(turn))
    centre = rest.groupBy("key").agg(F.min(F.struct(rank.alias("h"), F.col("fp").alias("c"), F.col("part").alias("p"))).alias("m"))
    apart = rest.join(centre, "key").filter("part != m.p").select(F.col("fp").alias("a"), F.col("m.c").alias("b")).distinct()
    return _nearest(bounded(apart, points, rule), 1)


def _nearest(pairs: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) in order, for each a with its `count` nearest b."""
    best = pairs.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("near")).alias("far"), "b"))), 1, count).alias("s"))
    each = best.select("a", F.explode("s.b").alias("b"))
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_pairs(key: int, tile: bool, fps: np.ndarray, sizes: np.ndarray, points: np.ndarray, least: np.ndarray, parts: np.ndarray, half: np.ndarray, rule: Rule, nearest: int | None):
    """Yields arrays (a, b, near) of a block's members in different parts whose bound suffices and that share no smaller
    key: with a < b, or for each a its `nearest` b. tile: only members of different halves."""
    tree, step = PointTree(points, sizes), max(1, COMPARED // len(fps))
    for at in range(0, len(fps), step):
        i, j, common = tree.search(points[at : at + step], sizes[at : at + step], rule)
        i += at
        wanted = parts[i] != parts[j]
        if tile:
            wanted &= half[i] != half[j]
        if not nearest:
            wanted &= fps[i] < fps[j]
        i, j, common = i[wanted], j[wanted], common[wanted]
        if not len(i):
            continue
        x, y = least[i], least[j]
        elsewhere = ((x[:, :, None] == y[:, None, :]) & (x < key)[:, :, None]).any((1, 2))
        i, j, common = i[~elsewhere], j[~elsewhere], common[~elsewhere]
        near = similarity(common, sizes[i], sizes[j])
        if nearest and len(i):
            by = np.lexsort((fps[j], -near, i))
            i, j, near = i[by], j[by], near[by]
            new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            first = np.arange(len(i)) - np.repeat(new, np.diff(np.r_[new, len(i)])) < nearest
            i, j, near = i[first], j[first], near[first]
        yield fps[i], fps[j], near


def tree_pairs(members: DataFrame, rule: Rule, nearest: int | None = None) -> DataFrame:
    """Pairs (a, b) of members (key, fp, n, point, least, part, members) of a block that lie in different parts and pass the
    bound: all of them, or for each class those with its `nearest` ones."""

    def search(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def close(arrays):
            key, tile, half, fps, sizes, parts, points, least = arrays
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
                if b - a > 1:
                    yield from block_pairs(int(key[a]), bool(tile[a] % 2), fps[a:b], sizes[a:b], points[a:b], least[a:b], parts[a:b], half[a:b], rule, nearest)

        def found(arrays):
            out = [x for x in close(arrays) if len(x[0])]
            if out:
                a, b, near = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(near)], ["a", "b", "near"])

        for batch in batches:
            numbers = [batch.column(i).to_numpy() for i in range(6)]
            points = np.frombuffer(utf8(batch.column(6))[0].tobytes(), np.uint16).reshape(-1, COORDINATES)
            least = np.frombuffer(utf8(batch.column(7))[0].tobytes(), np.int64).reshape(-1, LEAST)
            held.append((*numbers, points, least))
            key, tile = numbers[:2]
            if key[0] != key[-1] or tile[0] != tile[-1]:  # all but the last block are complete
                arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.flatnonzero((arrays[0] != key[-1]) | (arrays[1] != tile[-1]))[-1] + 1
                yield from found([x[:last] for x in arrays])
                held[:] = [tuple(x[last:] for x in arrays)]
        if held:
            yield from found([np.concatenate(x) for x in zip(*held, strict=True)])

    # A block of more than TILE members is dealt into parts; tile 2 * (i * parts + j) holds part i alone (i = j) or, plus 1, parts i and j.
    many = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    half = F.pmod(F.xxhash64("fp"), many).cast("int")
    number = lambda j: 2 * (F.least("half", j) * F.col("many") + F.greatest("half", j)) + (F.col("half") != j).cast("int")
    dealt = members.withColumn("many", many).withColumn("half", half).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("many") - 1), number)))
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.select("key", "tile", "half", "fp", "n", "part", "point", "least").repartition(spread, "key", "tile").sortWithinPartitions("key", "tile", "fp")
    found = ordered.mapInArrow(search, "a bigint, b bigint, near double")
    return _nearest(found, nearest) if nearest else found.select("a", "b").distinct()


def unsettled(met: DataFrame, part: DataFrame | None) -> DataFrame:
    """Rows (key, fp, part, degree, members) of the blocks that join several components."""
    placed = met.withColumn("part", F.col("fp")) if part is None else met.join(part, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q")
    return placed.join(mixed.select("key"), "key", "left_semi").select("key", "fp", "part", "degree", "members")


def components(links: DataFrame) -> DataFrame:
    """Rows (fp, part): the smallest class that each linked class reaches.

    Each class and its label take the smallest label among the class's neighbours, then labels take their labels'
    labels: trees hook onto each other and flatten, in a logarithmic number of rounds. All stays distributed.
    """
    edges = cut_in_loop(links.union(links.select("b", "a")).toDF("u", "v").distinct())
    labels = cut_in_loop(edges.groupBy(F.col("u").alias("fp")).agg(F.least(F.min("v"), F.first("u")).alias("part")))
    while True:
        near = edges.join(labels, F.col("v") == F.col("fp")).groupBy("u").agg(F.min("part").alias("near"))
        seen = labels.join(near, F.col("fp") == F.col("u")).select("fp", "part", "near")
        hooks = seen.select("fp", "near").union(seen.select("part", "near")).groupBy(F.col("fp").alias("hook")).agg(F.min("near").alias("to"))
        middle = cut_in_loop(labels.join(hooks, F.col("fp") == F.col("hook")).select("fp", F.col("part").alias("old"), F.least("part", "to").alias("mid")))
        jump = middle.select(F.col("fp").alias("mid_fp"), F.col("mid").alias("far"))
        new = cut_in_loop(middle.join(jump, F.col("mid") == F.col("mid_fp")).select("fp", "old", F.least("mid", "far").alias("part")))
        labels = new.select("fp", "part")
        if new.filter("old != part").isEmpty():
            return labels


def join(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """Rows (id, n_shingles, component_id), one for each row of df.

    component_id: the smallest id that links reach, the row's own included. Texts without words link with
    nothing. Rows without an id take part, and get the smallest id that their component has, if any.
    Repeated rows give repeated results; an empty table gives no rows.
    """
    return _linked(df, rule, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def firsts(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """Rows (id, text_hash), one for each component: its smallest id, nulls last, and of that id's texts the smallest hash.

    Texts without words link with nothing; each such (id, text) is a component.
    """
    alone = F.col("part").isNull()
    rows = _linked(df, rule, id_col, text_col)
    groups = rows.groupBy("part", F.when(alone, F.col("id")).alias("own_id"), F.when(alone, F.col("text_hash")).alias("own_hash"))
    first = groups.agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"))
    return first.select(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))


def _linked(df: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Rows of signatures() with the component's smallest id and its label; both are null without words."""
    known = cut(signatures(df, rule, id_col, text_col))
    met = cut(blocks(df, rule, text_col))
    sweep(df.sparkSession)
    met = cut(met.join(met.groupBy("fp").agg(F.count(F.lit(1)).alias("degree")), "fp"))
    points = points_of(texts_of(met.select("fp").distinct(), df, known, id_col, text_col), rule)
    sweep(df.sparkSession)
    links, part, rest = None, None, met.withColumn("part", F.col("fp"))
    for turn in range(STAR_ROUNDS + 2):
        if turn < STAR_ROUNDS:
            pairs = stars(rest, points, rule, turn)
        else:
            pairs = tree_pairs(rest.join(points.drop("bits"), "fp"), rule, NEAREST if turn == STAR_ROUNDS else None)
        pairs = cut_in_loop(finer(cut_in_loop(pairs), points, rule))
        sweep(df.sparkSession)
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        found = cut_in_loop(verify(pairs, sets_of(texts_of(wanted, df, known, id_col, text_col), rule), rule))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            part = components(links)
        if turn <= STAR_ROUNDS:
            rest = cut_in_loop(unsettled(met, part))
            sweep(df.sparkSession)
            if rest.isEmpty():
                break
    if part is None:
        part = known.select("fp", F.col("fp").alias("part")).limit(0)
    smallest = known.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("least")).join(part, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    ids = smallest.groupBy("part").agg(F.min("least").alias("component"))
    classes = smallest.join(ids, "part").select(F.col("fp").alias("class"), "component", "part")
    return known.join(classes, F.col("fp") == F.col("class"), "left")
