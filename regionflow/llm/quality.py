"""Document quality by a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree at a time to a single feature or a pair of features and adds it to that
feature's lookup table; a score is an intercept plus one looked-up value per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import map_batches, span_hashes, utf8, word_spans

#: Labelled rows that training takes at most, those lowest by a hash of their ids.
TRAIN_ROWS = 20_000

NAMES = (
    "bytes", "words", "word_bytes", "symbol_share", "mark_share", "bar_share", "upper_share", "digit_share", "stop_share", "other_punctuation",
    "high_share", "line_count", "line_words", "distinct_share", "window_repeats", "symbol_words", "upper_words", "longest_word", "short_words", "top_word",
)


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _BAR, _MARK, _STOP = _lut(b"#*$%&<>@^~=\\"), _lut(b"|"), _lut(b"!?"), _lut(b".,;:")
_UPPER, _LOWER, _DIGIT = _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123))), _lut(bytes(range(48, 58)))
_OTHER = _lut(b"\"'()[]{}_-+/`")


def text_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text, from all its bytes. An empty text has zeros."""
    n = np.diff(at).astype(float)
    starts, ends, of = word_spans(data, at)
    words = np.diff(of).astype(float)
    doc = np.repeat(np.arange(len(n)), np.diff(of))
    size = (ends - starts).astype(float)

    def share(mask: np.ndarray, by: np.ndarray = n) -> np.ndarray:
        return _per(mask, at) / np.maximum(by, 1)

    def of_words(x: np.ndarray) -> np.ndarray:
        return _per(x, of) / np.maximum(words, 1)

    symbol, upper = _SYMBOL[data], _UPPER[data]
    letters = _per(upper | _LOWER[data] | (data >= 128), at)
    lines = _per(data == 10, at) + (n > 0)
    hashes = span_hashes(data, starts, ends)
    distinct, top, repeats = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    if len(h):
        fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        distinct = np.bincount(d[fresh], minlength=len(n)).astype(float)
        runs = np.diff(np.r_[np.flatnonzero(fresh), len(h)])
        np.maximum.at(top, d[fresh], runs)
        if len(h) > 2:
            w = hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7)
            inner = doc[:-2] == doc[2:]
            w, wd = w[inner], doc[:-2][inner]
            by = np.lexsort((w, wd))
            same = np.r_[False, (w[by][1:] == w[by][:-1]) & (wd[by][1:] == wd[by][:-1])] if len(w) else np.zeros(0, bool)
            repeats = np.bincount(wd[by][same], minlength=len(n)).astype(float)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    initial = upper[starts] & upper[np.minimum(starts + 1, len(data) - 1)] if len(starts) else np.zeros(0, bool)
    longest = np.zeros(len(n))
    np.maximum.at(longest, doc, size)
    return np.column_stack(
        [
            np.log1p(n), np.log1p(words), of_words(size), share(symbol), share(_MARK[data]), share(_BAR[data]), share(upper, letters), share(_DIGIT[data]),
            share(_STOP[data]), share(_OTHER[data]), share(data >= 128), np.log1p(lines), words / np.maximum(lines, 1), distinct / np.maximum(words, 1),
            repeats / np.maximum(words - 2, 1), of_words(_SYMBOL[last] | _MARK[last]), of_words(initial), longest, of_words(size <= 2), top / np.maximum(words, 1),
        ]
    )


def _per(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1)
    np.cumsum(x, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: one table look-up for each feature and pair, added up."""
        z = np.full(len(x), self.intercept)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += values[np.searchsorted(edge, x[:, j], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            z += values[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best gain and place of one cut of a histogram of gradients and curvatures."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = -1
    if not len(gain):
        return 0.0, -1
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1 if gain[best] > 1e-9 else -1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf values by bin of a tree over one histogram (one or two axes)."""
    out = np.full(g.shape, g.sum() / (h.sum() + 1))
    if depth:
        found = [(*_cut(*(y.sum(tuple(k for k in range(g.ndim) if k != axis)) for y in (g, h)), least), axis) for axis in range(g.ndim)]
        gain, place, axis = max(found)
        if place > 0:
            low, high = ([slice(None)] * g.ndim for _ in range(2))
            low[axis], high[axis] = slice(0, place), slice(place, None)
            for part in (tuple(low), tuple(high)):
                out[part] = _tree(g[part], h[part], depth - 1, least)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, depth: int = 2, least: float = 0.5) -> Gam:
    """Train on rows x with classes y (0 or 1). No rows: every score is 1; one class only: that class, smoothed."""
    width = x.shape[1]
    edges = [_edges(x[:, j], bins) for j in range(width)]
    coarse = [_edges(x[:, j], pair_bins) for j in range(width)]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], pair_edges=coarse)
    if not len(x):
        model.intercept = 30.0
        return model
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(p / (1 - p)))
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    z = np.full(len(x), model.intercept)

    def boost(places: list[np.ndarray], shapes: list[tuple[int, ...]], tables: list[np.ndarray], n: int) -> None:
        for _ in range(n):
            for place, shape, values in zip(places, shapes, tables, strict=True):
                q = 1 / (1 + np.exp(-z))
                size = int(np.prod(shape))
                g = np.bincount(place, y - q, size).reshape(shape)
                h = np.bincount(place, q * (1 - q), size).reshape(shape)
                step = rate * np.clip(_tree(g, h, depth, least), -4, 4)
                values += step
                z[:] += step.ravel()[place]

    boost(at, [t.shape for t in model.tables], model.tables, rounds)
    if pairs:
        low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
        q = 1 / (1 + np.exp(-z))
        gains = []
        for a in range(width):
            for b in range(a + 1, width):
                shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
                place = low[a] * shape[1] + low[b]
                g = np.bincount(place, y - q, shape[0] * shape[1])
                h = np.bincount(place, q * (1 - q), shape[0] * shape[1])
                gains.append((float((g**2 / (h + 1)).sum()), a, b))
        chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
        shapes = [(len(coarse[a]) + 1, len(coarse[b]) + 1) for a, b in chosen]
        model.pairs, model.pair_tables = chosen, [np.zeros(s) for s in shapes]
        boost([low[a] * s[1] + low[b] for (a, b), s in zip(chosen, shapes, strict=True)], shapes, model.pair_tables, rounds // 3)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the rows that training never sees; rows without an id aren't in it, nor in training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Gam:
    """Fit to at most `rows` labelled documents outside the held-out fifth: those lowest by a hash of the id. Rows without id or
    label don't count; of an id's several texts, that with the least features does."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")).filter("label_id is not null and label is not null")
    known = known.filter(~held_out("label_id")).orderBy(F.xxhash64("label_id"), "label_id", "label").limit(rows)
    chosen = documents.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("label_id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = text_features(*utf8(batch.column(2)))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    kind = labels.schema[id_col].dataType.simpleString()
    seen = map_batches(chosen.select("label_id", "label", text_col), run, f"id {kind}, label double, x array<double>")
    found = seen.groupBy("id", "label").agg(F.min("x").alias("x")).select("label", "x").toArrow()  # at most `rows`
    x = np.array(found["x"].to_pylist()).reshape(found.num_rows, len(NAMES))
    y = (found["label"].to_numpy() > 0).astype(float)
    order = np.lexsort((y, *x.T))  # the same model however the rows arrive
    return fit(x[order], y[order])


def score(documents: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of documents, and quality_score; a null text scores as an empty one."""
    names = [f.name for f in documents.schema.fields]
    name = "quality_score"
    while name in names:
        name += "_"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = model.score(text_features(*utf8(batch.column(names.index(text_col)))))
        return pa.record_batch([*batch.columns, pa.array(value)], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return map_batches(documents, run, f"{schema}, `{name}` double")
