"""Language of documents and of their spans.

Script ranges narrow a word's languages to those that use its script; letter trigrams score the word under
each; Viterbi with a penalty for switching labels the words, and runs of one label are spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import slices, utf8

#: Documents that training takes at most, those lowest by a hash of their ids.
TRAIN_ROWS = 6_000
#: Trigrams are hashed to so many slots, which bounds the model at languages x slots.
SLOTS = 1 << 16
#: Bytes that one Viterbi run holds.
VITERBI_BYTES = 6 << 20
UNKNOWN = "und"

# Script by the first byte of a UTF-8 letter.
SCRIPTS = {"latin": (0x41, 0xCD), "greek": (0xCE, 0xCF), "cyrillic": (0xD0, 0xD4), "armenian_hebrew": (0xD5, 0xD7), "arabic": (0xD8, 0xDD), "other_two": (0xDE, 0xDF), "indic": (0xE0, 0xE0), "asia_and_extended": (0xE1, 0xE1), "kana_han": (0xE3, 0xE9), "hangul": (0xEA, 0xED), "rare": (0xEE, 0xF4)}

_SCRIPT = np.zeros(256, np.int64)
for _i, (_a, _b) in enumerate(SCRIPTS.values()):
    _SCRIPT[_a : _b + 1] = _i
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xE2), *range(0xE3, 0xF5)]] = True


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and Latin-1), and which bytes belong to letters."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    before = np.empty_like(data)
    before[:1], before[1:] = 0, data[:-1]
    capital = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = np.where(capital, low + np.uint8(32), low)
    inside = _LETTER[data]
    trail = (data >= 0x80) & (data < 0xC0)
    off_two = trail & ((before == 0xC2) | (before == 0xE2) | (before == 0xC3) & ((data == 0x97) | (data == 0xB7)))
    off_three = np.zeros(len(data), bool)
    off_three[2:] = trail[2:] & trail[1:-1] & (data[:-2] == 0xE2)
    inside &= ~(off_two | off_three)
    lone = np.zeros(len(data), bool)
    lone[:-1] = (data[:-1] == 0xC3) & ~inside[1:]
    return low, inside & ~lone


def _words(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def _slots(low: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word's trigrams, the word framed by spaces, and for each word the range of its slots."""
    size = ends - starts
    ranges = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ranges[1:])
    place = np.arange(ranges[-1]) + np.repeat(starts - ranges[:-1], size)
    here = low[place].astype(np.uint32)
    before, after = np.full(len(here), 32, np.uint32), np.full(len(here), 32, np.uint32)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[ranges[:-1]] = 32
    after[ranges[1:] - 1] = 32
    code = (before << np.uint32(16) | here << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int64), ranges


@dataclass
class Model:
    """langs in code point order; weights: log probability by slot and language; scripts: may a language use it."""

    langs: list[str]
    weights: np.ndarray
    scripts: np.ndarray
    common: int = 0  # the language with most letters in training, for letters that no script range holds

    def word_scores(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low, inside = letters(data)
        starts, ends, of = _words(inside, at)
        slots, ranges = _slots(low, inside, starts, ends)
        sums = np.zeros((len(slots) + 1, len(self.langs)), np.float64)
        np.cumsum(self.weights[slots], axis=0, out=sums[1:])
        scores = sums[ranges[1:]] - sums[ranges[:-1]]
        allowed = self.scripts[_SCRIPT[data[starts]]]
        return np.where(allowed | ~allowed.any(1, keepdims=True), scores, scores - 50.0), starts, ends, of


def viterbi(scores: np.ndarray, of: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; rows of of[i]:of[i+1] are one text. All texts advance together, word by word."""
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], of[:-1][order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    label = np.zeros(len(scores), np.int16)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    v = np.zeros((len(size), scores.shape[1]))
    for t in range(steps):
        k = live[t]
        v = v[:k]
        if t:
            best = v.argmax(1)
            jump = (v[np.arange(k), best] - penalty)[:, None]
            kept.append((v >= jump, best.astype(np.int16)))
            v = np.maximum(v, jump)
        v = v + scores[first[:k] + t]
        if t + 1 < steps and live[t + 1] < k or t + 1 == steps:
            gone = slice(live[t + 1] if t + 1 < steps else 0, k)
            label[first[gone] + t] = v[gone].argmax(1)
    for t in range(steps - 1, 0, -1):
        k = live[t]
        stay, best = kept[t - 1]
        now = label[first[:k] + t]
        label[first[:k] + t - 1] = np.where(stay[np.arange(live[t]), now], now, best)
    return label


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most `rows` documents with text, language and id outside the held-out fifth (crc32 of id mod 5 = 0)."""
    usable = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    chosen = usable.select(F.col(id_col).alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen").limit(rows).distinct()
    sample = usable.join(F.broadcast(chosen), F.col(id_col) == F.col("chosen")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = utf8(part.column(1))
                low, inside = letters(data)
                starts, ends, of = _words(inside, at)
                slots, ranges = _slots(low, inside, starts, ends)
                langs = part.column(0).to_pylist()
                script = _SCRIPT[data[starts]]
                for lang in sorted(set(langs)):
                    own = np.zeros(len(slots), bool)
                    scripts = np.zeros(len(SCRIPTS), np.int64)
                    for i, x in enumerate(langs):
                        if x == lang:
                            own[ranges[of[i]] : ranges[of[i + 1]]] = True
                            scripts += np.bincount(script[of[i] : of[i + 1]], minlength=len(SCRIPTS))
                    n = np.r_[np.bincount(slots[own], minlength=SLOTS), scripts]
                    at_slot = np.flatnonzero(n)
                    yield pa.record_batch([pa.array([lang] * len(at_slot), pa.string()), pa.array(at_slot), pa.array(n[at_slot])], ["lang", "slot", "n"])

    found = sample.mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()), key=lambda x: x.encode())
    counts = np.zeros((SLOTS + len(SCRIPTS), len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    counts[found["slot"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    grams, scripts = counts[:SLOTS], counts[SLOTS:]
    seen = (grams.sum(1, keepdims=True) > 0).sum()
    weights = np.log((grams + 0.3) / (grams.sum(0) + 0.3 * max(seen, 1)))
    common = int(grams.sum(0).argmax()) if langs else 0
    return Model(langs, weights - weights.mean(1, keepdims=True) if langs else weights, scripts >= 0.005 * np.maximum(scripts.sum(0), 1), common)


def _label(model: Model, column: pa.Array, penalty: float):
    data, at = utf8(column)
    scores, starts, ends, of = model.word_scores(data, at)
    return viterbi(scores, of, penalty), starts, ends, of, data, at


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """Rows (id, lang_pred, score, n_spans): the language with most letters, its share of the letters.

    Null text, text without a letter, or a model without languages: `und`, score 0, no spans.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, VITERBI_BYTES):
                n = part.num_rows
                names, share, spans = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
                if model.langs:
                    label, starts, ends, of, data, at = _label(model, part.column(1), penalty)
                    doc = np.repeat(np.arange(n), np.diff(of))
                    width = len(model.langs)
                    mass = np.bincount(doc * width + label, (ends - starts).astype(float), n * width).reshape(n, width)
                    total = mass.sum(1)
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    spans = np.bincount(doc[new], minlength=n)
                    real = _has_ascii(data, at)
                    for i in np.flatnonzero(~real & (np.diff(at) > 0)):
                        text = data[at[i] : at[i + 1]].tobytes().decode()
                        real[i] = any(c.isalpha() for c in text)
                    best = np.where(total > 0, mass.argmax(1), model.common)
                    share = np.where(real & (total > 0), mass[np.arange(n), best] / np.maximum(total, 1), np.where(real, 1 / width, 0.0))
                    spans = np.where(real, spans, 0)
                    names = [model.langs[b] if r else UNKNOWN for b, r in zip(best.tolist(), real.tolist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(share), pa.array(spans)], [id_col, "lang_pred", "score", "n_spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, n_spans bigint")


def _has_ascii(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data < 128) & _LETTER[data], out=sums[1:])
    return sums[at[1:]] > sums[at[:-1]]


def spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """A row for each span: (id, lang, start, end), byte offsets in the UTF-8 text from first to last letter."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, VITERBI_BYTES):
                if not model.langs:
                    continue
                label, starts, ends, of, _, at = _label(model, part.column(1), penalty)
                doc = np.repeat(np.arange(part.num_rows), np.diff(of))
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(label)] - 1 if len(label) else first
                own = doc[first]
                yield pa.record_batch([part.column(0).take(pa.array(own)), pa.array([model.langs[x] for x in label[first]], pa.string()), pa.array(starts[first] - at[own]), pa.array(ends[last] - at[own])], [id_col, "lang", "start", "end"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang string, start bigint, end bigint")
