"""Quality rules and n-gram perplexity bands.

Spark counts the 4-grams of code points for each language and derives a modified Kneser-Ney model from all of them,
order by order; documents whose perplexity lies outside their language's band are rejected. Texts look up the most
frequent 4-grams, at most TABLE over all languages, in a broadcast table, and all others through a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import cut, map_batches, slices, span_hashes, sweep, utf8, word_spans

#: Symbols below START are code points; SYMBOLS ** ORDER is the largest that fits in 63 bits.
ORDER, SYMBOLS, START = 4, 55_108, 55_107
NO_LANGUAGE = ""
#: 4-grams of a language that `pruned` leaves.
LARGEST = 2_500_000
#: Most 4-grams of the broadcast table, over all languages; the rest is joined.
TABLE = 2_500_000
#: Most pairs of symbols of all languages that are broadcast to longer grams.
PAIRS = 500_000
#: Units of a cost, the negative log probability of a symbol: sums of whole numbers don't depend on their order.
UNIT = 1 << 24
#: Different 4-grams that a task holds before it hands over what it has.
HELD = 2_000_000

#: Symbol of a code point: itself, but for the few at START and beyond, which are folded onto lower ones.
_SYMBOL = (np.arange(0x110000) % START).astype(np.uint16)


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of UTF-8 texts, and each text's offsets in them."""
    first = (data & 0xC0) != 0x80
    if first.all() and not (data >= 0x80).any():
        return _SYMBOL[data], at
    lead = np.flatnonzero(first)
    points = data[lead].astype(np.int32)
    longer = np.flatnonzero(points >= 0xC0)
    b, follows = points[longer], np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    c, d, e = (follows[lead[longer] + k] for k in (1, 2, 3))
    points[longer] = np.where(b < 0xE0, (b & 0x1F) << 6 | c, np.where(b < 0xF0, (b & 0x0F) << 12 | c << 6 | d, (b & 7) << 18 | c << 12 | d << 6 | e))
    return _SYMBOL[np.minimum(points, 0x10FFFF)], np.searchsorted(lead, at)


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each code point the id of the ORDER symbols that end there; START stands before a text's first symbol."""
    return _grams(*symbols(data, at))


def _grams(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = s.astype(np.int64)
    out = s.copy()
    if not len(s):
        return out
    place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER):
        back = np.full(len(s), START, np.int64)
        back[k:] = s[:-k]
        out += np.where(place >= k, back, START) * np.int64(SYMBOLS**k)
    return out


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and their counts from several such."""
    if len(parts) == 1:
        return parts[0]
    ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(ids, kind="stable")
    ids, n = ids[by], n[by]
    at = np.flatnonzero(np.diff(ids, prepend=-1))
    return ids[at], np.add.reduceat(n, at)


def count(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, gram, n) over all texts; a null language is NO_LANGUAGE."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def hand_over():
            for lang, parts in held.items():
                ids, n = _sum_up(parts)
                yield pa.record_batch([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        def entries() -> int:
            return sum(len(ids) for parts in held.values() for ids, _ in parts)

        for batch in batches:
            for part in slices(batch):
                s, at = symbols(*utf8(part.column(1)))
                g = _grams(s, at)
                langs = np.array([x or NO_LANGUAGE for x in part.column(0).to_pylist()], object)
                own_lang = np.repeat(langs, np.diff(at)) if len(set(langs)) > 1 else None
                for lang in sorted(set(langs)):
                    own = g if own_lang is None else g[own_lang == lang]
                    if len(own):
                        held.setdefault(lang, []).append(np.unique(own, return_counts=True))
                if entries() > HELD:
                    for lang, parts in held.items():
                        held[lang] = [_sum_up(parts)]
                    if entries() > HELD // 2:
                        yield from hand_over()
        yield from hand_over()

    return df.select(lang_col, text_col).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def dealt(counts: DataFrame) -> DataFrame:
    """counts with mid, the inner symbols of a gram: in its partition lie all grams with its first or with its last three symbols."""
    return counts.withColumn("mid", F.expr(f"gram div {SYMBOLS} % {SYMBOLS**2}")).repartition("lang", "mid")


def pruned(counts: DataFrame, largest: int = LARGEST) -> DataFrame:
    """counts without, in a language of more than `largest` 4-grams, those below the least count that leaves so many.

    For callers who want a smaller model from `train`; `judge` takes all counts.
    """
    counts = cut(counts)
    many = counts.groupBy("lang", F.least("n", F.lit(10_000)).alias("n")).count().collect()
    least: dict[str, int] = {}
    for lang in {r["lang"] for r in many}:
        left = sum(r["count"] for r in many if r["lang"] == lang)
        for n, gone in sorted((r["n"], r["count"]) for r in many if r["lang"] == lang):
            if left <= largest:
                break
            least[lang], left = n + 1, left - gone
    for lang, n in least.items():
        counts = counts.filter((F.col("lang") != lang) | (F.col("n") >= min(n, 10_000)))
    return counts


@dataclass
class Model:
    """By order from 1: sorted ids and log probabilities of the n-grams; sorted ids of contexts and log back-off weights."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    context_keys: list[np.ndarray]
    backoffs: list[np.ndarray]

    def log_probability(self, ids: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(ids)), np.arange(len(ids))
        for order in range(ORDER, 0, -1):
            sub = ids[left] % SYMBOLS**order
            found, at = _find(self.keys[order - 1], sub)
            out[left[found]] += self.logs[order - 1][at]
            left, sub = left[~found], sub[~found]
            if not len(left):
                break
            known, at = _find(self.context_keys[order - 1], sub // SYMBOLS)
            out[left[known]] += self.backoffs[order - 1][at]
        out[left] += -np.log(SYMBOLS)
        return out


def _find(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
    found = keys[at] == ids if len(keys) else np.zeros(len(ids), bool)
    return found, at[found]


def _discounts(grams_: DataFrame, *of: tuple[str, str]) -> DataFrame:
    """A row for each language: of the counts in a column, where a condition holds, three discounts d<column>1 to 3."""
    ks = (1, 2, 3, 4)
    sums = grams_.groupBy(F.col("lang").alias("of_lang")).agg(*(F.expr(f"greatest(count_if({n} = {k} and {where}), 1e-9D)").alias(f"{n}_{k}") for n, where in of for k in ks))
    d = []
    for n, _ in of:
        a, b, c, e = (f"{n}_{k}" for k in ks)
        y = f"{a} / ({a} + 2 * {b})"
        for k, raw, most in ((1, f"1 - 2 * {y} * {b} / {a}", 0.95), (2, f"2 - 3 * {y} * {c} / {b}", 1.9), (3, f"3 - 4 * {y} * {e} / {c}", 2.9)):
            d.append(F.expr(f"greatest(0.05D, least({most}D, {raw}))").alias(f"d{n}{k}"))
    return sums.select("of_lang", *d)


def _discounted(rows: DataFrame, discounts: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(discounts), F.col("lang") == F.col("of_lang"))  # a row for each language


def _own(n: str, total: str) -> Column:
    return F.expr(f"({n} - case {n} when 1 then d{n}1 when 2 then d{n}2 else d{n}3 end) / {total}")


def _gamma(n: str, total: str, *times: str) -> Column:
    return F.expr(f"({' + '.join(f'd{n}{k} * {x}' for k, x in enumerate(times, 1))}) / {total}")


def levels(counts: DataFrame) -> list[DataFrame]:
    """By order from 1: rows (lang, gram, n, p, gamma) of modified Kneser-Ney over all counts, from what `dealt` gives.

    Three discounts an order, lower orders from the number of different left neighbours; gamma is the back-off weight of
    the gram's context. Grams of four symbols and their last three share `mid`, which is the context of the latter.
    """
    rows = counts.select("lang", "mid", "gram", "n", F.expr(f"gram div {SYMBOLS}").alias("context"), (F.col("gram") % SYMBOLS ** (ORDER - 1)).alias("tail"))
    context, tail, mid = (Window.partitionBy("lang", "mid", *x) for x in (["context"], ["tail"], []))
    rows = rows.withColumns({"total": F.sum("n").over(context)} | {f"n{k}": F.expr(f"count_if(n {x})").over(context) for k, x in ((1, "= 1"), (2, "= 2"), (3, "> 2"))})
    rows = rows.withColumns({"m": F.count("*").over(tail), "first": F.row_number().over(tail.orderBy("gram")) == 1})
    rows = rows.withColumns({"m_total": F.count("*").over(mid)} | {f"m{k}": F.expr(f"count_if(first and m {x})").over(mid) for k, x in ((1, "= 1"), (2, "= 2"), (3, "> 2"))})
    two = cut(rows.filter("first").groupBy("lang", (F.col("tail") % SYMBOLS**2).alias("gram")).agg(F.count("*").alias("n")))
    one = cut(two.groupBy("lang", (F.col("gram") % SYMBOLS).alias("gram")).agg(F.count("*").alias("n")))
    out: list[DataFrame] = []
    for low in (one, two):
        context = Window.partitionBy("lang", F.expr(f"gram div {SYMBOLS}"))  # at most SYMBOLS rows
        low = low.withColumns({"total": F.sum("n").over(context)} | {f"n{k}": F.expr(f"count_if(n {x})").over(context) for k, x in ((1, "= 1"), (2, "= 2"), (3, "> 2"))})
        low = _discounted(low, _discounts(low, ("n", "true"))).select("lang", "gram", "n", _own("n", "total").alias("own"), _gamma("n", "total", "n1", "n2", "n3").alias("gamma"))
        if out:
            before = out[-1].select("lang", F.col("gram").alias("last"), F.col("p").alias("low_p"))
            low = low.withColumn("last", F.col("gram") % SYMBOLS).join(before, ["lang", "last"])
        else:
            low = low.withColumn("low_p", F.lit(1 / SYMBOLS))
        out.append(cut(low.select("lang", "gram", "n", (F.col("own") + F.col("gamma") * F.col("low_p")).alias("p"), "gamma")))
    pairs = out[-1].select("lang", F.col("gram").alias("end"), F.col("p").alias("end_p"))
    rows = _discounted(rows, _discounts(rows, ("n", "true"), ("m", "first"))).withColumn("end", F.col("tail") % SYMBOLS**2)
    rows = rows.select("lang", "gram", "n", "tail", "m", "first", "end", _own("n", "total").alias("own"), _gamma("n", "total", "n1", "n2", "n3").alias("gamma"), _own("m", "m_total").alias("m_own"), _gamma("m", "m_total", "m1", "m2", "m3").alias("m_gamma"))
    rows = rows.join(F.broadcast(pairs) if two.count() <= PAIRS else pairs, ["lang", "end"])
    p = F.col("m_own") + F.col("m_gamma") * F.col("end_p")
    out.append(rows.filter("first").select("lang", F.col("tail").alias("gram"), F.col("m").alias("n"), p.alias("p"), F.col("m_gamma").alias("gamma")))
    out.append(rows.select("lang", "gram", "n", (F.col("own") + F.col("gamma") * p).alias("p"), "gamma"))
    return out


def _by_lang(df: DataFrame) -> dict[str, list[np.ndarray]]:
    """The columns of rows (lang, gram, ...) for each language, sorted by gram."""
    got = df.toArrow().combine_chunks()
    langs = got.column(0).combine_chunks().dictionary_encode()
    code, columns = langs.indices.to_numpy(), [x.to_numpy() for x in got.columns[1:]]
    by = np.lexsort((columns[0], code))
    ends = np.searchsorted(code[by], np.arange(len(langs.dictionary) + 1))
    return {lang: [x[by[ends[i] : ends[i + 1]]] for x in columns] for i, lang in enumerate(langs.dictionary.to_pylist())}


def train(counts: DataFrame) -> dict[str, Model]:
    """A model for each language, of all its counts, gathered as arrays: for texts of any origin. `judge` gathers none."""
    out: dict[str, Model] = {}
    for level in levels(cut(dealt(counts))):
        for lang, (grams_, p, gamma) in _by_lang(level.select("lang", "gram", "p", "gamma")).items():
            model = out.setdefault(lang, Model([], [], [], []))
            context, at = np.unique(grams_ // SYMBOLS, return_index=True)
            model.keys.append(grams_)
            model.logs.append(np.log(p).astype("f4"))
            model.context_keys.append(context)
            model.backoffs.append(np.log(np.maximum(gamma[at], 1e-12)).astype("f4"))
    return out


def costs(counts: DataFrame) -> DataFrame:
    """From what `dealt` gives, rows (lang, gram, n, cost): the last symbol's negative log probability in each counted 4-gram, in UNITs."""
    return levels(counts)[-1].select("lang", "gram", "n", F.round(-F.log("p") * UNIT).cast("bigint").alias("cost"))


def divided(counts: DataFrame, largest: int = TABLE) -> tuple[dict[str, list[np.ndarray]], DataFrame | None]:
    """The costs of the most frequent 4-grams for each language (sorted grams, costs), at most `largest`, and rows of all others, if any.

    The bound lies between two powers of two, so a 4-gram of the others is in few texts unless all are frequent.
    """
    counts = cut(dealt(counts))
    sweep(counts.sparkSession)
    digits = F.length(F.bin("n"))
    by = {r["digits"]: r["count"] for r in counts.groupBy(digits.alias("digits")).count().collect()}
    least, have = 65, 0
    for k in sorted(by, reverse=True):
        have += by[k]
        if have > largest:
            break
        least = k
    table, whole = costs(counts), have <= largest
    if not whole:
        table = cut(table)
    often = table.filter(digits >= least).select("lang", "gram", F.col("cost").cast("int").alias("cost"))
    return _by_lang(often), None if whole else table.filter(digits < least).select("lang", "gram", "cost")


def base_rules(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts over whole texts; see op8's contract in the README."""
    starts, ends, of = word_spans(data, at)
    n_words = np.diff(of)

    def per(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x, out=sums[1:])
        return sums[by[1:]] - sums[by[:-1]]

    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    points = ~space[data] & ((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    doc = np.repeat(np.arange(len(n_words)), n_words)
    hashes = span_hashes(data, starts, ends)
    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        w = hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:] * np.uint64(0x165667B19E3779F9)
        inner = np.flatnonzero(doc[:-2] == doc[2:])
        by = inner[np.lexsort((w[inner], doc[inner]))]
        same = (w[by][1:] == w[by][:-1]) & (doc[by][1:] == doc[by][:-1])
        twice = np.zeros(len(by), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[by[twice] + k] = True
    raw = data.tobytes()
    dup = np.zeros(len(n_words), np.int64)
    for i in np.flatnonzero(per(data == 10, at) > 0):
        lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": per(points, at), "n_symbols": per(symbol[data], at), "n_dup_lines": dup, "n_repeat_words": per(covered, of)}


def measure(df: DataFrame, often: dict[str, list[np.ndarray]], others: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, lang, the base counts, log_ppl, text_hash): mean cost of a text's symbols, null without text.

    A text's 4-grams are among those of `divided`; those that are not in `often` go, once a text, to a join with `others`.
    """
    held = df.sparkSession.sparkContext.broadcast(often)  # at most TABLE entries
    whole = others is None
    none = [np.empty(0, np.int64), np.empty(0, np.int32)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column(2))
        base = base_rules(data, at)
        s, at = symbols(data, at)
        g = _grams(s, at)
        langs = [x or NO_LANGUAGE for x in batch.column(1).to_pylist()]
        cost = np.zeros(len(g), np.int64)
        by_doc = np.array(langs, object)
        size = np.diff(at)
        doc = np.repeat(np.arange(len(size)), size)
        rest = [(np.empty(0, np.int64),) * 3]
        for lang in sorted(set(langs)):
            own = np.repeat(by_doc == lang, size)
            if own.any():
                ids, place = np.unique(g[own], return_inverse=True)
                keys, values = held.value.get(lang, none)
                found, where = _find(keys, ids)
                of = np.zeros(len(ids), np.int64)
                of[found] = values[where]
                cost[own] = of[place]
                if not found.all():
                    far = ~found[place]
                    pairs, n = np.unique(doc[own][far] * len(ids) + place[far], return_counts=True)
                    rest.append((pairs // len(ids), ids[pairs % len(ids)], n))
        sums = np.zeros(len(g) + 1, np.int64)
        np.cumsum(cost, out=sums[1:])
        columns = [batch.column(0), pa.array(langs, pa.string()), *(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(size.astype(np.int64)), batch.column(3)]
        names = [id_col, "lang", *base, "cost", "size", "text_hash"]
        if not whole:
            of_doc, gram, n = (np.concatenate(x) for x in zip(*rest, strict=True))
            by = np.argsort(of_doc, kind="stable")
            ends = pa.array(np.searchsorted(of_doc[by], np.arange(len(size) + 1)).astype(np.int32))
            columns += [pa.ListArray.from_arrays(ends, pa.array(gram[by])), pa.ListArray.from_arrays(ends, pa.array(n[by].astype(np.int32)))]
            names += ["grams", "times"]
        return pa.record_batch(columns, names)

    kind = df.schema[id_col].dataType.simpleString()
    base = "lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    schema = f"`{id_col}` {kind}, {base}, cost bigint, size bigint, text_hash bigint" + ("" if whole else ", grams array<bigint>, times array<int>")
    rows = map_batches(df.select(id_col, lang_col, text_col, F.xxhash64(text_col)), run, schema)
    if others is not None:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        pairs = rows.select("row", "lang", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "lang", "x.grams", "x.times")
        pairs = pairs.join(others.select("lang", F.col("gram").alias("grams"), F.col("cost").alias("each")), ["lang", "grams"])
        more = pairs.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
        rows = rows.drop("grams", "times").join(more, "row", "left").withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0)))
    mean = F.when(F.col("size") > 0, F.col("cost") / UNIT / F.col("size"))
    return rows.select(id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", mean.alias("log_ppl"), "text_hash")


def judge(df: DataFrame, width: float = 8.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", largest: int = TABLE) -> DataFrame:
    """Rows (id, base counts, base_failed, perplexity, low, high, kept).

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. A language's
    band reaches `width` times the median's distance to the quartile on either side of the median log
    perplexity of its documents that pass the base rules. Null or empty texts fail the base rules. The 4-grams beyond
    the `largest` in the broadcast table are joined; the rows are the same whatever it is.
    """
    often, others = divided(count(df, text_col, lang_col), largest)
    rows = measure(df, often, others, id_col, text_col, lang_col)
    rows = cut(rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000)
    texts = rows.filter(~F.col("base_failed")).groupBy("lang", "text_hash").agg(F.max("log_ppl").alias("log_ppl"))
    bands = texts.groupBy(F.col("lang").alias("band_lang")).agg(q.alias("q"))
    bands = bands.select("band_lang", (F.col("q")[1] - width * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + width * (F.col("q")[2] - F.col("q")[1])).alias("high"))
    judged = rows.join(F.broadcast(bands), F.col("lang") == F.col("band_lang"), "left")  # a row for each model at most
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"))
