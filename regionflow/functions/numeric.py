"""Numeric scalars as Column expressions over numbers and arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors below which a probability counts as none, and ITU-601 luma weights scaled by 2^16.
LEAST_PROBABILITY = 1e-7
LUMA = (19595, 38470, 7471, 32768)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also inside the lambdas that `use` makes."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def softmax(logits: Column) -> Column:
    """Shifted by the largest; uniform if nothing has mass."""
    raised = lambda top: F.transform(logits, lambda x: F.exp(x - top))
    share = lambda e, total: F.when(total > 0, F.try_divide(e, total)).otherwise(F.try_divide(F.lit(1.0), F.size(logits)))
    return let(F.array_max(logits), lambda top: let(raised(top), lambda es: let(_sum(es), lambda total: F.transform(es, lambda e: share(e, total)))))


def log_softmax(logits: Column) -> Column:
    norm = lambda top: top + F.ln(_sum(F.transform(logits, lambda x: F.exp(x - top))))
    return let(F.array_max(logits), lambda top: let(norm(top), lambda n: F.transform(logits, lambda x: x - n)))


def entropy(probabilities: Column) -> Column:
    """Bits; probabilities near 0 give nothing."""
    return F.aggregate(F.filter(probabilities, lambda p: p > LEAST_PROBABILITY), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def brier_weight(score: Column) -> Column:
    return F.exp(-F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def beam_score(logprob: Column, length: Column, penalty: float = 2.0) -> Column:
    return logprob / F.pow(F.greatest(length, F.lit(1)), F.lit(penalty))


def mean_confidence(probability: Column) -> Column:
    """Aggregate: geometric mean with a floor; nulls don't count, and without rows it is 0."""
    floored = F.when(probability.isNotNull(), F.greatest(probability, F.lit(LEAST_PROBABILITY)))
    return F.coalesce(F.exp(F.avg(F.ln(floored))), F.lit(0.0))


def sequence_confidence(logprob: Column, length: Column) -> Column:
    return F.least(F.greatest(F.exp(F.try_divide(logprob, length)), F.lit(0.0)), F.lit(1.0))


def luma(red: Column, green: Column, blue: Column) -> Column:
    r, g, b, half = LUMA
    return F.shiftright(red * r + green * g + blue * b + half, 16)


def rescaled(value: Column) -> Column:
    """A pixel from 0..255 to -1..1."""
    return (value / 255.0 - 0.5) / 0.5


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array; no interpolation."""
    return let(F.array_sort(values), lambda ordered: F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))


def banned_next(tokens: Column, n: int = 3) -> Column:
    """Tokens that would repeat an n-gram if they came next, in order of their first use."""
    have, head = F.size(tokens), n - 1
    tail = F.slice(tokens, F.greatest(have - head + 1, F.lit(1)), F.lit(head))
    starts = F.sequence(F.lit(1), F.greatest(have - head, F.lit(1)))
    repeated = let(tail, lambda last: F.filter(starts, lambda i: (F.slice(tokens, i, F.lit(head)) == last) & (i + head <= have)))
    following = F.array_distinct(F.transform(repeated, lambda i: F.element_at(tokens, (i + head).cast("int"))))
    return F.when(have < n, F.array().cast("array<bigint>")).otherwise(following.cast("array<bigint>"))


def settled(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A usable probability: not null, not NaN, within bounds."""
    return F.coalesce(~F.isnan(value) & value.between(low, high), F.lit(False))


def uniform(seed: Column, draw: int, low: float, high: float) -> Column:
    """A number from low to high for each seed and draw, the same on any number of tasks and in any SQL engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.lit(str(draw)))), 1, 8), 16, 10).cast("double")
    return F.lit(low) + bits / float(1 << 32) * (high - low)
