"""Canonical JSON (RFC 8785) as Column expressions: members in key order, shortest numbers, least escapes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The short escapes of RFC 8785, the backslash first. Other control characters go by number.
SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r"))

NULL = "null"


def literal(value: str | None) -> Column:
    """A string that is known beforehand."""
    return F.lit(json.dumps(value, ensure_ascii=False))


def string(value: Column) -> Column:
    body = value
    for plain, escaped in SHORT:
        body = F.replace(body, F.lit(plain), F.lit(escaped))
    by_number = lambda c: F.when(F.ascii(c) < 32, F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c)
    rare = F.array_join(F.transform(F.split(body, ""), lambda c: F.when(c == "", c).otherwise(by_number(c))), "")
    return F.coalesce(F.concat(F.lit('"'), F.when(F.rlike(value, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]")), rare).otherwise(body), F.lit('"')), F.lit(NULL))


def boolean(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL))


def integer(value: Column) -> Column:
    return F.coalesce(value.cast("bigint").cast("string"), F.lit(NULL))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _printed(size: Column) -> Column:
    """struct<d,n> of what the JVM prints: the digits without outer zeros, and where the point stands in them. Whole
    numbers beyond 2^53 are printed as longs, which are exact."""
    plain = F.when((size >= 2.0**53) & (size < 9e18), F.concat(size.cast("bigint").cast("string"), F.lit(".0"))).otherwise(size.cast("string"))
    form = r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"
    parts = lambda s: F.struct(*(F.regexp_extract(s, form, k).alias(n) for k, n in ((1, "whole"), (2, "part"), (3, "power"))))
    raw = lambda p: F.struct(F.concat(p["whole"], p["part"]).alias("raw"), (F.length(p["whole"]) + F.coalesce(p["power"].try_cast("int"), F.lit(0))).alias("n"))
    lead = lambda r: F.struct(F.trim(r["raw"], F.lit("0")).alias("d"), (r["n"] - F.length(r["raw"]) + F.length(F.ltrim(r["raw"], F.lit("0")))).alias("n"))
    return _let(_let(_let(plain, parts), raw), lead)


def _shorter(p: Column, size: Column, digits: int) -> Column:
    """p rounded to fewer digits if that reads back as the same double, else null."""
    unit = F.pow(F.lit(10), F.greatest(F.length(p["d"]) - digits, F.lit(0))).cast("bigint")
    rounded = _let(unit, lambda u: F.call_function("div", p["d"].try_cast("bigint") + F.call_function("div", u, F.lit(2)), u).cast("string"))
    power = p["n"] - digits
    same = lambda d: F.concat(d, F.lit("E"), power.cast("string")).try_cast("double") == size
    return F.when(F.length(p["d"]).between(digits + 1, digits + 4), _let(rounded, lambda d: F.when(same(d), F.struct(d.alias("d"), (power + F.length(d)).alias("n")))))


def _layout(p: Column) -> Column:
    """Digits and point as ECMAScript lays them out."""
    d, n, k = p["d"], p["n"], F.length(p["d"])
    mantissa = F.concat(F.substring(d, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""))
    return (
        F.when((n >= k) & (n <= 21), F.rpad(d, n, F.lit("0")))
        .when((n > 0) & (n <= 21), F.concat(F.substr(d, F.lit(1), n), F.lit("."), F.substr(d, n + 1)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
        .otherwise(F.concat(mantissa, F.lit("e"), F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string")))
    )


def number(value: Column) -> Column:
    """A double as ECMAScript prints it; null is null, and what isn't finite is an error."""
    return F.get(numbers(value), F.lit(0))


def numbers(*values: Column) -> Column:
    """An array of doubles as ECMAScript prints them. The JVM may print a digit more than needed, so fewer digits are tried
    first. One call for all numbers of a record keeps its plan small."""

    def shown(x: Column) -> Column:
        size = F.abs(x)
        chosen = _let(_printed(size), lambda p: F.coalesce(*(_shorter(p, size, k) for k in (1, 15, 16, 17)), p))
        text = _let(_let(chosen, lambda p: F.struct(F.rtrim(p["d"], F.lit("0")).alias("d"), p["n"].alias("n"))), _layout)
        refused = F.raise_error(F.lit("canonical JSON has no number for what isn't finite")).cast("string")
        sign = F.when(x < 0, "-").otherwise("")
        return F.when(x.isNull(), NULL).when(F.isnan(x) | (size == float("inf")), refused).when(x == 0, "0").otherwise(F.concat(sign, text))

    return F.transform(F.array(*(v.cast("double") for v in values)), shown)


def array(values: Column) -> Column:
    """An array of members that are canonical already."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def record(members: dict[str, Column]) -> Column:
    """An object of members that are canonical already, in the order of UTF-16 code units of their names."""
    parts: list[Column] = []
    for name in sorted(members, key=lambda n: n.encode("utf-16-be")):
        parts += [F.lit(("," if parts else "{") + json.dumps(name, ensure_ascii=False) + ":"), members[name]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
