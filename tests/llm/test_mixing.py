from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from regionflow.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, full = total * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in full]
        if not free:
            return full
        per = (budget - sum(full.values())) / sum(w[n] for n in free)
        over = [n for n in free if per * w[n] > most * sizes[n]]
        if not over:
            return full | {n: per * w[n] for n in free}
        full |= {n: most * sizes[n] for n in over}


def test_targets_and_words_taken(hard):
    rows = mixing.mix(hard).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in hard.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want = brute_targets(sizes)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert len(r["positions"]) == r["passes"] and (r["position"] is None) == (r["taken"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)


def test_reruns_and_partitions_agree(hard):
    cols = ["doc_id", "size", "target", "taken", "passes", "position"]
    a = sorted(map(str, mixing.mix(hard).select(*cols).collect()))
    assert a == sorted(map(str, mixing.mix(hard.repartition(7, "n_chars")).select(*cols).collect()))


def test_the_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([(None, 1000), ("b", 1000), ("a", 10)], "source string, size bigint")
    s = mixing.shares(sizes, (5, 2, 1), 1.5, 2.0).orderBy(F.col("source").isNull(), "source").collect()
    assert [x["source"] for x in s] == ["a", "b", None] and s[0]["target"] == 20
    assert sum(x["target"] for x in s) == pytest.approx(1.5 * 2010)


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_random_sizes(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}" if i else None: rng.choice((0, 1, 7, 100, 5000)) * rng.randint(1, 9) for i in range(rng.choice((1, 2, 9, 40)))}
    total = rng.choice((0.5, 1.5, 1.99, 2.5))
    rows = mixing.shares(spark.createDataFrame(list(sizes.items()), "source string, size bigint"), (5, 2, 1), total, 2.0).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(brute_targets(sizes, total=total))


def brute_mix(rows, target):
    """Words taken and first positions, by walking each source's line: (id, text) to (taken, position)."""
    out = {}
    for source, of in rows.items():
        start, size = 0, sum(n for *_, n in of)
        goal = int(target[source])
        for key, _, n in of:
            taken = sum(max(0, min(n, goal - k * size - start)) for k in range(2))
            out[key] = (taken, sum(goal - k * size > start and n > 0 for k in range(2)), start)
            start += n
    return out


def test_taken_words_follow_the_lines(spark, hard):
    """taken and passes of every row against a walk along the sources' lines, in the order that the rows' hashes give."""
    base = hard.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    base = base.withColumn("order", F.xxhash64(F.lit("mixing order"), "doc_id", "h"))  # a single bucket: in order of the hash itself
    lines, sizes = {}, {}
    for r in sorted(base.collect(), key=lambda r: (r["order"], r["doc_id"] is not None, r["doc_id"] or 0)):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["t"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        lines.setdefault(r["source"], []).append(((r["doc_id"], r["h"], r["source"], len(lines.get(r["source"], []))), r["order"], n))
    want = brute_mix(lines, brute_targets(sizes))
    want = sorted((str(k[0]), k[1], taken, passes) for k, (taken, passes, _) in want.items())
    assert sorted((str(r["doc_id"]), r["text_hash"], r["taken"], r["passes"]) for r in mixing.mix(hard).collect()) == want


def test_sources_that_are_not_broadcast(hard, monkeypatch):
    cols = ["doc_id", "size", "target", "taken", "passes", "position"]
    want = sorted(map(str, mixing.mix(hard).select(*cols).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(hard).select(*cols).collect())) == want


def test_time_inverts_the_integral(spark):
    for corners in mixing.SCHEDULES.values():
        df = spark.range(101).select((F.col("id") / 100.0).alias("s"))
        back = df.select("s", mixing._given(mixing._time(F.col("s"), corners), corners).alias("b")).collect()
        assert all(abs(r["s"] - r["b"]) < 1e-9 for r in back)


def test_heavy_sources_come_earlier(spark):
    rows = [(i, "w " * 10, "abc"[i % 3], 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint")
    mean = {r["source"]: r["p"] for r in mixing.mix(df).groupBy("source").agg(F.avg("position").alias("p")).collect()}
    assert mean["a"] < mean["c"]


def test_stream_is_sorted(hard):
    parts = mixing.stream(mixing.mix(hard).filter("position is not null"), 3).rdd.glom().map(lambda p: [r["position"] for r in p]).collect()
    flat = [x for p in parts for x in p]
    assert flat == sorted(flat)


def test_empty_and_clashing(empty, clashing):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(clashing).count() == clashing.count()
