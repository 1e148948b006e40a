from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regionflow.llm import ngram_join as nj


def brute(rows, rule):
    """Component and set size of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = rule.words
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.share[1] * len(sets[i] & sets[j]) >= rule.share[0] * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((str(r[0]), len(sets[i]), str(least.get(root(i), r[0]) if sets[i] else r[0])) for i, r in enumerate(rows))


def found(df, rule):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nj.join(df, rule).collect())


@pytest.mark.parametrize("rule", [nj.Rule(3, (90, 100)), nj.Rule(5, (80, 100)), nj.Rule(2, (50, 100))])
def test_hard_rows(hard, rule):
    assert found(hard, rule) == brute([(r["doc_id"], r["text"]) for r in hard.collect()], rule)


def versions(seed, bases=6, copies=25):
    """Texts with edits that put their similarity on both sides of the threshold; a passage that all share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(50)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 200]))] + shared * rng.randint(0, 1)
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.2:
                t += [rng.choice(words) for _ in range(len(t) // 15)]
            rows.append((len(rows), " ".join(t).upper() if rng.random() < 0.1 else " ".join(t)))
    return rows


@pytest.mark.parametrize("rule", [nj.Rule(3, (90, 100)), nj.Rule(5, (80, 100))])
@pytest.mark.parametrize("star_rounds", [0, 3])
def test_versions(spark, rule, star_rounds, monkeypatch):
    """Without star rounds the trees find every link."""
    monkeypatch.setattr(nj, "STAR_ROUNDS", star_rounds)
    rows = versions(star_rounds)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if star_rounds == 0:
        met = nj.cut(nj.blocks(df, rule, "text"))
        known = nj.cut(nj.signatures(df, rule, "doc_id", "text"))
        texts = nj.texts_of(met.select("fp").distinct(), df, known, "doc_id", "text")
        from pyspark.sql import functions as F

        pairs = nj.tree_pairs(met.withColumn("part", F.col("fp")).join(nj.points_of(texts, rule), "fp"), rule)
        links = {tuple(sorted(r)) for r in nj.verify(nj.cut(pairs), nj.sets_of(texts, rule), rule).collect()}
        sets = {}
        for _, t in rows:
            s = nj.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), rule.words)[0]
            sets[nj.fingerprint(s)] = set(s.tolist())
        want = {(a, b) for a in sets for b in sets if a < b and rule.share[1] * len(sets[a] & sets[b]) >= rule.share[0] * len(sets[a] | sets[b])}
        assert links == want and want
    else:
        assert found(df, rule) == brute(rows, rule)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.data())
def test_linked_sets_share_a_group(a, data):
    rule = nj.Rule(3, (90, 100))
    items = sorted(a)
    drop = data.draw(st.sets(st.sampled_from(items), max_size=len(items) // 10))
    more = data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=len(items) // 12))
    b = (a - drop) | more
    if b and a != b and 100 * len(a & b) >= 90 * len(a | b):
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert set(nj.group_keys(x, rule).tolist()) & set(nj.group_keys(y, rule).tolist())
        assert nj.most_common_by_bits(nj.bitmap(x), len(x), nj.bitmap(y), len(y)) >= len(a & b)
        assert nj.most_common(nj.point(x), np.int64(len(x)), nj.point(y), np.int64(len(y))) >= len(a & b)


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(3)
    rule = nj.Rule(3, (90, 100))
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(120, 200)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(400)]
    points, sizes = np.array([nj.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = nj.PointTree(points, sizes)
    for i in range(0, 400, 7):
        bound = np.minimum(points, points[i]).sum(1) >= rule.overlap(sizes, np.int64(sizes[i]))
        near = (sizes <= rule.largest(sizes[i])) & (sizes >= -(-sizes[i] * 90 // 100))
        of, members, common = tree.search(points[[i]], sizes[[i]], rule)
        assert sorted(members.tolist()) == np.flatnonzero(bound & near).tolist() and not of.any()
        assert (common == np.minimum(points[members], points[i]).sum(1)).all()


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    parts = {r["fp"]: r["part"] for r in nj.components(links).collect()}
    assert {parts[i] for i in range(61)} == {0} and parts[101] == 100


def test_empty_and_clashing(empty, clashing):
    assert nj.join(empty).count() == 0
    assert nj.join(clashing).count() == clashing.count()


@pytest.mark.parametrize("nearest", [None, 2])
def test_tiles_give_the_pairs_of_one_tree(spark, nearest, monkeypatch):
    """Large blocks are searched in tiles; each pair comes from one of them."""
    from pyspark.sql import functions as F

    rule = nj.Rule(3, (90, 100))
    df = spark.createDataFrame(versions(7, bases=2, copies=60), "doc_id bigint, text string")
    known = nj.cut(nj.signatures(df, rule, "doc_id", "text"))
    met = nj.cut(nj.blocks(df, rule, "text"))
    points = nj.points_of(nj.texts_of(met.select("fp").distinct(), df, known, "doc_id", "text"), rule)
    members = met.withColumn("part", F.col("fp")).join(points, "fp")
    one = sorted(map(tuple, nj.tree_pairs(members, rule, nearest).collect()))
    monkeypatch.setattr(nj, "TILE", 7)
    monkeypatch.setattr(nj, "COMPARED", 50)
    assert sorted(map(tuple, nj.tree_pairs(members, rule, nearest).collect())) == one and one


def test_classes_meet_in_the_block_of_their_smallest_key():
    rng = np.random.default_rng(5)
    rule = nj.Rule(5, (80, 100))
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(300) > 0.03], rng.integers(0, 2**63, 8).astype(np.uint64)]) for _ in range(12)]
    points, sizes = np.array([nj.point(s) for s in sets]), np.array([len(s) for s in sets])
    least, fps = np.array([nj.least_keys(s, rule, 4) for s in sets]), np.arange(12)
    keys = [set(nj.cut_keys(nj.group_keys(s, rule), 4)[2].view(np.int64).tolist()) for s in sets]
    found = []
    for key in sorted(set().union(*keys)):
        own = np.array([i for i in range(12) if key in keys[i]])
        if len(own) > 1:
            for a, b, _ in nj.block_pairs(key, False, fps[own], sizes[own], points[own], least[own], fps[own], fps[own], rule, None):
                found += zip(a.tolist(), b.tolist(), strict=True)
    shared = {(i, j) for i in range(12) for j in range(i + 1, 12) if keys[i] & keys[j]}
    times = sum(len(keys[i] & keys[j]) for i, j in shared)
    assert set(found) == shared and len(found) < times / 5


def test_many_rows_without_an_id(spark):
    """Versions of a text whose rows all lack an id link, and each class is read from its own text."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = [(None, " ".join([*base, f"end{i}"])) for i in range(40)] + [(None, f"other words {i} stand here alone") for i in range(40)] + [(9, " ".join([*base, "last"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    rule = nj.Rule(3, (90, 100))
    known = nj.cut(nj.signatures(df, rule, "doc_id", "text"))
    assert nj.texts_of(known.select("fp").distinct(), df, known, "doc_id", "text").count() == 81
    assert found(df, rule) == brute(rows, rule)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 700), st.integers(1, 700), st.integers(0, 2**32), st.floats(0, 1))
def test_bitmaps_bound_the_overlap(n, m, seed, share):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    y = np.unique(np.r_[x[rng.random(len(x)) < share], rng.integers(0, 2**64, m, dtype=np.uint64)])
    common = len(np.intersect1d(x, y))
    bound = nj.most_common_by_bits(nj.bitmap(x), len(x), nj.bitmap(y), len(y))
    assert common <= bound <= common + 0.6 * max(len(x), len(y)) + 1
