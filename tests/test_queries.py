"""Every query against its SQL on the smallest tables, in the way that the driver compares them."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from regionflow.plans.catalog import QUERIES
from regionflow.plans.oracles import SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def key(row):
    return tuple(("", f"{v:.5g}") if isinstance(v, float) else ("", "") if v is None else ("v", str(v)) for v in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert rows or name == "missing_names"
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert len(rows) == len(want)
    assert all(same(a, b) for x, y in zip(rows, want, strict=True) for a, b in zip(x, y, strict=True))


def test_the_flagship_runs(spark):
    assert entry.entry(spark).count() > 50


def test_plans(spark, sf):
    """Joins keep an equality, and scans read what they need."""
    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    for name in ("iou_pairs", "box_occupancy", "art_penalty", "panel_order_violations", "innermost_container"):
        assert not re.search("NestedLoop|CartesianProduct", plan(name)), name
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan("crop_box") or "text" not in re.search(r"ReadSchema: \S+", plan("crop_box"))[0]
    assert "Python" not in plan("greedy_match") and "Python" not in plan("reading_order_rows")


def test_the_rest_does_not_need_the_corpus_operators():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "regionflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
