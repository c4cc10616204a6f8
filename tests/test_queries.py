"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidecube.operators import vortex
from tidecube.plans import registry
from tidecube.plans.queries import _vortices

DATA = os.environ.get("TIDECUBE_TEST_DATA", "/root/testdata/sf0.001")
ORACLES = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x) if isinstance(x, str) else x or 0) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want) if not all(map(same, a, b))]
    assert not bad, bad[:3]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_vortices_of_all_layers_match_brute_force(spark):
    cells = {(r["t"], r["k"], r["j"], r["i"]): r for r in _vortices(spark, DATA).where("mask = 1").collect()}
    found, seen = {}, set()
    for start in sorted(cells):
        if start in seen:
            continue
        seen.add(start)
        part = [start]
        for t, k, j, i in part:
            for near in ((t, k + a, j + b, i + c) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))):
                if near in cells and near not in seen:
                    seen.add(near)
                    part.append(near)
        if len(part) > 5:
            found[start[0], 1 + sum(t == start[0] for t, _ in found)] = sorted(part)
    assert any(len({k for _, k, _, _ in part}) > 1 for part in found.values())
    queries = registry.queries()
    rows = queries["vortex_components"](spark, DATA).collect()
    assert sorted((r["t"], r["vortex_id"], r["k"], r["j"], r["i"]) for r in rows) == sorted((t, n, *c[1:]) for (t, n), part in found.items() for c in part)
    props = {(r["t"], r["vortex_id"]): r for r in queries["vortex_properties"](spark, DATA).collect()}
    assert set(props) == set(found)
    for key, part in found.items():
        own = [cells[c] for c in part]
        centre = max(own, key=lambda r: r["speed"])
        far = max(math.dist([r[a] for a in "xyz"], [centre[a] for a in "xyz"]) for r in own if r["speed"] >= 0.05 * centre["speed"])
        want = {"n_cells": len(own), "sign": -1 if centre["w"] < 0 else 1, "size": far, "abs_strength": centre["speed"], "rel_strength": centre["speed"]}
        want |= {f"bary_{a}": sum(r[a] for r in own) / len(own) for a in "xyz"} | {f"center_{a}": centre[a] for a in "xyz"}
        want |= {f"rot_{a}": centre[v] / centre["speed"] for a, v in zip("xyz", "uvw")} | {"circulation": sum(r["e1t"] * r["e2t"] * r["w"] for r in own)}
        assert {c: props[key][c] for c in want} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_do_not_depend_on_tiles(spark, connectivity):
    masked = _vortices(spark, DATA).withColumn("mask", (F.col("speed") > 0.2).cast("int"))
    whole = vortex.vortex_components(masked, connectivity=connectivity).collect()
    tiled = vortex.vortex_components(masked, connectivity=connectivity, tile=3).collect()
    assert whole and sorted(whole) == sorted(tiled)
