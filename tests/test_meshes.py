"""Any grid: gradients, neighbours, located points, levels and columns by tolerance, components."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.operators import column, graph, locate, stats, stencil, unstructured
from tidecube.operators.unstructured import DIMENSION, EDGES, HEXAHEDRON, REPLACEMENTS

CORNERS = "t long, cell long, kind string, corner int, point long, x double, y double, z double"
#: Corners of one cell of each kind, none of them regular.
SHAPES = {
    "hexahedron": [(0, 0, 0), (2, 0.1, 0), (2.1, 1, 0.2), (0, 1.2, 0), (0.1, 0, 3), (2, 0, 3.1), (2.2, 1.1, 3), (0, 1, 2.9)],
    "wedge": [(0, 0, 0), (1, 0.2, 0), (0.1, 1, 0), (0, 0.1, 2), (1.1, 0, 2.2), (0, 1, 2)], "tetra": [(0, 0, 0), (1, 0.1, 0), (0.2, 1, 0), (0.1, 0.3, 1)],
    "quad": [(0, 0, 0), (2, 0, 1), (2, 1, 1.5), (0, 1, 0.5)], "triangle": [(0, 0, 0), (2, 0.1, 1), (0.3, 1, 0)], "line": [(0.5, 0, 0), (1, 2, 2)],
}
SLOPE = np.array([0.7, -1.3, 0.4])


def corners_of(spark, cells):
    """cells: (t, cell, kind, [(point, xyz)])."""
    return spark.createDataFrame([(t, c, kind, n, p, *map(float, xyz)) for t, c, kind, points in cells for n, (p, xyz) in enumerate(points)], CORNERS)


def own_cells(kinds):
    return [(0, n, kind, [(n * 10 + m, xyz) for m, xyz in enumerate(SHAPES[kind])]) for n, kind in enumerate(kinds)]


def within(kind):
    """The part of SLOPE that lies within a cell of the kind."""
    points = np.array(SHAPES[kind], float)
    spans = (points[1:] - points[0])[: DIMENSION[kind]] if kind != "quad" else (points[[1, 3]] - points[0])
    basis = np.linalg.qr(spans.T)[0]
    return basis @ (basis.T @ SLOPE)


def test_gradients_of_linear_fields_are_exact_in_every_kind_of_cell(spark):
    kinds = list(SHAPES)
    cells = own_cells(kinds)
    corners = corners_of(spark, cells)
    values = spark.createDataFrame([(0, p, float(SLOPE @ xyz) + 5) for _, _, _, points in cells for p, xyz in points], "t long, point long, f double")
    got = {r["point"]: (r["dfdx"], r["dfdy"], r["dfdz"]) for r in unstructured.point_gradient(values, corners, ["f"], depth_factor=1.0).collect()}
    for n, kind in enumerate(kinds):
        for m in range(len(SHAPES[kind])):
            assert got[n * 10 + m] == pytest.approx(tuple(within(kind)), abs=1e-9), kind


@pytest.mark.parametrize("kind", list(SHAPES))
def test_slopes_at_centres_are_those_of_the_shape_functions(kind):
    points = np.array(SHAPES[kind], float)
    slopes = np.array([[*s, *[0.0] * (3 - len(s))] for s in unstructured._slopes(kind)])
    jacobian, right = slopes.T @ points, slopes.T @ (points @ SLOPE)
    assert np.allclose(slopes.sum(axis=0), 0) and np.allclose(jacobian @ SLOPE, right)
    assert len({frozenset(e) for e in EDGES[kind]}) == len(EDGES[kind])


def grid(spark, nx=4, ny=3, nz=3, steps=2, bent=0.0):
    rows = [(t, k, j, i, k * 1000 + j * 100 + i) for t in range(steps) for k in range(nz) for j in range(ny) for i in range(nx)]
    cells = spark.createDataFrame(rows, "t long, k long, j long, i long, n long").withColumn("cell", unstructured.packed(F.col("k"), F.col("j"), F.col("i")))
    points = [(k, j, i, i + 0.2 * j + bent * i * k, j + bent * math.sin(i), -10.0 * k - bent * j) for k, j, i in itertools.product(range(nz + 1), range(ny + 1), range(nx + 1))]
    return cells, spark.createDataFrame(points, "k long, j long, i long, x double, y double, z double")


def test_cell_gradient_is_fv2_inside_a_straight_grid(spark):
    cells, points = grid(spark, 5, 4, 4)
    corners = unstructured.grid_corners(cells, points.withColumn("x", F.col("i") + 0.0))
    linear = cells.withColumns({"f": 2.0 * F.col("i") - 3.0 * F.col("j") + 0.5 * F.col("k"), "x": F.col("i") + 0.5, "y": F.col("j") + 0.5, "depth": 10.0 * F.col("k") + 5})
    plain = {(r["t"], r["cell"]): r for r in stencil.gradient(linear, ["f"], "fv2").collect()}
    inside = [r for r in unstructured.cell_gradient(linear, corners, ["f"], depth_factor=-1.0).collect() if 0 < r["k"] < 3 and 0 < r["j"] < 3 and 0 < r["i"] < 4]
    assert len(inside) == 2 * 2 * 2 * 3
    for r in inside:
        assert [r[f"dfd{a}"] for a in "xyz"] == pytest.approx([plain[r["t"], r["cell"]][f"dfd{a}"] for a in "xyz"])


@pytest.mark.parametrize("contributing,want", [("all", 2.0), ("patch", 3.0), ("max", 3.0)])
def test_contributing_cells(spark, contributing, want):
    """A quad on a face of a hexahedron, and a line by itself: the quad counts with "all" alone, the line's points lose theirs with "max"."""
    hexa = list(enumerate(SHAPES["hexahedron"]))
    cells = [(0, 1, "hexahedron", hexa), (0, 2, "quad", hexa[:4]), (0, 3, "line", [(90, (9, 9, 9)), (91, (9, 9, 8))])]
    values = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0), (0, 3, 7.0)], "t long, cell long, f double")
    got = {r["point"]: r["f"] for r in unstructured.cells_to_points(values, corners_of(spark, cells), ["f"], contributing=contributing).collect()}
    assert got[0] == want and got[5] == 3 and got.get(90) == (None if contributing == "max" else 7)


@pytest.mark.parametrize("name", list(REPLACEMENTS))
def test_replacements(spark, name):
    """A cell without corners, a flat hexahedron and a point of no cell have no derivative; a null value stays one."""
    flat = [(p, (x, y, 0)) for p, (x, y, _) in enumerate(SHAPES["hexahedron"])]
    corners = corners_of(spark, [(0, 1, "hexahedron", flat)])
    cells = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "t long, cell long, f double")
    points = spark.createDataFrame([(0, 77, 1.0)], "t long, point long, f double")
    want = REPLACEMENTS[name]
    rows = unstructured.cell_gradient(cells, corners, ["f"], replacement=name).collect() + unstructured.point_gradient(points, corners, ["f"], replacement=name).collect()
    for r in rows:
        for a in "xyz":
            got = r[f"dfd{a}"]
            assert got is None if want is None else math.isnan(got) if math.isnan(want) else got == want


def test_points_that_a_cell_has_twice_do_not_count(spark):
    folded = [(0 if p == 1 else p, SHAPES["hexahedron"][0] if p == 1 else xyz) for p, xyz in enumerate(SHAPES["hexahedron"])]
    values = spark.createDataFrame([(0, p, float(p)) for p in range(8)], "t long, point long, f double")
    got = {r["point"]: r for r in unstructured.point_gradient(values, corners_of(spark, [(0, 1, "hexahedron", folded)]), ["f"], replacement="null").collect()}
    assert got[0]["dfdx"] is None and got[6]["dfdx"] is not None


def test_given_derivatives_feed_the_criteria(spark):
    cells, points = grid(spark, 4, 4, 4, 1, 0.05)
    corners = unstructured.grid_corners(cells, points)
    made = cells.withColumns({"u": F.sin("n"), "v": F.cos("n"), "w": F.sin(F.col("n") * 2)})
    out = unstructured.cell_gradient(made, corners, ["u", "v", "w"])
    r = stencil.derivatives(out, ("u", "v", "w"), True, True, True, "given").collect()
    assert all(x["div"] == pytest.approx(x["dudx"] + x["dvdy"] + x["dwdz"]) and x["curl_z"] == pytest.approx(x["dvdx"] - x["dudy"]) for x in r) and len(r) == 64


def test_neighbours(spark):
    cells, points = grid(spark)
    chosen = cells.where("(i + j + k) % 4 > 0")
    corners = unstructured.grid_corners(chosen, points)
    places = {(r["t"], r["cell"]): (r["k"], r["j"], r["i"]) for r in chosen.collect()}
    gap = lambda a, b: [abs(x - y) for x, y in zip(a, b)]
    want = {(t, a, b) for (t, a), p in places.items() for (s, b), q in places.items() if s == t and a != b and max(gap(p, q)) == 1 and sum(gap(p, q)) <= 2}
    assert {tuple(r) for r in unstructured.connected_cells(corners).collect()} == want
    rows = [(r["t"], r["cell"], r["point"]) for r in corners.collect()]
    near = {(t, p, q) for t, c, p in rows for s, d, q in rows if (t, c) == (s, d) and p != q} if len(rows) < 400 else None
    if near is not None:
        assert {tuple(r) for r in unstructured.connected_points(corners).collect()} == near


# -------------------------------------------------------------------- location


def test_points_are_found_in_a_bent_mesh(spark):
    cells, points = grid(spark, 5, 4, 4, 2, 0.1)
    corners = unstructured.grid_corners(cells, points)
    shapes = {}
    for r in corners.where("t = 0").collect():
        shapes.setdefault(r["cell"], {})[r["corner"]] = (r["x"], r["y"], r["z"])
    shapes = {c: np.array([s[n] for n in range(8)]) for c, s in shapes.items()}
    rng = np.random.default_rng(2)
    names = list(shapes)
    probes, truth = [], []
    for n in range(200):
        cell = names[rng.integers(len(names))]
        rst = rng.uniform(0.01, 0.99, (1, 3))
        probes.append((n, *(locate.weights(rst)[0] @ shapes[cell]).tolist()))
        truth.append((cell, rst[0]))
    found = {r["pid"]: r for r in locate.find_cells(spark.createDataFrame(probes, "pid long, x double, y double, z double"), corners).collect()}
    for n, (cell, rst) in enumerate(truth):
        assert found[n]["cell"] == cell and found[n]["dist2"] == 0
        assert [found[n][a] for a in "rsq"] == pytest.approx(rst.tolist(), abs=1e-9)


def test_points_outside_on_faces_and_repeated(spark):
    """Cells of very different size share one index; the tolerance follows the cell."""
    def box(c, lo, size):
        return (0, c, "hexahedron", [(c * 10 + n, tuple(a + s * o for a, s, o in zip(lo, size, off))) for n, off in enumerate(HEXAHEDRON)])

    corners = corners_of(spark, [box(1, (0, 0, 0), (1, 1, 1)), box(2, (1, 0, 0), (1000, 1, 1)), box(3, (0, 1, 0), (1, 0.001, 1)), box(4, (0, 5, 0), (0, 1, 1))])
    rows = [(0, 0.5, 0.5, 0.5), (1, 1.0, 0.5, 0.5), (2, 700.0, 0.5, 0.5), (3, 1001.9, 0.5, 0.5), (4, 1002.1, 0.5, 0.5), (5, -0.001, 0.5, 0.5), (6, -0.01, 0.5, 0.5),
            (7, 0.5, 1.0005, 0.5), (8, None, 0.5, 0.5), (9, float("nan"), 0.0, 0.0), (10, 0.0, 5.5, 0.5), (0, 0.5, 0.5, 0.5)]
    probes = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    found = locate.find_cells(probes, corners)
    got = [(r["pid"], r["cell"]) for r in found.collect()]
    assert len(got) == 12 and dict(got) == {0: 1, 1: 1, 2: 2, 3: 2, 4: None, 5: 1, 6: None, 7: 3, 8: None, 9: None, 10: None}
    values = spark.createDataFrame([(0, c * 10 + n, c * 10.0 + n) for c in (1, 2, 3, 4) for n in range(8)], "t long, point long, f double")
    at = {r["pid"]: r["f"] for r in locate.point_values(found.distinct(), corners, values, ["f"], ["pid"]).collect()}
    assert at[0] == pytest.approx(13.5) and 4 not in at
    cellwise = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0), (0, 3, 7.0)], "t long, cell long, f double")
    assert sorted((r["pid"], r["f"]) for r in locate.cell_values(found, cellwise, ["f"]).collect()) == [(0, 5), (0, 5), (1, 5), (2, 6), (3, 6), (5, 5), (7, 7)]


# ------------------------------------------------- levels, columns, components


def levels_by_hand(depths, tolerance):
    out = []
    for d in sorted(set(depths)):
        if not out or d - out[-1] >= tolerance:
            out.append(d)
    return out


@pytest.mark.parametrize("noise", [0.0, 0.2, 0.9, 5.0])
def test_levels_by_tolerance(spark, noise):
    rng = random.Random(4)
    depths = [round(10.0 * k + rng.uniform(0, noise), 4) for k in range(20) for _ in range(12)]
    df = spark.createDataFrame([(n, d) for n, d in enumerate(depths)] + [(-1, None), (-2, float("nan"))], "n long, depth double").repartition(4)
    want = levels_by_hand(depths, 0.5)
    levels = graph.kept(stats.unique_levels(df, 0.5))
    assert [tuple(r) for r in levels.orderBy("layer").collect()] == list(enumerate(want))
    for r in stats.with_levels(df, levels, 0.5).collect():
        own = [n for n, z in enumerate(want) if r["depth"] is not None and abs(r["depth"] - z) < 0.5]
        assert r["layer"] == (own[-1] if own else None)


def test_columns_by_position_equal_keyed_columns(spark):
    rng = random.Random(9)
    rows = [(t, k, j, i, i + rng.uniform(-0.02, 0.02), j + rng.uniform(-0.02, 0.02), 5.0 + 10 * k, rng.uniform(10, 11), 1) for t in (0, 1) for k in range(6) for j in range(4) for i in range(5)]
    cells = spark.createDataFrame(rows, "t long, k long, j long, i long, x double, y double, depth double, temp double, coast int")
    placed = column.columns_by_position(cells, 0.06)
    homes = {}
    for r in placed.collect():
        homes.setdefault((r["j"], r["i"]), set()).add((r["col_x"], r["col_y"]))
    assert all(len(v) == 1 for v in homes.values()) and len(set.union(*homes.values())) == 20
    key = lambda df: sorted((r["t"], r["k"], r["j"], r["i"], r["mld"]) for r in df.collect())
    assert key(column.mixed_layer_depth(placed, by=("t", "col_x", "col_y"))) == key(column.mixed_layer_depth(cells))


def test_places_joined_by_a_chain_are_one_column(spark):
    rows = [(0.09 * n, 0.0) for n in range(30)] + [(0.0, 5.0), (0.0, 5.11), (None, 1.0)]
    got = column.columns_by_position(spark.createDataFrame(rows, "x double, y double"), 0.1).collect()
    assert {(r["col_x"], r["col_y"]) for r in got if r["y"] == 0} == {(0.0, 0.0)}
    assert {r["col_y"] for r in got if r["y"] and r["y"] > 4} == {5.0, 5.11} and sum(r["col_x"] is None for r in got) == 1


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    links = [(t, rng.randrange(80), rng.randrange(80)) for t in (0, 1) for _ in range(60)] + [(2, n, n + 1) for n in range(200)] + [(3, 5, 5)]
    got = {(r["t"], r["node"]): r["component"] for r in graph.components(spark.createDataFrame(links, "t long, a long, b long"), ["t"]).collect()}
    want = {}
    for t in range(3):
        parent = {n: n for s, a, b in links if s == t and a != b for n in (a, b)}
        for _ in range(len(parent)):
            for s, a, b in links:
                if s == t and a != b:
                    parent[a] = parent[b] = min(parent[a], parent[b])
        want |= {(t, n): p for n, p in parent.items()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tasks_follow_the_rows_of_a_profile(spark, monkeypatch):
    """Cell 1 has many probes and few steps, cell 2 few probes and many steps: each is dealt by its longer side."""
    monkeypatch.setattr(locate, "TASK_ROWS", 50, raising=False)
    probes = [(n, 1) for n in range(200)] + [(n, 2) for n in range(200, 203)] + [(900, None), (901, 3)]
    values = [(t, 1, 10.0 * t) for t in range(4)] + [(t, 2, 20.0 * t) for t in range(100)]
    found = spark.createDataFrame(probes, "probe long, cell long")
    got = locate.cell_values(found, spark.createDataFrame(values, "t long, cell long, temp double"), ["temp"])
    rows = sorted((r["t"], r["probe"], r["cell"], r["temp"]) for r in got.collect())
    assert rows == sorted((t, p, c, v) for p, c in probes for t, own, v in values if own == c)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1100 and len(sizes) > 5 and max(sizes) <= 400


def test_tasks_follow_the_rows_of_points_in_a_grid(spark, monkeypatch):
    """One cell, 200 probes and 6 steps; step 4 lacks a corner, step 5 has one without a value."""
    monkeypatch.setattr(locate, "TASK_ROWS", 50, raising=False)
    corners = spark.createDataFrame([(7, "hexahedron", c, 100 + c, *map(float, o)) for c, o in enumerate(HEXAHEDRON)], "cell long, kind string, corner int, point long, x double, y double, z double")
    values = [(t, 100 + c, None if (t, c) == (5, 3) else float(10 * t + o[0] + 2 * o[1] + 4 * o[2])) for t in range(6) for c, o in enumerate(HEXAHEDRON) if (t, c) != (4, 3)]
    values = spark.createDataFrame(values, "t long, point long, temp double")
    places = {n: ((n % 5) / 4, (n % 7) / 6, (n % 11) / 10) for n in range(200)}
    found = spark.createDataFrame([(n, 7, *p) for n, p in places.items()] + [(900, None, None, None, None)], "probe long, cell long, r double, s double, q double")
    for whole in (True, False):
        got = locate.point_values(found, corners, values, ["temp"], ["probe"], whole=whole)
        rows = {(r["t"], r["probe"]): r["temp"] for r in got.collect()}
        assert set(rows) == {(t, n) for t in range(6) for n in places if whole or t != 4}
        corner = np.array(HEXAHEDRON)[3]
        for (t, n), temp in rows.items():
            full = 10 * t + places[n][0] + 2 * places[n][1] + 4 * places[n][2]
            if t == 5 and not whole:
                full -= np.where(corner == 1, places[n], 1 - np.array(places[n])).prod() * (50 + corner[0] + 2 * corner[1] + 4 * corner[2])
            assert temp is None if whole and t > 3 else temp == pytest.approx(full, abs=1e-9)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 5 and max(sizes) <= 400
