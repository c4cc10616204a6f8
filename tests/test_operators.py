import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecube.functions import projection, seawater
from tidecube.functions import text as tx
from tidecube.operators import column, pointwise, probe, select, stats, stencil, temporal, vortex

N = 6


@pytest.fixture(scope="module")
def grid(spark):
    """A uniform grid with unit metrics: u = -y, v = x, w = 0, f = 2x + 3y + 5 depth."""
    base = spark.range(N**3).select((F.col("id") / N**2).cast("long").alias("k"), ((F.col("id") / N) % N).cast("long").alias("j"), (F.col("id") % N).alias("i"))
    ones = {f"e{a}{b}": F.lit(1.0) for a, b in ("1t", "1u", "1v", "2t", "2u", "2v", "3t", "3u", "3v", "3w")}
    return base.withColumns({"t": F.lit(0), "x": F.col("i") * 1.0, "y": F.col("j") * 1.0, "z": -F.col("k") * 1.0, "depth": F.col("k") * 1.0,
                             "u": -F.col("j") * 1.0, "v": F.col("i") * 1.0, "w": F.lit(0.0), "coast": F.lit(1), "land": F.lit(0), **ones,
                             "f": 2.0 * F.col("i") + 3 * F.col("j") + 5 * F.col("k")}).cache()


@pytest.mark.parametrize("scheme", stencil.SCHEMES)
def test_linear_field_has_constant_gradient(grid, scheme):
    out = stencil.gradient(grid, ["f"], scheme).toPandas()
    inner = out[(out.i.between(1, N - 2)) & (out.j.between(1, N - 2)) & (out.k.between(1, N - 2))]
    assert np.allclose(inner[["dfdx", "dfdy", "dfdz"]], [2, 3, 5])


def test_rotation_has_known_curl_okubo_weiss_and_q(grid):
    out = stencil.derivatives(grid, ("u", "v", "w"), True, True, True, "fv2").toPandas()
    assert np.allclose(out["div"], 0) and np.allclose(out["curl_z"], 2) and np.allclose(out["q"], 1)
    ow = vortex.okubo_weiss(grid, grad_type="fv2").toPandas()
    assert np.allclose(ow.okubo_weiss, -4) and np.allclose(-2 * out["q"].mean(), -2)
    assert np.allclose(vortex.lambda2(grid, "fv2").toPandas().lambda2, -1)
    om = vortex.omega(grid, grad_type="fv2").toPandas().omega
    assert om.between(0, 1).all() and (om > 0.5).all()
    r = vortex.rortex(grid, grad_type="fv2").toPandas()
    assert np.allclose(r.rortex_z, 2) and np.allclose(r.rortex_x, 0) and (r.omega_r > 0.5).all()


def test_all_outputs_of_one_gradient(grid):
    out = vortex.gradient_outputs(grid, compute_gradient=False, compute_divergence=True, compute_vorticity=True, compute_q_criterion=True, compute_lambda2=True, compute_omega=True, compute_rortex=True)
    row = out.where("k = 2 AND j = 2 AND i = 2").first()
    assert (row["div"], row["curl_z"], row["q"]) == (0, 2, 1) and row["lambda2"] == pytest.approx(-1) and row["rortex_z"] == pytest.approx(2)
    assert "dudx" not in out.columns and row["omega"] > 0.5


def test_weighted_statistics_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0), ("a", 2.0, 1.0, 1), ("a", 3.0, 2.0, 2), ("b", 7.0, 2.0, 0), ("b", None, 2.0, 1)], "g string, v double, w double, n int")
    rows = {r["g"]: r for r in stats.weighted_stats(df, ["g"], "v", "w", tie=["n"]).collect()}
    a = rows["a"]
    assert a["mean"] == 2.25 and a["std"] == pytest.approx(math.sqrt(0.6875))
    assert (a["p05"], a["p25"], a["p75"], a["p95"]) == (1, 1.5, 3, 3) and a["p50"] == pytest.approx(2 + 0.125 / 0.375)
    assert all(rows["b"][s] == (0 if s == "std" else 7) for s in stats.ALL_STATS)


def test_compare_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(3.0, 3.0, 1.0), (None, None, None)], "a double, b double, c double")
    out = pointwise.compare_variables(df, "a = 10\nb = 20\nc = 30\nnothing", default_value=-1).collect()
    assert [r["comparison"] for r in out] == [10, -1]


def test_density_by_hand(spark):
    one = spark.createDataFrame([(14.0, 38.0), (10.0, 35.0), (4.0, 0.0)], "t double, s double")
    got = [r[0] for r in one.select(seawater.density(F.col("t"), F.col("s"), None, 2)).collect()]
    assert got == pytest.approx([1028.508601, 1026.952412, 999.974958], abs=1e-6)
    assert one.select(seawater.density(F.col("t"), F.col("s"), None, "lin_t")).first()[0] == pytest.approx(1045.704)
    with pytest.raises(NotImplementedError):
        seawater.density(F.col("t"), F.col("s"), None, "teos10")


def test_aggregates_check_their_variables(spark):
    df = spark.createDataFrame([(1.0, 2.0, [1.0])], "P1c double, P2c double, vec array<double>")
    assert pointwise.aggregate_variables(df, {"s": ("P1c", "P2c")}).columns == ["vec", "s"]
    assert pointwise.aggregate_variables(df, {"s": ("P1c", "P2c")}, delete_vars=False).columns == ["P1c", "P2c", "vec", "s"]
    for bad in ({"s": ("P1c", "none")}, {"s": ("vec",)}):
        with pytest.raises(ValueError):
            pointwise.aggregate_variables(df, bad)


def steps_of(spark, *stamps):
    return spark.createDataFrame([(datetime.fromisoformat(s),) for s in stamps], "t timestamp")


def test_boundary_steps_belong_to_two_months(spark):
    req = temporal.requests(spark, "monthly", "2000-01-01", "2000-02-20")
    steps = steps_of(spark, "2000-02-01T00:00:00")
    assert temporal.select_steps(steps, req).count() == 2
    assert temporal.select_steps(steps, req, closed="left").count() == 1


def test_overlap_weight(spark):
    req = temporal.generic_request(spark, "2000-01-25", "2000-02-10")
    out = temporal.select_steps(steps_of(spark, "2000-01-16"), req, "monthly").first()
    assert out["weight"] == 7 * 86400


def test_weekly_window_and_seasons(spark):
    lo, hi = temporal.step_window("weekly", F.col("t"))
    r = steps_of(spark, "2015-03-05").select(lo, hi).first()
    assert r[0] == datetime(2015, 3, 2) and r[1] == datetime(2015, 3, 8, 23, 59, 59)
    got = steps_of(spark, "2001-03-31", "2001-04-01T12:00:00", "2001-12-31").orderBy("t").select(temporal.season_index(F.col("t"))).collect()
    assert [x[0] for x in got] == [0, 1, 3]
    own = (("1201", "winter"), ("0301", "spring"))
    assert [x[0] for x in steps_of(spark, "2001-01-15", "2001-03-01").orderBy("t").select(temporal.season_index(F.col("t"), own)).collect()] == [0, 1]


@pytest.mark.parametrize(
    ("delta", "count", "want"),
    [({"days": 1}, 10, "daily"), ({"days": 7}, 10, "weekly"), ({"months": 1}, 10, "monthly"), ({"hours": 6}, 9, "hourly"), ({"mins": 15}, 9, "seconds=900"),
     ({"years": 1}, 6, "yearly"), ({"days": 10}, 6, "days=10")],
)
def test_frequency(spark, delta, count, want):
    axis = temporal.generate_steps(spark, "2001-01-01", "2010-01-01", **delta).orderBy("t").limit(count)
    assert temporal.infer_frequency(axis).first()["freq"] == want


def test_frequency_of_one_step_is_none(spark):
    assert temporal.infer_frequency(steps_of(spark, "2000-01-01")).first()["freq"] == "None"


def test_nearest_step_against_brute_force(spark):
    rng = np.random.default_rng(2)
    axis = sorted({datetime.fromtimestamp(int(x)) for x in rng.integers(9.6e8, 9.7e8, 15)})
    probes = [datetime.fromtimestamp(int(x)) for x in rng.integers(9.55e8, 9.75e8, 60)]
    got = temporal.nearest_step(spark.createDataFrame([(a,) for a in axis], "t timestamp"), spark.createDataFrame(list(enumerate(probes)), "n int, probe_t timestamp")).collect()
    want = {n: min(axis, key=lambda a: (abs((a - p).total_seconds()), a)) for n, p in enumerate(probes)}
    assert {r["n"]: r["t"] for r in got} == want


def test_polygon_methods_agree_and_invert(grid):
    text = "0.5 0.5\n4.5 0.5\n4.5 3.5\n0.5 3.5"
    a, b = select.select_polygon(grid, text), select.select_polygon(grid, text, method="crossing")
    assert a.count() == b.count() == 3 * 4 * N
    assert select.select_polygon(grid, text, invert=True).count() == N**3 - 12 * N


def test_mixed_layer_keeps_the_last_level_or_the_first_crossing(spark):
    rows = [(0, 0, 0, k, 10.0 * (k + 1), v, 1) for k, v in enumerate((0.0, 0.1, 0.3, 0.1))]
    df = spark.createDataFrame(rows, "t int, j int, i int, k int, depth double, temp double, coast int")
    assert column.mixed_layer_depth(df).first()["mld_k"] == 3
    assert column.mixed_layer_depth(df, first_crossing=True).first()["mld_k"] == 1


def test_probes_find_cells_and_leave_the_grid(spark, grid):
    line = probe.depth_line(spark, 2.2, 3.4, (0.0, 10.0), 10)
    out = probe.hovmoeller(grid, line, "f").orderBy("pid").toPandas()
    assert len(out) == 11 and out.value.iloc[2] == 2 * 2 + 3 * 3 + 5 * 2 and out.value.iloc[10] == 0
    assert probe.wide_by_time(probe.hovmoeller(grid, line, "f")).count() == 11
    assert probe.spaghetti(grid, probe.point_source(spark, 2.0, 3.0, 1.0).withColumn("depth", -F.col("z")), "f").first()["value"] == 4 + 9 + 5


def test_components_by_connectivity(spark):
    rows = [(0, 0, j, i, int(m)) for j, line in enumerate(["1100", "0010", "0011", "0000"]) for i, m in enumerate(line)]
    df = spark.createDataFrame(rows, "t long, k long, j long, i long, mask int")
    assert vortex.vortex_components(df, min_resolution=1, connectivity=4).select("vortex_id").distinct().count() == 2
    assert vortex.vortex_components(df, min_resolution=1, connectivity=18).select("vortex_id").distinct().count() == 1
    assert vortex.vortex_components(df.where("mask = 0"), min_resolution=0).count() == 0


def test_moving_average_shrinks_at_the_ends(spark):
    df = spark.createDataFrame([(n, float(v)) for n, v in enumerate((1, 2, 6, 4, 10))], "n int, v double")
    out = [r["v_smooth"] for r in stats.moving_average(df, "v", "n", span=3).orderBy("n").collect()]
    assert out == [1, 3, 4, pytest.approx(20 / 3), 10]


def test_merged_moments_equal_the_whole(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"part": rng.integers(0, 5, 200), "w": rng.random(200), "v": rng.random(200) * 100})
    parts = [(1, float(g.w.sum()), float(np.average(g.v, weights=g.w)), float((g.w * (g.v - np.average(g.v, weights=g.w)) ** 2).sum())) for _, g in pdf.groupby("part")]
    out = stats.merge_moments(spark.createDataFrame(parts, "g int, w double, mean double, m2 double"), ["g"]).first()
    mean = np.average(pdf.v, weights=pdf.w)
    assert out["mean"] == pytest.approx(mean) and out["m2"] == pytest.approx((pdf.w * (pdf.v - mean) ** 2).sum())


def test_projections_at_known_points(spark):
    df = spark.createDataFrame([(0.0, 0.0), (90.0, 45.0), (-60.0, -30.0)], "lon double, lat double")
    for name in projection.PROJECTIONS:
        x, y = projection.project(name, F.col("lon"), F.col("lat"))
        rows = df.select(x.alias("x"), y.alias("y")).collect()
        if name not in ("mercator", "satellite"):
            assert rows[0]["x"] == pytest.approx(0, abs=1e-6) and rows[0]["y"] == pytest.approx(0, abs=1e-6), name
        if name == "mollweide":  # the auxiliary angle solves its equation
            theta = math.asin(rows[1]["y"] / (math.sqrt(2) * projection.A))
            assert 2 * theta + math.sin(2 * theta) == pytest.approx(math.pi * math.sin(math.pi / 4), abs=1e-9)
        if name == "eckert iv":
            theta = math.asin(rows[1]["y"] / (2 * math.sqrt(math.pi / (4 + math.pi)) * projection.A))
            assert theta + math.sin(theta) * math.cos(theta) + 2 * math.sin(theta) == pytest.approx((2 + math.pi / 2) * math.sin(math.pi / 4), abs=1e-9)


def test_text_helpers(spark):
    one = spark.createDataFrame([("DATA/ave.*.x.*.nc", "2000", " a, b;;c ")], "p string, d string, n string")
    r = one.select(tx.with_date(F.col("p"), F.col("d")), tx.split_names(F.col("n")), tx.dot_field(F.lit("ave.20000101.N1p.nc"), 3)).first()
    assert r[0] == "DATA/ave.2000.x.*.nc" and r[1] == ["a", "b", "c"] and r[2] == "N1p"
    stamp = steps_of(spark, "2000-03-04T15:06:07")
    assert pointwise.annotate_date_time(stamp).first()["annotation"] == "Date: Mar 2000 - 03:06 PM"
