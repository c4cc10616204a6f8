"""Files written by many tasks have the bytes of those written by one; an aborted job leaves none."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.functions import projection
from tidecube.operators import locate, probe
from tidecube.sources import netcdf, sinks, slabs


def grid_of(spark, steps=2, nz=5, ny=4, nx=6):
    rows = spark.range(steps * nz * ny * nx).select(F.floor(F.col("id") / (nz * ny * nx)).cast("long").alias("t"), (F.floor(F.col("id") / (ny * nx)) % nz).alias("k"), (F.floor(F.col("id") / nx) % ny).alias("j"), (F.col("id") % nx).alias("i"), F.col("id"))
    return rows.select("t", "k", "j", "i", (F.col("i") * 2.0).alias("x"), (30 + F.col("j") * 1.0).alias("y"), (5 + 10.0 * F.col("k")).alias("depth"), F.sin("id").alias("v"), F.when(F.col("id") % 7 > 0, F.cos("id")).alias("w x"))


def test_slabs_have_the_bytes_of_whole_steps(spark, tmp_path):
    grid = grid_of(spark)
    some = grid.where("k <> 3 AND (t = 0 OR i <> 2)")  # a level without rows, a column without them
    mesh = grid.where("t = 0").select("k", "j", "i", "x", "y", "depth")
    sinks.write_netcdf(some, str(tmp_path / "one.nc"), ["v", "w x"], grid=mesh).collect()
    files = slabs.write_netcdf_slabs(some.repartition(7), str(tmp_path / "many.nc"), ["v", "w x"], grid=mesh)
    assert files == [str(tmp_path / f"many.{t}.nc") for t in (0, 1)]
    for t in (0, 1):
        assert (tmp_path / f"many.{t}.nc").read_bytes() == (tmp_path / f"one.{t}.nc").read_bytes()
    sinks.write_netcdf(some, str(tmp_path / "own.nc"), ["v"]).collect()
    slabs.write_netcdf_slabs(some, str(tmp_path / "owns.nc"), ["v"])
    assert (tmp_path / "owns.0.nc").read_bytes() == (tmp_path / "own.0.nc").read_bytes()
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    grid = grid_of(spark).withColumn("v", F.when((F.col("t") == 1) & (F.col("k") == 4), F.raise_error(F.lit("no value")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no value|abort|failed"):
        slabs.write_netcdf_slabs(grid, str(tmp_path / "bad.nc"), ["v"], grid=grid_of(spark, 1))
    assert os.listdir(tmp_path) == []


def test_projected_coordinates_are_written_as_degrees(spark, tmp_path):
    grid = grid_of(spark, 1)
    x, y = projection.project("mercator", F.col("x"), F.col("y"))
    metres = grid.withColumns({"x": x, "y": y})
    sinks.write_netcdf(metres, str(tmp_path / "a.nc"), ["v"], projection="mercator").collect()
    slabs.write_netcdf_slabs(metres, str(tmp_path / "b.nc"), ["v"], projection="Mercator")
    assert (tmp_path / "a.0.nc").read_bytes() == (tmp_path / "b.0.nc").read_bytes()
    f = netcdf.opened((tmp_path / "a.0.nc").read_bytes())
    assert f["nav_lon"] == pytest.approx(np.arange(6) * 2.0) and f["nav_lat"] == pytest.approx(30 + np.arange(4.0))


def test_round_trips_of_all_maps(spark):
    rows = spark.range(0, 160 * 300, 7).select(((F.col("id") / 300).cast("long") - 80.0).alias("lat"), (F.col("id") % 300 - 149.5).alias("lon"))
    rows = rows.union(spark.createDataFrame([(36.4, 17.5), (0.0, 0.0), (90.0, 0.0), (-90.0, 0.0), (None, 3.0), (None, None)], "lat double, lon double"))
    for name in projection.INVERSES:
        x, y = projection.project(name, F.col("lon"), F.col("lat"))
        back = rows.select("lon", "lat", x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND abs(y) < 1e9")
        lon, lat = projection.unproject(name, F.col("x"), F.col("y"))
        away = back.select(F.max(F.when(F.abs("lat") < 89, F.abs(lon - F.col("lon")))).alias("lon"), F.max(F.abs(lat - F.col("lat"))).alias("lat"), F.count("*").alias("n")).first()
        assert away["n"] > 1500 and away["lon"] < 1e-8 and away["lat"] < (1e-5 if name in ("mollweide", "eckert iv", "orthographic", "equal earth") else 1e-8), (name, away)
    beyond = spark.range(1).select(*projection.unproject("satellite", F.lit(9e6), F.lit(0.0))).first()
    assert beyond[0] is None and beyond[1] is None


def test_satellite_sees_beyond_the_pole(spark):
    """Places past the 180th meridian keep their own longitude, not one of more than 180 degrees."""
    rows = [(83.25, -166.5), (84.25, -165.5), (84.25, 179.5), (88.0, -162.5), (88.0, -170.0), (36.0, -5.0)]
    places = spark.createDataFrame(rows, "lat double, lon double")
    x, y = projection.project("satellite", F.col("lon"), F.col("lat"))
    lon, lat = projection.unproject("satellite", F.col("x"), F.col("y"))
    back = places.select(x.alias("x"), y.alias("y")).select(lat.alias("lat"), lon.alias("lon")).collect()
    assert [tuple(r) for r in back] == [pytest.approx(r, abs=1e-8) for r in rows]


def test_nearest_sites_by_growing_cubes(spark):
    rng = np.random.default_rng(1)
    sites, points = rng.random((120, 3)) * 10, rng.random((150, 3)) * 40 - 10
    points[:5] = sites[:5]
    left = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(points)] + [(500, None, 1.0, 1.0)], "point long, x double, y double, z double")
    right = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(sites)], "site long, x double, y double, z double")
    got = {r["point"]: (r["site"], r["dist"]) for r in locate.nearest(left, right, 1.0).collect()}
    far = np.linalg.norm(points[:, None] - sites[None], axis=2)
    assert {n: got[n][0] for n in range(150)} == dict(enumerate(far.argmin(axis=1).tolist())) and got[500] == (None, None)
    assert [got[n][1] for n in range(150)] == pytest.approx(far.min(axis=1).tolist())
    assert all(r["site"] is None for r in locate.nearest(left, right.limit(0), 1.0).collect())


def test_scatter_by_position_equals_scatter_by_key(spark):
    grid = grid_of(spark).withColumn("z", -F.col("depth"))
    subset = grid.where("(i + j) % 3 > 0")
    by_key = {tuple(r)[:4]: r["v"] for r in probe.scatter(grid, subset, ["v"]).collect()}
    placed = {tuple(r)[:4]: r["v"] for r in probe.scatter_by_position(grid, subset.drop("k", "j", "i"), ["v"], 3.0).collect()}
    assert len(placed) == 240 and all(placed[k] == v for k, v in by_key.items() if v < 1e20) and None not in placed.values()


def test_broken_lines(spark):
    corners = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 4.0, 0.0), (1, 2, 3.0, 4.0, 10.0), (2, 0, 7.0, 7.0, 7.0)], "line long, place long, x double, y double, depth double")
    rows = probe.broken_line(corners, 5).orderBy("line", "pid").collect()
    assert [r["pid"] for r in rows] == [*range(11), 0] and [r["along"] for r in rows][:11] == pytest.approx([*range(5), 5, 7, 9, 11, 13, 15])
    assert tuple(rows[2])[2:5] == pytest.approx((1.2, 1.6, 0)) and tuple(rows[10])[2:5] == (3, 4, 10) and tuple(rows[11])[2:5] == (7, 7, 7)


def test_repeated_probes_stay_rows(spark):
    cells = grid_of(spark, 1)
    probes = spark.createDataFrame([(2.0, 31.0, 15.0), (2.0, 31.0, 15.0), (2.5, 31.0, 16.0), (99.0, 31.0, 15.0)], "x double, y double, depth double")
    found = probe.locate(probes, probe.grid_axes(cells))
    assert sorted((r["i"] is None, r["i"] or 0, r["k"]) for r in found.collect()) == [(False, 1, 1), (False, 1, 1), (False, 1, 1), (True, 0, 1)]
