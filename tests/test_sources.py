import os
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from tidecube.plans import filters
from tidecube.sources import catalog, grid_source, mesh, netcdf, profiles, sinks
from tidecube.streaming import buckets

TIMES = ["20000101-12:00:00", "20000201-12:00:00", "20000301-12:00:00"]


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(0)
    nz, ny, nx = 3, 4, 5
    m = mesh.Mesh(np.arange(nx + 1.0), np.arange(ny + 1.0), np.array([0.0, 10, 30, 60]), rng.integers(0, 2, (60, 16)).astype(np.uint8),
                  rng.integers(0, 3, (60, 1)).astype(np.uint8), rng.integers(0, 2, (60, 1)).astype(np.uint8))
    (root / "mesh.bin").write_bytes(mesh.encode(m))
    flat = {n: (("y", "x"), rng.random((ny, nx)) + 1) for n in mesh.STRETCH_2D}
    deep = {f"{n}_0": (("z", "y", "x"), rng.random((nz, ny, nx)) + 1) for n in mesh.STRETCH_3D}
    (root / "meshmask.nc").write_bytes(netcdf.encode({"z": nz, "y": ny, "x": nx}, flat | deep))
    values = {}
    for t in TIMES:
        for v in ("N1p", "P1c"):
            a = rng.random((1, nz, ny, nx)).astype(np.float32)
            a[0, 0, 0, 0] = 1e20
            values[t, v] = a
            (root / f"ave.{t}.{v}.nc").write_bytes(netcdf.encode({"t": 1, "z": nz, "y": ny, "x": nx}, {v: (("t", "z", "y", "x"), a)}))
        uvw = {n: (("z", "y", "x"), rng.random((nz, ny, nx))) for n in ("uu", "vv", "ww")}
        (root / f"vel.{t}.nc").write_bytes(netcdf.encode({"z": nz, "y": ny, "x": nx}, uvw))
    c = catalog.generate(str(root), {"AVE_FREQ": "ave.%s.%s.nc"}, [("Mercator", "mesh.bin", "meshmask.nc")], "N1p")
    c.variables["AVE_PHYS"]["Velocity"] = ("uu,vv,ww", "vel.*.nc")
    (root / "set.txt").write_text(catalog.render(c))
    return root, m, values


def test_catalog_round_trip(dataset):
    root, *_ = dataset
    c = catalog.read(str(root / "set.txt"))
    assert c.times == TIMES and set(c.variables["AVE_FREQ"]) == {"N1p", "P1c"}
    assert c.path("N1p", TIMES[0]) == str(root / f"ave.{TIMES[0]}.N1p.nc")
    assert catalog.parse("# c\nWRKDIR\n/a\n\nMESH\n0\nAVE_PHYS\n1\nT : votemper : x/ave.*.T.nc\nTIME\n1\n20000101-00:00:00\n").find("T") == ("votemper", "x/ave.*.T.nc")
    with pytest.raises(KeyError):
        c.find("none")


def test_mesh_round_trip(dataset):
    root, m, _ = dataset
    again = mesh.decode((root / "mesh.bin").read_bytes())
    assert again.shape == (3, 4, 5) and (again.basins == m.basins).all() and (again.level == m.level).all()
    assert mesh.extend(np.array([1.0, 2, 3])).tolist() == [0.5, 1, 2, 3]
    assert mesh.extend_depth(np.array([0.0, 10, 30])).tolist() == [0, 10, 30, 40]


def test_netcdf_record_dimension_and_types():
    raw = netcdf.encode({"x": 3}, {"a": (("x",), np.array([1, 2, 3], np.int32)), "b": (("x",), np.array([1.5, 2, 1e20]), {"units": "m"})}, {"title": "t"})
    f = netcdf.File(raw)
    assert f["a"].tolist() == [1, 2, 3] and f.variables["b"][4]["units"] == "m" and f.attributes["title"] == "t"
    assert np.isnan(f.values("b")[2]) and f.values("b", "zero")[2] == 0
    with pytest.raises(ValueError):
        netcdf.File(b"\x89HDF\r\n\x1a\n")


def test_grid_source_reads_prunes_and_joins_mesh(spark, dataset):
    root, m, values = dataset
    grid_source.register(spark)
    df = spark.read.format("oceangrid").option("path", str(root / "set.txt")).option("vars", "P1c,Velocity").option("mesh", "true").load()
    assert {"P1c", "Velocity_u", "Velocity_w", "basins", "e3w", "x"} <= set(df.columns)
    some = df.where("t >= timestamp'2000-02-01 12:00:00' AND k = 1").toPandas()
    assert len(some) == 2 * 20
    one = some[(some.t == datetime(2000, 2, 1, 12)) & (some.j == 2) & (some.i == 3)].iloc[0]
    assert one.P1c == pytest.approx(values[TIMES[1], "P1c"][0, 1, 2, 3])
    assert df.where("P1c IS NULL").count() == 3
    zero = spark.read.format("oceangrid").option("path", str(root / "set.txt")).option("vars", "P1c").option("missing", "zero").load()
    assert zero.where("P1c = 0").count() == 3
    reader = grid_source.GridReader(catalog.read(str(root / "set.txt")), ["P1c"], [], {})
    list(reader.pushFilters([grid_source.EqualTo(("t",), datetime(2000, 3, 1, 12))]))
    assert [p.time for p in reader.partitions()] == TIMES[2:]
    list(reader.pushFilters([grid_source.GreaterThan(("k",), 0), grid_source.EqualTo(("j",), 1)]))
    assert [(p.first, p.end) for p in reader.partitions()] == [(1, 3)]
    thin = grid_source.GridReader(catalog.read(str(root / "set.txt")), ["P1c"], [], {"levels": "1"})
    list(thin.pushFilters([grid_source.In(("k",), (0, 2))]))
    assert [(p.first, p.end) for p in thin.partitions()] == [(0, 1), (2, 3)] * 3


def test_sinks_round_trip(spark, tmp_path):
    pdf = pd.DataFrame([(t, k, j, i, float(i), float(j), -5.0 * k, 5.0 * k, i + 10.0 * j + 100 * k + t) for t in (0, 1) for k in range(2) for j in range(3) for i in range(4)],
                       columns=["t", "k", "j", "i", "x", "y", "z", "depth", "v"])
    df = spark.createDataFrame(pdf).repartition(3)
    done = sinks.write_npz(df, str(tmp_path / "a.npz"), ["v"]).collect()
    assert sorted(r["rows"] for r in done) == [24, 24]
    back = np.load(tmp_path / "a.1.npz")
    assert back["xyz"].shape == (24, 3) and back["v"].tolist() == pdf[pdf.t == 1].v.tolist()
    sinks.append_npz(str(tmp_path / "a.1.npz"), {"w": np.arange(3)})
    assert set(np.load(tmp_path / "a.1.npz")) == {"xyz", "v", "w"}
    for fortran in (True, False):
        sinks.write_field(df, str(tmp_path / "f.field"), ["v", "x"], fortran=fortran).collect()
        _, xyz, data = sinks.read_field((tmp_path / "f.0.field").read_bytes(), fortran)
        assert data[:, 0].tolist() == pdf[pdf.t == 0].v.tolist() and xyz[:, 2].tolist() == pdf[pdf.t == 0].z.tolist()
    grid = df.where("t = 0").select("k", "j", "i", "x", "y", "depth")
    sinks.write_netcdf(df.where("i <> 2"), str(tmp_path / "n.nc"), ["v"], grid=grid).collect()
    f = netcdf.File((tmp_path / "n.1.nc").read_bytes())
    assert f["v"].shape == (1, 2, 3, 4) and f["v"][0, 1, 2, 3] == 124 and (f["v"][0, :, :, 2] == np.float32(1e20)).all()
    sinks.write_npz_table(df.groupBy("t").sum("v"), str(tmp_path / "t.npz"))
    assert set(np.load(tmp_path / "t.npz")) == {"t", "sum(v)"}
    sinks.write_profile(df.where("i = 0 AND j = 0").withColumnRenamed("v", "value"), str(tmp_path / "p.nc"), "v")
    assert netcdf.File((tmp_path / "p.nc").read_bytes())["v"].tolist() == [[0, 100], [1, 101]]
    sinks.write_steps(df, str(tmp_path / "steps"))
    assert os.path.isdir(tmp_path / "steps" / "t=1")


def test_stat_profiles(spark, tmp_path):
    values = np.random.default_rng(1).random((21, 3, 4, 9))
    (tmp_path / "ave.20000101-12:00:00.stat_profiles.nc").write_bytes(profiles.profile_bytes("P1c", values))
    df = profiles.with_time(profiles.read_profiles(spark, str(tmp_path), "P1c"))
    row = df.where("basin = 7 AND coast = 1 AND k = 2 AND stat = 'p50'").first()
    assert row["value"] == values[7, 1, 2, 5] and row["t"] == datetime(2000, 1, 1, 12)


def test_coast_and_land_masks(spark):
    rows = [(k, 0, i, 150.0 + 50 * k, int(k < 3 or i == 1), int(i != 2)) for k in range(4) for i in range(3)]
    df = mesh.land_mask(mesh.coast_mask(spark.createDataFrame(rows, "k int, j int, i int, depth double, water int, inside int")))
    got = {r["i"]: (r["coast"], r["land"]) for r in df.where("k = 0").collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (0, 1)}


def test_user_filters(spark):
    @filters.register("scale", "a double", factor=2.0)
    def scale(pdf, factor):
        return pd.DataFrame({"a": pdf["a"] * factor})

    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert sorted(r["a"] for r in filters.get("scale")(df, factor=3).collect()) == [3.0, 6.0]
    with pytest.raises(TypeError):
        scale(df, factor="x")
    with pytest.raises(TypeError):
        scale(df, other=1)


def test_stream_matches_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, d, h), float(d * h)) for d in (1, 2, 3) for h in range(0, 24, 6)]
    spark.createDataFrame(rows, "t timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, value double").parquet(str(tmp_path / "in"))
    query = buckets.daily_means(stream, late="1 hour").writeStream.format("memory").queryName("daily").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["start"], r["n"], r["value"]) for r in spark.table("daily").collect()}
    want = {(r["start"], r["n"], r["value"]) for r in buckets.daily_means(spark.createDataFrame(rows, "t timestamp, value double")).collect()}
    assert got == want and len(got) == 3
