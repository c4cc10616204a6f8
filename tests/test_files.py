"""Ranges of files: levels of classic and HDF5-based NetCDF files, and how many bytes they take."""

import numpy as np
import pytest

from hdf5_files import newer, older
from tidecube.sources import catalog, grid_source, hdf5, netcdf
from tidecube.sources.ranges import Ranges

RNG = np.random.default_rng(3)
FIELD = RNG.random((1, 7, 9, 11)).astype(np.float32)
COUNTS = RNG.integers(-1000, 1000, (5, 6)).astype(">i2")
ALL = {
    "field": {"array": FIELD, "chunk": (1, 2, 4, 5), "filters": ((2, 4), (1, 6), (3, 0)), "fill": 1e20},
    "counts": {"array": COUNTS}, "small": {"array": np.arange(6.0).reshape(2, 3), "layout": "compact"},
    "whole": {"array": RNG.random((4, 4)), "chunk": (4, 4)}, "none": {"array": np.zeros((2, 2), np.int32), "layout": "empty", "fill": -7},
    "split": {"array": np.arange(40, dtype=np.uint8), "chunk": (16,), "filters": ((1, 9),), "split": True},
}


@pytest.mark.parametrize("make", [newer, older, lambda v: newer(v, dense=True), lambda v: newer(v, dense=True, indirect=True)])
def test_hdf5_variables_of_every_kind(make):
    many = ALL | {f"filler_{n}": {"array": np.arange(3) + n} for n in range(12)}
    f = netcdf.opened(make(many))
    assert isinstance(f, hdf5.File) and set(many) <= set(f.variables)
    for name, v in many.items():
        got = f[name]
        assert got.shape == v["array"].shape and (got == (-7 if name == "none" else v["array"])).all(), name
    assert (f.read("field", [(0, 1), (3, 6), (2, 9), (0, 11)]) == FIELD[:, 3:6, 2:9]).all()
    assert (f.read("counts", [(1, 4), (2, 3)]) == COUNTS[1:4, 2:3]).all()
    if "group" in f.variables:
        with pytest.raises(KeyError):
            f["group"]


def test_an_hdf5_file_equals_the_classic_one():
    dims = {"t": 1, "z": 7, "y": 9, "x": 11}
    values = np.where(FIELD > 0.9, np.float32(1e20), FIELD)
    classic = netcdf.opened(netcdf.encode(dims, {"v": (tuple(dims), values)}))
    other = netcdf.opened(newer({"v": {"array": values, "chunk": (1, 3, 9, 4), "filters": ((2, 4), (1, 4))}}))
    assert netcdf.levels_of(classic, "v") == netcdf.levels_of(other, "v") == (7, 9, 11)
    for a, b in ((0, 1), (2, 6), (6, 7)):
        one, two = (netcdf.slab(f, "v", a, b) for f in (classic, other))
        assert one.shape == (b - a, 9, 11) and np.array_equal(one, two, equal_nan=True) and np.isnan(one).any() == (values[0, a:b] >= 1e20).any()


def test_broken_files_are_refused():
    whole = newer(ALL)
    for raw in (b"\x89HDF\r\n\x1a\n" + bytes([9]) * 90, whole[:200], b"plain text, not a file of data"):
        with pytest.raises((ValueError, IndexError, KeyError)):
            netcdf.opened(raw)["field"]
    strange = newer({"v": {"array": FIELD, "chunk": (1, 7, 9, 11), "filters": ((32015, 3),)}})
    with pytest.raises(ValueError, match="filter 32015"):
        netcdf.opened(strange)["v"]
    with pytest.raises(ValueError, match="ends early"):
        netcdf.File(netcdf.encode({"x": 3}, {"a": (("x",), np.arange(3))})[:40])


@pytest.mark.parametrize("chunked", [False, True])
def test_one_level_takes_its_own_bytes(tmp_path, chunked):
    array = RNG.random((1, 40, 50, 60)).astype(np.float32)
    raw = newer({"v": {"array": array, "chunk": (1, 1, 50, 60), "fanout": 16}}) if chunked else netcdf.encode({"t": 1, "z": 40, "y": 50, "x": 60}, {"v": (("t", "z", "y", "x"), array)})
    (tmp_path / "v.nc").write_bytes(raw)
    with Ranges(str(tmp_path / "v.nc")) as ranges:
        file = netcdf.opened(ranges)
        head = ranges.taken
        assert np.array_equal(netcdf.slab(file, "v", 17, 18)[0], array[0, 17].astype(float))
        assert ranges.taken - head < 50 * 60 * 4 + 4000 and ranges.taken < len(raw) / 10


def test_record_variables_are_read_by_ranges():
    """A growing first dimension: records of two variables lie in turns."""
    import struct

    one, two = np.arange(12.0).reshape(3, 4), np.arange(3, dtype=np.int32)
    head = b"CDF\x01" + struct.pack(">i", 3) + struct.pack(">ii", 10, 2) + netcdf._name("time") + struct.pack(">i", 0) + netcdf._name("x") + struct.pack(">i", 4) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
    entries = lambda at: (netcdf._name("one") + struct.pack(">iiiiiiii", 2, 0, 1, 0, 0, 6, 32, at) + netcdf._name("two") + struct.pack(">iiiiiii", 1, 0, 0, 0, 4, 4, at + 32))
    at = len(head) + len(entries(0))
    raw = head + entries(at) + b"".join(one[r].astype(">f8").tobytes() + two[r : r + 1].astype(">i4").tobytes() for r in range(3))
    f = netcdf.File(raw)
    assert (f["one"] == one).all() and (f["two"] == two).all() and (f.read("one", [(1, 3), (2, 4)]) == one[1:, 2:]).all()


def test_the_grid_source_reads_hdf5_by_blocks_of_levels(spark, tmp_path):
    times = ["20000101-12:00:00", "20000102-12:00:00"]
    arrays = {t: RNG.random((1, 7, 9, 11)).astype(np.float32) for t in times}
    for t, a in arrays.items():
        (tmp_path / f"ave.{t}.v.nc").write_bytes(newer({"v": {"array": a, "chunk": (1, 2, 9, 11), "filters": ((2, 4), (1, 6))}}))
    c = catalog.generate(str(tmp_path), {"AVE_FREQ": "ave.%s.%s.nc"}, [], "v")
    (tmp_path / "set.txt").write_text(catalog.render(c))
    grid_source.register(spark)
    df = spark.read.format("oceangrid").option("path", str(tmp_path / "set.txt")).option("levels", "3").load()
    assert df.rdd.getNumPartitions() == 6
    deep = df.where("k >= 5")
    rows = {(r["t"].day, r["k"], r["j"], r["i"]): r["v"] for r in deep.collect()}
    assert len(rows) == 2 * 2 * 99 and all(v == arrays[times[d - 1]][0, k, j, i] for (d, k, j, i), v in rows.items())
