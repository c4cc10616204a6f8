"""Sinks: Parquet by step for tables at scale; NPZ, .field and NetCDF files with one task per time step.

A step's rows are gathered into one task and sorted there, which is as much as the formats hold in one file.
Files are written under a temporary name and then renamed, so a repeated or lost task leaves whole files.
"""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projection import unproject
from .netcdf import MISSING, encode

RESULT = "path string, rows long"


def write_steps(df: DataFrame, path: str, time: str = "t") -> None:
    """The default sink: Parquet, a folder per step."""
    df.write.partitionBy(time).mode("overwrite").parquet(path)


def _save(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def _stamp(value) -> str:
    return pd.Timestamp(value).strftime("%Y%m%d-%H:%M:%S") if isinstance(value, (pd.Timestamp, np.datetime64)) else str(value)


def _columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*dict.fromkeys(names))


def _per_step(df: DataFrame, path: str, make, order: list[str], suffix: str, time: str) -> DataFrame:
    stem = path.removesuffix(suffix)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        target = f"{stem}.{_stamp(pdf[time].iloc[0])}{suffix}"
        _save(target, make(pdf))
        return pd.DataFrame({"path": [target], "rows": [len(pdf)]})

    return df.groupBy(time).applyInPandas(write, RESULT)


ORDER = ["k", "j", "i"]


def npz_bytes(pdf: pd.DataFrame, variables: list[str]) -> bytes:
    out = io.BytesIO()
    np.savez(out, xyz=pdf[["x", "y", "z"]].to_numpy(float), **{v: pdf[v].to_numpy() for v in variables})
    return out.getvalue()


def write_npz(df: DataFrame, path: str, variables: list[str], time: str = "t", order=ORDER) -> DataFrame:
    """One .npz per step: xyz (n x 3) and one array per variable. Returns (path, rows); the files are there once it has run."""
    return _per_step(_columns(df, time, *order, "x", "y", "z", *variables), path, lambda p: npz_bytes(p, variables), list(order), ".npz", time)


def append_npz(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Add arrays to a small .npz file on the driver, replacing those of the same name."""
    old = dict(np.load(path)) if os.path.exists(path) else {}
    out = io.BytesIO()
    np.savez(out, **(old | arrays))
    _save(path, out.getvalue())


def write_npz_table(table: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """A result table of at most `limit` rows, one array per column."""
    rows = table.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"the table has more than {limit} rows")
    out = io.BytesIO()
    np.savez(out, **{c: rows[c].to_numpy() for c in rows.columns})
    _save(path, out.getvalue())


def field_bytes(xyz: np.ndarray, data: np.ndarray, time: float = 0.0, fortran: bool = True) -> bytes:
    """int32 columns, int32 rows, float32 time, then float32 coordinates and data, column by column or row by row."""
    order = "F" if fortran else "C"
    head = np.array([data.shape[1], len(data)], "<i4").tobytes() + np.array([time], "<f4").tobytes()
    return head + xyz.astype("<f4").tobytes(order) + data.astype("<f4").tobytes(order)


def read_field(raw: bytes, fortran: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    columns, rows = np.frombuffer(raw, "<i4", 2)
    time = float(np.frombuffer(raw, "<f4", 1, 8)[0])
    order = "F" if fortran else "C"
    xyz = np.frombuffer(raw, "<f4", 3 * rows, 12).reshape((rows, 3), order=order)
    return time, xyz, np.frombuffer(raw, "<f4", columns * rows, 12 + 12 * int(rows)).reshape((rows, columns), order=order)


def write_field(df: DataFrame, path: str, variables: list[str], time: str = "t", order=ORDER, fortran: bool = True) -> DataFrame:
    make = lambda p: field_bytes(p[["x", "y", "z"]].to_numpy(float), p[variables].to_numpy(float), 0.0, fortran)
    return _per_step(_columns(df, time, *order, "x", "y", "z", *variables), path, make, list(order), ".field", time)


DIMS = ("time_counter", "deptht", "y", "x")
AXES = {
    "nav_lon": (("x",), {"units": "degrees_east"}), "nav_lat": (("y",), {"units": "degrees_north"}), "deptht": (("deptht",), {"units": "meter", "positive": "down"}),
}


def file_name(variable: str) -> str:
    return variable.strip().replace(" ", "_")


def netcdf_bytes(pdf: pd.DataFrame, variables: list[str], lon: str, lat: str, depth: str = "depth") -> bytes:
    """var(time_counter, deptht, y, x) over the whole grid; cells without a row or value are MISSING."""
    axes = {n: np.sort(pdf[n].unique()) for n in ("k", "j", "i")}
    shape = tuple(len(a) for a in axes.values())
    at = tuple(np.searchsorted(axes[n], pdf[n]) for n in axes)
    first = lambda n, c: pdf.groupby(n)[c].first().to_numpy(float)
    dims = dict(zip(DIMS, (1, *shape)))
    found = {"nav_lon": first("i", lon), "nav_lat": first("j", lat), "deptht": first("k", depth)}
    out = {n: (d, found[n], a) for n, (d, a) in AXES.items()}
    for name in variables:
        grid = np.full(shape, MISSING)
        grid[at] = pdf[name].fillna(MISSING).to_numpy(float)
        out[file_name(name)] = (tuple(dims), grid[None].astype(np.float32), {"missing_value": np.float32(MISSING)})
    return encode(dims, out)


def _in_degrees(df: DataFrame, lon: str, lat: str, projection: str | None) -> DataFrame:
    if projection is None:
        return df
    return df.withColumns(dict(zip((lon, lat), unproject(projection, F.col(lon), F.col(lat)))))


#: Steps that a whole mesh may be met with; each is a file.
STEP_LIMIT = 100_000


def write_netcdf(df: DataFrame, path: str, variables: list[str], time: str = "t", lon: str = "x", lat: str = "y", grid: DataFrame | None = None, projection: str | None = None) -> DataFrame:
    """One NetCDF file per step, made in one task. grid, if given, has the whole mesh's (k, j, i, lon, lat, depth), onto which a subset is put back by key.

    With a projection, lon and lat hold its metres and degrees are written. Steps that one task cannot hold go through write_netcdf_slabs().
    """
    df, grid = _in_degrees(df, lon, lat, projection), grid if grid is None else _in_degrees(grid, lon, lat, projection)
    rows = _columns(df, time, *ORDER, lon, lat, "depth", *variables)
    if grid is not None:
        steps = df.select(time).distinct()
        if steps.limit(STEP_LIMIT + 1).count() > STEP_LIMIT:
            raise ValueError(f"more than {STEP_LIMIT} steps")
        whole = grid.select(*ORDER, lon, lat, "depth").crossJoin(F.broadcast(steps))
        rows = whole.join(df.select(time, *ORDER, *variables), [time, *ORDER], "left")
    return _per_step(rows, path, lambda p: netcdf_bytes(p, variables, lon, lat), ORDER, ".nc", time)


def profile_file(table: pd.DataFrame, variable: str) -> bytes:
    """var(time, depth) of a long depth-time table (t, depth, value)."""
    wide = table.pivot(index="t", columns="depth", values="value")
    dims = {"time": len(wide), "depth": wide.shape[1]}
    values = wide.fillna(MISSING).to_numpy(np.float32)
    return encode(dims, {"depth": (("depth",), wide.columns.to_numpy(float)), variable: (("time", "depth"), values)})


def write_profile(table: DataFrame, path: str, variable: str, limit: int = 1_000_000) -> None:
    rows = table.select("t", "depth", "value").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"the profile has more than {limit} rows")
    _save(path, profile_file(rows, variable))
