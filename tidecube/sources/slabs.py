"""NetCDF files written by many tasks: each writes whole levels of a step at the places where the file has them.

df.write.format("oceanslabs") is what write_netcdf_slabs() uses. Files grow under temporary names, in a folder that driver and executors
share; the commit adds headers and levels that no row was for, and renames them, an abort deletes them. A task that is repeated writes the same bytes
to the same places.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .netcdf import MISSING, header
from .sinks import AXES, DIMS, ORDER, STEP_LIMIT, _in_degrees, file_name

#: Cells along an axis, at most: the axes are known to every task.
AXIS_LIMIT = 100_000
#: Bytes that the commit writes at a time into levels without rows.
PIECE = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    """The levels of each step that a task wrote."""

    levels: list[tuple[str, int]]


class Plan:
    """Where everything of a step's file lies."""

    def __init__(self, options: dict):
        self.stem, self.job, self.variables = options["stem"], options["job"], json.loads(options["variables"])
        self.axes = {n: np.array(json.loads(options[n]), float) for n in AXES}
        self.keys = {n: np.array(json.loads(options[f"keys_{n}"]), np.int64) for n in ORDER}
        self.shape = tuple(len(self.keys[n]) for n in ORDER)
        dims = dict(zip(DIMS, (1, *self.shape)))
        kinds = {n: (d, np.float64, a) for n, (d, a) in AXES.items()}
        kinds |= {file_name(v): (DIMS, np.float32, {"missing_value": np.float32(MISSING)}) for v in self.variables}
        self.head, self.begins, self.size = header(dims, kinds)
        self.level = self.shape[1] * self.shape[2] * 4

    def target(self, step: str) -> str:
        return f"{self.stem}.{step}.nc"

    def part(self, step: str) -> str:
        return f"{self.target(step)}.{self.job}.part"

    def opened(self, step: str) -> int:
        """The growing file, made by whoever comes first; all have the same size from the start."""
        os.makedirs(os.path.dirname(self.stem) or ".", exist_ok=True)
        handle = os.open(self.part(step), os.O_RDWR | os.O_CREAT, 0o644)
        os.truncate(handle, self.size)
        return handle

    def put(self, handle: int, variable: str, level: int, values: bytes) -> None:
        os.pwrite(handle, values, self.begins[file_name(variable)] + level * self.level)


class SlabSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oceanslabs"

    def writer(self, schema, overwrite: bool) -> SlabWriter:
        return SlabWriter(dict(self.options))


class SlabWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (step, k, j, i, variables), those of a level of a step next to each other; a level is held at a time."""
        plan, written, held, key, handle = Plan(self.options), [], None, None, None

        def flush() -> None:
            nonlocal handle
            if key is None:
                return
            if not written or written[-1][0] != key[0]:
                if handle is not None:
                    os.close(handle)
                handle = plan.opened(key[0])
            for n, v in enumerate(plan.variables):
                plan.put(handle, v, key[1], held[n].tobytes())
            written.append(key)

        for batch in iterator:
            steps = batch.column(0).to_pylist()
            k, j, i = (np.searchsorted(plan.keys[n], batch.column(1 + m).to_numpy(zero_copy_only=False)) for m, n in enumerate(ORDER))
            values = [batch.column(4 + n).fill_null(MISSING).to_numpy(zero_copy_only=False) for n in range(len(plan.variables))]
            names = np.array(steps, object)
            edges = np.flatnonzero((names[1:] != names[:-1]) | (k[1:] != k[:-1])) + 1 if len(names) else []
            for rows in np.split(np.arange(len(names)), edges):
                if not len(rows):
                    continue
                here = (steps[rows[0]], int(k[rows[0]]))
                if here != key:
                    flush()
                    key, held = here, [np.full(plan.shape[1:], MISSING, ">f4") for _ in plan.variables]
                for n, v in enumerate(values):
                    held[n][j[rows], i[rows]] = np.where(np.isnan(v[rows]), MISSING, v[rows])
        flush()
        if handle is not None:
            os.close(handle)
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        plan, levels = Plan(self.options), {}
        for message in messages:
            for step, level in message.levels if message else ():
                levels.setdefault(step, set()).add(level)
        blank = np.full(min(plan.level, PIECE) // 4, MISSING, ">f4").tobytes()
        for step, there in levels.items():
            handle = plan.opened(step)
            os.pwrite(handle, plan.head, 0)
            for name, axis in plan.axes.items():
                os.pwrite(handle, axis.astype(">f8").tobytes(), plan.begins[name])
            for level in set(range(plan.shape[0])) - there:
                for v in plan.variables:
                    for at in range(0, plan.level, len(blank)):
                        os.pwrite(handle, blank[: plan.level - at], plan.begins[file_name(v)] + level * plan.level + at)
            os.close(handle)
            os.replace(plan.part(step), plan.target(step))

    def abort(self, messages: list[Written | None]) -> None:
        plan = Plan(self.options)
        for path in glob.glob(f"{glob.escape(plan.stem)}.*.nc.{plan.job}.part"):
            os.remove(path)


def write_netcdf_slabs(df: DataFrame, path: str, variables: list[str], time: str = "t", lon: str = "x", lat: str = "y", grid: DataFrame | None = None, projection: str | None = None) -> list[str]:
    """One NetCDF file per step, byte for byte that of write_netcdf(), whose levels are written by as many tasks as there are partitions.

    Rows of a level of a step meet in one task, which holds that level; nothing else is gathered. The axes come from grid, the whole mesh, or from df
    itself; they and the names of the steps (at most STEP_LIMIT) are what the driver sees. Cells without a row or value are MISSING. With a projection, lon and
    lat hold its metres. Returns the files.
    """
    source = _in_degrees(df if grid is None else grid, lon, lat, projection)
    first = lambda index, value, *rest: source.groupBy(index).agg(F.min_by(F.col(value).cast("double"), F.struct(*rest)).alias("v"))
    found = {"k": first("k", "depth", "j", "i"), "j": first("j", lat, "k", "i"), "i": first("i", lon, "k", "j")}
    options = {"stem": path.removesuffix(".nc"), "job": uuid.uuid4().hex, "variables": json.dumps(variables)}
    for (index, table), name in zip(found.items(), ("deptht", "nav_lat", "nav_lon")):
        rows = sorted((r[index], r["v"]) for r in table.limit(AXIS_LIMIT + 1).collect())
        if len(rows) > AXIS_LIMIT:
            raise ValueError(f"axis {index} has more than {AXIS_LIMIT} cells")
        options[f"keys_{index}"], options[name] = json.dumps([int(r[0]) for r in rows]), json.dumps([r[1] for r in rows])
    stamp = F.date_format(time, "yyyyMMdd-HH:mm:ss") if dict(df.dtypes)[time].startswith("timestamp") else F.col(time).cast("string")
    rows = df.select(stamp.alias("step"), *[F.col(n).cast("long").alias(n) for n in ORDER], *[F.col(v).cast("double").alias(f"v{n}") for n, v in enumerate(variables)])
    steps = [r[0] for r in rows.select("step").distinct().limit(STEP_LIMIT + 1).collect()]
    if len(steps) > STEP_LIMIT:
        raise ValueError(f"more than {STEP_LIMIT} steps")
    df.sparkSession.dataSource.register(SlabSink)
    rows.repartition("step", "k").sortWithinPartitions("step", "k").write.format("oceanslabs").mode("append").options(**options).save()
    return [f"{options['stem']}.{s}.nc" for s in sorted(steps)]
