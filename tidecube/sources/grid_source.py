"""spark.read.format("oceangrid"): a catalogued dataset as cells, one task per time step and block of levels.

Options: path (master file), vars (comma-separated, default all), missing ("null" or "zero"), mesh ("true"
adds centres, masks and stretch factors), projection, levels (of a block; by default as many as make about BLOCK_CELLS cells). Filters on t and k
with =, >, >=, <, <= and IN drop the files of other steps before any is opened and the blocks of other levels before they are read: of a
file its header and the levels asked for are read, a level at a time. Files may be classic or HDF5-based, and must be where every executor can open them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import catalog as catalogs
from . import mesh as meshes
from .netcdf import levels_of, opened, slab
from .ranges import Ranges

STAMP = "%Y%m%d-%H:%M:%S"
#: Cells of a task, about.
BLOCK_CELLS = 1 << 21
MESH_COLUMNS = ("x", "y", "depth", "basins", "coast", "land")


def _bytes(path: str) -> bytes:
    with open(path, "rb") as data:
        return data.read()


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oceangrid"

    def _catalog(self) -> catalogs.Catalog:
        return catalogs.read(self.options["path"])

    def _wanted(self, catalog: catalogs.Catalog) -> list[str]:
        asked = [v.strip() for v in self.options.get("vars", "").split(",") if v.strip()]
        return asked or catalog.names()

    def _mesh_columns(self, catalog: catalogs.Catalog) -> list[str]:
        if self.options.get("mesh", "false").lower() != "true":
            return []
        with Ranges(catalog.mesh(self.options.get("projection"))[1]) as found:
            factors = meshes.stretch_names(opened(found))
        return [*MESH_COLUMNS, *factors]

    def schema(self) -> str:
        catalog = self._catalog()
        columns = ["t timestamp", "k long", "j long", "i long"]
        for name in self._wanted(catalog):
            parts = catalog.find(name)[0].split(catalogs.VECTOR_MARK)
            columns += [f"`{name}` double"] if len(parts) == 1 else [f"`{name}_{a}` double" for a in "uvw"[: len(parts)]]
        columns += [f"`{c}` {'long' if c in ('basins', 'coast', 'land') else 'double'}" for c in self._mesh_columns(catalog)]
        return ", ".join(columns)

    def reader(self, schema) -> GridReader:
        catalog = self._catalog()
        return GridReader(catalog, self._wanted(catalog), self._mesh_columns(catalog), dict(self.options))


class Block(InputPartition):
    """The levels from first to end of a time step."""

    def __init__(self, time: str, first: int, end: int):
        self.time, self.first, self.end = time, first, end


class GridReader(DataSourceReader):
    def __init__(self, catalog: catalogs.Catalog, wanted: list[str], mesh_columns: list[str], options: dict):
        self.catalog, self.wanted, self.mesh_columns, self.options = catalog, wanted, mesh_columns, options
        self.times, self.level_tests = list(catalog.times), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {
            EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
            LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
        }
        for f in filters:
            test = tests.get(type(f))
            if test and f.attribute == ("t",):
                plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime) else v
                value = tuple(map(plain, f.value)) if isinstance(f, In) else plain(f.value)
                self.times = [t for t in self.times if test(datetime.strptime(t, STAMP), value)]
            elif test and f.attribute == ("k",):
                self.level_tests.append((test, f.value))
            yield f  # Spark tests the rows again

    def _inner(self, name: str) -> list[str]:
        return [p.strip() for p in self.catalog.find(name)[0].split(catalogs.VECTOR_MARK)]

    def partitions(self) -> list[Block]:
        if not self.times or not self.wanted:
            return []
        with Ranges(self.catalog.path(self.wanted[0], self.times[0])) as first:
            nz, ny, nx = levels_of(opened(first), self._inner(self.wanted[0])[0])
        block = int(self.options.get("levels", 0)) or max(1, BLOCK_CELLS // (ny * nx))
        kept = [k for k in range(nz) if all(test(k, value) for test, value in self.level_tests)]
        runs: list[list[int]] = []
        for k in kept:
            if runs and k == runs[-1][-1] + 1 and len(runs[-1]) < block:
                runs[-1].append(k)
            else:
                runs.append([k])
        return [Block(t, run[0], run[-1] + 1) for t in self.times for run in runs]

    def _mesh(self) -> dict[str, np.ndarray]:
        if not self.mesh_columns:
            return {}
        mesh_file, mask_file = self.catalog.mesh(self.options.get("projection"))
        with Ranges(mask_file) as mask:
            return meshes.mesh_rows(meshes.decode(_bytes(mesh_file)), meshes.stretch(opened(mask)))

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        mesh, held = self._mesh(), {}
        try:
            for level in range(partition.first, partition.end):
                yield self._level(partition.time, level, held, mesh)
        finally:
            for ranges, _ in held.values():
                ranges.close()

    def _level(self, time: str, level: int, held: dict, mesh: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns, shape = {}, None
        for name in self.wanted:
            path = self.catalog.path(name, time)
            if path not in held:
                ranges = Ranges(path)
                held[path] = (ranges, opened(ranges))
            parts = self._inner(name)
            for n, part in enumerate(parts):
                values = slab(held[path][1], part, level, level + 1, self.options.get("missing", "null"))
                shape = shape or values.shape
                columns[name if len(parts) == 1 else f"{name}_{'uvw'[n]}"] = values.ravel()
        _, ny, nx = shape
        j, i = (a.ravel() for a in np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij"))
        stamp = np.full(len(j), np.datetime64(datetime.strptime(time, STAMP), "us"))
        arrays = [pa.array(stamp, pa.timestamp("us", tz="UTC")), pa.array(np.full(len(j), level)), pa.array(j), pa.array(i)]
        arrays += [pa.array(v, pa.float64(), from_pandas=True) for v in columns.values()]
        here = slice(level * ny * nx, (level + 1) * ny * nx)
        arrays += [pa.array(np.ascontiguousarray(mesh[c][here])) for c in self.mesh_columns]
        return pa.RecordBatch.from_arrays(arrays, names=["t", "k", "j", "i", *columns, *self.mesh_columns])


def register(spark) -> None:
    """Make the format known and let filters reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
