"""The mesh: axes in metres, masks, stretch factors; its binary file and its generation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .netcdf import doubles

#: Stretch factors in the meshmask file and their columns.
STRETCH_2D = ("e1t", "e1u", "e1v", "e1f", "e2t", "e2u", "e2v", "e2f")
STRETCH_3D = ("e3t", "e3u", "e3v", "e3w")


@dataclass
class Mesh:
    """Vertices of the three axes, and masks with one row per cell (x fastest, depth slowest)."""

    lon: np.ndarray
    lat: np.ndarray
    level: np.ndarray
    basins: np.ndarray
    coasts: np.ndarray
    land: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        """Cells along depth, y and x."""
        return len(self.level) - 1, len(self.lat) - 1, len(self.lon) - 1


def decode(data: bytes) -> Mesh:
    nlon, nlat, nlev = np.frombuffer(data, "<i4", 3)
    at, axes = 12, []
    for n in (nlon, nlat, nlev):
        axes.append(np.frombuffer(data, "<f8", n, at))
        at += 8 * int(n)
    cells, masks = int((nlon - 1) * (nlat - 1) * (nlev - 1)), []
    for _ in range(3):
        width = int(np.frombuffer(data, "<i4", 1, at)[0])
        masks.append(np.frombuffer(data, np.uint8, cells * width, at + 4).reshape(cells, width))
        at += 4 + cells * width
    return Mesh(*axes, *masks)


def encode(mesh: Mesh) -> bytes:
    out = np.array([len(mesh.lon), len(mesh.lat), len(mesh.level)], "<i4").tobytes()
    out += b"".join(np.asarray(a, "<f8").tobytes() for a in (mesh.lon, mesh.lat, mesh.level))
    for mask in (mesh.basins, mesh.coasts, mesh.land):
        mask = np.asarray(mask, np.uint8).reshape(len(mask), -1)
        out += np.array([mask.shape[1]], "<i4").tobytes() + mask.tobytes()
    return out


def extend(centres: np.ndarray) -> np.ndarray:
    """Vertices from upper cell edges: one more before the first, half a step away."""
    centres = np.asarray(centres, float)
    return np.concatenate(([centres[0] - (centres[1] - centres[0]) / 2], centres))


def extend_depth(levels: np.ndarray) -> np.ndarray:
    levels = np.asarray(levels, float)
    return np.append(levels, levels[-1] + (levels[-1] - levels[-2]) / 2)


def stretch_names(mask) -> list[str]:
    """The columns that stretch() gives, without reading them."""
    return [n for n in STRETCH_2D if n in mask.variables] + [n for n in STRETCH_3D if f"{n}_0" in mask.variables]


def stretch(mask) -> dict[str, np.ndarray]:
    """The stretch factors of a meshmask file as (depth, y, x) arrays, surface factors repeated over depth."""
    deep = {n: np.squeeze(doubles(mask[f"{n}_0"], "null")) for n in STRETCH_3D if f"{n}_0" in mask.variables}
    levels = next(iter(deep.values())).shape[0] if deep else 1
    flat = {n: np.squeeze(doubles(mask[n], "null")) for n in STRETCH_2D if n in mask.variables}
    return {n: np.broadcast_to(a, (levels, *a.shape)) for n, a in flat.items()} | deep


def mesh_rows(mesh: Mesh, factors: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Columns of the mesh table: indices, centres, masks and stretch factors of every cell."""
    nz, ny, nx = mesh.shape
    k, j, i = (a.ravel() for a in np.meshgrid(np.arange(nz), np.arange(ny), np.arange(nx), indexing="ij"))
    mid = lambda a: (a[1:] + a[:-1]) / 2
    bits = (mesh.basins.astype(np.int64) != 0) @ (1 << np.arange(mesh.basins.shape[1], dtype=np.int64))
    out = {"k": k, "j": j, "i": i, "x": mid(mesh.lon)[i], "y": mid(mesh.lat)[j], "depth": mid(mesh.level)[k]}
    out |= {"basins": bits, "coast": mesh.coasts[:, 0].astype(np.int64), "land": mesh.land[:, 0].astype(np.int64)}
    for name, values in (factors or {}).items():
        out[name] = np.broadcast_to(values, mesh.shape).ravel()
    return out


def mesh_table(spark: SparkSession, mesh: Mesh, factors: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The mesh as a table; a mesh has as many rows as one time step."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(mesh_rows(mesh, factors)))


def coast_mask(cells: DataFrame, water: str = "water", inside: str = "inside", level: float = 200.0) -> DataFrame:
    """cells with coast: 2 where the column has water at the level after `level` metres, 1 elsewhere inside, 0 outside."""
    depths = cells.groupBy("k").agg(F.min("depth").alias("d"))
    # The level nearest to `level`, and the next one down.
    nearest = depths.agg((F.min_by("k", F.struct(F.abs(F.col("d") - level), "k")) + 1).alias("__k"))
    deep = cells.join(nearest, F.col("k") == F.col("__k")).select("j", "i", F.col(water).cast("boolean").alias("__open"))
    joined = cells.join(deep, ["j", "i"], "left")
    kind = F.when(F.coalesce("__open", F.lit(False)), 2).otherwise(1)
    return joined.withColumn("coast", F.when(F.col(inside).cast("boolean"), kind).otherwise(0)).drop("__open")


def land_mask(cells: DataFrame) -> DataFrame:
    """cells with land: what is in no coast class."""
    return cells.withColumn("land", (F.col("coast") == 0).cast("int"))
