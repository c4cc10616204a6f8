"""Selections of cells and steps: plain predicates, so keys survive and filters reach the scan."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of the sixteen sub-basins, in the order of the mask's bits.
BASINS = (
    "Alboran Sea", "South Western Mediterranean (west)", "South Western Mediterranean (east)", "North Western Mediterranean", "Northern Tyrrhenian",
    "Southern Tyrrhenian", "Northern Adriatic", "Southern Adriatic", "Aegean Sea", "Western Ionian", "Eastern Ionian", "Northern Ionian",
    "Western Levantine", "Northern Levantine", "Southern Levantine", "Eastern Levantine",
)
COASTS = {"continental shelf": 1, "open sea": 2}
FLOW_REGIONS = {"vorticity": 0, "background": 1, "strain": 2}


def basin_bits(basins) -> int:
    numbers = [BASINS.index(b) if isinstance(b, str) else int(b) for b in basins]
    return sum(1 << n for n in set(numbers))


def select_basin(cells: DataFrame, basins, mask_field: str = "basins", basins_field: str | None = None) -> DataFrame:
    """Cells in any of the basins (names or numbers); mask_field is a bit mask, so basins may overlap.

    basins_field names a new column with the last of the selected basins that the cell is in.
    """
    numbers = sorted({BASINS.index(b) if isinstance(b, str) else int(b) for b in basins})
    kept = cells.where(F.col(mask_field).bitwiseAND(F.lit(basin_bits(numbers))) != 0)
    if basins_field:
        inside = [F.when(F.col(mask_field).bitwiseAND(F.lit(1 << n)) != 0, F.lit(n)) for n in numbers]
        kept = kept.withColumn(basins_field, F.greatest(*inside) if len(inside) > 1 else inside[0])
    return kept


def select_coast(cells: DataFrame, coasts=("continental shelf", "open sea"), mask_field: str = "coast") -> DataFrame:
    return cells.where(F.col(mask_field).isin([COASTS.get(c, c) for c in coasts]))


def select_land(cells: DataFrame, mask_field: str = "land") -> DataFrame:
    return cells.where(F.col(mask_field).cast("double").between(0.5, 1.0))


def select_sea(cells: DataFrame, mask_field: str = "coast") -> DataFrame:
    return cells.where(F.col(mask_field) > 0)


def select_okubo_weiss(cells: DataFrame, regions=("vorticity",), mask_field: str = "okubo_weiss_mask") -> DataFrame:
    return cells.where(F.col(mask_field).isin([FLOW_REGIONS.get(r, r) for r in regions]))


def parse_polygon(text: str) -> list[tuple[float, float]]:
    """(x, y) corners of lines "lat lon"; the polygon closes itself."""
    corners = []
    for line in text.splitlines():
        fields = line.split()
        if len(fields) >= 2:
            corners.append((float(fields[1]), float(fields[0])))
    return corners[:-1] if len(corners) > 1 and corners[0] == corners[-1] else corners


def winding_number(x: Column, y: Column, corners) -> Column:
    """How often the polygon goes around (x, y): upward edges left of it minus downward edges right of it."""
    total = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        side = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
        total = total + F.when((y >= y0) & (y < y1) & (side > 0), 1).when((y < y0) & (y >= y1) & (side < 0), -1).otherwise(0)
    return total


def crossing_number(x: Column, y: Column, corners) -> Column:
    """How many edges a ray to the right of (x, y) crosses."""
    total = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 == y1:
            continue
        up = ((y >= y0) & (y < y1)) | ((y < y0) & (y >= y1))
        total = total + F.when(up & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0)), 1).otherwise(0)
    return total


def select_polygon(cells: DataFrame, polygon, invert: bool = False, x: str = "x", y: str = "y", method: str = "winding") -> DataFrame:
    """Cells whose centre is inside the polygon; its bounding box comes first, where scans can use it."""
    corners = parse_polygon(polygon) if isinstance(polygon, str) else list(polygon)
    if len(corners) < 3:
        return cells if invert else cells.where(F.lit(False))
    xs, ys = zip(*corners)
    box = F.col(x).between(float(min(xs)), float(max(xs))) & F.col(y).between(float(min(ys)), float(max(ys)))
    inside = winding_number(F.col(x), F.col(y), corners) != 0 if method == "winding" else crossing_number(F.col(x), F.col(y), corners) % 2 == 1
    return cells.where(~(box & inside)) if invert else cells.where(box & inside)


def select_time_period(steps: DataFrame, start: str, end: str, time: str = "t") -> DataFrame:
    """Steps in [start, end], both ends included."""
    return steps.where(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def data_columns(df: DataFrame, keys=("t", "k", "j", "i"), excluded=("e1", "e2", "e3", "basins", "coast", "land", "depth", "x", "y")) -> list[str]:
    """Names of the variables proper: no keys, no metrics, nothing with mask in its name."""
    return [c for c in df.columns if c not in keys and not any(c == e or (e[0] == "e" and len(e) == 2 and c.startswith(e)) for e in excluded) and "mask" not in c.lower()]


def land_outline(cells: DataFrame, land: str = "land") -> DataFrame:
    """Surface land cells with at least one neighbour at sea: a join on shifted keys, no window over a whole layer."""
    surface = cells.where("k = 0").select("t", "j", "i", F.col(land).cast("int").alias("land"))
    around = F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj, di in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    sea = surface.where("land = 0").select("t", F.explode(around).alias("o"), "j", "i")
    sea = sea.select("t", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i")).distinct()
    return surface.where("land = 1").join(sea, ["t", "j", "i"], "left_semi").select("t", "j", "i")


