"""Points in any grid of hexahedra: a hashed grid of buckets finds candidates, the trilinear map decides.

Meshes are tables of corners, as in `unstructured`. A cell is indexed at the level of buckets that are as large as it is, so it lies
in a few buckets whatever its size; a point has one key for each level that there is. The join is an equi-join of keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import kept
from .unstructured import HEXAHEDRON

#: A point belongs to a cell if its squared distance is at most this part of the squared diagonal of the cell's box.
TOLERANCE2 = 1e-6
#: Newton steps of the inverse of the trilinear map, and how near to a face a place counts as on it.
STEPS, SNAP = 20, 1e-9
#: Rows of a result of probes and steps that one task makes, about.
TASK_ROWS = 1_000_000
_CORNERS = np.array(HEXAHEDRON, float)


def weights(rst: np.ndarray) -> np.ndarray:
    """(n, 8) trilinear weights of the corners at parametric places (n, 3)."""
    at = rst[:, None, :]
    return np.where(_CORNERS == 1, at, 1 - at).prod(axis=2)


def _slopes(rst: np.ndarray) -> np.ndarray:
    """(n, 8, 3) derivatives of weights()."""
    at = np.where(_CORNERS == 1, rst[:, None, :], 1 - rst[:, None, :])
    sign = 2 * _CORNERS - 1
    return np.stack([sign[:, a] * at[:, :, (a + 1) % 3] * at[:, :, (a + 2) % 3] for a in range(3)], axis=2)


def inverse(corners: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parametric places (n, 3) within the cell, squared distances) of points (n, 3) to hexahedra (n, 8, 3).

    Newton's method; a place outside the cell is moved into it along each parametric axis, and the distance is from there; within it is 0. Cells
    without volume, where no step can be taken, are infinitely far.
    """
    rst, lost = np.full((len(points), 3), 0.5), np.zeros(len(points), bool)
    for _ in range(STEPS):
        miss = np.einsum("nc,nca->na", weights(rst), corners) - points
        jacobian = np.einsum("ncp,nca->nap", _slopes(rst), corners)
        volume = np.linalg.det(jacobian)
        lost |= ~np.isfinite(volume) | (volume == 0)
        jacobian[lost] = np.eye(3)
        step = np.linalg.solve(jacobian, miss[:, :, None])[:, :, 0]
        rst = np.where(lost[:, None], 0.5, np.clip(rst - step, -10, 11))
        if not np.abs(step[~lost]).max(initial=0) > 1e-14:
            break
    rst = np.where(np.abs(rst) < SNAP, 0, np.where(np.abs(rst - 1) < SNAP, 1, rst))
    inside = np.clip(rst, 0, 1)
    away = np.einsum("nc,nca->na", weights(inside), corners) - points
    return inside, np.where(lost, np.inf, np.where((rst == inside).all(axis=1), 0, (away * away).sum(axis=1)))


def _inverses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        points = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in range(3)], axis=1)
        corners = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 3)
        rst, dist2 = inverse(corners, points)
        made = [pa.array(np.ascontiguousarray(rst[:, n])) for n in range(3)] + [pa.array(dist2)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in range(5)], *made], names=["x", "y", "z", "cell", "length2", "r", "s", "q", "dist2"])


def cell_boxes(corners: DataFrame) -> DataFrame:
    """(cell, lo_x .. hi_z, length2, shape): the box of each hexahedron, its squared diagonal and its corners' coordinates in a row.

    Times do not matter to where a cell is: rows that repeat a corner count once.
    """
    rows = corners.where("kind = 'hexahedron'")
    ends = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = rows.groupBy("cell").agg(*ends, F.array_sort(F.collect_set(F.struct("corner", "x", "y", "z"))).alias("set"))
    length2 = sum(((F.col(f"hi_{a}") - F.col(f"lo_{a}")) * (F.col(f"hi_{a}") - F.col(f"lo_{a}")) for a in "yz"), (F.col("hi_x") - F.col("lo_x")) * (F.col("hi_x") - F.col("lo_x")))
    shape = F.flatten(F.transform("set", lambda c: F.array(c["x"], c["y"], c["z"]).cast("array<double>")))
    return boxes.where(F.size("set") == 8).select("cell", *[f"{n}_{a}" for a in "xyz" for n in ("lo", "hi")], length2.alias("length2"), shape.alias("shape"))


def find_cells(probes: DataFrame, corners: DataFrame, tolerance2: float = TOLERANCE2, position=("x", "y", "z")) -> DataFrame:
    """probes with cell, r, s, q (the place in the cell, 0 to 1) and dist2; null where no cell is within the tolerance.

    The nearest cell counts, of equally near ones that of the smallest number. Positions are looked up once each, so repeated probes stay rows of
    their own and cost nothing. Only the mean box and the levels of buckets come to the driver (a row, and some tens of numbers).
    """
    boxes = kept(cell_boxes(corners))
    wide = {a: F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"}
    mean = boxes.agg(*[F.avg(wide[a]).alias(a) for a in "xyz"]).first()
    size = {a: float(mean[a] or 1.0) for a in "xyz"}
    reach = F.sqrt(F.col("length2") * tolerance2)
    ratio = F.greatest(*[wide[a] / size[a] for a in "xyz"], F.lit(1e-9))
    boxes = boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(ratio))).cast("int")).withColumn("reach", reach)
    levels = sorted(r["level"] for r in boxes.select("level").distinct().collect())
    bucket = lambda value, a, level: F.floor(value / (size[a] * F.pow(F.lit(2.0), level)))
    index = boxes
    for a in "xyz":
        ends = [bucket(F.col(f"{n}_{a}") + sign * F.col("reach"), a, F.col("level")) for n, sign in (("lo", -1), ("hi", 1))]
        index = index.withColumn(f"b{a}", F.explode(F.sequence(*ends)))
    names = dict(zip("xyz", position))
    places = probes.select(*[F.col(names[a]).cast("double").alias(a) for a in "xyz"]).where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in "xyz")).distinct()
    asked = places.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    asked = asked.withColumns({f"b{a}": bucket(F.col(a), a, F.col("level")) for a in "xyz"})
    met = asked.join(index, ["level", "bx", "by", "bz"])
    for a in "xyz":
        met = met.where(F.col(a).between(F.col(f"lo_{a}") - F.col("reach"), F.col(f"hi_{a}") + F.col("reach")))
    near = met.select("x", "y", "z", "cell", "length2", "shape").mapInArrow(_inverses, "x double, y double, z double, cell long, length2 double, r double, s double, q double, dist2 double")
    best = near.where(F.col("dist2") <= F.col("length2") * tolerance2).groupBy("x", "y", "z").agg(F.min(F.struct("dist2", "cell", "r", "s", "q")).alias("b"))
    best = best.select(*[F.col(a).alias(f"__{a}") for a in "xyz"], "b.cell", "b.r", "b.s", "b.q", "b.dist2")
    same = F.lit(True)
    for a in "xyz":
        same = same & (F.col(names[a]).cast("double") == F.col(f"__{a}"))
    return probes.join(best, same, "left").drop(*[f"__{a}" for a in "xyz"])


def cell_values(found: DataFrame, values: DataFrame, fields: list[str], keys=("t",)) -> DataFrame:
    """found (of find_cells) at each step with its cell's values(keys.., cell, fields): the value is copied.

    The result has as many rows as a cell's probes times its steps, far more than either table, so tasks follow the result and not what is shuffled: it is
    counted first from both counts of each cell, and a cell with over TASK_ROWS of it is dealt over tasks by its longer side, while the shorter is repeated.
    """
    columns = found.columns
    found, values = kept(found.where("cell IS NOT NULL")), kept(values.where("cell IS NOT NULL").select(*keys, "cell", *fields))
    sides = found.groupBy("cell").agg(F.count("*").alias("__p")).join(values.groupBy("cell").agg(F.count("*").alias("__q")), "cell")
    rows = F.col("__p") * F.col("__q")
    total = sides.agg(F.sum(rows)).first()[0] or 0
    ways = F.ceil(rows / TASK_ROWS).cast("int")
    large = kept(sides.where(rows > TASK_ROWS).select("cell", F.when(F.col("__p") >= F.col("__q"), ways).otherwise(1).alias("__p"), F.when(F.col("__p") < F.col("__q"), ways).otherwise(1).alias("__q")))
    tasks, place = max(1, -(-total // TASK_ROWS)), ["cell", "__own", "__other"]

    def dealt(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        each = df.withColumn("__row", F.monotonically_increasing_id()).join(large, "cell", "left").withColumn(names[0], F.pmod("__row", F.coalesce(own, F.lit(1))).cast("int"))
        each = each.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return each.select(*df.columns, "__own", "__other").repartition(tasks, *place)

    left, right = dealt(found, "__p", "__q", ("__own", "__other")), dealt(values, "__q", "__p", ("__other", "__own"))
    return left.join(right, place).select(*keys, *columns, *fields)


def point_values(found: DataFrame, corners: DataFrame, values: DataFrame, fields: list[str], probe: list[str], keys=("t",), whole: bool = True) -> DataFrame:
    """(keys.., probe, fields): values(keys.., point, fields) interpolated between the corners of each probe's cell.

    probe names the columns that tell probes apart. A probe with a corner that has no value is null. Without whole such a corner adds nothing, and
    a probe has rows only where all eight corners are there. A cell's corners are gathered first, so a row of the result is made by one row of cell_values().
    """
    at = {n: F.col(n) for n in "rsq"}
    share = [F.lit(1.0)] * 8
    for c, offsets in enumerate(HEXAHEDRON):
        for n, o in zip("rsq", offsets):
            share[c] = share[c] * (at[n] if o else 1 - at[n])
    placed = found.where("cell IS NOT NULL").select(*probe, "cell", F.array(*share).alias("__share"))
    mesh = corners.where("kind = 'hexahedron'").select("cell", "corner", "point").distinct()
    gathered = [F.array(*[F.max(F.when(F.col("corner") == c, F.col(f).cast("double"))) for c in range(8)]).alias(f"__at_{f}") for f in fields]
    held = mesh.join(values.select(*keys, "point", *fields), "point").groupBy(*keys, "cell").agg(F.count("*").alias("__n"), *[F.count(f).alias(f"__n_{f}") for f in fields], *gathered)
    if not whole:
        held = held.where("__n = 8")
    met = cell_values(placed, held, ["__n", *[f"__{n}_{f}" for f in fields for n in ("n", "at")]], keys)
    part = lambda f, c: F.coalesce(F.get("__share", F.lit(c)) * F.get(f"__at_{f}", F.lit(c)), F.lit(0.0))
    total = lambda f: sum((part(f, c) for c in range(1, 8)), part(f, 0))
    least = 8 if whole else 1
    return met.select(*keys, *probe, *[F.when(F.col(f"__n_{f}") >= least, total(f)).alias(f) for f in fields])


def nearest(points: DataFrame, sites: DataFrame, size: float, site: str = "site") -> DataFrame:
    """points(point, x, y, z) with the nearest of sites(site, x, y, z) and dist: the smaller site of equally near ones; null without sites.

    Both fall into cubes of `size`, about the distance of neighbouring sites, and a point meets the sites of its own cube and of those around it. A site within a
    cube's width is the nearest there is; points that have none so near go on with cubes of twice the width, so rounds are
    as many as the logarithm of the farthest distance and what goes on is what lies far from every site.
    """
    place = lambda df, name: df.select(name, *[F.col(a).cast("double").alias(a) for a in "xyz"])
    left, there = kept(place(points, "point")), kept(place(sites, site).withColumnsRenamed({a: f"s{a}" for a in "xyz"}))
    steps = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{a}") for a, o in zip("xyz", c)]) for c in itertools.product((-1, 0, 1), repeat=3)])).alias("o")
    found, some = None, there.limit(1).count() > 0
    while True:
        cube = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        asked = left.select("point", "x", "y", "z", steps).select("point", "x", "y", "z", *[(cube(a) + F.col(f"o.o{a}")).alias(f"b{a}") for a in "xyz"])
        met = asked.join(there.select("*", *[cube(f"s{a}").alias(f"b{a}") for a in "xyz"]), ["bx", "by", "bz"])
        away = F.sqrt(sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in "yz"), (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx"))))
        best = met.groupBy("point").agg(F.min(F.struct(away.alias("dist"), F.col(site).alias(site))).alias("b")).select("point", "b.*")
        best = kept(best.where(F.col("dist") <= size).select("point", site, "dist"))
        found = best if found is None else found.union(best)
        left = kept(left.join(best.select("point"), "point", "left_anti"))
        if not some or not left.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").limit(1).count():
            return points.join(found, "point", "left")
        size *= 2
