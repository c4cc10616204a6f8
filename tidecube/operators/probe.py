"""Probes: points and lines, nearest cells, depth profiles, depth-time tables and point series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projection import project
from . import locate as locate_any
from .axis import numbered, ranged
from .stats import weighted_mean

#: Rows that an axis table may have to be broadcast.
AXIS_LIMIT = 100_000


def point_source(spark: SparkSession, lon: float, lat: float, depth: float = 0.0, number: int = 1, radius: float = 0.0, projection: str = "degrees", seed: int = 0, shell: bool = False) -> DataFrame:
    """(pid, x, y, z): a point, or `number` points evenly filling a ball around it, or with shell its surface."""
    x, y = project(projection, F.lit(float(lon)), F.lit(float(lat)))
    base = spark.range(number).select(F.col("id").alias("pid"))
    cosine, turn = 2 * F.rand(seed) - 1, 2 * 3.141592653589793 * F.rand(seed + 1)
    reach = F.lit(float(radius)) if shell else radius * F.cbrt(F.rand(seed + 2))
    flat = F.sqrt(1 - cosine * cosine)
    return base.select("pid", (x + reach * flat * F.cos(turn)).alias("x"), (y + reach * flat * F.sin(turn)).alias("y"), (F.lit(-float(depth)) + reach * cosine).alias("z"))


def depth_line(spark: SparkSession, lon: float, lat: float, depth_range=(0.0, 0.0), resolution: int = 1000, projection: str = "degrees") -> DataFrame:
    """(pid, x, y, depth): resolution + 1 evenly spaced points between two depths, both positive down."""
    x, y = project(projection, F.lit(float(lon)), F.lit(float(lat)))
    top, bottom = map(float, depth_range)
    step = (bottom - top) / max(resolution, 1)
    return spark.range(resolution + 1).select(F.col("id").alias("pid"), x.alias("x"), y.alias("y"), (F.lit(top) + F.col("id") * step).alias("depth"))


def broken_line(corners: DataFrame, resolution: int = 1000, keys=("line",)) -> DataFrame:
    """(keys.., pid, x, y, depth, along): lines through corners(keys.., place, x, y, depth), resolution points to each segment and the last corner.

    place counts a line's corners from 0. Points are evenly spaced within their segment; along is the distance from the line's beginning.
    A corner meets the next by an equi-join, so lines are as many as one likes; only a line's own corners are put in order for the distance.
    A line of one corner is refused by no error: it is that point.
    """
    keys, axes, step = list(keys), ("x", "y", "depth"), max(int(resolution), 1)
    after = corners.select(*keys, (F.col("place") - 1).alias("place"), *[F.col(a).cast("double").alias(f"__{a}") for a in axes])
    segments = corners.select(*keys, "place", *[F.col(a).cast("double").alias(a) for a in axes]).join(after, [*keys, "place"], "left")
    size = F.sqrt(sum(((F.col(f"__{a}") - F.col(a)) * (F.col(f"__{a}") - F.col(a)) for a in axes[1:]), (F.col("__x") - F.col("x")) * (F.col("__x") - F.col("x"))))
    before = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("__size", size).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0.0)))
    points = segments.withColumn("n", F.explode(F.sequence(F.lit(0), F.when(F.col("__size").isNull(), 0).otherwise(step - 1))))
    part = F.col("n") / step
    spots = [(F.col(a) + F.when(F.col("n") > 0, part * (F.col(f"__{a}") - F.col(a))).otherwise(0.0)).alias(a) for a in axes]
    along = F.col("__before") + F.when(F.col("n") > 0, part * F.col("__size")).otherwise(0.0)
    return points.select(*keys, (F.col("place") * step + F.col("n")).cast("long").alias("pid"), *spots, along.alias("along"))


def axis_from_centres(cells: DataFrame, index: str, centre: str) -> DataFrame:
    """(index, lo, hi): a cell reaches half way to its neighbours; at the ends as far as on the other side."""
    one = cells.select(index, F.col(centre).cast("double").alias("c")).distinct()
    near = one.select((F.col(index) + 1).alias(index), F.col("c").alias("before")), one.select((F.col(index) - 1).alias(index), F.col("c").alias("after"))
    met = one.join(near[0], index, "left").join(near[1], index, "left")
    half_lo = F.coalesce((F.col("c") - F.col("before")) / 2, (F.col("after") - F.col("c")) / 2, F.lit(0.5))
    half_hi = F.coalesce((F.col("after") - F.col("c")) / 2, (F.col("c") - F.col("before")) / 2, F.lit(0.5))
    return met.select(index, (F.col("c") - half_lo).alias("lo"), (F.col("c") + half_hi).alias("hi"))


def _locate(probes: DataFrame, axis: DataFrame, index: str, value: str, tolerance: float) -> DataFrame:
    """probes with the index whose cell holds value; the lower of two; axis tables are small, which is checked."""
    if axis.limit(AXIS_LIMIT + 1).count() > AXIS_LIMIT:
        raise ValueError(f"axis {index} has more than {AXIS_LIMIT} cells")
    before = F.lag("hi").over(Window.orderBy(index))
    a = axis.select(F.col(index).alias(f"__{index}"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), before.alias("__before"))
    v = F.col(value)
    # A cell counts if the one before it does not hold the value too, so a probe meets one cell and stays one row.
    own = (v >= F.col("__lo") - tolerance) & (v <= F.col("__hi") + tolerance) & (F.col("__before").isNull() | (v > F.col("__before") + tolerance))
    return probes.join(F.broadcast(a), own, "left").select(*probes.columns, F.col(f"__{index}").alias(index))


def locate(probes: DataFrame, axes: dict[str, DataFrame], tolerance: float = 0.0, coordinates=(("i", "x"), ("j", "y"), ("k", "depth"))) -> DataFrame:
    """probes with the (i, j, k) of the cell they are in; null outside the grid."""
    out = probes
    for index, value in coordinates:
        if index in axes:
            out = _locate(out, axes[index], index, value, tolerance)
    return out


def grid_axes(cells: DataFrame) -> dict[str, DataFrame]:
    """The three axis tables of a grid, found in one pass; an axis has at most AXIS_LIMIT cells, which is checked."""
    pairs = [F.struct(F.lit(n).alias("axis"), F.col(n).cast("long").alias("at"), F.col(c).cast("double").alias("c")) for n, c in (("i", "x"), ("j", "y"), ("k", "depth"))]
    found = cells.select(F.explode(F.array(*pairs)).alias("a")).select("a.*").distinct().limit(3 * AXIS_LIMIT + 1).collect()
    if len(found) > 3 * AXIS_LIMIT:
        raise ValueError(f"the grid's axes have more than {AXIS_LIMIT} cells")
    out = {}
    for name in "ijk":
        centres = dict(sorted((r["at"], r["c"]) for r in found if r["axis"] == name))
        rows = []
        for at, c in centres.items():
            before, after = (centres.get(at - 1), centres.get(at + 1))
            down = (c - before) / 2 if before is not None else (after - c) / 2 if after is not None else 0.5
            up = (after - c) / 2 if after is not None else down
            rows.append((at, c - down, c + up))
        out[name] = cells.sparkSession.createDataFrame(rows, f"{name} long, lo double, hi double")
    return out


def depth_profile(cells: DataFrame, probes: DataFrame, variables: list[str], tolerance: float = 0.0, axes: dict[str, DataFrame] | None = None) -> DataFrame:
    """probes at each step with the values of their cells; probes outside have none."""
    found = locate(probes, axes or grid_axes(cells), tolerance)
    values = cells.select("t", "k", "j", "i", *variables)
    return found.join(values, ["i", "j", "k"]).select("t", *probes.columns, *variables)


def _every(found: DataFrame, times: DataFrame) -> DataFrame:
    """Each located point at each time; the smaller side is broadcast, which is the points, if they are as few as an axis may have."""
    if found.limit(AXIS_LIMIT + 1).count() > AXIS_LIMIT:
        raise ValueError(f"more than {AXIS_LIMIT} points")
    return times.select("t").distinct().crossJoin(F.broadcast(found))


def hovmoeller(cells: DataFrame, probes: DataFrame, variable: str, axes: dict[str, DataFrame] | None = None, steps: DataFrame | None = None, missing: float = 0.0) -> DataFrame:
    """(pid, depth, t, value): a row for each point of the line and chosen step; missing where the line leaves the grid.

    Points are few (AXIS_LIMIT, which is checked); their cells are picked out of the grid before steps and points meet, so a
    grid of any size is read once for its times and once for the cells on the line.
    """
    found = locate(probes, axes or grid_axes(cells))
    chosen = cells if steps is None else cells.join(steps.select("t"), "t", "left_semi")
    on_line = F.broadcast(found.select("i", "j", "k").distinct())
    values = chosen.select("t", "i", "j", "k", F.col(variable).alias("value")).join(on_line, ["i", "j", "k"], "left_semi")
    grid = _every(found, chosen if steps is None else steps)
    return grid.join(values, ["t", "i", "j", "k"], "left").select("pid", "depth", "t", F.coalesce("value", F.lit(missing)).alias("value"))


def hovmoeller_from_profile(profile: DataFrame, probes: DataFrame, axis_z: DataFrame, basin: int, coast: int = 2, stat: str = "mean", missing: float = 0.0) -> DataFrame:
    """The same table from kept profiles(t, basin, coast, k, stat, value): every point at every instant of the profiles, missing where a level has none."""
    found = locate(probes, {"k": axis_z})
    kept = profile.where((F.col("basin") == basin) & (F.col("coast") == coast) & (F.col("stat") == stat)).select("t", "k", "value")
    return _every(found, profile).join(kept, ["t", "k"], "left").select("pid", "depth", "t", F.coalesce("value", F.lit(missing)).alias("value"))


def wide_by_time(long: DataFrame, keys=("depth",), time: str = "t", value: str = "value", instants: list | None = None) -> DataFrame:
    """One column per instant; give the instants to spare the pass that finds them."""
    grouped = long.groupBy(*keys)
    return (grouped.pivot(time, instants) if instants else grouped.pivot(time)).agg(F.first(value))


def spaghetti(cells: DataFrame, probe: DataFrame, variable: str, axes: dict[str, DataFrame] | None = None) -> DataFrame:
    """(pid, t, value): the series of each point's cell."""
    return depth_profile(cells, probe, [variable], axes=axes).select("pid", "t", F.col(variable).alias("value"))


def spaghetti_depth_mean(cells: DataFrame, line: DataFrame, variable: str, weight: str = "e3t", axes: dict[str, DataFrame] | None = None) -> DataFrame:
    """(t, value): the thickness-weighted mean over the cells that a line goes through, each once."""
    found = locate(line, axes or grid_axes(cells)).select("i", "j", "k").distinct()
    return cells.join(found, ["i", "j", "k"], "left_semi").groupBy("t").agg(weighted_mean(F.col(variable), F.col(weight)).alias("value"))


def scatter(grid: DataFrame, subset: DataFrame, variables: list[str], keys=("t", "k", "j", "i"), missing: float = 1e20) -> DataFrame:
    """The whole grid's keys with the subset's values, missing elsewhere; a null of the subset stays null."""
    joined = grid.select(*keys).join(subset.select(*keys, *variables, F.lit(True).alias("__found")), list(keys), "left")
    return joined.select(*keys, *[F.when(F.col("__found"), F.col(v)).otherwise(F.lit(missing)).alias(v) for v in variables])


def scatter_by_position(grid: DataFrame, subset: DataFrame, variables: list[str], spacing: float, keys=("t", "k", "j", "i"), position=("x", "y", "z")) -> DataFrame:
    """The whole grid's keys with the values of the subset's nearest cell at the same step, for a subset that has places but no keys.

    spacing is about the distance of neighbouring cells, by which the search begins. Places of the grid are looked up once whatever the number of steps; the subset must
    hold the same places at each step. Cells at one place take the values of one of them.
    """
    at = [F.col(p).cast("double").alias(a) for p, a in zip(position, "xyz")]
    name = lambda df: df.select(*at).distinct().withColumn("site", F.struct("x", "y", "z"))
    met = locate_any.nearest(name(grid).withColumnRenamed("site", "point"), name(subset), spacing)
    values = subset.select("t", F.struct(*at).alias("site"), *variables).groupBy("t", "site").agg(*[F.first(v).alias(v) for v in variables])
    own = grid.select(*keys, F.struct(*at).alias("point")).join(met.select("point", "site"), "point", "left")
    return own.join(values, ["t", "site"], "left").select(*keys, *variables)


def tail_range(df: DataFrame, start: int, end: int, time: str = "t") -> DataFrame:
    """Rows of the steps numbered [start, end) in time order."""
    steps = numbered(ranged(df.select(time).distinct(), time), time, "__n")
    return df.join(steps.where((F.col("__n") >= start) & (F.col("__n") < end)).select(time), time, "left_semi")


