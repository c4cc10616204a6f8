"""Weighted statistics per layer: exact means, deviations and interpolated percentiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, kept

MOMENTS = ("mean", "std", "min", "max")
PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
ALL_STATS = (*MOMENTS, *PERCENTILES)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value carry no weight; no weight at all gives null."""
    w = F.sum(F.when(value.isNotNull(), weight))
    return F.when(w != 0, F.sum(weight * value) / w)


#: Rows over which a group's percentiles are cut into ranges of values before anything is sorted, and how many ranges.
LARGE_GROUP, RANGES = 1_000_000, 64
#: Rows of cuts that are broadcast; more are dealt with the rows over SALTS tasks a group.
SMALL_TABLE, SALTS = 50_000, 64


def weighted_stats(df: DataFrame, keys: list[str], value: str, weight: str, stats=ALL_STATS, tie: list[str] | None = None, large: int = LARGE_GROUP, skip_nulls: bool = True) -> DataFrame:
    """One row per group with the asked statistics of value, weighted.

    Means, extremes and the population deviation in its two-pass form are partial sums, joined back by group: rows
    never meet by group. A percentile interpolates between cumulative midpoint weights (cumw - w / 2) / W and is the
    first or last value beyond them; only the windows that the asked statistics need are planned. Where a group has more than
    `large` rows, only ranges of values that hold a percentile are ordered, cut again until they are no more. tie orders equal values, for exact repeatability.

    Rows without a value do not take part. With skip_nulls off they count with their weight, above all values: a group without any value
    has a row of nulls, and a percentile beyond the last value is that value. Rows without a weight never take part.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), F.col(weight).cast("double").alias("__w"), *[F.col(c).alias(f"__t{n}") for n, c in enumerate(tie or [])])
    rows = rows.where("__w IS NOT NULL")
    valued = rows.where("__v IS NOT NULL")
    rows = valued if skip_nulls else rows
    v, w = F.col("__v"), F.col("__w")
    plain = {"mean": F.sum(w * v) / F.sum(w), "min": F.min(v), "max": F.max(v)}
    first = rows.groupBy(*keys).agg(F.sum(w).alias("__total"), plain["mean"].alias("__mean"), F.count(v).alias("__n"), *[plain[s].alias(s) for s in stats if s in plain])
    out = first
    if "std" in stats:
        away = v - F.col("__mean")
        means = first.select(*keys, "__mean")
        spread = _by(rows, means, keys).groupBy(*keys).agg(F.sqrt(F.sum(w * away * away) / F.sum(w)).alias("std"))
        out = _by(out, spread, keys)
    asked = [s for s in stats if s in PERCENTILES]
    if asked:
        split = first.where(F.col("__n") > large).limit(1).count() > 0
        given = (first.select(*keys, "__total"), keys, asked, len(tie or []))
        if split:
            big = kept(first.where(F.col("__n") > large).select(*keys))
            found = _split_percentiles(_meet(valued, big, keys), *given, large).unionByName(_percentiles(_meet(valued, big, keys, "left_anti"), *given, own=skip_nulls))
        else:
            found = _percentiles(valued, *given, own=skip_nulls)
        out = _by(out, found, keys, "inner" if skip_nulls else "left")
    return out.select(*keys, *stats)


def _by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys, of which any may be null."""
    names = [F.col(k).alias(f"__k_{k}") for k in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(right.select(*names, *[c for c in right.columns if c not in keys]), same, how).drop(*[f"__k_{k}" for k in keys])


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """_by() for rows of few large groups: rows never meet by group. table, computed before, has few rows a group and is broadcast if it is small."""
    if table.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        table, salt = F.broadcast(table), []
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), *[c for c in rows.columns if c[:3] in ("__v", "__w", "__t")]), F.lit(SALTS)))
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        salt = ["__salt"]
    names = {k: f"__k_{k}" for k in [*keys, *salt]}
    same = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return rows.join(table.withColumnsRenamed(names), same, how).drop(*names.values(), *salt)


def _percentiles(rows: DataFrame, totals: DataFrame, keys: list[str], asked: list[str], ties: int, before: bool = False, own: bool = True) -> DataFrame:
    """Percentiles of each group's rows in the order of their values; before: rows have __before, the weight of all rows of lower ranges.

    A group's weight is that of its own rows here, or with own off, and before, that in totals. A row of weight None keeps its place in the order for its own midpoint __p alone.
    """
    order = [F.col("__v"), *[F.col(f"__t{n}") for n in range(ties)]]
    group = Window.partitionBy(*keys)
    ranked = group.orderBy(*order)
    if before:
        part = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        running = F.col("__before") + F.sum("__w").over(part)
        rows = _by(rows, totals, keys)
        p = F.coalesce(F.col("__at"), running - F.col("__w") / 2) / F.col("__total")
    else:
        rows = rows if own else _by(rows, totals, keys)
        p = (F.sum("__w").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w") / 2) / (F.sum("__w").over(group) if own else F.col("__total"))
    rows = rows.withColumn("__p", p)
    ranked = group.orderBy("__p", *order) if before else ranked
    rows = rows.withColumn("__p0", F.lag("__p").over(ranked)).withColumn("__v0", F.lag("__v").over(ranked))
    return rows.groupBy(*keys).agg(*[_percentile(F.col("__v"), PERCENTILES[s]).alias(s) for s in asked])


def _split_percentiles(rows: DataFrame, totals: DataFrame, keys: list[str], asked: list[str], ties: int, large: int) -> DataFrame:
    """The same percentiles where groups are large: weights are summed by RANGES ranges of values, which partial aggregates find.

    Of a group only the ranges that hold a percentile, the next and the one below are kept; while more than `large` rows of a group are, they are cut into
    ranges again, so what is put in order at the end does not follow the group. A range of one value, however
    many rows have it, is its first and last row by tie: between their midpoints every percentile is that value.
    """
    v, w = F.col("__v"), F.col("__w")
    tie = F.struct(*[F.col(f"__t{n}") for n in range(ties)], F.col("__w"))
    rows, flats, most = rows.withColumns({"__range": F.lit(0).cast("long"), "__base": F.lit(0.0)}), None, None
    while True:
        inner = [*keys, "__range"]
        cuts = kept(rows.groupBy(*inner).agg(F.percentile_approx("__v", [n / RANGES for n in range(1, RANGES)], 10_000).alias("__cuts")))
        # A value that is a cut has a range of its own, so a common value never shares its range with others.
        place = F.size(F.filter("__cuts", lambda c: c < v)) * 2 + F.array_contains("__cuts", v).cast("int")
        ranged = _meet(rows, cuts, inner).withColumn("__parent", F.col("__range")).withColumn("__range", F.col("__range") * (2 * RANGES) + place).drop("__cuts")
        # Only aggregates whose buffers are plain numbers, so that partial sums are hashed: an aggregate over a struct would sort every row.
        sums = ranged.groupBy(*keys, "__parent", "__range").agg(
            F.sum(w).alias("__s"), F.min(v).alias("__low"), F.max(v).alias("__high"), F.count("*").alias("__m"), F.max("__base").alias("__base")
        )
        within, upto = Window.partitionBy(*keys, "__parent").orderBy("__range"), Window.partitionBy(*keys).orderBy("__range")
        before = F.col("__base") + F.sum("__s").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")
        sums = _by(sums.withColumn("__before", before), totals, keys)
        # The row sought is in the first range that reaches the percentile's weight, or first in the next; the row before it may be in the last range below.
        hit = F.lit(False)
        for s in asked:
            sums = sums.withColumn(f"__is_{s}", F.col("__before") + F.col("__s") >= PERCENTILES[s] * F.col("__total"))
        for s in asked:
            reached = F.col(f"__is_{s}")
            sums = sums.withColumn(f"__at_{s}", reached & ~F.coalesce(F.lag(reached).over(upto), F.lit(False))).withColumn(f"__under_{s}", ~reached & F.coalesce(F.lead(reached).over(upto), F.lit(True)))
        for s in asked:
            sums = sums.withColumn(f"__next_{s}", F.coalesce(F.lag(f"__at_{s}").over(upto), F.lit(False)))
            hit = hit | F.col(f"__at_{s}") | F.col(f"__under_{s}") | F.col(f"__next_{s}")
        needed = kept(sums.where(hit).select(*keys, F.col("__parent").alias("__range"), F.col("__range").alias("__place"), "__before", "__s", "__low", "__high", "__m"))
        flat = F.col("__low") == F.col("__high")
        # Ranges do not overlap, so a row's range follows from the ends of those that are needed.
        held = lambda part, *more: _meet(rows.drop("__base"), part, inner).where(v.between(F.col("__low"), F.col("__high"))).select(*keys, "__v", "__w", *[f"__t{n}" for n in range(ties)], F.col("__place").alias("__range"), "__before", *more)  # noqa: B023, E731
        edges = held(needed.where(flat), "__s").groupBy(*inner, "__before", "__s", "__v").agg(F.min_by(w, tie).alias("__wf"), F.max_by(w, tie).alias("__wl"))
        ends = edges.select(
            *keys, "__range", "__before", "__v", F.lit(None).cast("double").alias("__w"),
            F.explode(F.array_distinct(F.array(F.col("__before") + F.col("__wf") / 2, F.col("__before") + F.col("__s") - F.col("__wl") / 2))).alias("__at"),
        )
        flats = ends if flats is None else flats.union(ends)
        rest = held(needed.where(~flat))
        size = needed.where(~flat).groupBy(*keys).agg(F.sum("__m").alias("n")).agg(F.max("n")).first()[0] or 0
        if size <= large or size == most:
            break
        most, rows = size, kept(rest.withColumnRenamed("__before", "__base"))
    rest = rest.withColumn("__at", F.lit(None).cast("double"))
    return _percentiles(rest.unionByName(flats, allowMissingColumns=True), totals, keys, asked, ties, before=True)


def _percentile(v: Column, q: float) -> Column:
    p, p0, v0 = F.col("__p"), F.col("__p0"), F.col("__v0")
    here = F.when(p0.isNull(), v).otherwise(v0 + (q - p0) / (p - p0) * (v - v0))
    first = F.min_by(F.when(p >= q, here), F.when(p >= q, p))
    return F.coalesce(first, F.max_by(v, p))


def unpivot(df: DataFrame, keys: list[str], variables: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Long form: one row per key and variable, so that all variables share one shuffle."""
    return df.unpivot(keys, variables, name, value)


def depth_layer(depth: Column, levels: list[float] | None = None, k: str = "k") -> Column:
    """Layer number: the index axis itself, or the first user level that is deeper; deeper cells join the last layer."""
    if not levels:
        return F.col(k)
    layer = F.when(F.lit(False), F.lit(0))
    for n, level in enumerate(levels):
        layer = layer.when(depth < F.lit(float(level)), F.lit(n))
    return layer.otherwise(F.lit(len(levels) - 1)).cast("long")


def unique_levels(df: DataFrame, tolerance: float, depth: str = "depth") -> DataFrame:
    """(layer, level): the depths that stand for all others, from the shallowest down: each is the first that is tolerance or more under the one before.

    Rows count by their depths alone, so their order does not matter; where a reader meets depths in order, these are the levels that it
    sees first. Distinct depths fall into bins of the tolerance, and bins into runs by links between neighbours, so runs are found by joins. A run
    narrower than the tolerance is one level; within a longer one jumps are made over its distinct depths, in one task a run.
    """
    depths = kept(df.select(F.col(depth).cast("double").alias("d")).where("d IS NOT NULL AND NOT isnan(d)").distinct().withColumn("bin", F.floor(F.col("d") / tolerance)))
    bins = kept(depths.groupBy("bin").agg(F.min("d").alias("low"), F.max("d").alias("high")))
    after = bins.select((F.col("bin") - 1).alias("bin"), F.col("low").alias("next"))
    links = bins.join(after, "bin").where(F.col("next") - F.col("high") < tolerance).select(F.col("bin").alias("a"), (F.col("bin") + 1).alias("b"))
    runs = bins.join(components(links).withColumnRenamed("node", "bin"), "bin", "left").withColumn("run", F.coalesce("component", "bin")).drop("component")
    wide = kept(runs.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high")))

    def jumps(run: pd.DataFrame) -> pd.DataFrame:
        found, rest = [], np.sort(run["d"].to_numpy())
        while len(rest):
            found.append(rest[0])
            rest = rest[np.searchsorted(rest - rest[0], tolerance) :]
        return pd.DataFrame({"level": found})

    long = wide.where(F.col("high") - F.col("low") >= tolerance).select("run")
    inner = depths.join(runs.select("bin", "run"), "bin").join(long, "run", "left_semi").groupBy("run").applyInPandas(jumps, "level double")
    levels = wide.where(F.col("high") - F.col("low") < tolerance).select(F.col("low").alias("level")).union(inner)
    return levels.select((F.row_number().over(Window.orderBy("level")) - 1).cast("long").alias("layer"), "level")


def with_levels(df: DataFrame, levels: DataFrame, tolerance: float, depth: str = "depth") -> DataFrame:
    """df with the layer and level (of unique_levels) less than tolerance away, the deeper one of two; null without any."""
    bins = F.explode(F.sequence(F.floor(F.col("level") / tolerance) - 1, F.floor(F.col("level") / tolerance) + 1))
    near = levels.select(F.col("layer").alias("__layer"), F.col("level").alias("__level"), bins.alias("__bin"))
    depths = df.select(F.col(depth).cast("double").alias("__d")).distinct().withColumn("__bin", F.floor(F.col("__d") / tolerance))
    met = depths.join(near, "__bin").where(F.abs(F.col("__d") - F.col("__level")) < tolerance)
    best = met.groupBy("__d").agg(F.max(F.struct(F.col("__layer").alias("layer"), F.col("__level").alias("level"))).alias("__best"))
    return df.join(best, F.col(depth).cast("double") == F.col("__d"), "left").select(*df.columns, "__best.layer", "__best.level")


def spatial_stats(cells: DataFrame, variables: list[str], stats=ALL_STATS, use_volume: bool = False, depth_levels: list[float] | None = None, tolerance: float | None = None, skip_nulls: bool = True) -> DataFrame:
    """(t, layer, variable) with the statistics over the layer's cells, weighted by area or volume; with a tolerance, layers are the unique levels of depth. skip_nulls: see weighted_stats."""
    weight = F.col("e1t") * F.col("e2t") * (F.col("e3t") if use_volume else F.lit(1.0))
    if tolerance is not None:
        cells = with_levels(cells, unique_levels(cells, tolerance), tolerance).withColumnRenamed("k", "__k").withColumn("k", F.col("layer"))
    base = cells.select("t", depth_layer(F.col("depth"), depth_levels).alias("layer"), weight.alias("w"), "k", "j", "i", *variables)
    rows = unpivot(base, ["t", "layer", "w", "k", "j", "i"], variables)
    return weighted_stats(rows, ["t", "layer", "variable"], "value", "w", stats, ["k", "j", "i"], skip_nulls=skip_nulls)


def stats_to_cells(cells: DataFrame, table: DataFrame, variable: str, stats=ALL_STATS, depth_levels: list[float] | None = None) -> DataFrame:
    """Cells with a column "<variable>, <stat>" of their layer's value each."""
    own = table.where(F.col("variable") == variable).select("t", "layer", *[F.col(s).alias(f"{variable}, {s}") for s in stats])
    return cells.withColumn("layer", depth_layer(F.col("depth"), depth_levels)).join(own, ["t", "layer"], "left")


def stats_from_profile(cells: DataFrame, profile: DataFrame, stats=ALL_STATS, per_coast: bool = False, basins: int = 16, open_sea: int = 2) -> DataFrame:
    """Cells with columns from profile(t, basin, coast, k, stat, value): their first basin's, 0 without one and null where its value is.

    Without per_coast the profile of the open sea and all is used; land (coast 0) counts as no coast.
    """
    first = F.coalesce(*[F.when(F.col("basins").bitwiseAND(F.lit(1 << n)) != 0, F.lit(n)) for n in range(basins)])
    coast = F.col("coast") if per_coast else F.lit(open_sea)
    wide = profile.groupBy("t", "basin", "coast", "k").pivot("stat", list(stats)).agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("rows"))
    wide = wide.select("t", "k", F.col("basin").alias("__b"), F.col("coast").alias("__c"), *[c for s in stats for c in (F.col(f"{s}_value").alias(s), F.col(f"{s}_rows").alias(f"__{s}"))])
    keyed = cells.withColumn("__b", first.cast("int")).withColumn("__c", coast.cast("int"))
    joined = keyed.join(wide.withColumn("__b", F.col("__b").cast("int")).withColumn("__c", F.col("__c").cast("int")), ["t", "k", "__b", "__c"], "left")
    return joined.select(*cells.columns, *[F.when(F.col(f"__{s}") > 0, F.col(s)).otherwise(0.0).alias(s) for s in stats])


def profile_of(cells: DataFrame, variable: str, basins: int = 16, stats=ALL_STATS, skip_nulls: bool = True) -> DataFrame:
    """(t, basin, coast, k, stat, value): the layer statistics of each basin and coast, as they are kept in files. skip_nulls: see weighted_stats."""
    inside = F.filter(F.array(*[F.when(F.col("basins").bitwiseAND(F.lit(1 << n)) != 0, F.lit(n)) for n in range(basins)]), lambda x: x.isNotNull())
    rows = cells.select("t", F.explode(inside).alias("basin"), "coast", "k", (F.col("e1t") * F.col("e2t")).alias("w"), F.col(variable).alias("value"), "j", "i")
    wide = weighted_stats(rows, ["t", "basin", "coast", "k"], "value", "w", stats, ["j", "i"], skip_nulls=skip_nulls)
    return wide.unpivot(["t", "basin", "coast", "k"], list(stats), "stat", "value")


def vertical_mean(cells: DataFrame, variable: str, keys=("t", "j", "i"), weight: str = "e3t") -> DataFrame:
    return cells.groupBy(*keys).agg(weighted_mean(F.col(variable), F.col(weight)).alias(variable))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(w, mean, m2) of groups from those of their parts, exactly: deviations are taken from the joint mean."""
    joint = Window.partitionBy(*keys)
    mean = F.sum(F.col("w") * F.col("mean")).over(joint) / F.sum("w").over(joint)
    moved = parts.withColumn("__m", mean)
    away = F.col("mean") - F.col("__m")
    return moved.groupBy(*keys).agg(F.sum("w").alias("w"), F.first("__m").alias("mean"), F.sum(F.col("m2") + F.col("w") * away * away).alias("m2"))


def moving_average(df: DataFrame, value: str, order: str, keys=(), span: int = 5, name: str | None = None) -> DataFrame:
    """Mean over an odd span that shrinks at the ends, keeping its centre.

    keys should bound the series: a series is one window partition.
    """
    half = span // 2
    part = Window.partitionBy(*keys)
    run = part.orderBy(order)
    wide = [F.avg(value).over(run.rowsBetween(-h, h)) for h in range(half + 1)]
    place, total = F.row_number().over(run), F.count(F.lit(1)).over(part)
    reach = F.least(F.lit(half), place - 1, total - place)
    out = wide[half]
    for h in range(half):
        out = F.when(reach == h, wide[h]).otherwise(out)
    return df.withColumn(name or f"{value}_smooth", out)
