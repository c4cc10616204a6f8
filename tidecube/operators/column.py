"""Water-column diagnostics: everything of a column (t, j, i) meets in one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import coriolis
from .graph import components, kept

COLUMN = ("t", "j", "i")


def columns_by_position(cells: DataFrame, tolerance: float, x: str = "x", y: str = "y") -> DataFrame:
    """cells with col_x and col_y, the place of the water column that each belongs to, for rows that no (j, i) tells apart.

    Places no more than tolerance apart are one column, and so are those that a chain of such places joins; it is named by its smallest place.
    Distinct places fall into square bins whose diagonal is the tolerance, so those of a bin are one column at sight; places of bins that are near enough meet by an
    equi-join and are measured, and links are joined by contraction. A bin's places are the levels and steps of one column whose places differ.
    """
    side = tolerance / 2**0.5
    place = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("p")
    places = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(place).distinct()
    places = kept(places.withColumns({f"b{a}": F.floor(F.col(f"p.{a}") / side) for a in "xy"}))
    firsts = places.groupBy("bx", "by").agg(F.min("p").alias("a"))
    own = places.join(firsts, ["bx", "by"]).select("a", F.col("p").alias("b"))
    near = [(m, n) for m in range(3) for n in range(-2, 3) if (m, n) > (0, 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in near])).alias("o")
    asked = places.select(F.col("p").alias("a"), "bx", "by", steps).select("a", (F.col("bx") + F.col("o.m")).alias("bx"), (F.col("by") + F.col("o.n")).alias("by"))
    away = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    across = asked.join(places.select("bx", "by", F.col("p").alias("b")), ["bx", "by"]).where(away <= tolerance).select("a", "b")
    homes = components(own.union(across))
    homes = places.join(homes, F.col("p") == F.col("node"), "left").select("p.x", "p.y", F.coalesce("component", "p").alias("home"))
    homes = homes.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("home.x").alias("col_x"), F.col("home.y").alias("col_y"))
    met = cells.join(homes, (F.col(x).cast("double") == F.col("__x")) & (F.col(y).cast("double") == F.col("__y")), "left")
    return met.drop("__x", "__y")


def mixed_layer_depth(cells: DataFrame, d_t: float = 0.2, use_density: bool = False, d_rho: float = 0.03, zref: float = 10.0, mask_field: str = "coast", temp: str = "temp", rho: str = "rho", first_crossing: bool = False, by=COLUMN) -> DataFrame:
    """cells with mld_k, mld (depth of that level) and mld_mask (1 above it).

    The reference level is the one nearest to zref, the upper of two as near. The layer ends at the last sea level
    whose value is within the threshold of the reference's; with first_crossing, at the last one before the first that is not. Without any it is
    the reference level. `by` tells columns apart: those of columns_by_position() for cells without indices.
    """
    value, limit = (rho, d_rho) if use_density else (temp, d_t)
    column = Window.partitionBy(*by)
    at = F.struct(F.abs(F.col("depth") - zref).alias("away"), F.col("k").alias("k"), F.col(value).alias("v"))
    out = cells.withColumn("__ref", F.min(at).over(column))
    near = (F.col(mask_field) > 0) & (F.abs(F.col(value) - F.col("__ref.v")) < limit)
    if first_crossing:
        far = F.min(F.when((F.col(mask_field) > 0) & ~near & (F.col("k") > F.col("__ref.k")), F.col("k"))).over(column)
        out = out.withColumn("__far", far)
        near = near & (F.col("__far").isNull() | (F.col("k") < F.col("__far")))
    last = F.max(F.when(near, F.struct(F.col("k").alias("k"), F.col("depth").alias("d")))).over(column)
    own = F.max(F.when(F.col("k") == F.col("__ref.k"), F.struct(F.col("k").alias("k"), F.col("depth").alias("d")))).over(column)
    out = out.withColumn("__end", F.coalesce(last, own))
    out = out.withColumns({"mld_k": F.col("__end.k"), "mld": F.col("__end.d"), "mld_mask": (F.col("k") < F.col("__end.k")).cast("int")})
    return out.drop("__ref", "__end", "__far")


def rossby_radius(cells: DataFrame, g: float = 9.81, f_cor_ct: float = 1e-4, use_constant: bool = True, lat: str = "lat", mask_field: str = "coast", rho: str = "rho", by=COLUMN) -> DataFrame:
    """cells (with mld and mld_mask) with r_ext and r_int in km; null over land, r_int null without a mixed layer."""
    column = Window.partitionBy(*by)
    sea = F.col(mask_field) > 0
    f = F.lit(float(f_cor_ct)) if use_constant else coriolis(F.col(lat))
    wet = lambda c: F.when(sea, c)
    inside = F.col("mld_mask") * F.col("e3t")
    out = cells.withColumns({
        "__d": F.max(wet(F.col("depth"))).over(column),
        "__all": F.sum(wet(F.col(rho) * F.col("e3t"))).over(column) / F.sum(wet(F.col("e3t"))).over(column),
        "__top": F.sum(wet(F.col(rho) * inside)).over(column) / F.nullif(F.sum(wet(inside)).over(column), F.lit(0.0)),
    })
    reduced = g * F.abs(F.col("__top") - F.col("__all")) / F.col("__all")
    return out.withColumns({
        "r_ext": F.when(sea, F.sqrt(g * F.col("__d")) / f / 1e3), "r_int": F.when(sea, F.sqrt(reduced * F.col("mld")) / f / 1e3),
    }).drop("__d", "__all", "__top")
