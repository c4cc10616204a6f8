"""Vortex identification, masks, labels and properties."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, kept
from .stencil import curl, derivatives, gradient, q_criterion, tensor


def area() -> Column:
    return F.col("e1t") * F.col("e2t")


def with_sigma(df: DataFrame, value: str, name: str = "sigma", among: Column | None = None, keys=("t",), how: str = "left") -> DataFrame:
    """df with the area-weighted population deviation of value over each time step (rows in among only).

    The deviation is taken in two passes, as one-row-per-step aggregates that are joined back by step: each
    is partially summed before it is shuffled, so a step's cells never meet in one task. A step without any value has a null deviation, or with
    how="inner" no rows.
    """
    rows = df if among is None else df.where(among)
    rows = rows.select(*keys, area().alias("w"), F.col(value).alias("v")).where("v IS NOT NULL")
    mean = rows.groupBy(*keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    away = F.col("v") - F.col("m")
    spread = rows.join(mean, list(keys)).groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * away * away) / F.sum("w")).alias(name))
    return df.join(spread, list(keys), how)


def three_way_mask(value: Column, limit: Column) -> Column:
    """0 below -limit (vorticity), 2 above limit (strain), 1 between."""
    return F.when(value < -limit, 0).when(value > limit, 2).when(value.isNotNull(), 1)


def okubo_weiss(cells: DataFrame, coef: float = 0.2, grad_type: str = "model1", u: str = "u", v: str = "v", mask_field: str = "coast", shape: dict[str, int] | None = None, how: str = "left") -> DataFrame:
    """cells with okubo_weiss and okubo_weiss_mask of the surface, given to the whole column; null over land. how: see with_sigma."""
    top = gradient(cells.where("k = 0"), [u, v], grad_type, shape)
    sn = F.col(f"d{u}dx") - F.col(f"d{v}dy")
    ss = F.col(f"d{v}dx") + F.col(f"d{u}dy")
    spin = F.col(f"d{v}dx") - F.col(f"d{u}dy")
    top = top.withColumn("okubo_weiss", F.when(F.col(mask_field) > 0, sn * sn + ss * ss - spin * spin))
    top = with_sigma(top, "okubo_weiss", how=how)
    top = top.select("t", "j", "i", "okubo_weiss", three_way_mask(F.col("okubo_weiss"), coef * F.col("sigma")).alias("okubo_weiss_mask"))
    return cells.join(top, ["t", "j", "i"], how)


def q_criterion_mask(cells: DataFrame, coef: float = 0.2, grad_type: str = "model1", fields=("u", "v", "w"), mask_field: str = "coast", shape: dict[str, int] | None = None, how: str = "left") -> DataFrame:
    """cells with q and q_mask; the mask is that of -2 q, which is on Okubo and Weiss's scale; null over land. how: see with_sigma."""
    out = gradient(cells, list(fields), grad_type, shape).withColumn("q", F.when(F.col(mask_field) > 0, q_criterion(*fields)))
    out = with_sigma(out.withColumn("__scaled", -2 * F.col("q")), "__scaled", how=how)
    return out.withColumn("q_mask", three_way_mask(F.col("__scaled"), coef * F.col("sigma"))).drop("__scaled", "sigma")


def middle_eigenvalue(a: list[list[Column]]) -> Column:
    """Middle eigenvalue of a symmetric 3 x 3 matrix, in closed form."""
    mean = (a[0][0] + a[1][1] + a[2][2]) / 3
    d = [a[n][n] - mean for n in range(3)]
    off = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    scale = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6)
    det = d[0] * (d[1] * d[2] - a[1][2] * a[1][2]) - a[0][1] * (a[0][1] * d[2] - a[1][2] * a[0][2]) + a[0][2] * (a[0][1] * a[1][2] - d[1] * a[0][2])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * scale * scale * scale)))) / 3
    return F.when(scale == 0, mean).otherwise(mean + 2 * scale * F.cos(angle - 2 * math.pi / 3))


def lambda2(cells: DataFrame, grad_type: str = "model1", fields=("u", "v", "w"), shape: dict[str, int] | None = None) -> DataFrame:
    """cells with lambda2, the middle eigenvalue of the squared symmetric plus the squared antisymmetric tensor."""
    out = gradient(cells, list(fields), grad_type, shape)
    g = tensor(*fields)
    square = [[sum((g[r][k] * g[k][c] for k in range(1, 3)), g[r][0] * g[0][c]) for c in range(3)] for r in range(3)]
    for r in range(3):
        for c in range(r, 3):
            out = out.withColumn(f"__a{r}{c}", (square[r][c] + square[c][r]) / 2)
    a = [[F.col(f"__a{min(r, c)}{max(r, c)}") for c in range(3)] for r in range(3)]
    return out.withColumn("lambda2", middle_eigenvalue(a)).drop(*[f"__a{r}{c}" for r in range(3) for c in range(r, 3)])


def strain_and_spin(fields=("u", "v", "w")) -> tuple[Column, Column]:
    """Squared Frobenius norms of the symmetric and the antisymmetric part of the gradient."""
    g = tensor(*fields)
    sym = g[0][0] * g[0][0] + g[1][1] * g[1][1] + g[2][2] * g[2][2]
    anti = F.lit(0.0)
    for r, c in ((0, 1), (0, 2), (1, 2)):
        plus, minus = g[r][c] + g[c][r], g[r][c] - g[c][r]
        sym, anti = sym + plus * plus / 2, anti + minus * minus / 2
    return sym, anti


def _share(out: DataFrame, a: str, b: str, name: str, epsi: float, modified: bool) -> DataFrame:
    """b's share of a + b, steadied by epsi times the step's largest b - a."""
    top = out.groupBy("t").agg((epsi * F.greatest(F.lit(0.0), F.max(F.col(b) - F.col(a)))).alias("__eps"))
    out = out.join(top, "t", "left")
    a, b, e = F.col(a), F.col(b), F.col("__eps")
    return out.withColumn(name, (b + e) / (a + b + 2 * e) if modified else b / F.nullif(a + b + e, F.lit(0.0))).drop("__eps")


def omega(cells: DataFrame, epsi: float = 0.001, use_modified_omega: bool = False, grad_type: str = "model1", fields=("u", "v", "w"), shape: dict[str, int] | None = None) -> DataFrame:
    out = gradient(cells, list(fields), grad_type, shape)
    a, b = strain_and_spin(fields)
    return _share(out.withColumns({"__a": a, "__b": b}), "__a", "__b", "omega", epsi, use_modified_omega).drop("__a", "__b")


def rortex(cells: DataFrame, coef: float = 0.2, epsi: float = 0.001, use_modified_omega: bool = False, grad_type: str = "model1", fields=("u", "v", "w"), shape: dict[str, int] | None = None) -> DataFrame:
    """cells with rortex_x, rortex_y, rortex_z, omega_r and rortex_mask.

    The real eigenvector r of the gradient comes from the characteristic cubic in closed form. With the
    spin s along r (turned so that s > 0) and the imaginary part c of the complex pair, the rigid rotation is
    s - sqrt(s * s - 4 c * c); alpha and beta of the plane block follow. Without a complex pair it is 0.
    """
    out = gradient(cells, list(fields), grad_type, shape)
    g = tensor(*fields)
    trace = g[0][0] + g[1][1] + g[2][2]
    minors = g[0][0] * g[1][1] - g[0][1] * g[1][0] + g[0][0] * g[2][2] - g[0][2] * g[2][0] + g[1][1] * g[2][2] - g[1][2] * g[2][1]
    det = (
        g[0][0] * (g[1][1] * g[2][2] - g[1][2] * g[2][1]) - g[0][1] * (g[1][0] * g[2][2] - g[1][2] * g[2][0])
        + g[0][2] * (g[1][0] * g[2][1] - g[1][1] * g[2][0])
    )
    root = let({"tr": trace, "mi": minors, "de": det}, _real_root)
    out = out.withColumn("__root", root)
    lr = F.col("__root.lr")
    rows = [[g[r][c] - lr if r == c else g[r][c] for c in range(3)] for r in range(3)]
    cross = lambda x, y: (x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
    sides = [let(dict(zip("xyz", cross(rows[a], rows[b]))), lambda c: F.struct((c["x"] * c["x"] + c["y"] * c["y"] + c["z"] * c["z"]).alias("n"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"))) for a, b in ((0, 1), (0, 2), (1, 2))]
    wx, wy, wz = curl(*fields)
    given = {"best": F.greatest(*sides), "wx": wx, "wy": wy, "wz": wz, "ci2": F.col("__root.ci2"), "disc": F.col("__root.disc")}
    out = out.withColumn("__r", let(given, _rotation)).select(*cells.columns, "__r.*")
    out = _share(out, "__a2", "__b2", "omega_r", epsi, use_modified_omega)
    out = with_sigma(out, "__size").withColumn("rortex_mask", (F.col("__size") > coef * F.col("sigma")).cast("int"))
    return out.drop("sigma", "__size", "__a2", "__b2")


def let(names: dict[str, Column], body) -> Column:
    """body of a struct of named values, each computed once: a lambda's variable is not expanded by the optimiser."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in names.items()]))
    return F.element_at(F.transform(bound, body), 1)


def _real_root(s: Column) -> Column:
    """Real eigenvalue, squared imaginary part of the complex pair and discriminant, from trace, minors and determinant."""
    p, q = s["mi"] - s["tr"] * s["tr"] / 3, -2 * s["tr"] * s["tr"] * s["tr"] / 27 + s["tr"] * s["mi"] / 3 - s["de"]

    def solve(c: Column) -> Column:
        root = F.sqrt(F.greatest(c["disc"], F.lit(0.0)))
        return F.struct((F.cbrt(-c["q"] / 2 + root) + F.cbrt(-c["q"] / 2 - root) + c["tr"] / 3).alias("lr"), c["tr"].alias("tr"), c["mi"].alias("mi"), c["disc"].alias("disc"))

    def pair(c: Column) -> Column:
        half = (c["tr"] - c["lr"]) / 2
        left = F.greatest(F.lit(0.0), c["mi"] - c["lr"] * (c["tr"] - c["lr"]) - half * half)
        return F.struct(c["lr"].alias("lr"), left.alias("ci2"), c["disc"].alias("disc"))

    solved = let({"q": q, "disc": q * q / 4 + p * p * p / 27, "tr": s["tr"], "mi": s["mi"]}, solve)
    return F.element_at(F.transform(F.array(solved), pair), 1)


def _rotation(c: Column) -> Column:
    """Rotation vector along the real eigenvector and the plane block's squared alpha and beta."""
    best, length = c["best"], F.sqrt(c["best"]["n"])
    along = (c["wx"] * best["x"] + c["wy"] * best["y"] + c["wz"] * best["z"]) / F.nullif(length, F.lit(0.0))

    def finish(v: Column) -> Column:
        s, spins = F.abs(v["along"]), (v["disc"] > 0) & (v["length"] > 0)
        size = F.when(spins, s - F.sqrt(F.greatest(F.lit(0.0), s * s - 4 * v["ci2"]))).otherwise(0.0)
        sign = F.when(v["along"] < 0, -1.0).otherwise(1.0)
        parts = [F.when(spins, size * sign * v[n] / v["length"]).otherwise(0.0).alias(f"rortex_{n}") for n in "xyz"]
        beta2 = F.when(spins, s * s / 4).otherwise(0.0)
        alpha2 = F.when(spins, F.greatest(F.lit(0.0), s * s / 4 - v["ci2"])).otherwise(0.0)
        return F.struct(*parts, size.alias("__size"), beta2.alias("__b2"), alpha2.alias("__a2"))

    return let({"along": along, "length": length, "ci2": c["ci2"], "disc": c["disc"], **{n: best[n] for n in "xyz"}}, finish)


def vortex_mask(cells: DataFrame, array: str, kind: str, coef: float = 0.2, mask_field: str | None = None, name: str = "mask", missing: int | None = 0, how: str = "left") -> DataFrame:
    """cells with a 0/1 mask: Okubo-Weiss under -coef sigma, Q over coef sigma / 2, Rortex's size over coef sigma.

    sigma is over all cells of the step, land too, unless mask_field is given. A cell without a value has the mask missing. how: see with_sigma.
    """
    among = F.col(mask_field) > 0 if mask_field else None
    out = with_sigma(cells, array, among=among, how=how)
    limit = coef * F.col("sigma")
    test = {"okubo_weiss": F.col(array) < -limit, "q": F.col(array) > 0.5 * limit, "rortex": F.col(array) > limit}[kind]
    return out.withColumn(name, F.coalesce(test.cast("int"), F.lit(missing).cast("int"))).drop("sigma")


NEIGHBOURS = {
    4: ((0, 0, 1), (0, 1, 0)), 6: ((0, 0, 1), (0, 1, 0), (1, 0, 0)),
    18: ((0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 1, 1), (0, 1, -1), (1, 0, 1), (1, 0, -1), (1, 1, 0), (1, -1, 0)),
    26: tuple((a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)),
}


#: Cells along each side of the tiles that are labelled on their own; a packed cell number has PACK bits an axis.
TILE, PACK = 128, 21


def _packed(k: Column, j: Column, i: Column) -> Column:
    """One number for a cell, in (k, j, i) order."""
    return (F.shiftleft(k.cast("long"), 2 * PACK) + F.shiftleft(j.cast("long"), PACK) + i.cast("long")).cast("long")


def _roots(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Smallest number that each of 0..count - 1 reaches by the links (a, b)."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _label_tile(offsets):
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "j", "i"])
        key = pdf[["k", "j", "i"]].to_numpy(np.int64)
        base = key - key.min(axis=0) + 1
        span = base.max(axis=0) + 2
        flat = lambda x: ((x[:, 0] * span[1]) + x[:, 1]) * span[2] + x[:, 2]
        code, index = flat(base), np.arange(len(key))
        links = []
        for o in offsets:
            want = flat(base + np.array(o))
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[at] == want
            links.append(np.stack([index[hit], at[hit]]))
        root = key[_roots(*np.concatenate(links, axis=1), len(key))]
        return pdf[["t", "k", "j", "i"]].assign(part=(root[:, 0] << (2 * PACK)) + (root[:, 1] << PACK) + root[:, 2])

    return label


def vortex_components(cells: DataFrame, mask: str = "mask", min_resolution: int = 5, connectivity: int = 6, tile: int = TILE) -> DataFrame:
    """(t, k, j, i, vortex_id) of the masked cells' true components of more than min_resolution cells.

    Components are numbered from 1 in each step by their first cell in (k, j, i) order. A task labels one tile of at most
    tile ** 3 cells; masked cells at the borders of tiles meet their neighbours by a join, and the links between
    tiles are contracted by joins. Labels are computed once and kept. Indices are at least 0 and under 2 ** PACK.
    """
    chosen = cells.where(F.col(mask) == 1).select("t", "k", "j", "i")
    kinds = dict(chosen.dtypes)
    tiles = {c: F.floor(F.col(c) / tile) for c in "kji"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("t", "k", "j", "i")) + ", part long"
    tiled = chosen.withColumns({f"tile_{c}": e for c, e in tiles.items()})
    labelled = tiled.groupBy("t", "tile_k", "tile_j", "tile_i").applyInPandas(_label_tile(NEIGHBOURS[connectivity]), schema)
    labelled = kept(labelled)
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip("kji", o)]) for o in NEIGHBOURS[connectivity]])).alias("o")
    near = {c: F.col(c) + F.col(f"o.d{c}") for c in "kji"}
    outside = F.lit(False)
    for c in "kji":
        outside = outside | (F.floor(near[c] / tile) != tiles[c])
    border = labelled.select("t", "k", "j", "i", F.col("part").alias("a"), steps).where(outside).select("t", _packed(*(near[c] for c in "kji")).alias("cell"), "a")
    facing = labelled.select("t", _packed(F.col("k"), F.col("j"), F.col("i")).alias("cell"), F.col("part").alias("b"))
    links = border.join(facing, ["t", "cell"]).select("t", "a", "b").distinct()
    joined = components(links, ["t"]).withColumnRenamed("node", "part")
    whole = kept(labelled.join(joined, ["t", "part"], "left").withColumn("component", F.coalesce("component", "part")))
    sizes = whole.groupBy("t", "component").agg(F.count("*").alias("n")).where(F.col("n") > min_resolution)
    rank = F.row_number().over(Window.partitionBy("t").orderBy("component"))
    named = sizes.select("t", "component", rank.cast("long").alias("vortex_id"))
    return whole.join(named, ["t", "component"]).select("t", "k", "j", "i", "vortex_id")


def vortex_properties(cells: DataFrame, components: DataFrame, scalar: str, vector=("u", "v", "w"), x="x", y="y", z="z", change_mask: bool = True) -> DataFrame:
    """One row per vortex: cells, barycentre, centre, size, rotation axis, strengths, circulation and sign.

    The centre is the cell with the largest scalar, the first in (k, j, i) order of several; size is the
    distance to the farthest cell whose scalar is at least a twentieth of the centre's.
    """
    cell = F.struct("k", "j", "i")
    rows = cells.join(components, ["t", "k", "j", "i"])
    first = F.struct(F.col(scalar).alias("f"), (-F.col("k")).alias("nk"), (-F.col("j")).alias("nj"), (-F.col("i")).alias("ni"))
    here = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"), F.col(scalar).alias("f"), *[F.col(c).alias(f"v{n}") for n, c in enumerate(vector)], cell.alias("cell"))
    centre = rows.groupBy("t", "vortex_id").agg(F.max_by(here, first).alias("c"))
    met = rows.join(centre, ["t", "vortex_id"])
    away = F.sqrt(F.pow(F.col(x) - F.col("c.x"), F.lit(2)) + F.pow(F.col(y) - F.col("c.y"), F.lit(2)) + F.pow(F.col(z) - F.col("c.z"), F.lit(2)))
    strength = F.sqrt(sum((F.col(f"c.v{n}") * F.col(f"c.v{n}") for n in range(1, 3)), F.col("c.v0") * F.col("c.v0")))
    props = met.groupBy("t", "vortex_id", "c").agg(
        F.count("*").alias("n_cells"), F.avg(x).alias("bary_x"), F.avg(y).alias("bary_y"), F.avg(z).alias("bary_z"),
        F.max(F.when(F.col(scalar) >= 0.05 * F.col("c.f"), away)).alias("size"), F.sum(area() * F.col(vector[2])).alias("circulation"),
    )
    sign = F.when(F.col("c.v2") < 0, -1).otherwise(1) if change_mask else F.lit(1)
    return props.select(
        "t", "vortex_id", "n_cells", "bary_x", "bary_y", "bary_z", F.col("c.x").alias("center_x"), F.col("c.y").alias("center_y"), F.col("c.z").alias("center_z"),
        "size", *[(F.col(f"c.v{n}") / F.nullif(strength, F.lit(0.0))).alias(f"rot_{a}") for n, a in enumerate("xyz")],
        strength.alias("abs_strength"), F.col("c.f").alias("rel_strength"), "circulation", sign.cast("long").alias("sign"),
    )


def vortex_mean_strengths(cells: DataFrame, components: DataFrame, scalar: str, weight: Column, vector=("u", "v", "w")) -> DataFrame:
    """Strengths of each vortex as weighted means over its cells, in place of the values at the centre."""
    rows = cells.join(components, ["t", "k", "j", "i"]).withColumn("__w", weight)
    speed = F.sqrt(sum((F.col(c) * F.col(c) for c in vector[1:]), F.col(vector[0]) * F.col(vector[0])))
    return rows.groupBy("t", "vortex_id").agg(
        (F.sum(F.col("__w") * speed) / F.sum("__w")).alias("abs_strength"), (F.sum(F.col("__w") * F.col(scalar)) / F.sum("__w")).alias("rel_strength")
    )


def gradient_outputs(cells: DataFrame, fields=("u", "v", "w"), compute_gradient: bool = True, compute_divergence: bool = False, compute_vorticity: bool = False, compute_q_criterion: bool = False, compute_lambda2: bool = False, compute_omega: bool = False, compute_rortex: bool = False, epsi: float = 0.001, grad_type: str = "fv2", replacement: float | None = None, shape: dict[str, int] | None = None) -> DataFrame:
    """All that follows from one gradient, on request: divergence, vorticity, q, lambda2, omega, rortex and omega_r.

    Each criterion is joined by cell, so asking for one costs its own windows only. replacement stands in for
    derivatives that a cell without neighbours lacks (null by default).
    """
    keys = ["t", "k", "j", "i"]
    out = derivatives(cells, tuple(fields), compute_divergence, compute_vorticity, compute_q_criterion, grad_type, shape)
    made = [c for c in out.columns if c not in cells.columns]
    if replacement is not None:
        out = out.withColumns({c: F.coalesce(c, F.lit(float(replacement))) for c in made})
    if not compute_gradient:
        out = out.drop(*[f"d{f}d{a}" for f in fields for a in "xyz"])
    if compute_lambda2:
        out = out.join(lambda2(cells, grad_type, fields, shape).select(*keys, "lambda2"), keys)
    if compute_omega:
        out = out.join(omega(cells, epsi, False, grad_type, fields, shape).select(*keys, "omega"), keys)
    if compute_rortex:
        out = out.join(rortex(cells, epsi=epsi, grad_type=grad_type, fields=fields, shape=shape).select(*keys, "rortex_x", "rortex_y", "rortex_z", "omega_r"), keys)
    return out
