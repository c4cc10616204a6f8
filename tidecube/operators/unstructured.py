"""Any grid as a table of corners: gradients by shape functions, data moved from cells to points, and neighbours.

A mesh is a table of corners (keys.., cell, kind, corner, point, x, y, z): a row for each corner of each cell, corners numbered in
the usual order of the kind. What a cell keeps of the mesh after a selection are its own rows, so nothing here needs a
structured grid. All of it is equi-joins and partial sums by point and by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets of a hexahedron's corners along (i, j, k).
HEXAHEDRON = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
#: Corners joined by an edge, by kind of cell.
EDGES = {
    "hexahedron": ((0, 1), (1, 2), (3, 2), (0, 3), (4, 5), (5, 6), (7, 6), (4, 7), (0, 4), (1, 5), (2, 6), (3, 7)),
    "wedge": ((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)),
    "tetra": ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)),
    "quad": ((0, 1), (1, 2), (2, 3), (3, 0)), "triangle": ((0, 1), (1, 2), (2, 0)), "line": ((0, 1),),
}
DIMENSION = {"hexahedron": 3, "wedge": 3, "tetra": 3, "quad": 2, "triangle": 2, "line": 1}
CONTRIBUTING = ("all", "patch", "max")
#: What stands where no derivative can be had: the extremes are those of a double (the least positive one, as the option means).
REPLACEMENTS = {"null": None, "zero": 0.0, "nan": float("nan"), "min": 2.2250738585072014e-308, "max": 1.7976931348623157e308}


def _slopes(kind: str) -> list[tuple[float, ...]]:
    """Derivatives of each corner's shape function by the parametric axes, at the parametric centre."""
    if kind == "hexahedron":
        return [tuple((2 * o[a] - 1) / 4 for a in range(3)) for o in HEXAHEDRON]
    if kind == "quad":
        return [tuple((2 * o[a] - 1) / 2 for a in range(2)) for o in HEXAHEDRON[:4]]
    flat = [(-1.0, -1.0), (1.0, 0.0), (0.0, 1.0)]
    if kind == "wedge":
        return [(r / 2, s / 2, sign / 3) for sign in (-1, 1) for r, s in flat]
    if kind == "triangle":
        return flat
    return [tuple(-1.0 for _ in range(n)) if not c else tuple(float(a == c - 1) for a in range(n)) for n in (DIMENSION[kind],) for c in range(n + 1)]


def _by_corner(table: dict[str, list], kind: Column, corner: Column) -> Column:
    """The entry of a small fixed table for a row's kind and corner."""
    out = None
    for name, rows in table.items():
        found = F.get(F.lit(rows), corner)
        out = F.when(kind == name, found) if out is None else out.when(kind == name, found)
    return out


def dimension(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, n in DIMENSION.items():
        out = out.when(kind == name, F.lit(n))
    return out


def grid_corners(cells: DataFrame, points: DataFrame, keys=("t",), dims: tuple[str, str, str] = ("k", "j", "i")) -> DataFrame:
    """Corners of a curvilinear grid's cells (keys.., k, j, i): points(k, j, i, x, y, z) has the position of every grid point.

    Cell (k, j, i) has the points from (k, j, i) to (k + 1, j + 1, i + 1). cell and point are the numbers of 21 bits an axis that
    `packed` gives; cells without all of their eight points are left out as the join finds fewer.
    """
    k, j, i = dims
    corner = F.array(*[F.struct(F.lit(n).alias("corner"), F.lit(o[2]).alias("dk"), F.lit(o[1]).alias("dj"), F.lit(o[0]).alias("di")) for n, o in enumerate(HEXAHEDRON)])
    rows = cells.select(*keys, packed(F.col(k), F.col(j), F.col(i)).alias("cell"), k, j, i, F.explode(corner).alias("c"))
    at = packed(F.col(k) + F.col("c.dk"), F.col(j) + F.col("c.dj"), F.col(i) + F.col("c.di"))
    rows = rows.select(*keys, "cell", F.lit("hexahedron").alias("kind"), F.col("c.corner").alias("corner"), at.alias("point"))
    where = points.select(packed(F.col(k), F.col(j), F.col(i)).alias("point"), "x", "y", "z")
    return rows.join(where, "point").select(*keys, "cell", "kind", "corner", "point", "x", "y", "z")


def packed(k: Column, j: Column, i: Column, bits: int = 21) -> Column:
    """One number for a place on the grid, in (k, j, i) order."""
    return F.shiftleft(k.cast("long"), 2 * bits) + F.shiftleft(j.cast("long"), bits) + i.cast("long")


def _contributing(corners: DataFrame, keys, contributing: str) -> DataFrame:
    """corners of the cells that may speak for a point: all, those of the highest dimension around it, or of the data set."""
    if contributing not in CONTRIBUTING:
        raise ValueError(f"no contributing cells {contributing}; there are {', '.join(CONTRIBUTING)}")
    if contributing == "all":
        return corners
    sized = corners.withColumn("__dim", dimension(F.col("kind")))
    by = [*keys, "point"] if contributing == "patch" else list(keys)
    if by:
        top = sized.groupBy(*by).agg(F.max("__dim").alias("__top"))
        return sized.join(top, by).where("__dim >= __top").drop("__dim", "__top")
    return sized.join(F.broadcast(sized.agg(F.max("__dim").alias("__top"))), F.expr("__dim >= __top")).drop("__dim", "__top")


def cells_to_points(values: DataFrame, corners: DataFrame, fields: list[str], keys=("t",), contributing: str = "all") -> DataFrame:
    """(keys.., point, fields): at each point the mean of its contributing cells; cells without a value do not count.

    Sums are partial before they meet by point, so a point of many cells is one row a task.
    """
    rows = _contributing(corners, keys, contributing).select(*keys, "cell", "point").join(values.select(*keys, "cell", *fields), [*keys, "cell"])
    return rows.groupBy(*keys, "point").agg(*[F.avg(f).alias(f) for f in fields])


def _solved(rows: list[list[Column]], right: list[Column]) -> list[Column]:
    """(gx, gy, gz) of rows . g = right by cofactors; null where the rows span no volume."""
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    sides = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    volume = F.nullif(sum((rows[0][a] * sides[0][a] for a in range(1, 3)), rows[0][0] * sides[0][0]), F.lit(0.0))
    return [sum((right[n] * sides[n][a] for n in range(1, 3)), right[0] * sides[0][a]) / volume for a in range(3)]


def _derivative(df: DataFrame, fields: list[str], keep: list[str], depth_factor: float) -> DataFrame:
    """keep and d<field>d<axis> from columns __j<row><axis> (rows of the Jacobian) and __v<row><field>; dim tells how many rows count.

    Flat cells get their normal as the third row and a line two normals, along which nothing changes, so the gradient lies within them.
    """
    j = [[F.col(f"__j{n}{a}") for a in range(3)] for n in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    # Second row of a line: across its least component, so the two are never parallel.
    least = F.least(*[F.abs(c) for c in j[0]])
    unit = [F.when(F.abs(j[0][0]) == least, 1.0).otherwise(0.0)]
    unit.append(F.when((F.abs(j[0][1]) == least) & (unit[0] == 0), 1.0).otherwise(0.0))
    unit.append(F.when((unit[0] == 0) & (unit[1] == 0), 1.0).otherwise(0.0))
    across = cross(j[0], unit)
    df = df.withColumns({f"__j1{a}": F.when(F.col("dim") < 2, across[a]).otherwise(j[1][a]) for a in range(3)})
    normal = cross(j[0], j[1])
    df = df.withColumns({f"__j2{a}": F.when(F.col("dim") < 3, normal[a]).otherwise(j[2][a]) for a in range(3)})
    made = []
    for f in fields:
        right = [F.col(f"__v0{f}"), F.when(F.col("dim") < 2, 0.0).otherwise(F.col(f"__v1{f}")), F.when(F.col("dim") < 3, 0.0).otherwise(F.col(f"__v2{f}"))]
        found = _solved(j, right)
        made += [(found[n] * (depth_factor if a == "z" else 1.0)).alias(f"d{f}d{a}") for n, a in enumerate("xyz")]
    return df.select(*keep, *made)


def cell_gradient(values: DataFrame, corners: DataFrame, fields: list[str], keys=("t",), contributing: str = "all", replacement: str = "zero", depth_factor: float = 1.0, whole: bool = True) -> DataFrame:
    """values(keys.., cell, fields, ..) with d<field>dx, d<field>dy, d<field>dz of cell data.

    Values go to points first, where contributing cells are averaged; a cell's derivative is that of its shape functions at its parametric
    centre. Sums over a cell's corners are partial and meet by cell once for all fields. Cells that have no corners, a corner without a value or no volume get replacement. Without
    whole a corner without a value adds nothing, and only cells that have none at all count as without.
    """
    at_points = cells_to_points(values, corners, fields, keys, contributing)
    slopes = {kind: [[*map(float, s), *[0.0] * (3 - len(s))] for s in _slopes(kind)] for kind in DIMENSION}
    rows = corners.withColumn("__s", _by_corner(slopes, F.col("kind"), F.col("corner"))).join(at_points, [*keys, "point"], "left")
    sums = [F.sum(F.get("__s", F.lit(n)) * F.col(a)).alias(f"__j{n}{m}") for n in range(3) for m, a in enumerate("xyz")]
    enough = lambda f: F.count(f) == F.count("*") if whole else F.count(f) > 0
    sums += [F.when(enough(f), F.sum(F.get("__s", F.lit(n)) * F.col(f))).alias(f"__v{n}{f}") for n in range(3) for f in fields]
    met = rows.groupBy(*keys, "cell").agg(F.max(dimension(F.col("kind"))).alias("dim"), *sums)
    found = _derivative(met, fields, [*keys, "cell"], depth_factor)
    return _replaced(values.join(found, [*keys, "cell"], "left"), fields, replacement)


def point_gradient(values: DataFrame, corners: DataFrame, fields: list[str], keys=("t",), contributing: str = "all", replacement: str = "zero", depth_factor: float = 1.0) -> DataFrame:
    """values(keys.., point, fields, ..) with d<field>dx, d<field>dy, d<field>dz of point data: the mean over contributing cells of their derivative at that corner.

    At a corner the shape functions' derivatives are those along the edges that leave it. Cells that have a point twice, and cells without volume there, do
    not count; points without any get replacement.
    """
    once = corners.groupBy(*keys, "cell", "point").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in ("kind", "corner", "x", "y", "z")])
    own = _contributing(corners, keys, contributing).select(*keys, "cell", "point").distinct().join(once.where("__n = 1"), [*keys, "cell", "point"])
    ends = {k: [[b if a == c else a for a, b in EDGES[k] if c in (a, b)] for c in range(max(map(max, EDGES[k])) + 1)] for k in EDGES}
    edges = own.select(*keys, "cell", "point", "kind", "x", "y", "z", F.posexplode(_by_corner(ends, F.col("kind"), F.col("corner"))).alias("row", "to"))
    edges = edges.join(values.select(*keys, "point", *[F.col(f).alias(f"__own_{f}") for f in fields]), [*keys, "point"])
    far = corners.select(*keys, "cell", F.col("corner").alias("to"), F.col("point").alias("__far"), *[F.col(a).alias(f"__{a}") for a in "xyz"])
    met = edges.join(far, [*keys, "cell", "to"]).join(values.select(*keys, F.col("point").alias("__far"), *[F.col(f).alias(f"__far_{f}") for f in fields]), [*keys, "__far"])
    pick = lambda n, c: F.max(F.when(F.col("row") == n, c))
    sums = [pick(n, F.col(f"__{a}") - F.col(a)).alias(f"__j{n}{m}") for n in range(3) for m, a in enumerate("xyz")]
    sums += [pick(n, F.col(f"__far_{f}") - F.col(f"__own_{f}")).alias(f"__v{n}{f}") for n in range(3) for f in fields]
    by_cell = met.groupBy(*keys, "point", "cell").agg(F.max(dimension(F.col("kind"))).alias("dim"), *sums)
    each = _derivative(by_cell, fields, [*keys, "point"], depth_factor)
    found = each.groupBy(*keys, "point").agg(*[F.avg(f"d{f}d{a}").alias(f"d{f}d{a}") for f in fields for a in "xyz"])
    return _replaced(values.join(found, [*keys, "point"], "left"), fields, replacement)


def _replaced(df: DataFrame, fields: list[str], replacement: str) -> DataFrame:
    if replacement not in REPLACEMENTS:
        raise ValueError(f"no replacement {replacement}; there are {', '.join(REPLACEMENTS)}")
    if REPLACEMENTS[replacement] is None:
        return df
    return df.withColumns({c: F.coalesce(c, F.lit(REPLACEMENTS[replacement])) for c in (f"d{f}d{a}" for f in fields for a in "xyz")})


def connected_cells(corners: DataFrame, keys=("t",)) -> DataFrame:
    """(keys.., cell, near), both ways: cells that have an edge in common.

    Cells meet by the numbers of an edge's two points, as many as lie around one edge: a handful in any mesh of volumes.
    """
    table = {kind: [list(e) for e in edges] for kind, edges in EDGES.items()}
    every = F.when(F.lit(False), F.lit([[0]]))
    for kind, edges in table.items():
        every = every.when(F.col("kind") == kind, F.lit(edges))
    # The corner that an edge begins at brings the edge to its cell; the other end's point is found by corner.
    starts = corners.select(*keys, "cell", "kind", "corner", "point").withColumn("e", F.explode(F.filter(every, lambda e: F.get(e, F.lit(0)) == F.col("corner"))))
    ends = corners.select(*keys, "cell", F.col("corner").alias("to"), F.col("point").alias("end"))
    edge = starts.withColumn("to", F.get("e", F.lit(1))).join(ends, [*keys, "cell", "to"])
    edge = edge.select(*keys, "cell", F.least("point", "end").alias("lo"), F.greatest("point", "end").alias("hi"))
    other = edge.select(*keys, "lo", "hi", F.col("cell").alias("near"))
    return edge.join(other, [*keys, "lo", "hi"]).where("cell <> near").select(*keys, "cell", "near").distinct()


def connected_points(corners: DataFrame, keys=("t",)) -> DataFrame:
    """(keys.., point, near), both ways: points that have a cell in common."""
    own, other = corners.select(*keys, "cell", "point"), corners.select(*keys, "cell", F.col("point").alias("near"))
    return own.join(other, [*keys, "cell"]).where("point <> near").select(*keys, "point", "near").distinct()
