"""DuckDB statements with the same rows as the queries, written from the operators' definitions."""

from __future__ import annotations

import math

from ..functions import seawater as sw
from ..functions.projection import EQUAL_EARTH, ROBINSON_X, ROBINSON_Y
from ..operators.select import parse_polygon
from ..operators.stencil import SCHEMES
from .fixture import SQL as CELLS
from .queries import FAST, FASTEST, POLYGON, PROJECTED

WITH = "WITH " + CELLS
KEYS = "t, k, j, i"
PERCENT = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _stats(source: str, keys: str, tie: str, names, digits: int = 5) -> str:
    """source(keys, w, v, tie..) -> the asked statistics, rounded."""
    pieces = []
    for n in names:
        if n in ("min", "max"):
            pieces.append(f"round({n}(v), {digits}) + 0.0 AS {n}")
        elif n == "mean":
            pieces.append(f"round(sum(w * v) / sum(w), {digits}) + 0.0 AS mean")
        elif n == "std":
            pieces.append(f"round(sqrt(sum(w * (v - m) * (v - m)) / sum(w)), {digits}) + 0.0 AS std")
        else:
            q = PERCENT[n]
            pieces.append(
                f"round(coalesce(arg_min(CASE WHEN p0 IS NULL THEN v ELSE v0 + ({q}::DOUBLE - p0) / (p - p0) * (v - v0) END, p) FILTER (p >= {q}::DOUBLE),"
                f" arg_max(v, p)), {digits}) + 0.0 AS {n}"
            )
    return f"""src AS ({source}),
means AS (SELECT *, sum(w * v) OVER (PARTITION BY {keys}) / sum(w) OVER (PARTITION BY {keys}) AS m,
  (sum(w) OVER (PARTITION BY {keys} ORDER BY v, {tie} ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY {keys}) AS p FROM src),
lagged AS (SELECT *, lag(p) OVER (PARTITION BY {keys} ORDER BY v, {tie}) AS p0, lag(v) OVER (PARTITION BY {keys} ORDER BY v, {tie}) AS v0 FROM means)
SELECT {keys}, {', '.join(pieces)} FROM lagged GROUP BY {keys}"""


MOMENTS = ("mean", "std", "min", "max")
ALL = (*MOMENTS, *PERCENT)


def _poly(c, x):
    return " + ".join(f"({v!r}::DOUBLE) * power({x}, {n})" if n else f"({v!r}::DOUBLE)" for n, v in enumerate(c))


def _density(name: str, deep: bool) -> str:
    t, s, d = "temp", "sal", "depth" if deep else "0.0::DOUBLE"
    r = f"sqrt({s})"
    surface = f"({_poly(sw.PURE_WATER, t)} + {s} * ({_poly(sw.SALT_1, t)}) + power({s}, 1.5) * ({_poly(sw.SALT_3_2, t)}) + {sw.SALT_2}::DOUBLE * {s} * {s})"
    if name == "lin_t":
        return f"1020 * (0.028::DOUBLE - 0.0002::DOUBLE * {t}) + 1020"
    if name == "lin_ts":
        return f"1020 * (0.001::DOUBLE * {s} - 0.0002::DOUBLE * {t}) + 1020"
    if name == "jmd94":
        k = f"((({_poly(sw.JMD94_B1, t)}) * {r} + {_poly(sw.JMD94_A1, t)}) * {s} + {_poly(sw.JMD94_KW, t)})"
        a = f"(({sw.JMD94_D}::DOUBLE * {r} + {_poly(sw.JMD94_C, t)}) * {s} + {_poly(sw.JMD94_AW, t)})"
        b = f"({_poly(sw.JMD94_BW, t)} + ({_poly(sw.JMD94_E, t)}) * {s})"
        return f"{surface} / (1 - {d} / ({k} - {d} * ({a} - {d} * {b})))"
    if name == "jaot12":
        p = f"({d} * {sw.GRAVITY * sw.WATER * 1e-5!r}::DOUBLE)"
        bulk = (
            f"({_poly(sw.BULK_FRESH, t)} + {s} * ({_poly(sw.BULK_SALT, t)}) + power({s}, 1.5) * ({_poly(sw.BULK_SALT_3_2, t)})"
            f" + {p} * ({_poly(sw.BULK_P, t)}) + {p} * {s} * ({_poly(sw.BULK_P_SALT, t)}) + {p} * power({s}, 1.5) * {sw.BULK_P_SALT_3_2}::DOUBLE"
            f" + {p} * {p} * ({_poly(sw.BULK_P2, t)}) + {p} * {p} * {s} * ({_poly(sw.BULK_P2_SALT, t)}))"
        )
        return f"{surface} / (1 - {p} / {bulk})"
    p = f"({d} * {sw.GRAVITY * sw.WATER * 1e-4!r}::DOUBLE)"
    num = (
        f"({_poly(sw.MDJWF_NUM_T, t)} + {s} * ({sw.MDJWF_NUM_S}::DOUBLE + ({sw.MDJWF_NUM_ST}::DOUBLE) * {t} + {sw.MDJWF_NUM_SS}::DOUBLE * {s})"
        f" + {p} * ({sw.MDJWF_NUM_P}::DOUBLE + {sw.MDJWF_NUM_PTT}::DOUBLE * {t} * {t} + {sw.MDJWF_NUM_PS}::DOUBLE * {s}"
        f" + {p} * (({sw.MDJWF_NUM_PP}::DOUBLE) + ({sw.MDJWF_NUM_PPTT}::DOUBLE) * {t} * {t})))"
    )
    den = (
        f"({_poly(sw.MDJWF_DEN_T, t)} + {s} * ({_poly(sw.MDJWF_DEN_S, t)}) + power({s}, 1.5) * ({_poly(sw.MDJWF_DEN_S_3_2, t)})"
        f" + {p} * ({sw.MDJWF_DEN_P}::DOUBLE + {p} * {t} * (({sw.MDJWF_DEN_PPTTT}::DOUBLE) * {t} * {t} + ({sw.MDJWF_DEN_PPPT}::DOUBLE) * {p})))"
    )
    return f"{num} / {den}"


AXIS = {"x": ("i", "t, k, j", 16), "y": ("j", "t, k, i", 10), "z": ("k", "t, j, i", 10)}
FACE = {"x": ("e1u", "e2u * e3u", "e2t * e3t"), "y": ("e2v", "e1v * e3v", "e1t * e3t"), "z": ("e3w", None, None)}
COORD = {"x": "x", "y": "y", "z": "depth"}


def _shift(expr: str, step: int, axis: str) -> str:
    order, part, _ = AXIS[axis]
    if step == 0:
        return f"({expr})"
    return f"{'lead' if step > 0 else 'lag'}({expr}, {abs(step)}) OVER (PARTITION BY {part} ORDER BY {order})"


def _grads(scheme: str, fields, source: str = "cells", axes: str = "xyz") -> str:
    """CTEs ending in one named grads, with d<field>d<axis> columns."""
    order = int(scheme[-1])
    faces, centres = [], []
    for axis in axes:
        idx, _, n = AXIS[axis]
        for f in fields:
            s = lambda k: _shift(f, k, axis)  # noqa: B023, E731
            c = lambda k: _shift(COORD[axis], k, axis)  # noqa: B023, E731
            forward, backward = f"(-3 * {s(0)} + 4 * {s(1)} - {s(2)}) / 2", f"(3 * {s(0)} - 4 * {s(-1)} + {s(-2)}) / 2"
            wide = f"(-{s(2)} + 8 * {s(1)} - 8 * {s(-1)} + {s(-2)})"
            if scheme == "fv2":
                e = f"CASE WHEN {idx} = 0 THEN ({s(1)} - {s(0)}) / ({c(1)} - {c(0)}) WHEN {idx} = {n - 1} THEN ({s(0)} - {s(-1)}) / ({c(0)} - {c(-1)}) ELSE ({s(1)} - {s(-1)}) / ({c(1)} - {c(-1)}) END"
            elif scheme == "fv4":
                e = f"CASE WHEN {idx} <= 1 THEN {forward} / ({c(1)} - {c(0)}) WHEN {idx} >= {n - 2} THEN {backward} / ({c(0)} - {c(-1)}) ELSE {wide} / 6 / ({c(1)} - {c(-1)}) END"
            elif order == 1:
                e = f"CASE WHEN {idx} = {n - 1} THEN {s(0)} - {s(-1)} ELSE {s(1)} - {s(0)} END / {FACE[axis][0]}"
            elif order == 2:
                e = f"CASE WHEN {idx} = 0 THEN {s(1)} - {s(0)} WHEN {idx} = {n - 1} THEN {s(0)} - {s(-1)} ELSE ({s(1)} - {s(-1)}) / 2 END / {FACE[axis][0]}"
            else:
                e = f"CASE WHEN {idx} <= 1 THEN {forward} WHEN {idx} >= {n - 2} THEN {backward} ELSE {wide} / 12 END / {FACE[axis][0]}"
            faces.append(f"{e} AS f{f}{axis}")
            name = f"d{f}d{axis}"
            if scheme.startswith("fv"):
                centres.append(f"f{f}{axis} AS {name}")
                continue
            before = _shift(f"f{f}{axis}", -1, axis)
            if order == 4:
                before = f"CASE WHEN {idx} = 3 THEN (-3 * {_shift(f, -1, axis)} + 4 * {f} - {_shift(f, 1, axis)}) / 2 / {_shift(FACE[axis][0], -1, axis)} ELSE {before} END"
            _, side, centre = FACE[axis]
            if side is None:
                both = f"0.5::DOUBLE * ({before} + f{f}{axis})"
            else:
                both = f"0.5::DOUBLE * ({_shift(side, -1, axis)} * ({before}) + {side} * f{f}{axis}) / ({centre})"
            centres.append(f"CASE WHEN {idx} = 0 THEN f{f}{axis} ELSE {both} END AS {name}")
    return f"faces AS (SELECT *, {', '.join(faces)} FROM {source}), grads AS (SELECT *, {', '.join(centres)} FROM faces)"


DIV = "dudx + dvdy + dwdz"
Q = "-0.5::DOUBLE * (dudx * dudx + dvdy * dvdy + dwdz * dwdz) - dudy * dvdx - dudz * dwdx - dvdz * dwdy"
UVW = ("u", "v", "w")
SIGMA = "sqrt(sum(e1t * e2t * (val - m) * (val - m)) / sum(e1t * e2t))"


def _sigma(source: str) -> str:
    """source(t, e1t, e2t, val) -> CTE sigmas(t, sigma)."""
    return f"""sv AS (SELECT * FROM ({source}) WHERE val IS NOT NULL), mv AS (SELECT t, sum(e1t * e2t * val) / sum(e1t * e2t) AS m FROM sv GROUP BY t),
sigmas AS (SELECT sv.t, {SIGMA} AS sigma FROM sv JOIN mv ON sv.t = mv.t GROUP BY sv.t)"""


def _region(x: str) -> str:
    return f"CASE WHEN {x} < -0.2::DOUBLE * sigma THEN 0 WHEN {x} > 0.2::DOUBLE * sigma THEN 2 WHEN {x} IS NOT NULL THEN 1 END"


OKUBO = f"""{WITH}, top AS (SELECT * FROM cells WHERE k = 0), {_grads('model1', ('u', 'v'), 'top', 'xy')},
ow AS (SELECT t, j, i, e1t, e2t, CASE WHEN coast > 0 THEN power(dudx - dvdy, 2) + power(dvdx + dudy, 2) - power(dvdx - dudy, 2) END AS val FROM grads),
{_sigma('SELECT * FROM ow')},
regions AS (SELECT t, k, j, i, val, {_region('val')} AS region FROM cells JOIN ow USING (t, j, i) JOIN sigmas USING (t))"""

COLUMN_REF = """refs AS (SELECT *, first_value(k) OVER c AS kref, first_value({v}) OVER c AS vref, first_value(depth) OVER c AS dref FROM {src}
  WINDOW c AS (PARTITION BY t, j, i ORDER BY abs(depth - 10), k))"""


def _mld(source: str, value: str, limit: str) -> str:
    return f"""{COLUMN_REF.format(v=value, src=source)},
mlds AS (SELECT *, coalesce(max(CASE WHEN coast > 0 AND abs({value} - vref) < {limit} THEN k END) OVER (PARTITION BY t, j, i), kref) AS mld_k FROM refs),
deep AS (SELECT *, 5 + 10::DOUBLE * mld_k AS mld, CASE WHEN k < mld_k THEN 1 ELSE 0 END AS mld_mask FROM mlds)"""


RHO_CELLS = f"{WITH}, wet AS (SELECT *, {_density('jmd94', True)} AS rho FROM cells)"


def _rossby(f: str) -> str:
    return f"""{RHO_CELLS}, {_mld('wet', 'temp', '0.2::DOUBLE')},
cols AS (SELECT t, j, i, max(depth) AS d, sum(rho * e3t) / sum(e3t) AS r1, sum(rho * e3t * mld_mask) / nullif(sum(e3t * mld_mask), 0) AS r2 FROM deep WHERE coast > 0 GROUP BY t, j, i)
SELECT {KEYS}, CASE WHEN coast > 0 THEN round(sqrt(9.81::DOUBLE * d) / {f} / 1000, 6) + 0.0 END AS r_ext,
  CASE WHEN coast > 0 THEN round(sqrt(9.81::DOUBLE * abs(r2 - r1) / r1 * mld) / {f} / 1000, 6) + 0.0 END AS r_int FROM deep LEFT JOIN cols USING (t, j, i)"""


def _winding(x: str, y: str) -> tuple[str, str]:
    corners = parse_polygon(POLYGON)
    wind, cross = [], []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        side = f"({x1 - x0}::DOUBLE * ({y} - {y0}::DOUBLE) - ({x} - {x0}::DOUBLE) * ({y1 - y0}::DOUBLE))"
        wind.append(f"CASE WHEN {y0} <= {y} AND {y1} > {y} AND {side} > 0 THEN 1 WHEN {y0} > {y} AND {y1} <= {y} AND {side} < 0 THEN -1 ELSE 0 END")
        cross.append(f"CASE WHEN ({y0} <= {y}) <> ({y1} <= {y}) AND {x} < {x0}::DOUBLE + ({y} - {y0}::DOUBLE) / ({y1 - y0}::DOUBLE) * ({x1 - x0}::DOUBLE) THEN 1 ELSE 0 END")
    return " + ".join(wind), " + ".join(cross)


DAILY = "daily AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS t, avg(o_totalprice) AS price FROM orders GROUP BY 1)"
MONTHS = "months AS (SELECT date_trunc('month', CAST(o_orderdate AS TIMESTAMP))::TIMESTAMP AS t, avg(o_totalprice) AS price FROM orders GROUP BY 1)"


def _bucket(reqs: str, data: str, value: str, closed: str = "<=") -> str:
    return f"WITH {DAILY}, ev AS (SELECT CAST(ts AS TIMESTAMP) AS t, value FROM events), req AS ({reqs}) SELECT label, count(*) AS n, round(avg({value}), 6) + 0.0 AS {value} FROM {data} JOIN req ON t >= s AND t {closed} e GROUP BY label, s"


def _series(start: str, end: str, step: str) -> str:
    return f"unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL {step}))"


def _span_requests(unit: str, fmt: str, start: str, end: str) -> str:
    return f"SELECT strftime(s, '{fmt}') AS label, s, s + INTERVAL 1 {unit} AS e FROM (SELECT {_series(start, end, '1 ' + unit)} AS s)"


LINE = "line AS (SELECT p AS pid, p * 5::DOUBLE AS depth, CAST(floor(p * 5 / 10.0::DOUBLE) AS BIGINT) AS k0 FROM (SELECT unnest(generate_series(0, 24)) AS p)), spots AS (SELECT pid, depth, CASE WHEN depth > 100 THEN NULL WHEN depth > 0 AND depth % 10 = 0 THEN k0 - 1 ELSE k0 END AS k FROM line)"


def _point(f: str) -> str:
    return f"SELECT c_custkey, c_custkey % 170 - 85 + 0.25::DOUBLE AS lat, c_custkey % 350 - 175 + 0.5::DOUBLE AS lon FROM customer"


def _projected(name: str) -> str:
    a, e = 6378137.0, math.sqrt((1 / 298.257223563) * (2 - 1 / 298.257223563))
    phi, lam = "radians(lat)", "radians(lon)"
    if name == "mercator":
        x = f"{a} * {lam} + 989634.3811336625"
        y = f"{a} * ln(tan(pi() / 4 + {phi} / 2) * power((1 - {e!r} * sin({phi})) / (1 + {e!r} * sin({phi})), {e / 2!r})) - 3512473.95569"
    elif name == "google":
        x, y = f"{a} * {lam}", f"{a} * ln(tan(pi() / 4 + {phi} / 2))"
    elif name == "cylindrical":
        x, y = f"{a} * {lam}", f"{a} * {phi}"
    elif name == "orthographic":
        n = f"{a} / sqrt(1 - {e * e!r} * power(sin({phi}), 2))"
        seen = f"cos({phi}) * cos({lam}) >= 0"
        x, y = f"CASE WHEN {seen} THEN {n} * cos({phi}) * sin({lam}) END", f"CASE WHEN {seen} THEN {n} * (1 - {e * e!r}) * sin({phi}) END"
    elif name == "satellite":
        l, p0, p = "radians(lon - 17.5::DOUBLE)", "radians(36.4::DOUBLE)", 1 + 6779000.0 / a
        c = f"(sin({p0}) * sin({phi}) + cos({p0}) * cos({phi}) * cos({l}))"
        k = f"({p - 1!r} / ({p!r} - {c}))"
        x = f"CASE WHEN {c} >= {1 / p!r} THEN {a} * {k} * cos({phi}) * sin({l}) END"
        y = f"CASE WHEN {c} >= {1 / p!r} THEN {a} * {k} * (cos({p0}) * sin({phi}) - sin({p0}) * cos({phi}) * cos({l})) END"
    elif name == "robinson":
        at, part = "CAST(least(floor(abs(lat) / 5), 17) AS INTEGER)", "(abs(lat) / 5 - least(floor(abs(lat) / 5), 17))"
        table = lambda values: f"({list(values)!r}[{at} + 1] * (1 - {part}) + {list(values)!r}[{at} + 2] * {part})"
        x, y = f"0.8487::DOUBLE * {a} * {table(ROBINSON_X)} * {lam}", f"1.3523::DOUBLE * {a} * {table(ROBINSON_Y)} * sign(lat)"
    elif name == "equal earth":
        qp = 1 + (1 - e * e) / (2 * e) * math.log((1 + e) / (1 - e))
        q = f"({1 - e * e!r} * (sin({phi}) / (1 - {e * e!r} * power(sin({phi}), 2)) - ln((1 - {e!r} * sin({phi})) / (1 + {e!r} * sin({phi}))) / {2 * e!r}))"
        th = f"asin({math.sqrt(3) / 2!r} * greatest(-1, least(1, {q} / {qp!r})))"
        c1, c2, c3, c4 = (f"({c!r}::DOUBLE)" for c in EQUAL_EARTH)
        slope = f"({c1} + 3 * {c2} * power({th}, 2) + 7 * {c3} * power({th}, 6) + 9 * {c4} * power({th}, 8))"
        radius = f"{a * math.sqrt(qp / 2)!r}"
        x = f"{radius} * {2 * math.sqrt(3)!r} * {lam} * cos({th}) / (3 * {slope})"
        y = f"{radius} * ({c1} * {th} + {c2} * power({th}, 3) + {c3} * power({th}, 7) + {c4} * power({th}, 9))"
    elif name == "mollweide":
        flat = 2 * math.sqrt(2) / math.pi * a
        return _newton("2 * th + sin(2 * th) - pi() * sin(phi)", "2 + 2 * cos(2 * th)", "phi", f"{flat!r} * lam * cos(th)", f"{math.sqrt(2) * a!r} * sin(th)")
    else:
        scale, high = 2 / math.sqrt(math.pi * (4 + math.pi)) * a, 2 * math.sqrt(math.pi / (4 + math.pi)) * a
        return _newton(f"th + sin(th) * cos(th) + 2 * sin(th) - {2 + math.pi / 2!r} * sin(phi)", "1 + cos(2 * th) + 2 * cos(th)", "phi / 2", f"{scale!r} * lam * (1 + cos(th))", f"{high!r} * sin(th)")
    return f"SELECT c_custkey, round({x}, 3) AS x, round({y}, 3) AS y FROM ({_point(name)})"


def _labels(source: str, least: int) -> str:
    """source ends in sp(t, k, j, i, speed, ..) and hot, the masked rows of it -> CTE named(t, k, j, i, vortex_id)."""
    text = f"""{WITH}, {source}, m AS (SELECT t, k, j, i, (k * 10 + j) * 16 + i AS id FROM hot),
pairs AS (SELECT a.t AS t, a.id AS a, b.id AS b FROM m a JOIN m b ON a.t = b.t AND abs(a.k - b.k) + abs(a.j - b.j) + abs(a.i - b.i) = 1),
reach AS (SELECT t, id, id AS root FROM m UNION SELECT p.t, p.a, r.root FROM reach r JOIN pairs p ON r.t = p.t AND r.id = p.b WHERE r.root < p.a),
comp AS (SELECT t, id, min(root) AS root FROM reach GROUP BY t, id), sized AS (SELECT *, count(*) OVER (PARTITION BY t, root) AS n FROM comp),
named AS (SELECT t, id // 160 AS k, id // 16 % 10 AS j, id % 16 AS i, dense_rank() OVER (PARTITION BY t ORDER BY root) AS vortex_id FROM sized WHERE n > {least})"""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _properties() -> str:
    return """, mem AS (SELECT sp.*, vortex_id, row_number() OVER (PARTITION BY sp.t, vortex_id ORDER BY speed DESC, sp.k, sp.j, sp.i) AS rn FROM sp JOIN named USING (t, k, j, i)),
ctr AS (SELECT t, vortex_id, x AS cx, y AS cy, z AS cz, u AS cu, v AS cv, w AS cw, speed AS cs FROM mem WHERE rn = 1)
SELECT t, vortex_id, count(*) AS n_cells, CAST(CASE WHEN any_value(cw) < 0 THEN -1 ELSE 1 END AS BIGINT) AS sign, round(avg(x), 6) + 0.0 AS bary_x, round(avg(y), 6) + 0.0 AS bary_y, round(avg(z), 6) + 0.0 AS bary_z,
  round(any_value(cx), 6) + 0.0 AS center_x, round(any_value(cy), 6) + 0.0 AS center_y, round(any_value(cz), 6) + 0.0 AS center_z,
  round(max(sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2))) FILTER (speed >= 0.05::DOUBLE * cs), 6) + 0.0 AS size,
  round(any_value(cu / cs), 6) + 0.0 AS rot_x, round(any_value(cv / cs), 6) + 0.0 AS rot_y, round(any_value(cw / cs), 6) + 0.0 AS rot_z,
  round(any_value(cs), 6) + 0.0 AS abs_strength, round(any_value(cs), 6) + 0.0 AS rel_strength, round(sum(e1t * e2t * w), 6) + 0.0 AS circulation FROM mem JOIN ctr USING (t, vortex_id) GROUP BY t, vortex_id"""


#: The gradient's rows less the real eigenvalue; two of them span the plane that the real eigenvector is normal to.
_LESS = [[f"d{c}d{r}" + (" - lr" if r == a else "") for r, a in zip("xyz", a3)] for c, a3 in zip(UVW, ("x__", "_y_", "__z"))]


def _normal(r: int, s: int) -> list[str]:
    p, q = _LESS[r], _LESS[s]
    return [f"(({p[b]}) * ({q[c]}) - ({p[c]}) * ({q[b]}))" for b, c in ((1, 2), (2, 0), (0, 1))]


def _rortex() -> str:
    minors = "dudx * dvdy - dudy * dvdx + dudx * dwdz - dudz * dwdx + dvdy * dwdz - dvdz * dwdy"
    det = "dudx * (dvdy * dwdz - dvdz * dwdy) - dudy * (dvdx * dwdz - dvdz * dwdx) + dudz * (dvdx * dwdy - dvdy * dwdx)"
    sides = ", ".join(f"{e} AS {a}{n}" for n, (r, s) in enumerate(((0, 1), (0, 2), (1, 2))) for a, e in zip("xyz", _normal(r, s)))
    best = lambda a: f"CASE WHEN n0 >= n1 AND n0 >= n2 THEN {a}0 WHEN n1 >= n2 THEN {a}1 ELSE {a}2 END"
    return f"""{WITH}, {_grads('model1', UVW)}, inv AS (SELECT *, {DIV} AS tr, {minors} AS mi, {det} AS de FROM grads),
pq AS (SELECT *, mi - tr * tr / 3 AS cp, -2 * tr * tr * tr / 27 + tr * mi / 3 - de AS cq FROM inv), dd AS (SELECT *, cq * cq / 4 + cp * cp * cp / 27 AS disc FROM pq),
rr AS (SELECT *, cbrt(-cq / 2 + sqrt(greatest(disc, 0))) + cbrt(-cq / 2 - sqrt(greatest(disc, 0))) + tr / 3 AS lr FROM dd),
ci AS (SELECT *, greatest(0, mi - lr * (tr - lr) - power((tr - lr) / 2, 2)) AS ci2, {sides} FROM rr),
nn AS (SELECT *, x0 * x0 + y0 * y0 + z0 * z0 AS n0, x1 * x1 + y1 * y1 + z1 * z1 AS n1, x2 * x2 + y2 * y2 + z2 * z2 AS n2 FROM ci),
bb AS (SELECT *, {best('x')} AS bx, {best('y')} AS by_, {best('z')} AS bz, sqrt(greatest(n0, n1, n2)) AS len FROM nn),
al AS (SELECT *, ((dwdy - dvdz) * bx + (dudz - dwdx) * by_ + (dvdx - dudy) * bz) / nullif(len, 0) AS al FROM bb),
sz AS (SELECT *, disc > 0 AND len > 0 AS spins, CASE WHEN disc > 0 AND len > 0 THEN abs(al) - sqrt(greatest(0, al * al - 4 * ci2)) ELSE 0 END AS size, CASE WHEN al < 0 THEN -1 ELSE 1 END AS sgn FROM al),
rortexes AS (SELECT *, CASE WHEN spins THEN size * sgn * bx / len ELSE 0 END AS rx, CASE WHEN spins THEN size * sgn * by_ / len ELSE 0 END AS ry, CASE WHEN spins THEN size * sgn * bz / len ELSE 0 END AS rz,
  CASE WHEN spins THEN al * al / 4 ELSE 0 END AS b2, CASE WHEN spins THEN greatest(0, al * al / 4 - ci2) ELSE 0 END AS a2 FROM sz)"""


RORTEX = _rortex()
_G = [[f"d{c}d{r}" for r in "xyz"] for c in UVW]
_SYM = "(power(dudx, 2) + power(dvdy, 2) + power(dwdz, 2) + (power(dudy + dvdx, 2) + power(dudz + dwdx, 2) + power(dvdz + dwdy, 2)) / 2)"
_ANTI = "((power(dudy - dvdx, 2) + power(dudz - dwdx, 2) + power(dvdz - dwdy, 2)) / 2)"
AB = f"ab AS (SELECT {KEYS}, {_SYM} AS a, {_ANTI} AS b FROM grads), es AS (SELECT t, 0.001::DOUBLE * greatest(0, max(b - a)) AS e FROM ab GROUP BY t)"


def _square(r: int, c: int) -> str:
    return f"0.5::DOUBLE * ({' + '.join(f'({_G[r][k]}) * ({_G[k][c]}) + ({_G[c][k]}) * ({_G[k][r]})' for k in range(3))})"


LAMBDA_CTES = f"""m AS (SELECT {KEYS}, {', '.join(f'{_square(r, c)} AS a{r}{c}' for r, c in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))} FROM grads),
n AS (SELECT *, (a00 + a11 + a22) / 3 AS q, a01 * a01 + a02 * a02 + a12 * a12 AS p1 FROM m), o3 AS (SELECT *, sqrt((power(a00 - q, 2) + power(a11 - q, 2) + power(a22 - q, 2) + 2 * p1) / 6) AS p FROM n),
r3 AS (SELECT *, ((a00 - q) * ((a11 - q) * (a22 - q) - a12 * a12) - a01 * (a01 * (a22 - q) - a12 * a02) + a02 * (a01 * a12 - (a11 - q) * a02)) / (2 * p * p * p) AS r FROM o3),
e3 AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS phi FROM r3)"""
LAMBDA2 = f"SELECT {KEYS}, round(3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), 7) + 0.0 AS lambda2 FROM e3"


def _newton(value: str, slope: str, start: str, x: str, y: str) -> str:
    """25 steps of Newton's method for theta, then x and y."""
    return f"""WITH RECURSIVE p AS (SELECT c_custkey, radians(lat) AS phi, radians(lon) AS lam FROM ({_point('')})),
n AS (SELECT c_custkey, phi, lam, {start} AS th, 0 AS step FROM p UNION ALL SELECT c_custkey, phi, lam, CASE WHEN abs({slope}) < 1e-12 THEN th ELSE th - ({value}) / ({slope}) END, step + 1 FROM n WHERE step < 25)
SELECT c_custkey, round({x}, 3) AS x, round({y}, 3) AS y FROM n WHERE step = 25"""


def oracle_sql() -> dict[str, str]:
    line = "SELECT CAST(l_linenumber AS BIGINT) AS layer, l_quantity AS w, l_extendedprice AS v, l_orderkey, l_partkey, l_suppkey FROM lineitem"
    long = "SELECT t, k AS layer, 'temp' AS variable, {w} AS w, temp AS v, k, j, i FROM cells UNION ALL SELECT t, k, 'sal', {w}, sal, k, j, i FROM cells"
    levels = "SELECT t, CAST(CASE WHEN depth < 20 THEN 0 WHEN depth < 50 THEN 1 ELSE 2 END AS BIGINT) AS layer, 'temp' AS variable, e1t * e2t AS w, temp AS v, k, j, i FROM cells"
    profile = "profile AS (SELECT t, basin, coast, k, sum(e1t * e2t * temp) / sum(e1t * e2t) AS mean, max(temp) AS max FROM cells GROUP BY t, basin, coast, k)"
    wind, cross = _winding("x", "y")
    speed = "vs AS (SELECT *, sqrt(u * u + v * v + w * w) AS val FROM cells)"
    surface = _labels("sp AS (SELECT *, sqrt(u * u + v * v + w * w) AS speed FROM cells WHERE k = 0), hot AS (SELECT * FROM sp WHERE speed > 0.23)", 2)
    volume = _labels(f"{speed}, {_sigma('SELECT t, e1t, e2t, val FROM vs')}, sp AS (SELECT vs.*, vs.val AS speed FROM vs), hot AS (SELECT sp.* FROM sp JOIN sigmas ON sp.t = sigmas.t WHERE speed > 0.5::DOUBLE * {FASTEST} * sigma)", 5)
    fast = volume.replace(f"* {FASTEST} *", f"* {FAST} *")
    ab = f"{WITH}, {_grads('model1', UVW)}, {AB}"
    own = {
        "spatial_stats_layer": "WITH " + _stats(line, "layer", "l_orderkey, l_partkey, l_suppkey, w", MOMENTS),
        "weighted_percentiles": "WITH " + _stats(line, "layer", "l_orderkey, l_partkey, l_suppkey, w", tuple(PERCENT)),
        "spatial_stats_cells": f"{WITH}, " + _stats(long.format(w="e1t * e2t"), "t, layer, variable", "k, j, i", ALL),
        "spatial_stats_volume": f"{WITH}, " + _stats(long.format(w="e1t * e2t * e3t"), "t, layer, variable", "k, j, i", MOMENTS),
        "spatial_stats_user_levels": f"{WITH}, " + _stats(levels, "t, layer, variable", "k, j, i", ALL),
        "stats_to_cells": f"{WITH}, st AS ({'WITH ' + _stats(long.format(w='e1t * e2t'), 't, layer, variable', 'k, j, i', ('mean', 'p50'))}) SELECT {KEYS}, mean AS temp_mean, p50 AS temp_p50 FROM cells JOIN st ON cells.t = st.t AND cells.k = st.layer WHERE variable = 'temp'".replace(f"SELECT {KEYS}, mean", "SELECT cells.t AS t, k, j, i, mean"),
        "stats_from_profile": f"{WITH}, {profile} SELECT {KEYS}, round(mean, 6) + 0.0 AS mean, round(max, 6) + 0.0 AS max FROM cells JOIN profile USING (t, basin, coast, k)",
        "vertical_mean": f"{WITH} SELECT t, j, i, round(sum(e3t * temp) / sum(e3t), 6) + 0.0 AS temp FROM cells GROUP BY t, j, i",
        "merge_moments": f"WITH s AS ({line}), m AS (SELECT layer, sum(w * v) / sum(w) AS m FROM s GROUP BY layer) SELECT s.layer AS layer, round(sum(w), 2) + 0.0 AS w, round(any_value(m), 4) + 0.0 AS mean, round(sqrt(sum(w * (v - m) * (v - m)) / sum(w)), 4) AS std FROM s JOIN m ON s.layer = m.layer GROUP BY s.layer",
        "variable_aggregate": f"{WITH} SELECT {KEYS}, round(u + v + w + sal, 9) + 0.0 AS total FROM cells",
        "variable_aggregate_xml": "SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax + l_discount, 4) + 0.0 AS charge FROM lineitem",
        "compare_variables_max": f"{WITH} SELECT {KEYS}, CASE WHEN u >= v AND u >= w THEN 1.0::DOUBLE WHEN v >= w THEN 2 ELSE 3 END AS comparison FROM cells",
        "compare_variables_min": f"{WITH} SELECT {KEYS}, CASE WHEN u <= v AND u <= w THEN 1.0::DOUBLE WHEN v <= w THEN 2 ELSE 3 END AS comparison FROM cells",
        "vector_magnitude": f"{WITH} SELECT {KEYS}, round(sqrt(u * u + v * v + w * w), 9) AS speed FROM cells",
        "annotate_date_time": "SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M at %S') AS annotation FROM orders",
        "annotate_step_value": "SELECT l_orderkey, l_linenumber, strftime(CASE WHEN l_linenumber = 2 THEN CAST(l_shipdate AS TIMESTAMP) + INTERVAL 390 minute ELSE TIMESTAMP '2000-01-01' + to_seconds(CAST(floor((l_orderkey % 9000 * 3 + l_linenumber * 0.25::DOUBLE) * 3600) AS BIGINT)) END, '%d/%m/%Y %H:%M:%S') AS annotation FROM lineitem",
        "zero_to_missing": "SELECT count(nullif(l_discount, 0)) AS present, count(*) AS every FROM lineitem",
        "uvw_to_t": f"""{WITH} SELECT {KEYS},
  round(CASE WHEN i = 0 THEN u ELSE 0.5::DOUBLE * (lag(e2u * e3u * u) OVER (PARTITION BY t, k, j ORDER BY i) + e2u * e3u * u) / (e2t * e3t) END, 9) + 0.0 AS u_t,
  round(CASE WHEN j = 0 THEN v ELSE 0.5::DOUBLE * (lag(e1v * e3v * v) OVER (PARTITION BY t, k, i ORDER BY j) + e1v * e3v * v) / (e1t * e3t) END, 9) + 0.0 AS v_t,
  round(CASE WHEN k = 0 THEN w ELSE 0.5::DOUBLE * (lag(w) OVER (PARTITION BY t, j, i ORDER BY k) + w) END, 9) + 0.0 AS w_t FROM cells""",
        "select_basin": f"{WITH} SELECT {KEYS}, CAST(basin AS BIGINT) AS chosen FROM cells WHERE basin IN (0, 8, 12)",
        "select_coast": f"{WITH} SELECT {KEYS} FROM cells WHERE coast = 2",
        "select_land": f"{WITH} SELECT {KEYS} FROM cells WHERE land BETWEEN 0.5 AND 1",
        "select_polygon": f"{WITH} SELECT {KEYS} FROM cells WHERE ({wind}) <> 0",
        "select_polygon_crossing": f"{WITH} SELECT {KEYS} FROM cells WHERE ({cross}) % 2 = 0",
        "select_time_period": "SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-02-28'",
        "select_okubo_weiss": f"{OKUBO} SELECT {KEYS}, region FROM regions WHERE region IN (0, 2)",
        "okubo_weiss": f"{OKUBO} SELECT {KEYS}, round(val, 8) + 0.0 AS okubo_weiss, region FROM regions",
        "land_outline": f"{WITH}, s AS (SELECT t, j, i, land FROM cells WHERE k = 0) SELECT a.t, a.j, a.i FROM s a WHERE a.land = 1 AND EXISTS (SELECT 1 FROM s b WHERE b.t = a.t AND b.land = 0 AND abs(a.j - b.j) + abs(a.i - b.i) = 1)",
        "time_average": f"WITH {DAILY} SELECT 'period' AS label, count(*) AS n, round(avg(price), 6) + 0.0 AS price FROM daily WHERE t BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-02-28'",
        "time_agg_daily": _bucket(_span_requests("day", "%Y%m%d", "2024-01-01", "2024-01-31"), "ev", "value"),
        "time_agg_weekly": _bucket(f"SELECT strftime(d, '%Y%m%d') AS label, d - INTERVAL 84 hour + INTERVAL 12 hour AS s, d + INTERVAL 96 hour - INTERVAL 1 second AS e FROM (SELECT {_series('2023-12-25', '2024-02-05', '7 day')} AS d)", "ev", "value"),
        "time_agg_monthly": _bucket(_span_requests("month", "%Y%m", "1995-01-01", "2001-08-01"), "daily", "price"),
        "time_agg_monthly_left": _bucket(_span_requests("month", "%Y%m", "1995-01-01", "2001-08-01"), "daily", "price", "<"),
        "time_agg_seasonal": _bucket(f"SELECT strftime(s, '%Y') || ' ' || CASE month(s) WHEN 1 THEN 'win' WHEN 4 THEN 'spr' WHEN 7 THEN 'sum' ELSE 'fal' END AS label, s, s + INTERVAL 3 month AS e FROM (SELECT {_series('1995-01-01', '2001-07-01', '3 month')} AS s)", "daily", "price"),
        "time_agg_yearly": _bucket(_span_requests("year", "%Y", "1995-01-01", "2001-08-01"), "daily", "price"),
        "time_agg_decadal": _bucket("SELECT '1990...2000' AS label, TIMESTAMP '1990-01-01' AS s, TIMESTAMP '2000-01-01' AS e UNION ALL SELECT '2000...2010', TIMESTAMP '2000-01-01', TIMESTAMP '2010-01-01'", "daily", "price"),
        "time_agg_overlap": f"""WITH {MONTHS}, req AS (SELECT strftime(d, '%Y%m%d') AS label, d + INTERVAL 12 hour - INTERVAL 540 hour AS s, d + INTERVAL 12 hour + INTERVAL 540 hour AS e FROM (SELECT {_series('1995-02-01', '2001-06-01', '45 day')} AS d)),
ov AS (SELECT label, price, greatest(0, epoch(least(e, t + INTERVAL 1 month)) - epoch(greatest(s, t))) AS w FROM months, req WHERE s < t + INTERVAL 1 month AND t < e)
SELECT label, count(*) AS n, round(sum(w), 0) + 0.0 AS weight, round(sum(w * price) / sum(w), 6) + 0.0 AS price FROM ov WHERE w > 0 GROUP BY label""",
        "climatology_season": f"WITH {DAILY} SELECT CAST((month(t) - 1) // 3 AS BIGINT) AS bucket, count(*) AS n, round(avg(price), 6) + 0.0 AS price FROM daily GROUP BY 1",
        "climatology_month": f"WITH {DAILY} SELECT month(t) AS bucket, count(*) AS n, round(avg(price), 6) + 0.0 AS price FROM daily GROUP BY 1",
        "climatology_day": f"WITH {DAILY} SELECT month(t) * 100 + day(t) AS bucket, count(*) AS n, round(avg(price), 6) + 0.0 AS price FROM daily GROUP BY 1",
        "climatology_month_coarse": f"WITH {MONTHS}, days AS (SELECT month(t) AS bucket, price, datediff('day', t, t + INTERVAL 1 month) AS d FROM months) SELECT bucket, CAST(sum(d) AS BIGINT) AS n, round(sum(d * price) / sum(d), 6) + 0.0 AS price FROM days GROUP BY bucket",
        "infer_frequency": "WITH g AS (SELECT epoch(lead(t) OVER (ORDER BY t)) - epoch(t) AS secs FROM (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)), m AS (SELECT secs, count(*) AS n FROM g WHERE secs IS NOT NULL GROUP BY secs ORDER BY n DESC, secs LIMIT 1) SELECT CASE WHEN secs = 86400 THEN 'daily' ELSE 'other' END AS freq, CAST(secs AS BIGINT) AS secs FROM m",
        "generate_steps": "WITH e AS (SELECT CAST(min(o_orderdate) AS TIMESTAMP) AS a, CAST(max(o_orderdate) AS TIMESTAMP) AS b FROM orders) SELECT strftime(a + n * INTERVAL 1 month, '%Y%m%d') AS step FROM e, (SELECT unnest(generate_series(0, 1200)) AS n) WHERE a + n * INTERVAL 1 month <= b",
        "merge_steps": """WITH RECURSIVE a AS (SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS t FROM events UNION SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) + INTERVAL 12 hour FROM events),
stays AS (SELECT min(t) AS t FROM a UNION ALL SELECT (SELECT min(a.t) FROM a WHERE a.t >= stays.t + INTERVAL 1 day) FROM stays WHERE t IS NOT NULL) SELECT strftime(t, '%Y%m%d%H') AS step FROM stays WHERE t IS NOT NULL""",
        "couple_times": f"""WITH a AS (SELECT {_series('2024-01-02 12:00:00', '2024-01-30 12:00:00', '7 day')} AS t) SELECT strftime(a.t, '%Y%m%d') AS step, count(*) AS n_obs, min(event_id) AS first_id
FROM a JOIN events ON CAST(ts AS TIMESTAMP) BETWEEN a.t - INTERVAL 84 hour AND a.t + INTERVAL 84 hour - INTERVAL 1 second GROUP BY a.t""",
        "nearest_time": f"""WITH a AS (SELECT {_series('2024-01-02 12:00:00', '2024-01-30 12:00:00', '3 day')} AS t), ev AS (SELECT event_id, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS s FROM events)
SELECT event_id AS id, strftime(arg_min(t, abs(s - epoch(t)) * 1000000 + epoch(t) / 1000000), '%Y%m%d') AS step FROM ev, a GROUP BY event_id""",
        "first_containing": "SELECT strftime(min(CAST(o_orderdate AS TIMESTAMP)), '%Y%m%d') AS step FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) BETWEEN TIMESTAMP '1996-03-03 10:00:00' AND TIMESTAMP '1997-01-01'",
        "depth_profile": f"{WITH}, {LINE} SELECT t, pid, round(spots.depth, 4) + 0.0 AS depth, round(temp, 6) + 0.0 AS temp, round(sal, 6) + 0.0 AS sal FROM spots JOIN cells ON cells.k = spots.k WHERE j = 4 AND i = 12",
        "hovmoeller": f"{WITH}, {LINE}, ts AS (SELECT DISTINCT t FROM cells) SELECT ts.t AS t, pid, round(spots.depth, 4) + 0.0 AS depth, round(coalesce(temp, 0), 6) + 0.0 AS value FROM spots CROSS JOIN ts LEFT JOIN cells ON cells.k = spots.k AND cells.t = ts.t AND j = 4 AND i = 12",
        "hovmoeller_from_profile": f"{WITH}, {LINE}, p AS (SELECT t, k, sum(e1t * e2t * temp) / sum(e1t * e2t) AS mean FROM cells WHERE basin = 3 AND coast = 2 GROUP BY t, k), ts AS (SELECT DISTINCT t FROM cells) SELECT ts.t AS t, pid, round(depth, 4) + 0.0 AS depth, round(coalesce(mean, 0), 6) + 0.0 AS value FROM spots CROSS JOIN ts LEFT JOIN p ON p.k = spots.k AND p.t = ts.t",
        "spaghetti": f"{WITH} SELECT t, round(temp, 6) + 0.0 AS value FROM cells WHERE j = 4 AND i = 12 AND k = 3",
        "spaghetti_depth_mean": f"{WITH} SELECT t, round(sum(e3t * temp) / sum(e3t), 6) + 0.0 AS value FROM cells WHERE j = 4 AND i = 12 GROUP BY t",
        "scatter_to_grid": f"{WITH} SELECT {KEYS}, CASE WHEN coast = 2 THEN round(temp, 6) + 0.0 ELSE 1e20::DOUBLE END AS temp FROM cells",
        "derivatives": f"{WITH}, {_grads('model1', UVW)} SELECT {KEYS}, round({DIV}, 8) + 0.0 AS div, round(dwdy - dvdz, 8) + 0.0 AS curl_x, round(dudz - dwdx, 8) + 0.0 AS curl_y, round(dvdx - dudy, 8) + 0.0 AS curl_z, round({Q}, 8) + 0.0 AS q FROM grads",
        "q_criterion": f"{WITH}, {_grads('model1', UVW)}, qs AS (SELECT {KEYS}, e1t, e2t, CASE WHEN coast > 0 THEN {Q} END AS q, -2 * CASE WHEN coast > 0 THEN {Q} END AS val FROM grads), {_sigma('SELECT * FROM qs')} SELECT qs.t AS t, k, j, i, round(q, 8) + 0.0 AS q, {_region('val')} AS region FROM qs JOIN sigmas ON qs.t = sigmas.t",
        "lambda2": f"{WITH}, {_grads('model1', UVW)}, {LAMBDA_CTES} {LAMBDA2}",
        "omega": f"{ab} SELECT ab.t AS t, k, j, i, round(b / (a + b + e), 7) + 0.0 AS omega FROM ab JOIN es ON ab.t = es.t",
        "omega_modified": f"{ab} SELECT ab.t AS t, k, j, i, round((b + e) / (a + b + 2 * e), 7) + 0.0 AS omega FROM ab JOIN es ON ab.t = es.t",
        "mixed_layer_depth": f"{WITH}, {_mld('cells', 'temp', '0.2::DOUBLE')} SELECT {KEYS}, mld_k, mld, mld_mask FROM deep",
        "mixed_layer_depth_rho": f"{RHO_CELLS}, {_mld('wet', 'rho', '0.3::DOUBLE')} SELECT {KEYS}, mld_k, mld FROM deep",
        "mixed_layer_depth_first": f"""{WITH}, {COLUMN_REF.format(v='temp', src='cells')}, far AS (SELECT *, min(CASE WHEN coast > 0 AND k > kref AND abs(temp - vref) >= 0.2::DOUBLE THEN k END) OVER (PARTITION BY t, j, i) AS kf FROM refs),
ends AS (SELECT *, coalesce(max(CASE WHEN coast > 0 AND abs(temp - vref) < 0.2::DOUBLE AND (kf IS NULL OR k < kf) THEN k END) OVER (PARTITION BY t, j, i), kref) AS mld_k FROM far) SELECT {KEYS}, mld_k, 5 + 10::DOUBLE * mld_k AS mld FROM ends""",
        "rossby_radius": _rossby("0.0001::DOUBLE"),
        "rossby_radius_latitude": _rossby("(2 * 7.2921e-5::DOUBLE * sin(radians(lat)))"),
        "moving_average": f"""WITH {DAILY}, n AS (SELECT t, price, row_number() OVER y AS p, count(*) OVER (PARTITION BY year(t)) AS c FROM daily WINDOW y AS (PARTITION BY year(t) ORDER BY t)),
h AS (SELECT *, least(2, p - 1, c - p) AS h FROM n) SELECT strftime(a.t, '%Y%m%d') AS day, round(avg(b.price), 7) + 0.0 AS price_smooth FROM h a JOIN h b ON year(a.t) = year(b.t) AND b.p BETWEEN a.p - a.h AND a.p + a.h GROUP BY a.t""",
        "vortex_mask": f"{WITH}, {speed}, {_sigma('SELECT t, e1t, e2t, val FROM vs')} SELECT vs.t AS t, k, j, i, CAST(val > 0.5::DOUBLE * {FASTEST} * sigma AS BIGINT) AS mask FROM vs JOIN sigmas ON vs.t = sigmas.t",
        "vortex_components": f"{fast} SELECT t, k, j, i, vortex_id FROM named",
        "vortex_components_surface": f"{surface} SELECT t, j, i, vortex_id FROM named",
        "vortex_properties": volume + _properties(),
        "vortex_properties_surface": surface + _properties(),
        "vortex_mean_strengths": f"{fast} SELECT t, vortex_id, round(sum(e1t * e2t * speed) / sum(e1t * e2t), 6) + 0.0 AS abs_strength, round(sum(e1t * e2t * temp) / sum(e1t * e2t), 6) + 0.0 AS rel_strength FROM sp JOIN named USING (t, k, j, i) GROUP BY t, vortex_id",
        "vortex_mask_okubo_weiss": f"""{OKUBO}, sea AS (SELECT t, k, e1t, e2t, val FROM regions JOIN cells USING (t, k, j, i) WHERE coast > 0), mm AS (SELECT t, sum(e1t * e2t * val) / sum(e1t * e2t) AS m FROM sea GROUP BY t),
ss AS (SELECT sea.t, {SIGMA} AS s FROM sea JOIN mm ON sea.t = mm.t GROUP BY sea.t) SELECT regions.t AS t, k, j, i, CAST(coalesce(val < -0.2::DOUBLE * s, false) AS BIGINT) AS mask FROM regions JOIN ss ON regions.t = ss.t""",
        "vortex_mask_rortex": f"""{RORTEX}, vs AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS val FROM rortexes), {_sigma('SELECT t, e1t, e2t, val FROM vs')}
SELECT vs.t AS t, k, j, i, CAST(val > 0.2::DOUBLE * sigma AS BIGINT) AS mask FROM vs JOIN sigmas ON vs.t = sigmas.t""",
        "rortex": f"""{RORTEX}, vs AS (SELECT *, size AS val FROM rortexes), {_sigma('SELECT t, e1t, e2t, val FROM vs')}, ro AS (SELECT t AS t0, 0.001::DOUBLE * greatest(0, max(b2 - a2)) AS e FROM rortexes GROUP BY t)
SELECT vs.t AS t, k, j, i, round(rx, 7) + 0.0 AS rortex_x, round(ry, 7) + 0.0 AS rortex_y, round(rz, 7) + 0.0 AS rortex_z, round(b2 / nullif(a2 + b2 + e, 0), 7) + 0.0 AS omega_r, CAST(size > 0.2::DOUBLE * sigma AS INTEGER) AS rortex_mask
FROM vs JOIN sigmas ON vs.t = sigmas.t JOIN ro ON vs.t = t0""",
        "gradient_outputs": f"""{RORTEX}, ro AS (SELECT t AS t0, 0.001::DOUBLE * greatest(0, max(b2 - a2)) AS e FROM rortexes GROUP BY t), o AS (SELECT ab.t AS t, k, j, i, round(b / (a + b + e), 7) + 0.0 AS omega FROM ab JOIN es ON ab.t = es.t),
l AS ({LAMBDA2}) SELECT r.t AS t, k, j, i, round({DIV}, 7) + 0.0 AS div, round(dwdy - dvdz, 7) + 0.0 AS curl_x, round(dudz - dwdx, 7) + 0.0 AS curl_y, round(dvdx - dudy, 7) + 0.0 AS curl_z, round({Q}, 7) + 0.0 AS q, lambda2, omega,
  round(rx, 7) + 0.0 AS rortex_x, round(ry, 7) + 0.0 AS rortex_y, round(rz, 7) + 0.0 AS rortex_z, round(b2 / nullif(a2 + b2 + e, 0), 7) + 0.0 AS omega_r
FROM rortexes r JOIN ro ON r.t = t0 JOIN l USING (t, k, j, i) JOIN o USING (t, k, j, i)""".replace("rortexes AS (", f"{AB}, {LAMBDA_CTES}, rortexes AS (", 1),
        "data_columns": f"{WITH} SELECT {KEYS}, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in ("u", "v", "w", "temp", "sal", "z", "lat", "basin")) + " FROM cells",
        "tail_range": "WITH n AS (SELECT o_orderkey AS id, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS n FROM orders) SELECT id FROM n WHERE n >= 3 AND n < 10",
        "missing_to": "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 30000 THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_extendedprice < 30000 THEN l_extendedprice ELSE 0 END AS zeroed FROM lineitem",
        "couple_seconds": f"""WITH a AS (SELECT {_series('2024-01-02 12:00:00', '2024-01-30 12:00:00', '6 hour')} AS t) SELECT strftime(a.t, '%Y%m%d%H') AS step, count(*) AS n_obs, min(event_id) AS first_id
FROM a JOIN events ON CAST(ts AS TIMESTAMP) BETWEEN a.t - INTERVAL 1 hour AND a.t + INTERVAL 1 hour GROUP BY a.t""",
        "mercator_round_trip": "SELECT c_custkey, c_custkey % 350 - 175 + 0.0::DOUBLE AS lon, c_custkey % 170 - 85 + 0.0::DOUBLE AS lat FROM customer",
        "file_names": "WITH n AS (SELECT p_partkey, printf('ave.%08d-12:00:00.', p_partkey) || p_brand || '.nc' AS name FROM part) SELECT p_partkey, split_part(name, '.', 2) AS date, split_part(name, '.', 3) AS variable, replace(replace(replace(name || ' (x)', ' ', '_'), '(', ''), ')', '') AS clean FROM n",
        "daily_buckets": "SELECT strftime(CAST(ts AS TIMESTAMP), '%Y%m%d') AS day, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY 1",
    }
    own |= {f"density_{m}": f"{WITH} SELECT {KEYS}, round({_density(m, True)}, 6) + 0.0 AS rho FROM cells" for m in ("lin_t", "lin_ts", "jmd94", "jaot12", "jaot20")}
    own |= {f"density_{m}_surface": f"{WITH} SELECT {KEYS}, round({_density(m, False)}, 6) + 0.0 AS rho FROM cells" for m in ("jmd94", "jaot12", "jaot20")}
    own |= {f"grad_{s}": f"{WITH}, {_grads(s, ('temp',))} SELECT {KEYS}, " + ", ".join(f"round(dtempd{x}, 9) + 0.0 AS dtempd{x}" for x in "xyz") + " FROM grads" for s in SCHEMES}
    own |= {f"project_{p.replace(' ', '_')}": _projected(p) for p in PROJECTED}
    return own
