"""Sea-water density from temperature (deg C), salinity and depth (m, positive down)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polynomial coefficients in rising powers of temperature unless said otherwise.
PURE_WATER = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
SALT_1 = (0.824493, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
SALT_3_2 = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
SALT_2 = 4.8314e-4

JMD94_E = (-2.595994e-6, -1.248266e-8, -3.508914e-8)
JMD94_BW = (1.045941e-4, -5.782165e-9, 1.296821e-6)
JMD94_D = -2.042967e-2
JMD94_C = (0.1571896, 2.598241e-3, -7.267926e-5)
JMD94_AW = (-4.721788, -0.1028859, 2.512549e-3, 5.939910e-6)
JMD94_B1 = (-55.87545, 7.390729, -0.1909078)
JMD94_A1 = (1044.077, -65.00517, 1.553190, 2.326469e-3)
JMD94_KW = (190925.6, 2098.925, -30.41638, -1.852732e-2, -1.361629e-4)

BULK_FRESH = (1.965933e4, 1.444304e2, -1.706103, 9.648704e-3, -4.190253e-5)
BULK_SALT = (5.284855e1, -3.101089e-1, 6.283263e-3, -5.084188e-5)
BULK_SALT_3_2 = (3.886640e-1, 9.085835e-3, -4.619924e-4)
BULK_P = (3.186519, 2.212276e-2, -2.984642e-4, 1.956415e-6)
BULK_P_SALT = (6.704388e-3, -1.847318e-4, 2.059331e-7)
BULK_P_SALT_3_2 = 1.480266e-4
BULK_P2 = (2.102898e-4, -1.202016e-5, 1.394680e-7)
BULK_P2_SALT = (-2.040237e-6, 6.128773e-8, 6.207323e-10)

MDJWF_NUM_T = (9.99843699e2, 7.35212840, -5.45928211e-2, 3.98476704e-4)
MDJWF_NUM_S, MDJWF_NUM_ST, MDJWF_NUM_SS = 2.96938239, -7.23268813e-3, 2.12382341e-3
MDJWF_NUM_P, MDJWF_NUM_PTT, MDJWF_NUM_PS = 1.04004591e-2, 1.03970529e-7, 5.18761880e-6
MDJWF_NUM_PP, MDJWF_NUM_PPTT = -3.24041825e-8, -1.23869360e-11
MDJWF_DEN_T = (1.0, 7.28606739e-3, -4.60835542e-5, 3.68390573e-7, 1.80809186e-10)
MDJWF_DEN_S = (2.14691708e-3, -9.27062484e-6, 0.0, -1.78343643e-10)
MDJWF_DEN_S_3_2 = (4.76534122e-6, 0.0, 1.63410736e-9)
MDJWF_DEN_P, MDJWF_DEN_PPTTT, MDJWF_DEN_PPPT = 5.30848875e-6, -3.03175128e-16, -1.27934137e-17

GRAVITY, WATER = 9.80665, 997.0474


def polynomial(coefficients, x: Column) -> Column:
    """Horner form of a polynomial with coefficients in rising powers."""
    return reduce(lambda acc, c: acc * x + c, list(reversed(coefficients))[1:], F.lit(float(coefficients[-1])))


def linear_t(temp: Column, rho0: float = 1020.0, alpha: float = 2e-4) -> Column:
    return rho0 * (0.028 - alpha * temp) + rho0


def linear_ts(temp: Column, salt: Column, rho0: float = 1020.0, alpha: float = 2e-4, beta: float = 0.001) -> Column:
    return rho0 * (beta * salt - alpha * temp) + rho0


def surface_density(temp: Column, salt: Column, root: Column) -> Column:
    return polynomial(PURE_WATER, temp) + salt * (polynomial(SALT_1, temp) + root * polynomial(SALT_3_2, temp) + SALT_2 * salt)


def jmd94(temp: Column, salt: Column, depth: Column) -> Column:
    root = F.sqrt(F.abs(salt))
    stiff = (polynomial(JMD94_B1, temp) * root + polynomial(JMD94_A1, temp)) * salt + polynomial(JMD94_KW, temp)
    first = (JMD94_D * root + polynomial(JMD94_C, temp)) * salt + polynomial(JMD94_AW, temp)
    second = polynomial(JMD94_BW, temp) + polynomial(JMD94_E, temp) * salt
    return surface_density(temp, salt, root) / (1 - depth / (stiff - depth * (first - depth * second)))


def bar(depth: Column) -> Column:
    return depth * (GRAVITY * WATER * 1e-5)


def jaot12(temp: Column, salt: Column, depth: Column) -> Column:
    root, p = F.sqrt(salt), bar(depth)
    bulk = polynomial(BULK_FRESH, temp) + salt * (polynomial(BULK_SALT, temp) + root * polynomial(BULK_SALT_3_2, temp))
    bulk = bulk + p * (polynomial(BULK_P, temp) + salt * (polynomial(BULK_P_SALT, temp) + root * BULK_P_SALT_3_2))
    bulk = bulk + p * p * (polynomial(BULK_P2, temp) + salt * polynomial(BULK_P2_SALT, temp))
    return surface_density(temp, salt, root) / (1 - p / bulk)


def jaot20(temp: Column, salt: Column, depth: Column) -> Column:
    root, p = F.sqrt(salt), bar(depth) * 10
    num = polynomial(MDJWF_NUM_T, temp) + salt * (MDJWF_NUM_S + MDJWF_NUM_ST * temp + MDJWF_NUM_SS * salt)
    num = num + p * (MDJWF_NUM_P + MDJWF_NUM_PTT * temp * temp + MDJWF_NUM_PS * salt + p * (MDJWF_NUM_PP + MDJWF_NUM_PPTT * temp * temp))
    den = polynomial(MDJWF_DEN_T, temp) + salt * (polynomial(MDJWF_DEN_S, temp) + root * polynomial(MDJWF_DEN_S_3_2, temp))
    den = den + p * (MDJWF_DEN_P + p * temp * (MDJWF_DEN_PPTTT * temp * temp + MDJWF_DEN_PPPT * p))
    return num / den


#: Methods by number and name, in the order of the user interface.
METHODS = ("lin_t", "lin_ts", "jmd94", "jaot12", "jaot20", "teos10")


def density(temp: Column, salt: Column, depth: Column | None = None, method: int | str = 2, rho0: float = 1020.0, alpha: float = 2e-4, beta: float = 0.001) -> Column:
    """Density in kg/m3; without depth the pressure terms are those of the surface."""
    name = METHODS[method] if isinstance(method, int) else method
    deep = depth if depth is not None else F.lit(0.0)
    if name == "lin_t":
        return linear_t(temp, rho0, alpha)
    if name == "lin_ts":
        return linear_ts(temp, salt, rho0, alpha, beta)
    if name in ("jmd94", "jaot12", "jaot20"):
        return {"jmd94": jmd94, "jaot12": jaot12, "jaot20": jaot20}[name](temp, salt, deep)
    raise NotImplementedError(f"density method {name}")
