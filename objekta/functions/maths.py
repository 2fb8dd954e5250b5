"""Math functions. What Spark has is Spark's; the rest are Arrow-batched pandas UDFs, of numpy expressions over whole batches but for erf, erfc and gamma."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAME = "acos asin atan atan2 cos sin tan cosh sinh tanh acosh asinh atanh exp log10 expm1 log1p pow sqrt cbrt hypot rint".split()


def builtin(name: str, *columns: Column) -> Column:
    """A function that Spark has under the same name."""
    if name not in SAME:
        raise KeyError(f"{name} is not one of {', '.join(SAME)}")
    return getattr(F, name)(*columns)


def log(x: Column) -> Column:
    return F.ln(x)


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def fabs(x: Column) -> Column:
    return F.abs(x)


def fmod(x: Column, y: Column) -> Column:
    """The sign is that of x."""
    return x.cast("double") % y.cast("double")


def isnan(x: Column) -> Column:
    return F.isnan(x).cast("int")


def logb(x: Column) -> Column:
    """Binary exponent of a finite number other than 0, as a double."""
    return ilogb(x).cast("double")


def _batch(fn, kind: str, *columns: Column) -> Column:
    """fn of float arrays, over the rows in which no argument is null; the others are null."""

    @F.pandas_udf(kind)
    def apply(*series: pd.Series) -> pd.Series:
        values = [s.to_numpy(dtype=np.float64, na_value=np.nan) for s in series]
        known = ~np.logical_or.reduce([s.isna().to_numpy() for s in series])
        out = pd.Series(np.full(len(known), None, dtype=object))
        if known.any():
            with np.errstate(all="ignore"):
                out[known] = fn(*[v[known] for v in values])
        return out

    return apply(*columns)


def _each(fn):
    """numpy has no such function: the C library's own, value by value within the batch."""
    return lambda values: np.frompyfunc(fn, 1, 1)(values)


def _lgamma(x: float) -> float:
    return math.inf if x <= 0 and x == math.floor(x) else math.lgamma(x)


def _remainder(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x less the multiple of y that is nearest, the even one of two: exact, as fmod and these subtractions are."""
    b = np.abs(y)
    twice = np.isfinite(2 * b)
    a = np.where(twice, np.fmod(np.abs(x), np.where(twice, 2 * b, 1.0)), np.abs(x))
    over = a > b / 2
    a = np.where(over, a - b, a)
    a = np.where(over & (a >= b / 2), a - b, a)
    a = np.where(np.isinf(b) & np.isfinite(x), np.abs(x), a)
    return np.where(np.isinf(x) | (b == 0), np.nan, np.copysign(1.0, x) * a)


#: From here on the asymptotic series of Bessel functions of order 0 and 1 are exact to a double's last digits.
_FAR = 30.0


def _near_j(top: int, x: np.ndarray) -> np.ndarray:
    """J_0 to J_top for 0 <= x < _FAR, by Miller's recurrence from above, scaled by J_0 + 2 J_2 + 2 J_4 + ... = 1."""
    start = 2 * ((max(top, int(_FAR)) + 60) // 2)
    out = np.zeros((top + 1, len(x)))
    safe, above, here, total = np.where(x == 0, 1.0, x), np.zeros_like(x), np.full_like(x, 1e-280), np.zeros_like(x)
    for k in range(start, -1, -1):
        big = np.abs(here) > 1e200
        if big.any():
            for values in (above, here, total, *out):
                values[big] *= 1e-200
        if k <= top:
            out[k] = here
        if k % 2 == 0:
            total += here if k == 0 else 2 * here
        above, here = here, 2 * k / safe * here - above
    out = out / total
    out[:, x == 0] = 0.0
    out[0, x == 0] = 1.0
    return out


def _far(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """J_n and Y_n of order 0 or 1 for x >= _FAR, by Hankel's series."""
    p, q, term = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for k in range(1, 30):
        term = term * (4 * n * n - (2 * k - 1) ** 2) / (k * 8 * x)
        if k % 2:
            q += term * (-1) ** (k // 2)
        else:
            p += term * (-1) ** (k // 2)
    angle = x - (n / 2 + 0.25) * math.pi
    size = np.sqrt(2 / (math.pi * x))
    return size * (p * np.cos(angle) - q * np.sin(angle)), size * (p * np.sin(angle) + q * np.cos(angle))


def _up(n: int, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order n from orders 0 and 1, upwards."""
    if n == 0:
        return first
    for k in range(1, n):
        first, second = second, 2 * k / x * second - first
    return second


def _orders(fn):
    """fn(order, x) for each different order of a batch."""

    def apply(n: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for order in np.unique(n):
            which = n == order
            out[which] = fn(int(order), x[which])
        return out

    return apply


def _bessel_j(n: int, x: np.ndarray) -> np.ndarray:
    sign = np.where(x < 0, (-1.0) ** n, 1.0) * ((-1.0) ** n if n < 0 else 1.0)
    n, x, out = abs(n), np.abs(x), np.empty_like(x)
    near = x < _FAR
    out[near] = _near_j(n, x[near])[n]
    far = ~near & (x > n)
    out[far] = _up(n, x[far], _far(0, x[far])[0], _far(1, x[far])[0])
    for i in np.flatnonzero(~near & ~far):  # above its argument an order is only reached from higher ones: the integral over the angle
        m = 64 + 2 * (n + int(x[i]))
        t = (np.arange(m) + 0.5) * math.pi / m
        out[i] = np.cos(n * t - x[i] * np.sin(t)).mean()
    return sign * out


def _bessel_y(n: int, x: np.ndarray) -> np.ndarray:
    """Near: Y_0 by Neumann's series in J_n, Y_1 by the Wronskian or, where J_0 is small, by the derivative of that series."""
    sign, n = ((-1.0) ** n if n < 0 else 1.0), abs(n)
    out = np.where(x == 0, -np.inf, np.full_like(x, np.nan))
    near, far = (x > 0) & (x < _FAR), x >= _FAR
    if near.any():
        v = x[near]
        js, ks = _near_j(82, v), np.arange(1, 41)
        signs = ((-1.0) ** ks / ks)[:, None]
        log = np.log(v / 2) + np.euler_gamma
        y0 = 2 / math.pi * log * js[0] - 4 / math.pi * (signs * js[2 * ks]).sum(axis=0)
        slope = 2 / math.pi * (js[0] / v - log * js[1]) - 4 / math.pi * (signs * (js[2 * ks - 1] - js[2 * ks + 1]) / 2).sum(axis=0)
        wide = np.abs(js[0]) > 0.1
        y1 = np.where(wide, (js[1] * y0 - 2 / (math.pi * v)) / np.where(wide, js[0], 1.0), -slope)
        out[near] = _up(n, v, y0, y1)
    if far.any():
        out[far] = _up(n, x[far], _far(0, x[far])[1], _far(1, x[far])[1])
    return sign * out


def erf(x: Column) -> Column:
    return _batch(_each(math.erf), "double", x)


def erfc(x: Column) -> Column:
    return _batch(_each(math.erfc), "double", x)


def lgamma(x: Column) -> Column:
    return _batch(_each(_lgamma), "double", x)


gamma = lgamma


def ilogb(x: Column) -> Column:
    return _batch(lambda v: np.frexp(v)[1] - 1, "int", x)


def nextafter(x: Column, y: Column) -> Column:
    return _batch(np.nextafter, "double", x, y)


def remainder(x: Column, y: Column) -> Column:
    """x less the multiple of y that is nearest."""
    return _batch(_remainder, "double", x, y)


def scalb(x: Column, n: Column) -> Column:
    return _batch(lambda v, k: np.ldexp(v, k.astype(np.int32)), "double", x, n)


def jn(n: Column, x: Column) -> Column:
    return _batch(_orders(_bessel_j), "double", n, x)


def j0(x: Column) -> Column:
    return jn(F.lit(0), x)


def j1(x: Column) -> Column:
    return jn(F.lit(1), x)


def yn(n: Column, x: Column) -> Column:
    return _batch(_orders(_bessel_y), "double", n, x)


def y0(x: Column) -> Column:
    return yn(F.lit(0), x)


def y1(x: Column) -> Column:
    return yn(F.lit(1), x)
