"""Statistics as column expressions and driver-side formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def two_proportion_z(xa: Column, na: Column, xb: Column, nb: Column) -> Column:
    """Pooled z of two proportions; 0 where it is undefined."""
    pool = F.try_divide(xa + xb, na + nb)
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))
    z = F.try_divide(F.try_divide(xa, na) - F.try_divide(xb, nb), se)
    return F.when((pool > 0) & (pool < 1), F.coalesce(z, F.lit(0.0))).otherwise(0.0)


@F.arrow_udf(T.DoubleType())
def _cdf(z):
    import pyarrow as pa

    return pa.array([None if x is None else 0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z.to_pylist()], pa.float64())


def normal_cdf(z: Column) -> Column:
    return _cdf(z)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def logistic(x: Column, clip: float = 500.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def curve(x: Column, points: list[tuple[float, float]], missing: float = 50.0) -> Column:
    """Piecewise linear between the points, flat beyond them; `missing` for null."""
    out = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(missing)).when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(float(points[-1][1])))


def half_up(x: Column, places: int = 2) -> Column:
    """Rounded so that halves go towards plus infinity, as scripts in browsers do it."""
    f = 10.0**places
    return F.floor(x * f + 0.5) / f


def half_even(x: Column, places: int = 2) -> Column:
    return F.bround(x, places)


def binomial_cdf(n: int, p: float) -> list[float]:
    """The cumulative distribution of a binomial number, in logarithms so that no term overflows; its last entry is 1."""
    out, total = [], 0.0
    for k in range(n + 1):
        if p <= 0 or p >= 1:
            total = 1.0 if p <= 0 or k == n else 0.0
        else:
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        out.append(total)
    out[-1] = 1.0
    return out
