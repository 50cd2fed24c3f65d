"""String similarity: Jaro and Jaro-Winkler."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_WEIGHT, MAX_PREFIX = 0.1, 4


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within max(len) // 2 - 1 places (0 at least), half of those out of order (rounded down) count against."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    left, places, mine = list(b), [], []
    for i, c in enumerate(a):
        try:
            at = left.index(c, max(i - reach, 0), min(i + reach + 1, len(b)))
        except ValueError:
            continue
        left[at] = None
        places.append(at)
        mine.append(c)
    if not places:
        return 0.0
    crossed = sum(c != b[at] for c, at in zip(mine, sorted(places), strict=True)) // 2
    m = len(places)
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = PREFIX_WEIGHT) -> float:
    """Jaro similarity raised by a common prefix of up to four characters, whatever the similarity."""
    s = jaro(a, b)
    same = 0
    while same < min(MAX_PREFIX, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + same * weight * (1 - s) if s else 0.0


def _column(f):
    @F.arrow_udf(T.DoubleType())
    def scored(a, b):
        import pyarrow as pa

        return pa.array([f(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return scored


def jaro_column(a: Column, b: Column) -> Column:
    return _column(jaro)(a, b)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _column(jaro_winkler)(a, b)
