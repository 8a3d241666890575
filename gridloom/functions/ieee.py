"""IEEE-754 results under Spark's ANSI mode: division, remainder, logarithms and comparisons that never raise.

NaN is data and NULL is a masked element; nothing here turns one into the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def d(x) -> Column:
    return col(x).cast("double")


def whole(f, x: Column) -> Column:
    """``f``, a rounding to bigint, as a double: what isn't finite or has no fraction left stays."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def divide(a, b) -> Column:
    """a / b; x / ±0 is ±inf and 0 / 0 is NaN (the sign of a zero divisor counts)."""
    a, b = d(a), d(b)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(a * F.pow(b, F.lit(-1.0)))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def floor_divide(a, b) -> Column:
    a, b = d(a), d(b)
    return F.when(b == 0, divide(a, b)).otherwise(whole(F.floor, a / F.nullif(b, F.lit(0.0))))


def remainder(a, b) -> Column:
    """Remainder with the divisor's sign; NaN for a zero divisor."""
    a, b = d(a), d(b)
    by = F.nullif(b, F.lit(0.0))
    return F.when(b == 0, F.lit(NAN) + a * 0).otherwise(a - whole(F.floor, a / by) * by)


def fmod(a, b) -> Column:
    """Remainder with the dividend's sign."""
    a, b = d(a), d(b)
    return F.when(b == 0, F.lit(NAN) + a * 0).otherwise(a % F.nullif(b, F.lit(0.0)))


def int_floor_divide(a, b) -> Column:
    """Towards minus infinity; 0 for a zero divisor; the least long over -1 stays what it is."""
    a, b = col(a).cast("long"), col(b).cast("long")
    by = F.nullif(b, F.lit(0))
    rest = a % by
    down = ((rest != 0) & ((rest < 0) != (b < 0))).cast("long")
    least = F.lit(-(2**63)).cast("long")
    return F.when(b == 0, F.lit(0).cast("long")).when((b == -1) & (a == least), least).otherwise(F.call_function("div", a, by) - down)


def int_remainder(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("long")
    by = F.nullif(b, F.lit(0))
    return F.when(b == 0, F.lit(0)).otherwise((a % by + by) % by).cast("long")


def _log(f, x) -> Column:
    x = d(x)
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), f(x))


def log(x) -> Column:
    return _log(F.log, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log1p(x) -> Column:
    x = d(x)
    return F.when(F.isnan(x) | (x < -1), F.lit(NAN)).when(x == -1, F.lit(-INF)).when(x.isNotNull(), F.log1p(x))


def equal(a, b) -> Column:
    """a == b where NaN equals nothing."""
    a, b = d(a), d(b)
    return (a == b) & ~F.isnan(a)


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def less(a, b) -> Column:
    a, b = d(a), d(b)
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def less_equal(a, b) -> Column:
    return less(a, b) | equal(a, b)


def greater(a, b) -> Column:
    return less(b, a)


def greater_equal(a, b) -> Column:
    return less_equal(b, a)


def is_inf(x) -> Column:
    x = d(x)
    return (x == INF) | (x == -INF)


def is_finite(x) -> Column:
    x = d(x)
    return ~F.isnan(x) & ~is_inf(x)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = d(a), d(b)
    near = is_finite(a) & is_finite(b) & (F.abs(a - b) <= atol + rtol * F.abs(b))
    same = is_inf(a) & (a == b)
    return near | same | (F.isnan(a) & F.isnan(b) if equal_nan else F.lit(False))


def signbit(x) -> Column:
    """Whether the sign bit is set, of -0.0 too."""
    x = d(x)
    return (x < 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) < 0))


def minimum(a, b) -> Column:
    """The smaller; NaN if either is NaN."""
    a, b = d(a), d(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a, b) -> Column:
    a, b = d(a), d(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def fmin(a, b) -> Column:
    """The smaller; the other one if one is NaN."""
    return F.least(d(a), d(b))


def fmax(a, b) -> Column:
    a, b = d(a), d(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))
