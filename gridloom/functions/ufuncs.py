"""Elementwise functions by name: each builds a Column, so that a chain of them is one projection in generated code.

``UFUNCS[name](columns...)``; ``Ufunc`` adds reduce, accumulate, outer and at, by the aggregate that goes with a name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import ieee
from .ieee import INF, NAN, col, d

_PI = math.pi


def _cbrt(x):
    return F.cbrt(d(x))


def _logaddexp(a, b):
    a, b = d(a), d(b)
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(a == b, a + math.log(2)).otherwise(top + F.log1p(F.exp(low - top)))


def _logaddexp2(a, b):
    ln2 = math.log(2)
    return _logaddexp(d(a) * ln2, d(b) * ln2) / ln2


def _sinc(x):
    x = d(x) * _PI
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / F.nullif(x, F.lit(0.0)))


def _heaviside(x, h):
    x = d(x)
    return F.when(F.isnan(x), F.lit(NAN)).when(x < 0, F.lit(0.0)).when(x == 0, d(h)).otherwise(F.lit(1.0))


def _sign(x):
    x = d(x)
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(F.signum(x))


def _trunc(x):
    x = d(x)
    return F.when(x < 0, ieee.whole(F.ceil, x)).otherwise(ieee.whole(F.floor, x))


def _spacing(x):
    """The step to the next number away from zero, with the sign of ``x``."""
    x = d(x)
    size = F.abs(x)
    power = F.floor(F.log2(F.nullif(size, F.lit(0.0))))
    power = power - F.when(F.pow(F.lit(2.0), power) > size, 1).otherwise(0)  # a logarithm may round up to the next power
    step = F.pow(F.lit(2.0), F.greatest(power - 52, F.lit(-1074)))
    return F.when(~ieee.is_finite(x), F.when(x.isNotNull(), F.lit(NAN))).when(x < 0, -step).otherwise(step)


def _whole(f):
    return lambda x: ieee.whole(f, d(x))


def _nan_to_num(x, nan=0.0, posinf=1.7976931348623157e308, neginf=-1.7976931348623157e308):
    x = d(x)
    return F.when(F.isnan(x), F.lit(nan)).when(x == INF, F.lit(posinf)).when(x == -INF, F.lit(neginf)).otherwise(x)


def _frexp_exponent(x):
    x = d(x)
    return F.when((x == 0) | ~ieee.is_finite(x), F.lit(0)).otherwise(F.floor(F.log2(F.abs(x))) + 1).cast("int")


def _arctan2(y, x):
    return F.atan2(d(y), d(x))


def _gcd(a, b):
    """Euclid's loop has no expression in generated code: batches go through Arrow.  (A local function travels by value.)"""

    def euclid(x: pd.Series, y: pd.Series) -> pd.Series:
        both = x.notna() & y.notna()
        got = np.gcd(x.where(both, 0).astype("int64"), y.where(both, 0).astype("int64"))
        return got.astype("Int64").where(both)

    return F.pandas_udf(euclid, LongType())(col(a).cast("long"), col(b).cast("long"))


def _lcm(a, b):
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.call_function("div", F.abs(a), F.nullif(_gcd(a, b), F.lit(0))) * F.abs(b))


def _bessel_i0(x):
    """Modified Bessel function of order zero, by its power series up to |x| = 30 and its asymptotic one beyond."""
    x = F.abs(d(x))
    terms = F.sequence(F.lit(1), F.lit(80))
    series = F.aggregate(
        terms,
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: F.struct((a["t"] * x * x / (4.0 * k * k)).alias("t"), (a["s"] + a["t"] * x * x / (4.0 * k * k)).alias("s")),
        lambda a: a["s"],
    )
    far = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: F.struct(
            (a["t"] * (2.0 * k - 1) * (2.0 * k - 1) / (8.0 * k * F.nullif(x, F.lit(0.0)))).alias("t"),
            (a["s"] + a["t"] * (2.0 * k - 1) * (2.0 * k - 1) / (8.0 * k * F.nullif(x, F.lit(0.0)))).alias("s"),
        ),
        lambda a: a["s"],
    )
    return F.when(x <= 30, series).otherwise(F.exp(x) / F.sqrt(2 * _PI * x) * far)


UNARY: dict[str, Callable[..., Column]] = {
    "absolute": lambda x: F.abs(col(x)),
    "fabs": lambda x: F.abs(d(x)),
    "negative": lambda x: -col(x),
    "positive": col,
    "square": lambda x: d(x) * d(x),
    "sqrt": lambda x: F.sqrt(d(x)),
    "cbrt": _cbrt,
    "reciprocal": lambda x: ieee.divide(F.lit(1.0), x),
    "sign": _sign,
    "sin": lambda x: F.sin(d(x)),
    "cos": lambda x: F.cos(d(x)),
    "tan": lambda x: F.tan(d(x)),
    "arcsin": lambda x: F.asin(d(x)),
    "arccos": lambda x: F.acos(d(x)),
    "arctan": lambda x: F.atan(d(x)),
    "sinh": lambda x: F.sinh(d(x)),
    "cosh": lambda x: F.cosh(d(x)),
    "tanh": lambda x: F.tanh(d(x)),
    "arcsinh": lambda x: F.asinh(d(x)),
    "arccosh": lambda x: F.acosh(d(x)),
    "arctanh": lambda x: F.when(F.abs(d(x)) == 1, d(x) * INF).otherwise(F.atanh(d(x))),
    "degrees": lambda x: F.degrees(d(x)),
    "radians": lambda x: F.radians(d(x)),
    "deg2rad": lambda x: F.radians(d(x)),
    "rad2deg": lambda x: F.degrees(d(x)),
    "exp": lambda x: F.exp(d(x)),
    "exp2": lambda x: F.pow(F.lit(2.0), d(x)),
    "expm1": lambda x: F.expm1(d(x)),
    "log": ieee.log,
    "log2": ieee.log2,
    "log10": ieee.log10,
    "log1p": ieee.log1p,
    "sinc": _sinc,
    "i0": _bessel_i0,
    "floor": _whole(F.floor),
    "ceil": _whole(F.ceil),
    "trunc": _trunc,
    "fix": _trunc,
    "rint": lambda x: F.rint(d(x)),
    "isnan": lambda x: F.isnan(d(x)),
    "isinf": ieee.is_inf,
    "isposinf": lambda x: d(x) == INF,
    "isneginf": lambda x: d(x) == -INF,
    "isfinite": ieee.is_finite,
    "signbit": ieee.signbit,
    "spacing": _spacing,
    "frexp_exponent": _frexp_exponent,
    "frexp_mantissa": lambda x: F.when((d(x) == 0) | ~ieee.is_finite(x), d(x)).otherwise(d(x) / F.pow(F.lit(2.0), _frexp_exponent(x))),
    "modf_fraction": lambda x: F.when(ieee.is_inf(x), F.lit(0.0)).otherwise(d(x) - _trunc(x)),
    "modf_whole": _trunc,
    "nan_to_num": _nan_to_num,
    "logical_not": lambda x: ~col(x).cast("boolean"),
    "invert": lambda x: F.bitwise_not(col(x)),
    "bitwise_count": lambda x: F.bit_count(F.abs(col(x).cast("long"))),
}

BINARY: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: col(a) + col(b),
    "subtract": lambda a, b: col(a) - col(b),
    "multiply": lambda a, b: col(a) * col(b),
    "divide": ieee.divide,
    "true_divide": ieee.divide,
    "floor_divide": ieee.floor_divide,
    "int_floor_divide": ieee.int_floor_divide,
    "remainder": ieee.remainder,
    "mod": ieee.remainder,
    "int_remainder": ieee.int_remainder,
    "fmod": ieee.fmod,
    "power": lambda a, b: F.pow(d(a), d(b)),
    "float_power": lambda a, b: F.pow(d(a), d(b)),
    "hypot": lambda a, b: F.hypot(d(a), d(b)),
    "arctan2": _arctan2,
    "logaddexp": _logaddexp,
    "logaddexp2": _logaddexp2,
    "copysign": lambda a, b: F.when(ieee.signbit(b), -F.abs(d(a))).otherwise(F.abs(d(a))),
    "ldexp": lambda a, b: d(a) * F.pow(F.lit(2.0), d(b)),
    "heaviside": _heaviside,
    "maximum": ieee.maximum,
    "minimum": ieee.minimum,
    "fmax": ieee.fmax,
    "fmin": ieee.fmin,
    "equal": ieee.equal,
    "not_equal": ieee.not_equal,
    "less": ieee.less,
    "less_equal": ieee.less_equal,
    "greater": ieee.greater,
    "greater_equal": ieee.greater_equal,
    "isclose": ieee.isclose,
    "logical_and": lambda a, b: col(a).cast("boolean") & col(b).cast("boolean"),
    "logical_or": lambda a, b: col(a).cast("boolean") | col(b).cast("boolean"),
    "logical_xor": lambda a, b: col(a).cast("boolean") != col(b).cast("boolean"),
    "bitwise_and": lambda a, b: col(a).bitwiseAND(col(b)),
    "bitwise_or": lambda a, b: col(a).bitwiseOR(col(b)),
    "bitwise_xor": lambda a, b: col(a).bitwiseXOR(col(b)),
    "left_shift": lambda a, b: F.call_function("shiftleft", col(a), col(b).cast("int")),
    "right_shift": lambda a, b: F.call_function("shiftright", col(a), col(b).cast("int")),
    "gcd": _gcd,
    "lcm": _lcm,
}

UFUNCS: dict[str, Callable[..., Column]] = {**UNARY, **BINARY}


def clip(x, low, high) -> Column:
    """Between ``low`` and ``high``; NaN stays NaN."""
    x = d(x)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, d(low)), d(high)))


def round_to(x, decimals: int = 0) -> Column:
    """Half to even."""
    x = d(x)
    scale = 10.0**decimals
    return F.when(ieee.is_finite(x), F.rint(x * scale) / scale).otherwise(x)


def where(condition: Column, a, b) -> Column:
    return F.when(condition, col(a)).otherwise(col(b))


def select(conditions: list[Column], choices: list, default=0) -> Column:
    out = None
    for c, x in zip(conditions, choices, strict=True):
        out = F.when(c, col(x)) if out is None else out.when(c, col(x))
    return out.otherwise(col(default)) if out is not None else col(default)


def choose(index, choices: list) -> Column:
    """The choice that ``index`` names, from 0."""
    return F.get(F.array(*[col(c) for c in choices]), col(index).cast("int"))


def piecewise(x, conditions: list[Column], functions: list[Callable[[Column], Column] | float], default=0.0) -> Column:
    values = [f(d(x)) if callable(f) else F.lit(f) for f in functions]
    return select(conditions, values, default)


@dataclass(frozen=True)
class Ufunc:
    """A binary function with its reductions."""

    name: str
    aggregate: Callable[[Column], Column]
    identity: float | None

    def __call__(self, a, b) -> Column:
        return BINARY[self.name](a, b)

    def reduce(self, df: DataFrame, value: str, by: list[str]) -> DataFrame:
        out = self.aggregate(F.col(value))
        if self.identity is not None:
            out = F.coalesce(out, F.lit(self.identity))
        return df.groupBy(*by).agg(out.alias(value))

    def accumulate(self, df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
        """Running results, of lanes or of the whole column, over ranges of the order."""
        from ..operators.ranges import scan

        return scan(df, [order], value, value, self.name, by)

    def at(self, df: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
        """Each update applied, repeated keys more than once."""
        total = updates.groupBy(F.col(key).alias("__k")).agg(self.aggregate(F.col(value)).alias("__u"))
        joined = df.join(total, F.col(key) == F.col("__k"), "left")
        return joined.withColumn(value, F.when(F.col("__u").isNull(), F.col(value)).otherwise(self(value, "__u"))).drop("__k", "__u")

    def outer(self, a: DataFrame, b: DataFrame, value: str = "v", most: int = 1 << 20) -> DataFrame:
        """Every pair; ``b`` is counted and sent to every task, so it may have ``most`` rows at most."""
        n = b.count()
        if n > most:
            raise ValueError(f"the second operand of an outer has {n} rows; at most {most}")
        x = a.select(F.col("i0"), F.col(value).alias("__x"))
        y = b.select(F.col("i0").alias("i1"), F.col(value).alias("__y"))
        return x.join(F.broadcast(y)).select("i0", "i1", self("__x", "__y").alias(value))


UFUNC_OBJECTS = {
    "add": Ufunc("add", F.sum, 0.0),
    "multiply": Ufunc("multiply", F.product, 1.0),
    "maximum": Ufunc("maximum", F.max, None),
    "minimum": Ufunc("minimum", F.min, None),
    "logical_and": Ufunc("logical_and", F.bool_and, None),
    "logical_or": Ufunc("logical_or", F.bool_or, None),
}
