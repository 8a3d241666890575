"""Complex numbers as STRUCT<re, im>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import d, divide, log1p as real_log1p


def make(re, im=0.0) -> Column:
    return F.struct(d(re).alias("re"), d(im).alias("im"))


def real(z): return z["re"]  # noqa: E704
def imag(z): return z["im"]  # noqa: E704
def conj(z): return make(z["re"], -z["im"])  # noqa: E704
def absolute(z): return F.hypot(z["re"], z["im"])  # noqa: E704
def angle(z): return F.atan2(z["im"], z["re"])  # noqa: E704
def add(a, b): return make(a["re"] + b["re"], a["im"] + b["im"])  # noqa: E704
def subtract(a, b): return make(a["re"] - b["re"], a["im"] - b["im"])  # noqa: E704


def multiply(a, b) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def true_divide(a, b) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return make(divide(a["re"] * b["re"] + a["im"] * b["im"], n), divide(a["im"] * b["re"] - a["re"] * b["im"], n))


def exp(z) -> Column:
    return make(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def log(z) -> Column:
    from .ieee import log as real_log

    return make(real_log(absolute(z)), angle(z))


def sqrt(z) -> Column:
    """The root in the right half plane; the smaller part comes of the larger, so that nothing cancels."""

    def f(x: Column) -> Column:
        t = F.sqrt((absolute(x) + F.abs(x["re"])) / 2)
        u = F.coalesce(F.abs(x["im"]) / F.nullif(2 * t, F.lit(0.0)), F.lit(0.0))
        side = F.when(x["im"] < 0, -1.0).otherwise(1.0)
        return F.when(x["re"] >= 0, make(t, u * side)).otherwise(make(u, t * side))

    return bind(z, f)


def bind(z: Column, f) -> Column:
    """``f`` of a number that is computed once, however often ``f`` names it."""
    return F.transform(F.array(z), f)[0]


def scale(z, k: float) -> Column:
    return bind(z, lambda x: make(x["re"] * k, x["im"] * k))


def turn(z) -> Column:
    """i times z."""
    return bind(z, lambda x: make(-x["im"], x["re"]))


def square(z): return bind(z, lambda x: multiply(x, x))  # noqa: E704
def reciprocal(z): return bind(z, lambda x: true_divide(make(F.lit(1.0)), x))  # noqa: E704
def negative(z): return bind(z, lambda x: make(-x["re"], -x["im"]))  # noqa: E704
def log2(z): return scale(log(z), 1 / math.log(2))  # noqa: E704
def log10(z): return scale(log(z), 1 / math.log(10))  # noqa: E704


def log1p(z) -> Column:
    """Without loss where z is small: half of log1p(2 re + re^2 + im^2)."""
    return bind(z, lambda x: make(real_log1p(x["re"] * (2 + x["re"]) + x["im"] * x["im"]) / 2, F.atan2(x["im"], x["re"] + 1)))


def expm1(z) -> Column:
    def f(x: Column) -> Column:
        half = F.sin(x["im"] / 2)
        return make(F.expm1(x["re"]) * F.cos(x["im"]) - 2 * half * half, F.exp(x["re"]) * F.sin(x["im"]))

    return bind(z, f)


def sin(z): return bind(z, lambda x: make(F.sin(x["re"]) * F.cosh(x["im"]), F.cos(x["re"]) * F.sinh(x["im"])))  # noqa: E704
def cos(z): return bind(z, lambda x: make(F.cos(x["re"]) * F.cosh(x["im"]), -F.sin(x["re"]) * F.sinh(x["im"])))  # noqa: E704
def sinh(z): return bind(z, lambda x: make(F.sinh(x["re"]) * F.cos(x["im"]), F.cosh(x["re"]) * F.sin(x["im"])))  # noqa: E704
def cosh(z): return bind(z, lambda x: make(F.cosh(x["re"]) * F.cos(x["im"]), F.sinh(x["re"]) * F.sin(x["im"])))  # noqa: E704


def tanh(z) -> Column:
    """Far from the imaginary axis one, but for the sign."""

    def f(x: Column) -> Column:
        below = F.cosh(2 * x["re"]) + F.cos(2 * x["im"])
        near = make(divide(F.sinh(2 * x["re"]), below), divide(F.sin(2 * x["im"]), below))
        return F.when(F.abs(x["re"]) > 20, make(F.signum(x["re"]), 4 * F.sin(x["im"]) * F.cos(x["im"]) * F.exp(-2 * F.abs(x["re"])))).otherwise(near)

    return bind(z, f)


def tan(z): return negative(turn(tanh(turn(z))))  # noqa: E704


def _root(z: Column, sign: float) -> Column:
    """The square root of one plus or minus the square."""
    return bind(z, lambda x: sqrt(bind(multiply(x, x), lambda y: make(1 + sign * y["re"], sign * y["im"]))))


def arcsinh(z) -> Column:
    """Odd, so that the sum under the logarithm never cancels."""

    def f(x: Column) -> Column:
        flip = F.when(x["re"] < 0, -1.0).otherwise(1.0)
        right = make(x["re"] * flip, x["im"] * flip)
        return bind(bind(right, lambda y: log(bind(_root(y, 1.0), lambda q: add(y, q)))), lambda w: make(w["re"] * flip, w["im"] * flip))

    return bind(z, f)


def arcsin(z): return negative(turn(arcsinh(turn(z))))  # noqa: E704
def arccos(z): return bind(arcsin(z), lambda w: make(math.pi / 2 - w["re"], -w["im"]))  # noqa: E704


def arccosh(z) -> Column:
    def f(x: Column) -> Column:
        low, high = sqrt(make(x["re"] - 1, x["im"])), sqrt(make(x["re"] + 1, x["im"]))
        return bind(bind(low, lambda a: bind(high, lambda b: multiply(a, b))), lambda q: log(add(x, q)))

    return bind(z, f)


def arctanh(z) -> Column:
    """Half the difference of the logarithms of 1 + z and 1 - z."""

    def f(x: Column) -> Column:
        a, b = x["re"], x["im"]
        re = real_log1p(divide(4 * a, (1 - a) * (1 - a) + b * b)) / 4
        return make(re, (F.atan2(b, 1 + a) - F.atan2(-b, 1 - a)) / 2)

    return bind(z, f)


def arctan(z): return negative(turn(arctanh(turn(z))))  # noqa: E704


def power(z, w) -> Column:
    """exp(w log z); 0 to a power with a positive real part is 0, to the power 0 it is 1."""

    def f(x: Column, y: Column) -> Column:
        zero = (x["re"] == 0) & (x["im"] == 0)
        got = bind(log(x), lambda q: exp(multiply(y, q)))
        nothing = F.when((y["re"] == 0) & (y["im"] == 0), make(F.lit(1.0), F.lit(0.0))).when(y["re"] > 0, make(F.lit(0.0), F.lit(0.0)))
        return F.when(zero, nothing.otherwise(make(F.lit(float("nan")), F.lit(float("nan"))))).otherwise(got)

    return bind(z, lambda x: bind(w, lambda y: f(x, y)))


def isreal(z): return z["im"] == 0  # noqa: E704
def iscomplex(z): return z["im"] != 0  # noqa: E704


def from_polar(r, theta) -> Column:
    return make(d(r) * F.cos(d(theta)), d(r) * F.sin(d(theta)))
