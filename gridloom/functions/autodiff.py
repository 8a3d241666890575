"""Forward differentiation: a dual number is a pair of Columns, so a derivative is part of the same projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import d


def _dual(x) -> Dual:
    return x if isinstance(x, Dual) else Dual(d(x), F.lit(0.0))


@dataclass(frozen=True)
class Dual:
    value: Column
    tangent: Column

    def __add__(self, o): o = _dual(o); return Dual(self.value + o.value, self.tangent + o.tangent)  # noqa: E702, E704
    def __sub__(self, o): o = _dual(o); return Dual(self.value - o.value, self.tangent - o.tangent)  # noqa: E702, E704
    def __mul__(self, o): o = _dual(o); return Dual(self.value * o.value, self.tangent * o.value + self.value * o.tangent)  # noqa: E702, E704
    def __neg__(self): return Dual(-self.value, -self.tangent)  # noqa: E704
    def __radd__(self, o): return _dual(o) + self  # noqa: E704
    def __rsub__(self, o): return _dual(o) - self  # noqa: E704
    def __rmul__(self, o): return _dual(o) * self  # noqa: E704
    def __rtruediv__(self, o): return _dual(o) / self  # noqa: E704

    def __truediv__(self, o):
        o = _dual(o)
        return Dual(self.value / o.value, (self.tangent * o.value - self.value * o.tangent) / (o.value * o.value))

    def __pow__(self, n: float):
        return Dual(F.pow(self.value, F.lit(float(n))), F.pow(self.value, F.lit(float(n - 1))) * float(n) * self.tangent)

    def _chain(self, f, slope) -> Dual:
        return Dual(f(self.value), slope(self.value) * self.tangent)

    def sin(self): return self._chain(F.sin, F.cos)  # noqa: E704
    def cos(self): return self._chain(F.cos, lambda v: -F.sin(v))  # noqa: E704
    def tan(self): return self._chain(F.tan, lambda v: 1 / (F.cos(v) * F.cos(v)))  # noqa: E704
    def exp(self): return self._chain(F.exp, F.exp)  # noqa: E704
    def log(self): return self._chain(F.log, lambda v: 1 / v)  # noqa: E704
    def sqrt(self): return self._chain(F.sqrt, lambda v: 0.5 / F.sqrt(v))  # noqa: E704
    def tanh(self): return self._chain(F.tanh, lambda v: 1 - F.tanh(v) * F.tanh(v))  # noqa: E704
    def sinh(self): return self._chain(F.sinh, F.cosh)  # noqa: E704
    def cosh(self): return self._chain(F.cosh, F.sinh)  # noqa: E704
    def arctan(self): return self._chain(F.atan, lambda v: 1 / (1 + v * v))  # noqa: E704
    def arcsin(self): return self._chain(F.asin, lambda v: 1 / F.sqrt(1 - v * v))  # noqa: E704
    def abs(self): return self._chain(F.abs, F.signum)  # noqa: E704


def value_and_derivative(f: Callable[[Dual], Dual], x: Column | str) -> tuple[Column, Column]:
    out = f(Dual(d(x), F.lit(1.0)))
    return out.value, out.tangent


def derivative(f: Callable[[Dual], Dual], x: Column | str) -> Column:
    return value_and_derivative(f, x)[1]


def gradient(f: Callable[..., Dual], *xs: Column | str) -> list[Column]:
    """Partial derivatives, one pass of the function for each argument."""
    return [f(*[Dual(d(x), F.lit(1.0 if i == k else 0.0)) for i, x in enumerate(xs)]).tangent for k in range(len(xs))]


def jacobian(fs: list[Callable[..., Dual]], *xs: Column | str) -> list[list[Column]]:
    return [gradient(f, *xs) for f in fs]
