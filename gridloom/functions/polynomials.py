"""Polynomials in six bases: coefficients live on the driver, values are Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy import polynomial as P
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ieee import d

# Each basis by its recurrence p[n+1] = (a x + b) p[n] - c p[n-1]; (a, b, c) of n, and the first polynomial after 1.
_STEPS = {
    "power": (lambda n: (1.0, 0.0, 0.0), lambda x: x),
    "chebyshev": (lambda n: (2.0, 0.0, 1.0), lambda x: x),
    "legendre": (lambda n: ((2 * n + 1) / (n + 1), 0.0, n / (n + 1)), lambda x: x),
    "hermite": (lambda n: (2.0, 0.0, 2.0 * n), lambda x: x * 2),
    "hermite_e": (lambda n: (1.0, 0.0, float(n)), lambda x: x),
    "laguerre": (lambda n: (-1 / (n + 1), (2 * n + 1) / (n + 1), n / (n + 1)), lambda x: F.lit(1.0) - x),
}
_CLASSES = {"power": P.Polynomial, "chebyshev": P.Chebyshev, "legendre": P.Legendre, "hermite": P.Hermite, "hermite_e": P.HermiteE, "laguerre": P.Laguerre}


@dataclass(frozen=True)
class Series:
    """A polynomial: coefficients from the lowest degree up, in a basis."""

    coefficients: tuple[float, ...]
    basis: str = "power"

    @property
    def _np(self):
        return _CLASSES[self.basis](np.array(self.coefficients))

    def _of(self, p) -> Series:
        return Series(tuple(float(c) for c in p.coef), self.basis)

    def __call__(self, x: Column | str) -> Column:
        """The value as an expression: Horner's rule for powers, the basis's own recurrence (backwards) otherwise."""
        x, c = d(x), self.coefficients
        if self.basis == "power":
            out = F.lit(c[-1])
            for k in reversed(c[:-1]):
                out = out * x + k
            return out
        return F.aggregate(F.array(*[F.array(*[F.lit(float(v)) for v in (k, *self._step(i))]) for i, k in enumerate(c)]), *self._fold(x))

    def _step(self, n: int) -> tuple[float, float, float]:
        return _STEPS[self.basis][0](n)

    def _fold(self, x: Column):
        first = _STEPS[self.basis][1](x)
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0).alias("n"))

        def step(a, t):
            following = F.when(a["n"] == 0, first).otherwise((F.get(t, F.lit(1)) * x + F.get(t, F.lit(2))) * a["p"] - F.get(t, F.lit(3)) * a["q"])
            return F.struct((a["s"] + F.get(t, F.lit(0)) * a["p"]).alias("s"), following.alias("p"), a["p"].alias("q"), (a["n"] + 1).alias("n"))

        return zero, step, lambda a: a["s"]

    def __add__(self, other): return self._of(self._np + other._np)  # noqa: E704
    def __sub__(self, other): return self._of(self._np - other._np)  # noqa: E704
    def __mul__(self, other): return self._of(self._np * other._np)  # noqa: E704
    def divmod(self, other): return tuple(self._of(p) for p in divmod(self._np, other._np))  # noqa: E704
    def deriv(self, m=1): return self._of(self._np.deriv(m))  # noqa: E704
    def integ(self, m=1): return self._of(self._np.integ(m))  # noqa: E704
    def roots(self): return self._np.roots()  # noqa: E704
    def degree(self): return len(self.coefficients) - 1  # noqa: E704

    def convert(self, basis: str) -> Series:
        return Series(tuple(float(c) for c in self._np.convert(kind=_CLASSES[basis]).coef), basis)

    @staticmethod
    def from_roots(roots, basis: str = "power") -> Series:
        return Series(tuple(float(c) for c in _CLASSES[basis].fromroots(roots, domain=[-1, 1]).coef), basis)


def fit(df: DataFrame, x: str, y: str, degree: int, basis: str = "power") -> Series:
    """Least squares: one aggregate of (degree + 2) squared sums, solved on the driver."""
    columns = [Series(tuple([0.0] * k + [1.0]), basis)(x) for k in range(degree + 1)] + [d(y)]
    n = len(columns)
    row = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i + 1)]).first()
    full = np.array([[row[f"s{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
    return Series(tuple(np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0].tolist()), basis)
