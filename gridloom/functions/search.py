"""Binary search in a sorted list that a plan holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values: list[float]) -> Column:
    """A constant array of doubles of any length, made in one piece."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def place_among(v: Column, edges: list[float], side: str = "left") -> Column:
    """How many of the sorted ``edges`` lie below ``v`` (``right``: or at it); NaN lies above all."""
    n = len(edges)
    if n <= 8:
        out = F.lit(0)
        for e in edges:
            out = out + F.when((v > e) if side == "left" else (v >= e), 1).otherwise(0)
        return F.when(F.isnan(v), F.lit(n)).when(v.isNotNull(), out)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    held = literal_array(edges)

    def halved(x: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            e = F.get(held, at + s - 1)
            return F.when((x > e) if side == "left" else (x >= e), at + s).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    found = F.transform(F.array(v), halved)[0]
    return F.when(F.isnan(v), F.lit(n)).when(v.isNotNull(), found)
