"""Signal windows: the weight of position i of n as an expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ufuncs import UNARY

# Cosine-sum coefficients.
COSINES = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def taper(name: str, i: Column, n: int, *args: float) -> Column:
    """Symmetric windows of n points."""
    if n == 1:
        return F.lit(1.0)
    m = n - 1
    x = i.cast("double")
    if name in COSINES:
        out = F.lit(0.0)
        for k, a in enumerate(COSINES[name]):
            out = out + (-1) ** k * a * F.cos(x * (2 * math.pi * k / m))
        return out
    if name in ("general_cosine", "general_hamming"):
        terms = args if name == "general_cosine" else (args[0], 1 - args[0])
        out = F.lit(0.0)
        for k, a in enumerate(terms):
            out = out + (-1) ** k * a * F.cos(x * (2 * math.pi * k / m))
        return out
    u = x * (2.0 / m) - 1.0
    if name == "lanczos":
        return UNARY["sinc"](u)
    if name == "bartlett":
        return 1 - F.abs(u)
    if name in ("boxcar", "ones"):
        return F.lit(1.0)
    if name == "cosine":
        return F.sin((x + 0.5) * (math.pi / n))
    if name == "triang":
        return F.when(F.lit(n % 2 == 0), 1 - F.abs(2 * x - m) / n).otherwise(1 - F.abs(2 * x - m) / (n + 1))
    if name == "parzen":
        a = F.abs(2 * x - m) / n
        return F.when(a <= 0.5, 1 - 6 * a * a * (1 - a)).otherwise(2 * F.pow(1 - a, F.lit(3.0)))
    if name == "bohman":
        a = F.abs(u)
        return F.when(a == 1, F.lit(0.0)).otherwise((1 - a) * F.cos(math.pi * a) + F.sin(math.pi * a) / math.pi)
    if name == "gaussian":
        return F.exp(-F.pow((x - m / 2) / args[0], F.lit(2.0)) / 2)
    if name == "general_gaussian":
        return F.exp(-F.pow(F.abs((x - m / 2) / args[1]), F.lit(2.0 * args[0])) / 2)
    if name == "exponential":
        return F.exp(-F.abs(x - m / 2) / args[0])
    if name == "kaiser":
        return UNARY["i0"](F.sqrt(F.greatest(1 - u * u, F.lit(0.0))) * args[0]) / UNARY["i0"](F.lit(float(args[0])))
    if name == "tukey":
        width = args[0] * m / 2
        if width == 0:
            return F.lit(1.0)
        edge = F.least(x, m - x)
        return F.when(edge >= width, F.lit(1.0)).otherwise((1 - F.cos(edge * (math.pi / width))) / 2)
    raise ValueError(f"no window named {name!r}")


def window(spark: SparkSession, name: str, n: int, *args: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i0"), taper(name, F.col("id"), n, *args).alias("v"))


def taper_of(name: str, i: Column, n: Column) -> Column:
    """The weight of place ``i`` in a window whose length is a column, of the kinds that are cosine sums, or bartlett's."""
    x = i.cast("double") / F.nullif(n.cast("double") - 1, F.lit(0.0))
    if name in COSINES:
        out = F.lit(0.0)
        for k, a in enumerate(COSINES[name]):
            out = out + (-1) ** k * a * F.cos(x * (2 * math.pi * k))
    elif name == "bartlett":
        out = 1 - F.abs(2 * x - 1)
    else:
        raise ValueError(f"no window named {name!r} of a column's length")
    return F.when(n == 1, F.lit(1.0)).otherwise(out)
