"""Set operations on arrays held as one column.

Results are distinct within each side.  NaN equals nothing: it is in no intersection and no difference takes it away, but
one side's NaNs count as one value, so a union has one and a symmetric difference one of each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        v = v + 0.0  # -0.0 and 0.0 are one value
    return df.select(v.alias(value)).distinct()


def _is_number(df: DataFrame, value: str) -> Column:
    return ~F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else F.lit(True)


def union1d(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    return _side(a, value).union(_side(b, value)).distinct()


def intersect1d(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    return _side(a, value).join(_side(b, value).where(_is_number(b, value)), value, "left_semi")


def setdiff1d(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    return _side(a, value).join(_side(b, value).where(_is_number(b, value)), value, "left_anti")


def setxor1d(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    both = _side(a, value).union(_side(b, value))
    counted = both.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    # a value of both sides goes, but a NaN of each side stays
    return counted.where((F.col("__n") == 1) | ~_is_number(a, value)).select(value, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(value)


def isin(a: DataFrame, b: DataFrame, value: str, invert: bool = False, as_col: str = "isin") -> DataFrame:
    """Every row of ``a`` with whether its value stands in ``b``."""
    other = _side(b, value).select(F.col(value).alias("__o"), F.lit(True).alias("__in"))
    hit = F.coalesce(F.col("__in"), F.lit(False))
    if dict(a.dtypes)[value] in ("double", "float"):
        hit = hit & ~F.isnan(value)
    return a.join(other, F.col(value) == F.col("__o"), "left").withColumn(as_col, ~hit if invert else hit).drop("__o", "__in")
