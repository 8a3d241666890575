"""Masked arrays: a masked element is NULL, so Spark's aggregates skip it and its operators propagate it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import is_finite
from . import setops
from .order import runs

# What fills masked elements by default.
FILL = {"double": 1e20, "float": 1e20, "bigint": 999999, "int": 999999, "smallint": 999999, "boolean": True, "string": "N/A"}


def masked_where(df: DataFrame, condition: Column, value: str) -> DataFrame:
    return df.withColumn(value, F.when(~F.coalesce(condition, F.lit(False)), F.col(value)))


def masked_invalid(df: DataFrame, value: str) -> DataFrame:
    return masked_where(df, ~is_finite(value), value)


def masked_equal(df, value, x): return masked_where(df, F.col(value) == x, value)  # noqa: E704
def masked_not_equal(df, value, x): return masked_where(df, F.col(value) != x, value)  # noqa: E704
def masked_greater(df, value, x): return masked_where(df, F.col(value) > x, value)  # noqa: E704
def masked_greater_equal(df, value, x): return masked_where(df, F.col(value) >= x, value)  # noqa: E704
def masked_less(df, value, x): return masked_where(df, F.col(value) < x, value)  # noqa: E704
def masked_less_equal(df, value, x): return masked_where(df, F.col(value) <= x, value)  # noqa: E704
def masked_inside(df, value, a, b): return masked_where(df, F.col(value).between(min(a, b), max(a, b)), value)  # noqa: E704
def masked_outside(df, value, a, b): return masked_where(df, ~F.col(value).between(min(a, b), max(a, b)), value)  # noqa: E704


def getmask(value: str) -> Column:
    return F.col(value).isNull()


def count(value: str) -> Column:
    return F.count(value)


def count_masked(value: str) -> Column:
    return F.count_if(F.col(value).isNull())


def filled(value: str, fill) -> Column:
    return F.coalesce(value, F.lit(fill))


def default_fill(df: DataFrame, value: str) -> Column:
    return filled(value, FILL[dict(df.dtypes)[value]])


def compressed(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull())


def compress_rows(df: DataFrame, row: str, value: str) -> DataFrame:
    """Without the rows of a cell table that hold a masked element."""
    bad = df.where(F.col(value).isNull()).select(row).distinct()
    return df.join(bad, row, "left_anti")


def anomalies(df: DataFrame, value: str, by: list[str], as_col: str = "anomaly") -> DataFrame:
    """Difference from the mean of what isn't masked: a grouped mean and a join, so that a large group is many tasks' work."""
    means = df.groupBy(*[F.col(b).alias(f"__{k}") for k, b in enumerate(by)]).agg(F.avg(value).alias("__m"))
    on = F.lit(True)
    for k, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__{k}"))
    joined = df.join(means, on) if by else df.join(F.broadcast(means))  # one row
    return joined.withColumn(as_col, F.col(value) - F.col("__m")).drop("__m", *[f"__{k}" for k in range(len(by))])


def masked_values(df: DataFrame, value: str, x: float, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Masked where close to ``x``."""
    return masked_where(df, F.abs(F.col(value) - x) <= atol + rtol * abs(x), value)


def mask_rowcols(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Of a cell table: the whole of every row and column (along each of ``axes``) that holds a masked element is masked."""
    hit = F.lit(False)
    out = df
    for k, axis in enumerate(axes):
        bad = df.where(F.col(value).isNull()).select(F.col(axis).alias(f"__a{k}"), F.lit(True).alias(f"__bad{k}")).distinct()
        out = out.join(bad, F.col(axis) == F.col(f"__a{k}"), "left")
        hit = hit | F.coalesce(f"__bad{k}", F.lit(False))
    return out.select(*[F.when(~hit, F.col(c)).alias(c) if c == value else F.col(c) for c in df.columns])


def _masked_sides(f, a: DataFrame, b: DataFrame, value: str, both: Column) -> DataFrame:
    """A set operation on what isn't masked, and the masked element (one at most) where ``both`` of (in a, in b) says so."""
    hold = [x.agg(F.coalesce(F.bool_or(F.col(value).isNull()), F.lit(False)).alias(n)) for x, n in ((a, "__x"), (b, "__y"))]
    kind = a.schema[value].dataType
    masked = hold[0].join(F.broadcast(hold[1])).where(both).select(F.lit(None).cast(kind).alias(value))  # one row each
    return f(compressed(a, value), compressed(b, value), value).union(masked)


def ma_unique(a: DataFrame, value: str) -> DataFrame:
    """Distinct values; masked elements are one."""
    return a.select(value).distinct()


def ma_union1d(a, b, value): return _masked_sides(setops.union1d, a, b, value, F.col("__x") | F.col("__y"))  # noqa: E704
def ma_intersect1d(a, b, value): return _masked_sides(setops.intersect1d, a, b, value, F.col("__x") & F.col("__y"))  # noqa: E704
def ma_setdiff1d(a, b, value): return _masked_sides(setops.setdiff1d, a, b, value, F.col("__x") & ~F.col("__y"))  # noqa: E704
def ma_setxor1d(a, b, value): return _masked_sides(setops.setxor1d, a, b, value, F.col("__x") != F.col("__y"))  # noqa: E704


def ma_isin(a: DataFrame, b: DataFrame, value: str, as_col: str = "isin") -> DataFrame:
    """Masked elements stay masked in the answer."""
    return setops.isin(a, compressed(b, value), value, as_col=as_col).withColumn(as_col, F.when(F.col(value).isNotNull(), F.col(as_col)))


def median(value: str) -> Column:
    return F.percentile(F.col(value), F.lit(0.5))


def covariance(x: str, y: str, ddof: int = 1) -> Column:
    """Over pairs of which neither is masked."""
    from .reduce import covariance as cov

    return cov(x, y, ddof)


def clump_masked(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    return runs(df, order, F.col(value).isNull(), by)


def clump_unmasked(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    return runs(df, order, F.col(value).isNotNull(), by)


def edges(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """First and last unmasked place."""
    return compressed(df, value).groupBy(*by).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def domain(f, x: Column, valid: Column) -> Column:
    """A function masked outside its domain."""
    return F.when(valid, f(x))


def masked_log(x: Column) -> Column:
    return domain(F.log, x, x > 0)


def masked_sqrt(x: Column) -> Column:
    return domain(F.sqrt, x, x >= 0)


def masked_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)
