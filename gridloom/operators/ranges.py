"""Whole lanes over many tasks: rows are dealt by ranges of an order, and only what crosses a boundary travels.

A lane is a whole table, or a group of it with any share of the rows; a window over it would put it in one task.  Here a range
holds a stretch of the order, whatever lanes it cuts:

- :func:`scan` folds each stretch on its own; what a lane has in the ranges before is one value for each range;
- :func:`windowed` evaluates windows of bounded reach within ranges, and once more over the rows next to the boundaries alone;
- :func:`nearest` carries the closest mark on either side across ranges (an as-of join after a union).

Ranges are cut by the order, then by the other columns that can be sorted, then by the row's number, so neither ties nor equal rows
fill one.  There are as many as the rows need at ``ROWS`` a range, and a task of a window has one of them, so its memory doesn't grow with
the table.  Ranged rows are written once, so that every pass sees the same ranges: as a table in the folder that ``spark.checkpoint.dir``
names, or on one machine without one to Spark's cache.  :func:`release` gives both back; the session's end does so at the latest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ieee import NAN

#: Rows of a range, about.
ROWS = 400_000
#: Rows from which on a range is worth a task of its own, and the ranges that any table has.
FEW, LEAST = 20_000, 4

_held: list[tuple[DataFrame, str | None]] = []


def release() -> None:
    """Give back what ranged tables hold, when the results made from them have been read; else it goes with the session."""
    while _held:
        df, path = _held.pop()
        spark = df.sparkSession
        if path is None:
            df.unpersist()
        elif spark._sc._jsc is not None:  # with the session its tables have gone
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unbroken(df: DataFrame, order: list[str], by: list[str] | None = None) -> list[str]:
    """``order`` with the other sortable columns after it."""
    named = {*order, *(by or [])}
    return [*order, *[f.name for f in df.schema.fields if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType)) and "map<" not in f.dataType.simpleString()]]


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows dealt by ranges, with the number of the range (``__p``) and of the row (``__m``, the last to break ties)."""
    return _ranged(df, by, order)[0]


def _ranged(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """The same, and how many ranges there are."""
    every, n = unbroken(df, order, by), df.count()
    ranges = max(-(-n // ROWS), min(-(-n // FEW), df.sparkSession.sparkContext.defaultParallelism), LEAST)
    numbered = df.withColumn("__m", F.monotonically_increasing_id())
    return written(numbered.repartitionByRange(ranges, *by, *every, "__m").withColumn("__p", F.spark_partition_id())), ranges


def dealt(parts: DataFrame, ranges: int, number: str = "__p") -> DataFrame:
    """A range to a task, for windows within ranges: by its number itself, as hashes of numbers would put several together."""
    return parts.repartitionById(ranges, F.col(number))


def written(df: DataFrame) -> DataFrame:
    """``df``, made once: a table in the folder that ``spark.checkpoint.dir`` names, or on one machine the cache."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _held.append((df.persist(), None))
        return df
    path = f"{shared.rstrip('/')}/gridloom/ranged-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _held.append((out, path))
    return out


def _lane(by: list[str]) -> list[Column]:
    """What a lane is known by where only a few rows of each range are left; one lane has the same value in all."""
    return [F.col(b) for b in by] or [F.pmod("__p", F.lit(1))]


def _joined(parts: DataFrame, few: DataFrame, by: list[str], with_range: bool) -> DataFrame:
    """Left join with a table of at most one row for each range; its lanes are named ``__g0``, ... and its range ``__q``."""
    on = F.col("__p") == F.col("__q") if with_range else F.lit(True)
    for k, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__g{k}"))
    return parts.join(F.broadcast(few), on, "left").drop("__q", *[f"__g{k}" for k in range(len(by))])


def _named(by: list[str]) -> list[Column]:
    return [F.col(b).alias(f"__g{k}") for k, b in enumerate(by)]


@dataclass(frozen=True)
class Fold:
    """An associative function: ``of`` a column, through ``over`` (a window, or nothing), and ``both`` of two results."""

    of: Callable[[Column, Callable[[Column], Column]], Column]
    both: Callable[[Column, Column], Column]


def _plain(aggregate: Callable[[Column], Column]) -> Callable:
    return lambda v, over: over(aggregate(v))


def _has_nan(v: Column, over: Callable[[Column], Column]) -> Column:
    return over(F.max(F.isnan(v.cast("double"))))


#: Functions by name.  NULL is skipped, NaN is what the function makes of it: ``minimum`` and ``maximum`` pass it on.
FOLDS = {
    "add": Fold(_plain(F.sum), lambda a, b: a + b),
    "multiply": Fold(_plain(F.product), lambda a, b: a * b),
    "maximum": Fold(_plain(F.max), F.greatest),
    "minimum": Fold(lambda v, over: F.when(_has_nan(v, over), F.lit(NAN)).otherwise(over(F.min(v))), lambda a, b: F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(NAN)).otherwise(F.least(a, b))),
    "fmax": Fold(lambda v, over: over(F.max(F.when(~F.isnan(v.cast("double")), v))), F.greatest),
    "fmin": Fold(lambda v, over: over(F.min(F.when(~F.isnan(v.cast("double")), v))), F.least),
    "logical_and": Fold(_plain(F.bool_and), lambda a, b: a & b),
    "logical_or": Fold(_plain(F.bool_or), lambda a, b: a | b),
    "bitwise_and": Fold(_plain(F.bit_and), lambda a, b: a.bitwiseAND(b)),
    "bitwise_or": Fold(_plain(F.bit_or), lambda a, b: a.bitwiseOR(b)),
    "bitwise_xor": Fold(_plain(F.bit_xor), lambda a, b: a.bitwiseXOR(b)),
}


def scans(df: DataFrame, order: list[str], folds: dict[str, tuple[str | Fold, Column]], by: list[str] | None = None) -> DataFrame:
    """For each name the ``fold`` of all values of a column up to each row, within lanes or over the whole table, beside the
    other columns; all in one pass over the ranges."""
    by = by or []
    every = [*unbroken(df, order, by), "__m"]
    todo = [(FOLDS[f] if isinstance(f, str) else f, v) for f, v in folds.values()]
    parts, ranges = _ranged(df, by, order)
    here = W.partitionBy("__p", *by).orderBy(*every).rowsBetween(W.unboundedPreceding, W.currentRow)
    w = W.partitionBy(*_lane(by)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("__p", *by).agg(*[f.of(v, lambda c: c).alias(f"__t{k}") for k, (f, v) in enumerate(todo)])
    before = [f.of(F.col(f"__t{k}"), lambda c: c.over(w)).alias(f"__before{k}") for k, (f, _) in enumerate(todo)]
    carry = totals.select(F.col("__p").alias("__q"), *_named(by), F.row_number().over(W.partitionBy(*_lane(by)).orderBy("__p")).alias("__nth"), *before)
    carry = carry.where("__nth > 1").drop("__nth")  # a lane's first range has none before it
    local = dealt(parts, ranges).withColumns({f"__l{k}": f.of(v, lambda c: c.over(here)) for k, (f, v) in enumerate(todo)})
    out = _joined(local, carry, by, True)
    results = []
    for k, (f, _) in enumerate(todo):
        near, far = F.col(f"__l{k}"), F.col(f"__before{k}")
        results.append(F.when(far.isNull(), near).when(near.isNull(), far).otherwise(f.both(far, near)))
    kept = [c for c in df.columns if c not in folds]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[x.alias(name) for name, x in zip(folds, results, strict=True)])


def scan(df: DataFrame, order: list[str], value: str | Column, as_col: str, fold: str | Fold = "add", by: list[str] | None = None) -> DataFrame:
    """One scan: ``as_col`` is the ``fold`` of all values up to each row."""
    return scans(df, order, {as_col: (fold, F.col(value) if isinstance(value, str) else value)}, by)


def numbered(df: DataFrame, order: list[str], as_col: str, by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 by ``order``, within lanes or over the whole table."""
    by = by or []
    every = [*unbroken(df, order, by), "__m"]
    parts, ranges = _ranged(df, by, order)
    totals = parts.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__t"))
    w = W.partitionBy(*_lane(by)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumn("__before", F.sum("__t").over(w)).where("__before IS NOT NULL").select(F.col("__p").alias("__q"), *_named(by), "__before")
    local = F.row_number().over(W.partitionBy("__p", *by).orderBy(*every)) - 1
    out = _joined(dealt(parts, ranges).withColumn("__l", local), carry, by, True)
    return out.withColumn(as_col, (F.col("__l") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__l", "__before", "__p", "__m")


def windowed(df: DataFrame, order: list[str], by: list[str] | None, apply: Callable[[DataFrame, WindowSpec], DataFrame], before: int, after: int = 0) -> DataFrame:
    """Columns that ``apply(rows, window)`` adds by windows that reach ``before`` rows back and ``after`` rows on.

    ``apply`` must keep all rows.  It runs within ranges, then over the first and last ``before + after`` rows that a lane
    has in each of its ranges: there the rows beside a boundary find their neighbours.
    """
    by = by or []
    every = [*unbroken(df, order, by), "__m"]
    parts, ranges = _ranged(df, by, order)
    if by:  # only the first and the last lane of a range can be in another, so these are few
        cut = parts.groupBy(*by).agg(F.min("__p").alias("__a"), F.max("__p").alias("__b")).where("__a <> __b").select(*_named(by), F.lit(True).alias("__cut"))
        parts = _joined(parts, cut, by, False).withColumn("__cut", F.coalesce("__cut", F.lit(False)))
    else:
        parts = parts.withColumn("__cut", F.lit(True))
    here, reach = W.partitionBy("__p", *by), before + after
    placed = dealt(parts, ranges).withColumn("__i", F.row_number().over(here.orderBy(*every))).withColumn("__n", F.count(F.lit(1)).over(here))
    i, n = F.col("__i"), F.col("__n")
    placed = placed.withColumn("__border", F.col("__cut") & ((i <= before) | (i > n - after)))
    close = placed.where(F.col("__cut") & ((i <= reach) | (i > n - reach)))
    inner = apply(placed, here.orderBy(*every)).where("NOT __border")
    outer = apply(close, W.partitionBy(*_lane(by)).orderBy(*every)).where("__border")
    return inner.unionByName(outer).drop("__p", "__m", "__cut", "__i", "__n", "__border")


def nearest(df: DataFrame, order: list[str], mark: str, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """For every row the last ``mark`` that isn't NULL at or before it (``low``) and the first one after it (``high``)."""
    by = by or []
    every = [*unbroken(df, order, by), "__m"]
    parts, ranges = _ranged(df, by, order)
    place = F.struct(*every)
    # these aggregates sort what they read, so rows without a mark are left out of them
    ends = parts.where(F.col(mark).isNotNull()).groupBy("__p", *by).agg(F.max_by(mark, place).alias("__last"), F.min_by(mark, place).alias("__first"))
    ends = ends.unionByName(parts.select("__p", *by).distinct(), allowMissingColumns=True)
    ends = ends.groupBy("__p", *by).agg(F.first("__last", True).alias("__last"), F.first("__first", True).alias("__first"))
    # frames that begin at the start of an order cost a step a row, so what follows is looked at in falling order
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    w = W.partitionBy(*_lane(by))
    far = ends.select(
        F.col("__p").alias("__q"), *_named(by), F.last("__last", True).over(before(w.orderBy("__p"))).alias("__low"),
        F.last("__first", True).over(before(w.orderBy(F.col("__p").desc()))).alias("__high"),
    ).where("__low IS NOT NULL OR __high IS NOT NULL")
    # the last window leaves rows in falling order, so ranges are numbered in falling order as well
    here = W.partitionBy("__f", *by)
    local = dealt(parts.withColumn("__f", F.lit(ranges - 1) - F.col("__p")), ranges, "__f").withColumn(low, F.last(mark, True).over(here.orderBy(*every).rowsBetween(W.unboundedPreceding, W.currentRow)))
    local = local.withColumn(high, F.last(mark, True).over(before(here.orderBy(*[F.col(c).desc() for c in every]))))
    out = _joined(local, far, by, True)
    return out.withColumn(low, F.coalesce(low, "__low")).withColumn(high, F.coalesce(high, "__high")).drop("__low", "__high", "__p", "__f", "__m")
