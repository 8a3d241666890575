"""Operators that need an order: sorts, ranks, running folds, searches, interpolation, unique values.

A whole array, or one group with a third of all rows, is one lane; all operators here work on lanes by ranges
(:mod:`gridloom.operators.ranges`), so a lane is the work of many tasks.  Ties in the order are broken by the other columns that can be
sorted, so results don't depend on the run but among rows that are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ieee import NAN, d, divide
from ..functions.search import place_among
from .ranges import Fold, nearest, numbered, scan, scans, windowed


def ranked(df: DataFrame, order: list[str], as_col: str, by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 by ``order``, within groups or over the whole table."""
    return numbered(df, order, as_col, by)


def running(df: DataFrame, order: list[str], value: str, as_col: str, by: list[str] | None = None) -> DataFrame:
    """Running sum by ``order``, within groups or over the whole table."""
    return scan(df, order, value, as_col, "add", by)


def accumulate(df: DataFrame, order: str, value: str, fold: str = "add", by: list[str] | None = None, as_col: str = "accumulated") -> DataFrame:
    """Running results of a function of :data:`gridloom.operators.ranges.FOLDS`."""
    return scan(df, [order], value, as_col, fold, by)


def accumulate_many(df: DataFrame, order: str, folds: dict[str, tuple[str | Fold, Column]], by: list[str] | None = None) -> DataFrame:
    """Several running results in one pass: for each new column a function and what it runs over."""
    return scans(df, [order], folds, by)


def cumsum(df: DataFrame, order: str, value: str, by: list[str] | None = None, as_col: str = "cumsum") -> DataFrame:
    return running(df, [order], value, as_col, by)


def cumprod(df: DataFrame, order: str, value: str, by: list[str] | None = None, as_col: str = "cumprod") -> DataFrame:
    return scan(df, [order], d(value), as_col, "multiply", by)


def nancumsum(df: DataFrame, order: str, value: str, by: list[str] | None = None, as_col: str = "nancumsum") -> DataFrame:
    return scan(df, [order], F.when(F.isnan(d(value)), F.lit(0.0)).otherwise(d(value)), as_col, "add", by)


def nancumprod(df: DataFrame, order: str, value: str, by: list[str] | None = None, as_col: str = "nancumprod") -> DataFrame:
    return scan(df, [order], F.when(F.isnan(d(value)), F.lit(1.0)).otherwise(d(value)), as_col, "multiply", by)


def unwrap(df: DataFrame, order: str, value: str, by: list[str] | None = None, period: float = 6.283185307179586, as_col: str = "unwrapped") -> DataFrame:
    """Jumps of half a period or more between neighbours turned into their complements; of just half a period the sign stays."""
    half = period / 2

    def turned(rows: DataFrame, w: WindowSpec) -> DataFrame:
        step = d(value) - F.lag(d(value)).over(w)
        within = (step + half) - F.floor((step + half) / period) * period - half
        within = F.when((within == -half) & (step > 0), F.lit(half)).otherwise(within)
        return rows.withColumn("__t", F.coalesce(F.when(F.abs(step) >= half, within - step), F.lit(0.0)))

    out = running(windowed(df, [order], by, turned, 1), [order], "__t", "__s", by)
    return out.withColumn(as_col, d(value) + F.col("__s")).drop("__t", "__s")


def correlate(df: DataFrame, order: str, value: str, kernel: list[float], by: list[str] | None = None, as_col: str = "correlated") -> DataFrame:
    """Sums of products with a short kernel at every full overlap that ends at a row."""

    def summed(rows: DataFrame, w: WindowSpec) -> DataFrame:
        out = F.lit(0.0)
        for k, c in enumerate(reversed(kernel)):
            out = out + F.lag(d(value), k).over(w) * c
        return rows.withColumn(as_col, out)

    return windowed(df, [order], by, summed, len(kernel) - 1)


def diff(df: DataFrame, order: str, value: str, by: list[str] | None = None, n: int = 1, as_col: str = "diff") -> DataFrame:
    """n-th differences; rows without enough predecessors go."""

    def stepped(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn(as_col, F.col(value))
        for _ in range(n):
            rows = rows.withColumn(as_col, F.col(as_col) - F.lag(as_col).over(w))
        return rows

    return windowed(df, [order], by, stepped, n).where(F.col(as_col).isNotNull())


def ediff1d(df: DataFrame, order: str, value: str, to_begin: list[float] | None = None, to_end: list[float] | None = None) -> DataFrame:
    """(i0, v): differences of the whole column in order, with values before and after them."""
    before, after = to_begin or [], to_end or []
    rows = ranked(df.select(F.col(order).alias("__o"), d(value).alias("__v")), ["__o"], "__k")
    follows = rows.select((F.col("__k") + 1).alias("__k"), F.col("__v").alias("__w"))
    steps = rows.join(follows, "__k").select((F.col("__k") - 1 + len(before)).alias("i0"), (F.col("__v") - F.col("__w")).alias("v"))
    n = max(rows.count() - 1, 0)
    more = [(i, float(x)) for i, x in enumerate(before)] + [(len(before) + n + i, float(x)) for i, x in enumerate(after)]
    return steps.unionByName(df.sparkSession.createDataFrame(more, "i0 long, v double")) if more else steps


def gradient(df: DataFrame, order: str, value: str, by: list[str] | None = None, as_col: str = "gradient", spacing: float | str = 1.0) -> DataFrame:
    """Central differences inside, one-sided at the ends, of steps of one length, or of the coordinates in a column (there
    the inner ones are of second order in both steps)."""
    v = d(value)

    def sloped(rows: DataFrame, w: WindowSpec) -> DataFrame:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        if isinstance(spacing, str):
            left, right = d(spacing) - F.lag(d(spacing)).over(w), F.lead(d(spacing)).over(w) - d(spacing)
            inner = (left * left * after - right * right * before + (right * right - left * left) * v) / (left * right * (left + right))
        else:
            left = right = F.lit(float(spacing))
            inner = (after - before) / (2 * float(spacing))
        return rows.withColumn(as_col, F.when(before.isNull(), (after - v) / right).when(after.isNull(), (v - before) / left).otherwise(inner))

    return windowed(df, [order], by, sloped, 1, 1)


def trapezoid(df: DataFrame, x: str, y: str, by: list[str] | None = None, as_col: str = "area") -> DataFrame:
    def parts(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("__a", (d(x) - F.lag(d(x)).over(w)) * (d(y) + F.lag(d(y)).over(w)) / 2)

    return windowed(df, [x], by, parts, 1).groupBy(*(by or [])).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias(as_col))


def sort_lanes(df: DataFrame, by: list[str], value: str, as_col: str = "i") -> DataFrame:
    """Each lane sorted: the position of every value, NaN last."""
    return ranked(df, [value], as_col, by)


def argsort(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Stable: for each rank the position of the value that has it."""
    return ranked(df.select(*by, value, pos), [value, pos], "rank", by).select(*by, "rank", F.col(pos).alias("index"))


def lexsort(df: DataFrame, by: list[str], keys: list[str], pos: str) -> DataFrame:
    """The last key is the first to count."""
    return ranked(df.select(*by, *keys, pos), [*reversed(keys), pos], "rank", by).select(*by, "rank", F.col(pos).alias("index"))


def partition(df: DataFrame, value: str, pos: str, kth: int, by: list[str] | None = None) -> DataFrame:
    """Rows with ``part``: -1 for those that sort before the kth place (from 0), 0 for the one in it, 1 for those after; ties by
    position, NaN last.  ``pos`` of the rows in any order with part -1, 0, 1 is an argpartition."""
    placed = ranked(df, [value, pos], "__k", by)
    return placed.withColumn("part", F.signum(F.col("__k") - kth).cast("int")).drop("__k")


def sort_complex(df: DataFrame, re: str, im: str, as_col: str = "i") -> DataFrame:
    """Each row's place by real, then imaginary part; parts that are NaN last."""
    return ranked(df, [re, im], as_col)


def top_k(df: DataFrame, value: str, k: int, pos: str, by: list[str] | None = None) -> DataFrame:
    """The k largest, ties by position: what a partition around the k-th gives."""
    order = [F.col(value).desc(), F.col(pos)]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def average_ranks(df: DataFrame, value: str, by: list[str], weight: str, as_col: str) -> DataFrame:
    """(by..., value, rank): the mean rank from 1 of each distinct value, which has ``weight`` rows."""
    counts = df.groupBy(*by, value).agg(F.sum(weight).alias("__n"))
    upto = running(counts, [value], "__n", "__upto", by)
    return upto.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(as_col))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., rho, n): correlation of mean ranks, from counts per pair of values."""
    pairs = df.where(d(x).isNotNull() & d(y).isNotNull()).groupBy(*by, d(x).alias("__x"), d(y).alias("__y")).agg(F.count(F.lit(1)).alias("__w"))
    rx, ry = average_ranks(pairs, "__x", by, "__w", "__rx"), average_ranks(pairs, "__y", by, "__w", "__ry")
    both = pairs
    for ranks, v in ((rx, "__x"), (ry, "__y")):
        names = [*by, v]
        right = ranks.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], ranks.columns[-1])
        on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
        both = both.join(right, on).drop(*[f"__k{i}" for i in range(len(names))])
    n = both.groupBy(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)]).agg(F.sum("__w").alias("n"))
    on = [F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)]
    both = both.join(n, on) if by else both.join(F.broadcast(n))  # one row
    a, b, w = F.col("__rx") - (F.col("n") + 1) / 2, F.col("__ry") - (F.col("n") + 1) / 2, F.col("__w")
    rho = divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b)))
    return both.groupBy(*by).agg(rho.alias("rho"), F.max("n").alias("n"))


def searchsorted(df: DataFrame, value: str, edges: list[float], side: str = "left", as_col: str = "at") -> DataFrame:
    """Where each value would go in a sorted list that a plan holds: a binary search in it, no join; NaN goes last."""
    return df.withColumn(as_col, place_among(d(value), edges, side))


def digitize(df: DataFrame, value: str, edges: list[float], right: bool = False, as_col: str = "bin") -> DataFrame:
    return searchsorted(df, value, edges, "left" if right else "right", as_col)


def searchsorted_table(df: DataFrame, value: str, knots: DataFrame, knot: str, by: list[str] | None = None, as_col: str = "at", side: str = "left") -> DataFrame:
    """Of a long list of knots: how many lie below each value (``right``: or at it), counted over ranges of both."""
    by, first = by or [], 1 if side == "left" else 0
    both = df.withColumn("__k", d(value)).withColumn("__tag", F.lit(1 - first)).withColumn("__one", F.lit(0)).unionByName(
        knots.select(*by, d(knot).alias("__k"), F.lit(first).alias("__tag"), F.lit(1).alias("__one")), allowMissingColumns=True
    )
    return running(both, ["__k", "__tag"], "__one", as_col, by).where("__one = 0").drop("__one", "__tag", "__k")


def interp(df: DataFrame, x: str, knots: DataFrame, kx: str, ky: str, by: list[str] | None = None, as_col: str = "y") -> DataFrame:
    """Piecewise linear interpolation, constant beyond the ends: an as-of join both ways over ranges of both tables.

    Values and knots are dealt by ranges together, and the nearest knot of each side crosses from range to range.
    """
    by = by or []
    both = df.withColumn("__k", d(x)).withColumn("__q1", F.lit(1)).unionByName(
        knots.select(*by, d(kx).alias("__k"), F.struct(d(kx).alias("x"), d(ky).alias("y")).alias("__knot"), F.lit(0).alias("__q1")),
        allowMissingColumns=True,
    )
    out = nearest(both, ["__k", "__q1"], "__knot", "__a", "__b", by).where("__q1 = 1")
    step = F.nullif(F.col("__b.x") - F.col("__a.x"), F.lit(0.0))
    inner = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * (F.col("__k") - F.col("__a.x")) / step
    y = F.when(F.isnan("__k"), F.lit(NAN)).when(F.col("__a").isNull(), F.col("__b.y")).when(F.col("__b").isNull(), F.col("__a.y")).otherwise(inner)
    return out.withColumn(as_col, y).drop("__k", "__q1", "__a", "__b", "__knot")


def unique(df: DataFrame, value: str, pos: str) -> DataFrame:
    """value, index of its first place, count."""
    return df.groupBy(value).agg(F.min(pos).alias("first_index"), F.count(F.lit(1)).alias("n"))


def unique_inverse(df: DataFrame, value: str, pos: str) -> DataFrame:
    """pos, inverse: the rank of each row's value among the distinct ones."""
    ranks = ranked(df.select(value).distinct(), [value], "inverse").withColumnRenamed(value, "__v")
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).select(pos, "inverse")


def runs(df: DataFrame, order: str, flag: Column, by: list[str] | None = None) -> DataFrame:
    """Maximal stretches of rows whose flag holds: group columns, first, last, length (gaps and islands)."""
    by = by or []

    def begins(rows: DataFrame, w: WindowSpec) -> DataFrame:
        held = F.coalesce(F.col("__f"), F.lit(False))
        return rows.withColumn("__new", (held & ~F.coalesce(F.lag(held).over(w), F.lit(False))).cast("long"))

    marked = windowed(df.select(*by, order, flag.alias("__f")), [order], by, begins, 1)
    marked = running(marked, [order], "__new", "__island", by).where("__f")
    return marked.groupBy(*by, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__island")


def sliding(df: DataFrame, order: str, value: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Rows with ``sum``, ``mean``, ``min`` and ``max`` of the full window of ``width`` rows that ends there (NULL where it isn't full)."""

    def reduced(rows: DataFrame, w: WindowSpec) -> DataFrame:
        w = w.rowsBetween(1 - width, W.currentRow)
        full = F.count(F.lit(1)).over(w) == width
        return rows.withColumns({k: F.when(full, f(d(value)).over(w)) for k, f in (("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))})

    return windowed(df, [order], by, reduced, width - 1)
