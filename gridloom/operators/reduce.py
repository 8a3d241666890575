"""Reductions of an array held as rows: by groups (the axes that stay), with NaN and empty input treated as IEEE does.

Everything here is one aggregate with map-side combine, but for quantiles by method, which need an order of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ieee import INF, NAN, d, divide
from ..functions.search import place_among


def total(v) -> Column:
    return F.coalesce(F.sum(d(v)), F.lit(0.0))


def product(v) -> Column:
    return F.coalesce(F.product(d(v)), F.lit(1.0))


def mean(v) -> Column:
    return F.avg(d(v))


def minimum(v) -> Column:
    return F.when(F.bool_or(F.isnan(d(v))), F.lit(NAN)).otherwise(F.min(d(v)))


def maximum(v) -> Column:
    return F.max(d(v))


def ptp(v) -> Column:
    return maximum(v) - minimum(v)


def argmin(pos, v) -> Column:
    """Position of the first smallest; of the first NaN if there is one."""
    p = F.col(pos)
    return F.min_by(p, F.struct(~F.isnan(d(v)), d(v), p))


def argmax(pos, v) -> Column:
    p = F.col(pos)
    return F.max_by(p, F.struct(F.isnan(d(v)), F.when(F.isnan(d(v)), F.lit(0.0)).otherwise(d(v)), -p))


def variance(v, ddof: int = 0) -> Column:
    n, pop = F.count(d(v)), F.var_pop(d(v))
    short = F.when(pop * n == 0, F.lit(NAN)).otherwise(F.lit(INF))
    return F.when(n == 0, F.lit(None).cast("double")).when(n > ddof, pop * n / F.greatest(n - ddof, F.lit(1))).otherwise(short)


def std(v, ddof: int = 0) -> Column:
    return F.sqrt(variance(v, ddof))


def average(v, weights) -> Column:
    return divide(F.sum(d(v) * d(weights)), F.sum(d(weights)))


def count_nonzero(v) -> Column:
    return F.count_if((d(v) != 0) | F.isnan(d(v)))


def _skip(v) -> Column:
    return F.when(~F.isnan(d(v)), d(v))


def nansum(v) -> Column:
    return total(_skip(v))


def nanprod(v) -> Column:
    return product(_skip(v))


def nanmean(v) -> Column:
    return F.coalesce(F.avg(_skip(v)), F.lit(NAN))


def nanmin(v) -> Column:
    return F.coalesce(F.min(_skip(v)), F.lit(NAN))


def nanmax(v) -> Column:
    return F.coalesce(F.max(_skip(v)), F.lit(NAN))


def nanvar(v, ddof: int = 0) -> Column:
    return variance(_skip(v), ddof)


def nanstd(v, ddof: int = 0) -> Column:
    return F.sqrt(nanvar(v, ddof))


def nanargmin(pos, v) -> Column:
    """Position of the first smallest that isn't NaN."""
    p, x = F.col(pos), _skip(v)
    return F.min_by(p, F.when(x.isNotNull(), F.struct(x, p)))


def nanargmax(pos, v) -> Column:
    p, x = F.col(pos), _skip(v)
    return F.max_by(p, F.when(x.isNotNull(), F.struct(x, -p)))


def median(v) -> Column:
    """NaN if there is one.  Keeps a group's distinct values; groups of any size: :func:`quantiles`."""
    return F.when(F.bool_or(F.isnan(d(v))), F.lit(NAN)).otherwise(F.percentile(d(v), F.lit(0.5)))


def nanmedian(v) -> Column:
    return F.coalesce(F.percentile(_skip(v), F.lit(0.5)), F.lit(NAN))


def moment(v, k: int) -> list[Column]:
    return [F.sum(F.pow(d(v), F.lit(float(i)))) for i in range(1, k + 1)]


def skew(v) -> Column:
    return F.skewness(d(v))


def kurtosis(v) -> Column:
    """Excess."""
    return F.kurtosis(d(v))


def gmean(v) -> Column:
    """NaN where a value is negative or NaN, else 0 where one is 0."""
    x = d(v)
    mean_log = F.avg(F.log(F.when(x > 0, x)))
    return F.when(F.max((x < 0) | F.isnan(x)), F.lit(NAN)).when(F.min(x) == 0, F.lit(0.0)).otherwise(F.exp(mean_log))


def hmean(v) -> Column:
    return divide(F.count(d(v)), F.sum(divide(F.lit(1.0), d(v))))


def sem(v, ddof: int = 1) -> Column:
    return std(v, ddof) / F.sqrt(F.count(d(v)))


def mode(v) -> Column:
    """The most frequent; of several the smallest."""
    return F.mode(F.col(v) if isinstance(v, str) else v, True)


def covariance(x, y, ddof: int = 1) -> Column:
    n = F.count(d(x) + d(y))
    return divide(F.covar_pop(d(x), d(y)) * n, n - ddof)


def correlation(x, y) -> Column:
    """NaN where either is constant."""
    both = F.when(d(y).isNotNull(), d(x)), F.when(d(x).isNotNull(), d(y))
    return divide(F.covar_pop(d(x), d(y)), F.sqrt(F.var_pop(both[0]) * F.var_pop(both[1])))


def reduce_by(df: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """One row per group with the named reductions."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in columns.items()])


# The plotting positions of the continuous quantile definitions (alpha, beta).
CONTINUOUS = {
    "linear": (1.0, 1.0),
    "weibull": (0.0, 0.0),
    "hazen": (0.5, 0.5),
    "interpolated_inverted_cdf": (0.0, 1.0),
    "median_unbiased": (1 / 3, 1 / 3),
    "normal_unbiased": (3 / 8, 3 / 8),
}
DISCRETE = ("lower", "higher", "nearest", "midpoint", "inverted_cdf", "averaged_inverted_cdf", "closest_observation")
METHODS = (*CONTINUOUS, *DISCRETE)


def quantile_place(n: Column, q: float, method: str) -> tuple[Column, Column]:
    """(index below, weight of the value above it), from 0, of the q-quantile of n ordered values."""
    n = n.cast("double")
    if method in CONTINUOUS:
        a, b = CONTINUOUS[method]
        at = n * q + (a + q * (1 - a - b)) - 1
    elif method in ("lower", "higher", "nearest", "midpoint"):
        at = (n - 1) * q
    else:
        at = n * q - 1
    at = F.greatest(F.lit(0.0), F.least(at, n - 1)) if method in CONTINUOUS or method in DISCRETE[:4] else at
    low = F.floor(at + 1e-12 * F.signum(at) * 0)
    part = at - low
    if method == "lower":
        part = F.lit(0.0)
    elif method == "higher":
        part = F.ceil(part).cast("double")
    elif method == "nearest":
        low, part = F.rint(at), F.lit(0.0)
    elif method == "midpoint":
        part = F.when(part == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    elif method == "inverted_cdf":
        part = F.ceil(part).cast("double")
    elif method == "averaged_inverted_cdf":
        part = F.when(part == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    elif method == "closest_observation":
        up = (part > 0.5) | ((part == 0.5) & (F.pmod(low.cast("long"), F.lit(2)) == 0))
        part = F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))
    bounded = F.greatest(F.lit(0.0), low + 0.0)
    part = F.when(low < 0, F.lit(0.0)).otherwise(part)
    return bounded.cast("long"), part


#: Rank error of the sketch that brackets quantiles; a bracket reaches four of them to each side.
SKETCH_ERROR = 1 / 2000


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], method: str = "linear", skip_nan: bool = False) -> DataFrame:
    """One row per group with a column ``q_<i>`` for each quantile, selected without sorting the values.

    A first scan brackets every wanted place by a mergeable sketch of the group, which is sure of ranks but for a two-thousandth of
    the group.  A second scan counts equal values within the brackets, and between brackets only rows: under a hundredth of the
    rows for each quantile, and one row for a value that fills half a group.  Running counts over these, by ranges, find the places.
    Groups of a few thousand rows are counted whole.  NaN makes a group's quantiles NaN unless skipped; without values there is no row
    of a group, and none of a whole table.
    """
    from .order import running

    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    rows = df.select(*by, d(value).alias("__v")).where(F.col("__v").isNotNull())
    if skip_nan:
        rows = rows.where(~F.isnan("__v"))
    names = [F.col(b).alias(f"__b{k}") for k, b in enumerate(by)]
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__b{k}"))

    reach = 4 * SKETCH_ERROR
    ends = [min(max(q + side * reach, 0.0), 1.0) for q in qs for side in (-1, 1)]
    n = F.count(F.lit(1))
    sketch = F.percentile_approx(F.when(~F.isnan("__v"), F.col("__v")), ends, int(1 / SKETCH_ERROR))
    sizes = rows.groupBy(*by).agg(n.alias("__n"), F.bool_or(F.isnan("__v")).alias("__nan"), sketch.alias("__ends"))
    if not by:
        sizes = sizes.where("__n > 0")
    low, high, weight = [], [], []
    for q in qs:
        at, part = quantile_place(F.col("__n"), q, method)
        low.append(at)
        high.append(F.least(at + 1, F.col("__n") - 1))
        weight.append(part)
    small = F.col("__n") * SKETCH_ERROR < 2  # a place may be two off the quantile of the sketch
    wide = lambda i, edge, far: F.when(small | F.lit(edge), F.lit(far)).otherwise(F.get("__ends", F.lit(i)))
    brackets = F.array(*[
        F.struct(wide(2 * i, ends[2 * i] <= 0, float("-inf")).alias("lo"), wide(2 * i + 1, ends[2 * i + 1] >= 1, float("inf")).alias("hi")) for i in range(len(qs))
    ])
    sizes = sizes.select(*names, "__n", "__nan", brackets.alias("__in"), F.array(*low).alias("__low"), F.array(*high).alias("__high"), F.array(*[w.cast("double") for w in weight]).alias("__w"))

    held = rows.join(sizes.select(*[f"__b{k}" for k in range(len(by))], "__in"), same) if by else rows.join(F.broadcast(sizes.select("__in")))  # one row
    v, marks = F.col("__v"), F.col("__in")
    inside, gap = F.lit(False), F.lit(0)
    for i in range(len(qs)):
        e = F.get(marks, F.lit(i))
        inside = inside | ((v >= e["lo"]) & (v <= e["hi"]))
        gap = gap + F.when(v > e["hi"], 1).otherwise(0)
    counted = held.select(*by, gap.alias("__gap"), F.when(inside, v).alias("__v")).groupBy(*by, "__gap", "__v").agg(n.alias("__c"))
    upto = running(counted, ["__gap", "__v"], "__c", "__upto", by)  # NULL, the rows between brackets, comes first

    wanted = sizes.select(*[F.col(f"__b{k}") for k in range(len(by))], F.explode(F.array_distinct(F.concat("__low", "__high"))).alias("__k"))
    reached = (F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__c") <= F.col("__k"))
    if by:
        met = upto.join(wanted, same & reached)
    else:
        met = upto.join(F.broadcast(sizes.select(F.array_distinct(F.concat("__low", "__high")).alias("__ks"))))  # one row
        met = met.select("*", F.explode("__ks").alias("__k")).where(reached)
    found = F.coalesce("__v", F.when(F.col("__v").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).cast("double"))
    held = met.select(*[F.col(b).alias(f"__h{k}") for k, b in enumerate(by)], "__k", found.alias("__v"))
    held = held.groupBy(*[f"__h{k}" for k in range(len(by))]).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__at"))
    on = F.lit(True)
    for k in range(len(by)):
        on = on & F.col(f"__b{k}").eqNullSafe(F.col(f"__h{k}"))
    got = sizes.join(held, on) if by else sizes.join(F.broadcast(held))  # one row
    out = []
    for i in range(len(qs)):
        below, above, g = (F.col("__at")[F.get("__low", F.lit(i))], F.col("__at")[F.get("__high", F.lit(i))], F.get("__w", F.lit(i)))
        x = F.when(g == 0, below).when(g == 1, above).otherwise(below + (above - below) * g)
        out.append(F.when(F.col("__nan"), F.lit(NAN)).otherwise(x).alias(f"q_{i}"))
    return got.select(*[F.col(f"__b{k}").alias(b) for k, b in enumerate(by)], *out)


def iqr(df: DataFrame, by: list[str], value: str) -> DataFrame:
    got = quantiles(df, by, value, [0.25, 0.75])
    return got.select(*by, (F.col("q_1") - F.col("q_0")).alias("iqr"))


def zscore(df: DataFrame, by: list[str], value: str, ddof: int = 0, as_col: str = "z") -> DataFrame:
    stats = df.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(mean(value).alias("__m"), std(value, ddof).alias("__s"))
    on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    joined = df.join(stats, on) if by else df.join(F.broadcast(stats))  # one row
    return joined.withColumn(as_col, divide(d(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s", *[f"__{b}" for b in by])


# -- histograms ------------------------------------------------------------------------------------------------------


def bin_of(v, edges: list[float]) -> Column:
    """Which bin of equal or unequal ``edges`` a value falls in (the last bin is closed); NULL outside and for NaN."""
    x, n = d(v), len(edges) - 1
    widths = {round(b - a, 12) for a, b in zip(edges[:-1], edges[1:], strict=True)}
    low, width = float(edges[0]), (edges[-1] - edges[0]) / n
    if len(widths) == 1 and n > 8 and all(low + k * width == e for k, e in enumerate(edges)):
        # the edges are what this arithmetic gives, so one comparison each way mends the rounding of the division
        at = F.greatest(F.lit(0.0), F.least(F.floor((x - low) / width).cast("double"), F.lit(float(n - 1))))
        at = F.when(x < at * width + low, at - 1).when((x >= (at + 1) * width + low) & (at < n - 1), at + 1).otherwise(at)
    else:
        at = place_among(x, edges[:-1], "right") - 1
    inside = (x >= edges[0]) & (x <= edges[-1]) & ~F.isnan(x)
    return F.when(inside, at.cast("int"))


def histogram(df: DataFrame, value: str, edges: list[float], weights: str | None = None, density: bool = False) -> DataFrame:
    """bin, low, high, n of every bin, empty ones too."""
    spark = df.sparkSession
    what = F.sum(d(weights)) if weights else F.count(F.lit(1))
    counted = df.select(bin_of(value, edges).alias("bin"), *([weights] if weights else [])).where("bin IS NOT NULL").groupBy("bin").agg(what.alias("n"))
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, low double, high double")
    out = frame.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if density:
        out = out.withColumn("n", F.col("n") / (F.sum("n").over(W.partitionBy()) * (F.col("high") - F.col("low"))))
    return out


#: Most bins that the rule ``stone`` tries.
MOST_STONE = 4096


def _stone(df: DataFrame, value: str, n: int, lo: float, hi: float) -> int:
    """The number of equal bins with the least estimated squared error: counts for every number tried, added up within tasks."""
    import numpy as np
    import pyarrow as pa

    most = max(100, math.isqrt(n))
    if most > MOST_STONE:
        raise ValueError(f"the rule 'stone' would try {most} numbers of bins; at most {MOST_STONE}")

    def run(batches):
        counts = [np.zeros(k, np.int64) for k in range(1, most + 1)]
        for batch in batches:
            x = batch.column(0).to_numpy()
            for k, c in enumerate(counts, 1):
                c += np.histogram(x, k, (lo, hi))[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(1, most + 1), np.arange(1, most + 1))), pa.array(np.concatenate([np.arange(k) for k in range(1, most + 1)])), pa.array(np.concatenate(counts))], names=["k", "bin", "n"])

    held = df.select(d(value).alias("v")).where("v IS NOT NULL AND NOT isnan(v)").mapInArrow(run, "k long, bin long, n long")
    squares = held.groupBy("k", "bin").agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum(F.pow(F.col("n") / n, F.lit(2.0))).alias("s"))
    risk = (2 - (n + 1) * F.col("s")) * F.col("k") / (hi - lo)
    return squares.select("k", risk.alias("risk")).orderBy("risk", "k").first()["k"]


def bin_edges(df: DataFrame, value: str, bins: int | str = 10) -> list[float]:
    """Edges of equal bins over the range: a number of them, or the rule ``sturges``, ``sqrt``, ``rice``, ``scott``, ``fd``,
    ``doane``, ``auto`` or ``stone``."""
    v = d(value)
    known = df.where(~F.isnan(v))
    n, lo, hi, s, skewed = known.agg(F.count(v), F.min(v), F.max(v), F.stddev_pop(v), F.skewness(v)).first()
    if not n:
        lo, hi, s, n = 0.0, 1.0, 0.0, 1
    span = hi - lo
    if isinstance(bins, str) and not span:
        bins = 1
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if isinstance(bins, str):
        width = None
        if bins == "stone":
            bins = _stone(known, value, n, lo, hi)
        else:
            if bins in ("fd", "auto"):
                q = quantiles(known, [], value, [0.25, 0.75]).first()
                width = 2 * (q[1] - q[0]) / n ** (1 / 3)
            if bins == "auto":  # fixed rule: quartiles, but no more than about twice the root, and no fewer than by Sturges
                width = min(max(width, span / math.sqrt(n) / 2), span / (math.log2(n) + 1))
            elif bins == "scott":
                width = (24 * math.sqrt(math.pi) / n) ** (1 / 3) * s
            elif bins == "doane":
                bound = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0.0
                width = span / (1 + math.log2(n) + math.log2(1 + abs(skewed) / bound)) if bound and s else 0.0
            if width is None:
                bins = {"sturges": math.ceil(math.log2(n)) + 1, "sqrt": math.ceil(math.sqrt(n)), "rice": math.ceil(2 * n ** (1 / 3))}[bins]
            else:
                bins = math.ceil(span / width) if width else 1
    return [lo + (hi - lo) * k / bins for k in range(bins)] + [hi]


def histogramdd(df: DataFrame, values: list[str], edges: list[list[float]]) -> DataFrame:
    """b0, b1, ..., n of the bins that hold something."""
    names = [f"b{k}" for k in range(len(values))]
    placed = df.select(*[bin_of(v, e).alias(b) for v, e, b in zip(values, edges, names, strict=True)]).na.drop()
    return placed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    return (
        df.select(bin_of(x, x_edges).alias("bx"), bin_of(y, y_edges).alias("by"))
        .where("bx IS NOT NULL AND by IS NOT NULL")
        .groupBy("bx", "by")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bincount(df: DataFrame, value: str, weights: str | None = None, minlength: int = 0) -> DataFrame:
    """i0, n of every value from 0 to the largest (which an aggregate finds first, so that the frame is made by many tasks)."""
    what = F.sum(d(weights)) if weights else F.count(F.lit(1))
    rows = df.where(F.col(value).isNotNull())
    low, top = rows.agg(F.min(value), F.max(value)).first()
    if low is not None and low < 0:
        raise ValueError("a negative value has no bin")
    counted = rows.groupBy(F.col(value).cast("long").alias("i0")).agg(what.alias("n"))
    every = df.sparkSession.range(max(int(top if top is not None else -1) + 1, minlength)).select(F.col("id").alias("i0"))
    return every.join(counted, "i0", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# -- tests of hypotheses ---------------------------------------------------------------------------------------------


def _t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t):
        return NAN
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    dd = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = dd
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            dd = 1 + k * dd
            dd = 1 / (dd if abs(dd) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            out *= dd * c
        if abs(dd * c - 1) < 1e-15:
            break
    return front * out


def ttest_1samp(df: DataFrame, value: str, popmean: float) -> tuple[float, float]:
    m, s, n = df.agg(mean(value), std(value, 1), F.count(d(value))).first()
    t = (m - popmean) / (s / math.sqrt(n))
    return t, _t_two_sided(t, n - 1)


def ttest_ind(df: DataFrame, value: str, group: str, equal_var: bool = False) -> tuple[float, float]:
    """t and two-sided p of the two groups that ``group`` names, in order; NaN where neither varies."""
    rows = df.groupBy(group).agg(mean(value).alias("m"), variance(value, 1).alias("s"), F.count(d(value)).alias("n")).orderBy(group).take(2)
    if len(rows) < 2 or min(r["n"] for r in rows) < 2:
        raise ValueError("each sample needs two values at least")
    (_, m1, v1, n1), (_, m2, v2, n2) = rows
    if v1 == 0 and v2 == 0:
        return NAN, NAN
    if equal_var:
        dof = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        dof, se = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), math.sqrt(a + b)
    t = (m1 - m2) / se
    return t, _t_two_sided(t, dof)


def chi2_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of every pair of values, from marginals by cube."""
    cube = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    rows = cube.where("g = 1").select(F.col(a).alias("a"), F.col("n").alias("na"))
    cols = cube.where("g = 2").select(F.col(b).alias("b"), F.col("n").alias("nb"))
    cells = cube.where("g = 0").select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("n").alias("observed"))
    whole = cube.where("g = 3").select(F.col("n").alias("__n"))  # one row
    total = F.col("__n")
    return (
        cells.join(rows, "a").join(cols, "b").join(F.broadcast(whole))
        .withColumn("expected", F.col("na") * F.col("nb") / total)
        .select("a", "b", "observed", "expected")
    )


def ks_2samp(df: DataFrame, value: str, group: str) -> tuple[float, float]:
    """Largest distance between the distributions of the two groups that ``group`` (0 and 1) names, and its asymptotic
    p: counts per distinct value, then running sums over the distributed order of the values."""
    from .order import running

    per = df.groupBy(d(value).alias("v")).agg(*[F.count_if(F.col(group) == k).alias(f"c{k}") for k in (0, 1)])
    n0, n1 = per.agg(F.sum("c0"), F.sum("c1")).first()
    if not n0 or not n1:
        raise ValueError("both samples must have values")
    gap = running(per.withColumn("g", F.col("c0") * n1 - F.col("c1") * n0), ["v"], "g", "s")  # whole numbers: no rounding
    far = gap.agg(F.max(F.abs("s"))).first()[0] / (n0 * n1)
    root = math.sqrt(n0 * n1 / (n0 + n1))
    return far, _kolmogorov_tail((root + 0.12 + 0.11 / root) * far)  # fixed values: the usual correction for small samples


def _kolmogorov_tail(x: float) -> float:
    if x <= 0:
        return 1.0
    terms = [(-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 201)]
    return min(max(2 * math.fsum(terms), 0.0), 1.0)


def chi2_tail(x: float, dof: int) -> float:
    """P(X > x) of a chi-squared variable: a finite sum for whole degrees of freedom."""
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        return min(1.0, math.fsum(math.exp(-half + k * math.log(half) - math.lgamma(k + 1)) for k in range(dof // 2)))
    steps = [math.exp(-half + (k + 0.5) * math.log(half) - math.lgamma(k + 1.5)) for k in range((dof - 1) // 2)]
    return min(1.0, math.erfc(math.sqrt(half)) + math.fsum(steps))


def chi2_contingency(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """Statistic, p and degrees of freedom, without a correction for continuity."""
    cells = chi2_table(df, a, b)
    stat, rows, cols, seen = cells.agg(
        F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")), F.countDistinct("a"), F.countDistinct("b"), F.sum("expected")
    ).first()
    total = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).count()
    if not total:
        raise ValueError("an empty table")
    stat, dof = float(stat + total - seen), (rows - 1) * (cols - 1)  # absent cells add what they were expected to hold
    return stat, chi2_tail(stat, dof), dof


def _correlation_p(r: float | None, n: int) -> float:
    if r is None or math.isnan(r):
        return NAN
    if n <= 2:
        return 1.0 if n == 2 else NAN
    return _t_two_sided(r * math.sqrt((n - 2) / max(1 - r * r, 2.2250738585072014e-308)), n - 2)


def pearsonr(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Correlation and two-sided p over the rows that have both; NaN where either is constant."""
    r, n = df.agg(correlation(x, y), F.count(d(x) + d(y))).first()
    if n < 2:
        raise ValueError("two observations at least")
    r = NAN if r is None else min(max(r, -1.0), 1.0) if not math.isnan(r) else r
    return r, _correlation_p(r, n)


def spearmanr(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Correlation of mean ranks and two-sided p."""
    from .order import spearman

    row = spearman(df, x, y, []).first()
    if row is None or row["n"] is None or row["n"] < 2:
        raise ValueError("two observations at least")
    return row["rho"], _correlation_p(row["rho"], row["n"])


def all_true(v) -> Column:
    """Whether no value is 0 (NaN isn't); true of nothing."""
    return F.coalesce(F.bool_and((d(v) != 0) | F.isnan(d(v))), F.lit(True))


def any_true(v) -> Column:
    return F.coalesce(F.bool_or((d(v) != 0) | F.isnan(d(v))), F.lit(False))
