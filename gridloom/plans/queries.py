"""Queries over the test tables, each with its SQL.  Floats are rounded alike on both sides: sums depend on order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee, strings
from ..functions.ufuncs import BINARY, UFUNC_OBJECTS, UNARY, choose, clip, piecewise, round_to, select
from ..operators import arrange, linalg, masked, order, reduce, setops, udf
from ..operators.frame import NdFrame
from .catalog import query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, k: int = 6):
    return F.round(c, k)


@query(
    "reduce_by_group",
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 6) AS mean,
              round(stddev_pop(l_extendedprice), 6) AS std, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
              round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def reduce_by_group(spark, sf):
    keys, v = ["l_returnflag", "l_linestatus"], "l_extendedprice"
    rows = table(spark, sf, "lineitem").select(*keys, v)
    sums = rows.groupBy(*keys).agg(r(reduce.total(v), 2).alias("total"), r(reduce.mean(v)).alias("mean"), r(reduce.std(v)).alias("std"), F.count(F.lit(1)).alias("n"))
    places = reduce.quantiles(rows, keys, v, [0.5, 0.9])
    return sums.join(places, keys).select(*keys, "total", "mean", "std", r("q_0").alias("p50"), r("q_1").alias("p90"), "n")


@query(
    "reduce_extremes",
    """SELECT l_suppkey, min(l_discount) AS lo, max(l_tax) AS hi, round(max(l_quantity) - min(l_quantity), 6) AS ptp,
              round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS average,
              count(*) FILTER (WHERE l_discount <> 0) AS nonzero FROM lineitem GROUP BY l_suppkey""",
)
def reduce_extremes(spark, sf):
    return reduce.reduce_by(
        table(spark, sf, "lineitem"), ["l_suppkey"], lo=reduce.minimum("l_discount"), hi=reduce.maximum("l_tax"),
        ptp=r(reduce.ptp("l_quantity")), average=r(reduce.average("l_extendedprice", "l_quantity")), nonzero=reduce.count_nonzero("l_discount"),
    )


@query(
    "argmin_argmax",
    """SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS lowest,
              arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS highest FROM orders GROUP BY o_custkey""",
)
def argmin_argmax(spark, sf):
    return reduce.reduce_by(
        table(spark, sf, "orders"), ["o_custkey"], lowest=reduce.argmin("o_orderkey", "o_totalprice"), highest=reduce.argmax("o_orderkey", "o_totalprice")
    )


@query(
    "variance_ddof",
    """SELECT user_id, round(var_pop(value), 3) AS v0, round(CASE WHEN count(*) > 1 THEN var_samp(value)
              ELSE 'nan'::DOUBLE END, 3) AS v1, count(*) AS n FROM events GROUP BY user_id""",
)
def variance_ddof(spark, sf):
    return reduce.reduce_by(
        table(spark, sf, "events"), ["user_id"], v0=r(reduce.variance("value"), 3), v1=r(reduce.variance("value", 1), 3), n=F.count(F.lit(1))
    )


@query(
    "descriptive",
    """SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS gmean, round(count(*) / sum(1 / (value + 1)), 6) AS hmean,
              round(stddev_samp(value) / sqrt(count(*)), 6) AS sem,
              round((sum(value ** 3) / count(*) - 3 * avg(value) * sum(value ** 2) / count(*) + 2 * avg(value) ** 3)
                    / stddev_pop(value) ** 3, 5) AS skew
       FROM events WHERE value >= 0 GROUP BY event_type""",
)
def descriptive(spark, sf):
    e = table(spark, sf, "events").where("value >= 0")
    up = F.col("value") + 1
    return reduce.reduce_by(e, ["event_type"], gmean=r(reduce.gmean(up)), hmean=r(reduce.hmean(up)), sem=r(reduce.sem("value")), skew=r(reduce.skew("value"), 5))


@query(
    "correlations",
    """SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS r
       FROM lineitem GROUP BY l_returnflag""",
)
def correlations(spark, sf):
    return reduce.reduce_by(
        table(spark, sf, "lineitem"), ["l_returnflag"], cov=r(reduce.covariance("l_quantity", "l_extendedprice"), 4), r=r(reduce.correlation("l_quantity", "l_extendedprice"), 8)
    )


@query("mode_smallest", "SELECT l_suppkey, min(v) AS mode FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS k FROM (SELECT l_suppkey, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1 GROUP BY l_suppkey")
def mode_smallest(spark, sf):
    return reduce.reduce_by(table(spark, sf, "lineitem"), ["l_suppkey"], mode=reduce.mode("l_linenumber"))


@query(
    "nan_reductions",
    """SELECT l_returnflag, round(sum(v), 4) AS nansum, round(avg(v), 8) AS nanmean, round(max(v), 8) AS nanmax,
              round(var_pop(v), 8) AS nanvar, bool_or(v IS NULL) AS has_nan
       FROM (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS v FROM lineitem) GROUP BY l_returnflag""",
)
def nan_reductions(spark, sf):
    v = F.when(F.col("l_discount") > 0, ieee.log("l_discount")).otherwise(F.lit(ieee.NAN))
    df = table(spark, sf, "lineitem").select("l_returnflag", v.alias("v"))
    return reduce.reduce_by(
        df, ["l_returnflag"], nansum=r(reduce.nansum("v"), 4), nanmean=r(reduce.nanmean("v"), 8), nanmax=r(reduce.nanmax("v"), 8),
        nanvar=r(reduce.nanvar("v"), 8), has_nan=F.isnan(reduce.minimum("v")),
    )


def _quantile_sql(method: str) -> str:
    places = {
        "linear": ("1 + (n - 1) * q", None),
        "weibull": ("(n + 1) * q", None),
        "hazen": ("n * q + 0.5", None),
        "interpolated_inverted_cdf": ("n * q", None),
        "median_unbiased": ("(n + 1/3) * q + 1/3", None),
        "normal_unbiased": ("(n + 0.25) * q + 0.375", None),
        "lower": ("1 + (n - 1) * q", "0"),
        "higher": ("1 + (n - 1) * q", "ceil(g)"),
        "midpoint": ("1 + (n - 1) * q", "CASE WHEN g = 0 THEN 0 ELSE 0.5 END"),
        "inverted_cdf": ("n * q", "ceil(g)"),
        "averaged_inverted_cdf": ("n * q", "CASE WHEN g = 0 THEN 0.5 ELSE 1 END"),
        "nearest": ("1 + (n - 1) * q", "CASE WHEN g > 0.5 OR (g = 0.5 AND lo % 2 = 0) THEN 1 ELSE 0 END"),
        "closest_observation": ("n * q", "CASE WHEN g > 0.5 OR (g = 0.5 AND lo % 2 = 1) THEN 1 ELSE 0 END"),
    }
    at, part = places[method]
    return f"""
      WITH v AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k,
                        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
      p AS (SELECT DISTINCT l_suppkey, n, q, i, greatest(1, least(n, {at})) AS pl FROM v, (VALUES (0.1::DOUBLE, 0), (0.5, 1), (0.95, 2)) t(q, i)),
      g AS (SELECT *, floor(pl) AS lo, pl - floor(pl) AS g FROM p),
      w AS (SELECT *, {part or 'g'} AS w FROM g),
      s AS (SELECT w.l_suppkey, w.i, round(max(CASE WHEN k = lo THEN x END) * (1 - max(w.w)) + max(CASE WHEN k = least(lo + 1, v.n) THEN x END) * max(w.w), 6) AS val
            FROM w JOIN v ON v.l_suppkey = w.l_suppkey GROUP BY w.l_suppkey, w.i)
      SELECT l_suppkey, max(CASE WHEN i = 0 THEN val END) AS q_0, max(CASE WHEN i = 1 THEN val END) AS q_1, max(CASE WHEN i = 2 THEN val END) AS q_2
      FROM s GROUP BY l_suppkey"""


def _quantile_query(method: str):
    @query(f"quantile_{method}", _quantile_sql(method))
    def run(spark, sf):
        got = reduce.quantiles(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.1, 0.5, 0.95], method)
        return got.select("l_suppkey", *[r(f"q_{i}", 6).alias(f"q_{i}") for i in range(3)])


for _m in ("linear", "weibull", "hazen", "interpolated_inverted_cdf", "median_unbiased", "normal_unbiased", "lower", "higher",
           "midpoint", "inverted_cdf", "averaged_inverted_cdf", "nearest", "closest_observation"):
    _quantile_query(_m)

_EDGES = [float(x) for x in range(0, 10001, 500)]


@query(
    "histogram_20",
    """WITH b AS (SELECT i AS bin, i * 500.0::DOUBLE AS low, (i + 1) * 500.0::DOUBLE AS high FROM range(20) t(i)),
       c AS (SELECT least(floor(l_extendedprice / 500), 19) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 10000 GROUP BY 1)
       SELECT b.bin::INT AS bin, low, high, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin""",
)
def histogram_20(spark, sf):
    return reduce.histogram(table(spark, sf, "lineitem"), "l_extendedprice", _EDGES)


@query("histogram2d", "SELECT least(floor(l_quantity / 10), 4)::INT AS bx, least(floor(l_discount / 0.02), 4)::INT AS \"by\", count(*) AS n FROM (SELECT l_quantity, round(l_discount, 4) + 1e-9 AS l_discount FROM lineitem) WHERE l_quantity <= 50 AND l_discount <= 0.1 GROUP BY ALL")
def histogram2d(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.round("l_discount", 4) + 1e-9).alias("l_discount"))
    return reduce.histogram2d(df, "l_quantity", "l_discount", [0.0, 10.0, 20.0, 30.0, 40.0, 50.0], [0.0, 0.02, 0.04, 0.06, 0.08, 0.1])


@query("bincount", "SELECT i::BIGINT AS i0, coalesce(n, 0) AS n FROM range(12) t(i) LEFT JOIN (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = i")
def bincount(spark, sf):
    return reduce.bincount(table(spark, sf, "lineitem"), "l_linenumber", minlength=12)


@query("zscore", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w, 6) AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def zscore(spark, sf):
    return reduce.zscore(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderkey", r("z").alias("z"))


@query(
    "chi2_expected",
    """SELECT a, b, observed, round(sum(observed) OVER (PARTITION BY a) * sum(observed) OVER (PARTITION BY b) / sum(observed) OVER (), 6) AS expected
       FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS observed FROM lineitem GROUP BY 1, 2)""",
)
def chi2_expected(spark, sf):
    got = reduce.chi2_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return got.withColumn("expected", r("expected"))


def _tail(t: str, dof: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over 4000 steps of the density."""
    step = f"(abs({t}) / 4000)"
    density = f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2) - ln({dof} * pi()) / 2 - ({dof} + 1) / 2 * ln(1 + pow(k * {step}, 2) / {dof}))"
    return f"(SELECT 1 - 2 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density}) * {step} / 3 FROM range(4001) s(k))"


def _one(spark, names: list[str], values, digits: int = 6) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), digits) for v in values)], ", ".join(f"{n} double" for n in names))


@query(
    "ttest_welch",
    f"""SELECT round(t, 6) AS t, round({_tail("t", "dof")}, 6) AS p FROM
       (SELECT *, pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS dof, (m1 - m2) / sqrt(a + b) AS t FROM
       (SELECT *, v1 / n1 AS a, v2 / n2 AS b FROM
       (SELECT avg(value) FILTER (WHERE event_type = 'click') AS m1, var_samp(value) FILTER (WHERE event_type = 'click') AS v1,
               count(*) FILTER (WHERE event_type = 'click') AS n1, avg(value) FILTER (WHERE event_type <> 'click') AS m2,
               var_samp(value) FILTER (WHERE event_type <> 'click') AS v2, count(*) FILTER (WHERE event_type <> 'click') AS n2 FROM events)))""",
)
def ttest_welch(spark, sf):
    e = table(spark, sf, "events").select("value", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("g"))
    return _one(spark, ["t", "p"], reduce.ttest_ind(e, "value", "g"))


@query(
    "ttest_one_sample",
    f"""SELECT round(t, 6) AS t, round({_tail("t", "dof")}, 6) AS p FROM
        (SELECT (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS t, count(*) - 1 AS dof FROM events)""",
)
def ttest_one_sample(spark, sf):
    return _one(spark, ["t", "p"], reduce.ttest_1samp(table(spark, sf, "events"), "value", 50.0))


@query(
    "pearson_test",
    f"""SELECT round(r, 6) AS r, round({_tail("t", "dof")}, 5) AS p FROM (SELECT *, r * sqrt(dof / (1 - r * r)) AS t FROM
        (SELECT corr(l_quantity, l_discount) AS r, count(*) - 2 AS dof FROM lineitem))""",
)
def pearson_test(spark, sf):
    r_, p = reduce.pearsonr(table(spark, sf, "lineitem"), "l_quantity", "l_discount")
    return _one(spark, ["r", "p"], (round(r_, 6), round(p, 5)))


@query(
    "spearman_test",
    f"""WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
                     rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2 AS b FROM lineitem)
        SELECT round(r, 6) AS rho, round({_tail("t", "dof")}, 5) AS p FROM (SELECT *, r * sqrt(dof / (1 - r * r)) AS t FROM
        (SELECT corr(a, b) AS r, count(*) - 2 AS dof FROM k))""",
)
def spearman_test(spark, sf):
    rho, p = reduce.spearmanr(table(spark, sf, "lineitem"), "l_quantity", "l_tax")
    return _one(spark, ["rho", "p"], (round(rho, 6), round(p, 5)))


@query(
    "chi2_test",
    """WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2),
       e AS (SELECT coalesce(o, 0) AS o, na * nb / n AS e FROM (SELECT * FROM (SELECT a, sum(o) AS na FROM o GROUP BY a), (SELECT b, sum(o) AS nb FROM o GROUP BY b),
             (SELECT sum(o) AS n FROM o)) LEFT JOIN o USING (a, b)),
       x AS (SELECT sum((o - e) ** 2 / e) AS x, ((SELECT count(DISTINCT a) FROM o) - 1) * ((SELECT count(DISTINCT b) FROM o) - 1) AS dof FROM e)
       SELECT round(x, 6) AS statistic, round((SELECT sum(exp(-x / 2 + k * ln(x / 2) - lgamma(k + 1))) FROM range(dof // 2) t(k)), 6) AS p, dof::DOUBLE AS dof FROM x""",
)
def chi2_test(spark, sf):
    return _one(spark, ["statistic", "p", "dof"], reduce.chi2_contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query(
    "ks_test",
    """WITH v AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS c0, count(*) FILTER (WHERE event_type <> 'click') AS c1 FROM events GROUP BY value),
       d AS (SELECT max(abs(f0 - f1)) AS d, any_value(n0) AS n0, any_value(n1) AS n1 FROM
             (SELECT sum(c0) OVER w / sum(c0) OVER () AS f0, sum(c1) OVER w / sum(c1) OVER () AS f1, sum(c0) OVER () AS n0, sum(c1) OVER () AS n1 FROM v WINDOW w AS (ORDER BY value))),
       l AS (SELECT d, (sqrt(n0 * n1 / (n0 + n1)) + 0.12 + 0.11 / sqrt(n0 * n1 / (n0 + n1))) * d AS l FROM d)
       SELECT round(d, 6) AS d, round(least(1, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * l * l)) FROM range(1, 200) t(k))), 6) AS p FROM l""",
)
def ks_test(spark, sf):
    e = table(spark, sf, "events").select("value", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("g"))
    return _one(spark, ["d", "p"], reduce.ks_2samp(e, "value", "g"))


@query("kurtosis", "SELECT event_type, round((sum(pow(value - m, 4)) / count(*)) / pow(sum(pow(value - m, 2)) / count(*), 2) - 3, 5) AS kurtosis FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def kurtosis(spark, sf):
    return reduce.reduce_by(table(spark, sf, "events"), ["event_type"], kurtosis=r(reduce.kurtosis("value"), 5))


@query("all_any", "SELECT l_suppkey, bool_and(l_discount <> 0) AS every, bool_or(l_discount <> 0) AS some, bool_and(l_quantity <> 0) AS whole FROM lineitem GROUP BY 1")
def all_any(spark, sf):
    return reduce.reduce_by(table(spark, sf, "lineitem"), ["l_suppkey"], every=reduce.all_true("l_discount"), some=reduce.any_true("l_discount"), whole=reduce.all_true("l_quantity"))


# -- elementwise --------------------------------------------------------------------------------------------------------

_MATH = {
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "arctan": "atan(x)", "sinh": "sinh(x / 10)", "cosh": "cosh(x / 10)",
    "tanh": "tanh(x)", "arcsinh": "asinh(x)", "exp": "exp(-x)", "expm1": "exp(-x) - 1", "log": "ln(x)", "log2": "log2(x)",
    "log10": "log10(x)", "log1p": "ln(1 + x)", "sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "square": "x * x", "reciprocal": "1 / x",
    "floor": "floor(x * 1.5)", "ceil": "ceil(x * 1.5)", "trunc": "trunc(x * 1.5)", "rint": "round_even(x / 2, 0)", "degrees": "degrees(x)",
    "radians": "radians(x)", "sign": "sign(x - 25)::DOUBLE", "absolute": "abs(x - 25)", "exp2": "pow(2, x / 10)",
}
_SCALE = {"sinh": lambda x: x / 10, "cosh": lambda x: x / 10, "exp": lambda x: -x, "expm1": lambda x: -x, "floor": lambda x: x * 1.5, "ceil": lambda x: x * 1.5,
          "trunc": lambda x: x * 1.5, "rint": lambda x: x / 2, "sign": lambda x: x - 25, "absolute": lambda x: x - 25, "exp2": lambda x: x / 10}


@query("ufunc_unary", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({e}, 8) AS f_{n}" for n, e in _MATH.items()) + " FROM (SELECT *, l_quantity + l_discount AS x FROM lineitem)")
def ufunc_unary(spark, sf):
    x = F.col("x")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_discount")).alias("x"))
    return df.select("l_orderkey", "l_linenumber", *[r(UNARY[n](_SCALE.get(n, lambda v: v)(x)), 8).alias(f"f_{n}") for n in _MATH])


@query(
    "ufunc_binary",
    """SELECT l_orderkey, l_linenumber, round(q / d, 6) AS divide, floor(q / -3) AS floordiv, round(q - floor(q / -0.7) * -0.7, 6) AS remainder,
              round(sqrt(q * q + t * t), 6) AS hypot, round(atan2(q, t), 6) AS arctan2, greatest(q, 25) AS maximum, least(q, 25) AS minimum,
              gcd(l_orderkey, l_linenumber)::BIGINT AS gcd, lcm(l_orderkey, l_linenumber)::BIGINT AS lcm, xor(l_orderkey, 255) AS bxor, l_orderkey & 15 AS band
       FROM (SELECT *, l_quantity AS q, l_discount + 1 AS d, l_tax AS t FROM lineitem)""",
)
def ufunc_binary(spark, sf):
    q, t = F.col("l_quantity"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r(BINARY["divide"](q, F.col("l_discount") + 1)).alias("divide"), BINARY["floor_divide"](q, F.lit(-3.0)).alias("floordiv"),
        r(BINARY["remainder"](q, F.lit(-0.7))).alias("remainder"), r(BINARY["hypot"](q, t)).alias("hypot"), r(BINARY["arctan2"](q, t)).alias("arctan2"),
        BINARY["maximum"](q, F.lit(25.0)).alias("maximum"), BINARY["minimum"](q, F.lit(25.0)).alias("minimum"),
        BINARY["gcd"]("l_orderkey", "l_linenumber").alias("gcd"), BINARY["lcm"]("l_orderkey", "l_linenumber").alias("lcm"),
        BINARY["bitwise_xor"]("l_orderkey", F.lit(255)).alias("bxor"), BINARY["bitwise_and"]("l_orderkey", F.lit(15)).alias("band"),
    )


@query(
    "conditional",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice < 5000 THEN 1 ELSE 2 END AS sel,
              least(greatest(o_totalprice, 1000), 5000) AS clipped, (o_orderkey % 3 + 10) AS chosen,
              CASE WHEN o_totalprice < 2000 THEN o_totalprice / 2 ELSE 7 END AS pieces, round_even(o_totalprice / 8, 1) AS rounded FROM orders""",
)
def conditional(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", select([p < 1000, p < 5000], [F.lit(0), F.lit(1)], F.lit(2)).alias("sel"), clip(p, 1000.0, 5000.0).alias("clipped"),
        choose(F.col("o_orderkey") % 3, [F.lit(10).cast("long"), F.lit(11).cast("long"), F.lit(12).cast("long")]).alias("chosen"),
        piecewise(p, [p < 2000], [lambda x: x / 2], 7.0).alias("pieces"), round_to(p / 8, 1).alias("rounded"),
    )


@query("ieee_division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN (CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END) ELSE round(l_tax / l_discount, 6) END AS ratio, CASE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE round(ln(l_discount), 6) END AS lg FROM lineitem")
def ieee_division(spark, sf):
    def rounded(c):
        return F.when(ieee.is_finite(c), F.round(c, 6)).otherwise(c)

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rounded(ieee.divide("l_tax", "l_discount")).alias("ratio"), rounded(ieee.log("l_discount")).alias("lg"))


@query(
    "predicates",
    """SELECT l_orderkey, l_linenumber, l_tax <> 0 AND l_discount <> 0 AS finite, l_discount = 0 AND l_tax <> 0 AS infinite, l_discount = 0 AND l_tax = 0 AS nan,
              l_discount < 0.05 AS negative, abs(l_tax - l_discount) <= 0.001 + 0.1 * abs(l_discount) AS close, l_tax = l_discount AS same,
              (l_tax <> 0) <> (l_discount <> 0) AS either, bit_count(l_orderkey) AS bits FROM lineitem""",
)
def predicates(spark, sf):
    ratio = ieee.divide("l_tax", "l_discount")
    inverse = ieee.divide(F.lit(1.0), ratio)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (UNARY["isfinite"](ratio) & UNARY["isfinite"](inverse)).alias("finite"), UNARY["isposinf"](ratio).alias("infinite"), UNARY["isnan"](ratio).alias("nan"),
        UNARY["signbit"](F.col("l_discount") - 0.05).alias("negative"), ieee.isclose("l_tax", "l_discount", 0.1, 0.001).alias("close"), BINARY["equal"]("l_tax", "l_discount").alias("same"),
        BINARY["logical_xor"]("l_tax", "l_discount").alias("either"), UNARY["bitwise_count"]("l_orderkey").cast("long").alias("bits"),
    )


@query("ufunc_accumulate", "SELECT event_id, max(value) OVER w AS highest, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def ufunc_accumulate(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("highest"), F.col("value").alias("total"))
    return UFUNC_OBJECTS["add"].accumulate(UFUNC_OBJECTS["maximum"].accumulate(e, "highest", "event_id", ["user_id"]), "total", "event_id", ["user_id"]).select("event_id", "highest", r("total").alias("total"))


# -- order --------------------------------------------------------------------------------------------------------------


@query("cumsum_by_group", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS cumsum FROM events")
def cumsum_by_group(spark, sf):
    return order.cumsum(table(spark, sf, "events"), "event_id", "value", ["user_id"]).select("event_id", r("cumsum").alias("cumsum"))


@query("cumsum_whole", "SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey))::BIGINT AS cumsum FROM orders")
def cumsum_whole(spark, sf):
    return order.cumsum(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "cumsum")


@query("diff_by_group", "SELECT event_id, round(d, 6) AS diff FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) WHERE d IS NOT NULL")
def diff_by_group(spark, sf):
    return order.diff(table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id", "value", ["user_id"]).select("event_id", r("diff").alias("diff"))


@query("gradient", "SELECT event_id, round(CASE WHEN b IS NULL AND a IS NULL THEN NULL WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END, 6) AS gradient FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def gradient(spark, sf):
    return order.gradient(table(spark, sf, "events"), "event_id", "value", ["user_id"]).select("event_id", r("gradient").alias("gradient"))


@query("sort_lanes", "SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS i FROM orders")
def sort_lanes(spark, sf):
    got = order.sort_lanes(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice")
    return got.select("o_custkey", "o_totalprice", F.col("i").cast("long").alias("i"))


@query("argsort", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rank, event_id AS index FROM events")
def argsort(spark, sf):
    return order.argsort(table(spark, sf, "events"), ["user_id"], "value", "event_id").withColumn("rank", F.col("rank").cast("long"))


@query("lexsort", "SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_discount, l_orderkey * 10 + l_linenumber) - 1 AS rank, l_orderkey * 10 + l_linenumber AS index FROM lineitem")
def lexsort(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return order.lexsort(df, ["l_suppkey"], ["l_discount", "l_quantity"], "pos").withColumn("rank", F.col("rank").cast("long"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, sf):
    return order.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, "o_orderkey")


@query("spearman", "WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 8) AS rho FROM k GROUP BY 1")
def spearman(spark, sf):
    return order.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]).select("l_returnflag", r("rho", 8).alias("rho"))


@query("partition_kth", "SELECT o_orderkey, sign(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 - 100)::INT AS part FROM orders")
def partition_kth(spark, sf):
    return order.partition(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100).select("o_orderkey", "part")


@query("sort_complex", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS i FROM orders")
def sort_complex(spark, sf):
    z = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("re"), F.col("o_orderkey").cast("double").alias("im"))
    return order.sort_complex(z, "re", "im").select("o_orderkey", "i")


@query("ediff1d", "SELECT 0::BIGINT AS i0, -1.0::DOUBLE AS v UNION ALL SELECT k, round(v, 6) FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey) AS v FROM orders) WHERE v IS NOT NULL")
def ediff1d(spark, sf):
    return order.ediff1d(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", to_begin=[-1.0]).withColumn("v", r("v"))


@query(
    "gradient_spaced",
    """SELECT event_id, round(CASE WHEN b IS NULL AND a IS NULL THEN NULL WHEN b IS NULL THEN (a - value) / (ea - event_id) WHEN a IS NULL THEN (value - b) / (event_id - eb)
              ELSE (pow(event_id - eb, 2) * a - pow(ea - event_id, 2) * b + (pow(ea - event_id, 2) - pow(event_id - eb, 2)) * value) / ((event_id - eb) * (ea - event_id) * (ea - eb)) END, 8) AS gradient
       FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a, lag(event_id) OVER w AS eb, lead(event_id) OVER w AS ea FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
)
def gradient_spaced(spark, sf):
    return order.gradient(table(spark, sf, "events"), "event_id", "value", ["user_id"], spacing="event_id").select("event_id", r("gradient", 8).alias("gradient"))


@query("unique_counts", "SELECT l_partkey, min(l_orderkey) AS first_index, count(*) AS n FROM lineitem GROUP BY 1")
def unique_counts(spark, sf):
    return order.unique(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


@query("unique_inverse", "SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS inverse FROM events")
def unique_inverse(spark, sf):
    return order.unique_inverse(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "inverse")


@query("digitize", "SELECT o_orderkey, ((o_totalprice >= 1000)::INT + (o_totalprice >= 2500)::INT + (o_totalprice >= 7000)::INT) AS bin FROM orders")
def digitize(spark, sf):
    return order.digitize(table(spark, sf, "orders"), "o_totalprice", [1000.0, 2500.0, 7000.0]).select("o_orderkey", "bin")


@query("searchsorted_table", "SELECT e.event_id, (SELECT count(*) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_totalprice < e.value * 1000) AS at FROM events e")
def searchsorted_table(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("value") * 1000).alias("x"))
    knots = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_totalprice")
    return order.searchsorted_table(e, "x", knots, "o_totalprice", ["user_id"]).select("event_id", F.coalesce("at", F.lit(0)).cast("long").alias("at"))


@query(
    "interp",
    """WITH k AS (SELECT l_suppkey AS g, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
       q AS (SELECT DISTINCT l_suppkey AS g, l_quantity + 0.25 AS x FROM lineitem),
       m AS (SELECT q.g, q.x, max(k.x) FILTER (WHERE k.x <= q.x) AS lo, min(k.x) FILTER (WHERE k.x > q.x) AS hi FROM q LEFT JOIN k USING (g) GROUP BY 1, 2)
       SELECT m.g, m.x, round(CASE WHEN lo IS NULL THEN b.y WHEN hi IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (m.x - lo) / (hi - lo) END, 8) AS y
       FROM m LEFT JOIN k a ON a.g = m.g AND a.x = lo LEFT JOIN k b ON b.g = m.g AND b.x = hi""",
)
def interp(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "g")
    knots = li.groupBy("g", F.col("l_quantity").alias("kx")).agg(F.avg("l_extendedprice").alias("ky"))
    q = li.select("g", (F.col("l_quantity") + 0.25).alias("x")).distinct()
    return order.interp(q, "x", knots, "kx", "ky", ["g"]).select("g", "x", r("y", 8).alias("y"))


@query("sliding_window", "SELECT event_id, round(CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w END, 6) AS mean, CASE WHEN count(*) OVER w = 3 THEN max(value) OVER w END AS max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def sliding_window(spark, sf):
    s = order.sliding(table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id", "value", 3, ["user_id"])
    return s.select("event_id", r("mean").alias("mean"), "max")


@query(
    "runs",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
       g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM f WHERE value > 20)
       SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, isl""",
)
def runs(spark, sf):
    return order.runs(table(spark, sf, "events"), "event_id", F.col("value") > 20, ["user_id"])


# -- sets ---------------------------------------------------------------------------------------------------------------


def _two(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))


for _name, _op in (("union1d", "UNION"), ("intersect1d", "INTERSECT"), ("setdiff1d", "EXCEPT")):

    def _set_query(name: str = _name, op: str = _op):
        @query(name, f"SELECT o_custkey AS k FROM orders {op} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
        def run(spark, sf):
            return getattr(setops, name)(*_two(spark, sf), "k")

    _set_query()


@query("setxor1d", "SELECT k FROM (SELECT DISTINCT o_custkey AS k FROM orders UNION ALL SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) GROUP BY k HAVING count(*) = 1")
def setxor1d(spark, sf):
    return setops.setxor1d(*_two(spark, sf), "k")


_NAN_SIDES = """WITH a AS (SELECT DISTINCT CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE l_quantity END AS k FROM lineitem),
                     b AS (SELECT DISTINCT CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_linenumber * 9.0 END AS k FROM lineitem) """


def _nan_sides(spark, sf):
    li = table(spark, sf, "lineitem")
    nan = F.lit(ieee.NAN)
    return li.select(F.when(F.col("l_discount") == 0, nan).otherwise(F.col("l_quantity")).alias("k")), li.select(F.when(F.col("l_tax") == 0, nan).otherwise(F.col("l_linenumber") * 9.0).alias("k"))


for _name, _sql in (
    ("union1d", "SELECT k FROM a UNION SELECT k FROM b"),
    ("intersect1d", "SELECT k FROM a JOIN b USING (k) WHERE NOT isnan(k)"),
    ("setdiff1d", "SELECT k FROM a WHERE isnan(k) OR k NOT IN (SELECT k FROM b)"),
    ("setxor1d", "SELECT k FROM (SELECT k FROM a UNION ALL SELECT k FROM b) GROUP BY k HAVING count(*) = 1 AND NOT isnan(k) UNION ALL SELECT k FROM a WHERE isnan(k) UNION ALL SELECT k FROM b WHERE isnan(k)"),
):

    def _nan_query(name: str = _name, sql: str = _sql):
        @query(f"{name}_nan", _NAN_SIDES + sql)
        def run(spark, sf):
            return getattr(setops, name)(*_nan_sides(spark, sf), "k")

    _nan_query()


@query(
    "masked_sets",
    """WITH a AS (SELECT DISTINCT CASE WHEN c_acctbal > 0 THEN c_nationkey END AS k FROM customer), b AS (SELECT DISTINCT CASE WHEN s_acctbal > 5000 THEN s_nationkey END AS k FROM supplier)
       SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
       UNION ALL SELECT 'only', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def masked_sets(spark, sf):
    a = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("k"))
    b = table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).alias("k"))
    parts = (("union", masked.ma_union1d), ("both", masked.ma_intersect1d), ("only", masked.ma_setdiff1d))
    return masked_union([f(a, b, "k").select(F.lit(n).alias("op"), "k") for n, f in parts])


def masked_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("isin", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS isin FROM orders")
def isin(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return setops.isin(o, _two(spark, sf)[1], "k").select("o_orderkey", "isin")


# -- arrays -------------------------------------------------------------------------------------------------------------


def _matrix(spark, sf) -> NdFrame:
    """All embeddings, a row each; their ids are row numbers."""
    e = table(spark, sf, "embeddings")
    rows = e.agg(F.max("vec_id")).first()[0]
    return NdFrame.from_vectors(e, "vec_id", "embedding", (0 if rows is None else rows + 1, 64))


_CELLS = "WITH c AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT count(*) AS n FROM embeddings) "


@query("gram_matrix", "WITH c AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.j AS i0, b.j AS i1, round(sum(a.v * b.v), 5) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY ALL")
def gram_matrix(spark, sf):
    return linalg.gram(table(spark, sf, "embeddings"), "embedding", 64).withColumn("v", r("v", 5))


def _weights(spark, n: int, m: int) -> NdFrame:
    return NdFrame.from_function(spark, (n, m), lambda i, j: ((i * 3 + j) % 7 - 3).cast("double"))


@query("matmul", _CELLS + "SELECT i AS i0, l AS i1, round(sum(v * ((j * 3 + l) % 7 - 3)), 6) AS v FROM c, range(4) t(l) GROUP BY ALL")
def matmul(spark, sf):
    return _matrix(spark, sf).matmul(_weights(spark, 64, 4)).cells.withColumn("v", r("v"))


@query("block_matmul", _CELLS + "SELECT a.j AS i0, b.j AS i1, round(sum(a.v * b.v), 5) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY ALL")
def block_matmul(spark, sf):
    m = _matrix(spark, sf)
    return linalg.block_matmul(m.transpose(), m).cells.withColumn("v", r("v", 5))


@query("einsum_three", _CELLS + "SELECT i AS i0, p AS i1, round(sum(v * ((j * 3 + l) % 7 - 3) * ((l * 3 + p) % 7 - 3)), 5) AS v FROM c, range(4) t(l), range(3) u(p) GROUP BY ALL")
def einsum_three(spark, sf):
    return linalg.einsum("ij,jk,kl->il", _matrix(spark, sf), _weights(spark, 64, 4), _weights(spark, 4, 3)).cells.withColumn("v", r("v", 5))


@query("einsum_ellipsis", _CELLS + "SELECT i AS i0, j // 8 AS i1, l AS i2, round(sum(v * (((j % 8) * 3 + l) % 7 - 3)), 6) AS v FROM c, range(2) t(l) GROUP BY ALL")
def einsum_ellipsis(spark, sf):
    return linalg.einsum("...j,jk->...k", _matrix(spark, sf).reshape((-1, 8, 8)), _weights(spark, 8, 2)).cells.withColumn("v", r("v"))


@query("broadcast_center", _CELLS + "SELECT i AS i0, j AS i1, round(v - avg(v) OVER (PARTITION BY j), 6) AS v FROM c")
def broadcast_center(spark, sf):
    m = _matrix(spark, sf)
    return m.ufunc("subtract", m.reduce(F.avg, axis=0)).cells.withColumn("v", r("v"))


@query("axis_sums", _CELLS + "SELECT i AS i0, round(sum(v), 6) AS v FROM c GROUP BY i")
def axis_sums(spark, sf):
    return _matrix(spark, sf).reduce(F.sum, axis=1).cells.withColumn("v", r("v"))


@query("rearranged", _CELLS + "SELECT (63 - j) AS i0, ((i + 5) % n) AS i1, v FROM c, m")
def rearranged(spark, sf):
    return _matrix(spark, sf).roll(5, 0).transpose().flip(0).cells


@query("reshaped", _CELLS + "SELECT ((i * 64 + j) // 32)::BIGINT AS i0, ((i * 64 + j) % 32)::BIGINT AS i1, v FROM c")
def reshaped(spark, sf):
    return _matrix(spark, sf).reshape((-1, 32)).cells


@query("moved_axes", _CELLS + "SELECT j // 8 AS i0, j % 8 AS i1, i AS i2, v FROM c")
def moved_axes(spark, sf):
    return arrange.moveaxis(_matrix(spark, sf).reshape((-1, 8, 8)), 0, -1).cells


@query("backward_slice", _CELLS + "SELECT i AS i0, (63 - j) // 3 AS i1, v FROM c WHERE (63 - j) % 3 = 0 AND j > 1")
def backward_slice(spark, sf):
    return _matrix(spark, sf).slice(1, None, 1, -3).cells


@query("padded", _CELLS + "SELECT i AS i0, p AS i1, v FROM c, range(69) t(p) WHERE j = CASE WHEN p < 2 THEN 2 - p WHEN p > 65 THEN 128 - p ELSE p - 2 END")
def padded(spark, sf):
    return arrange.pad(_matrix(spark, sf), [(0, 0), (2, 3)], "reflect").cells


@query("inserted_deleted", _CELLS + "SELECT i AS i0, CASE WHEN k < 5 THEN k WHEN k = 5 THEN 6 - 1 ELSE k END AS i1, v FROM (SELECT i, CASE WHEN j - 1 < 5 THEN j - 1 ELSE j END AS k, v FROM c WHERE j NOT IN (0, 63) UNION ALL SELECT DISTINCT i, 5, 7.0 FROM c)")
def inserted_deleted(spark, sf):
    return arrange.insert(arrange.delete(_matrix(spark, sf), [0, -1], 1), 5, 7.0, 1).cells


@query("turned", _CELLS + "SELECT 63 - j AS i0, i AS i1, v FROM c")
def turned(spark, sf):
    return arrange.rot90(_matrix(spark, sf)).cells


@query("split_joined", _CELLS + "SELECT i AS i0, (CASE WHEN j < 22 THEN j + 42 WHEN j < 43 THEN j - 1 ELSE j - 43 END)::BIGINT AS i1, v FROM c")
def split_joined(spark, sf):
    a, b, c = arrange.array_split(_matrix(spark, sf), 3, 1)
    return arrange.hstack(c, b, a).cells


@query("put_diagonal", _CELLS + "SELECT i AS i0, j AS i1, CASE WHEN i % 64 = j THEN 0.5 ELSE v END AS v FROM c")
def put_diagonal(spark, sf):
    m = _matrix(spark, sf)
    at = spark.range(m.shape[0]).select(F.col("id").alias("i0"), (F.col("id") % 64).alias("i1"), F.lit(0.5).alias("v"))
    return m.put(at).cells


@query("place_putmask", _CELLS + "SELECT i AS i0, j AS i1, CASE WHEN v > 0.1 THEN (i * 64 + j) % 3 ELSE v END AS v FROM c")
def place_putmask(spark, sf):
    m = _matrix(spark, sf)
    return arrange.putmask(m, m.map(lambda v: (v > 0.1).cast("double")), [0.0, 1.0, 2.0]).cells


@query("meshed", "SELECT r_regionkey::BIGINT AS i0, n_nationkey::BIGINT AS i1, n_nationkey * 100.0 + r_regionkey AS v FROM nation, region")
def meshed(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i0"), F.col("n_nationkey").cast("double").alias("v"))
    g = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("i0"), F.col("r_regionkey").cast("double").alias("v"))
    x, y = arrange.meshgrid(NdFrame(n, (n.count(),)), NdFrame(g, (g.count(),)))
    return x.combine(y, lambda a, b: a * 100.0 + b).cells


@query("axis_medians", _CELLS + "SELECT i AS i0, round(quantile_cont(v, 0.5), 6) AS v FROM c GROUP BY i")
def axis_medians(spark, sf):
    return udf.apply_along_axis(_matrix(spark, sf), 1, np.median).cells.withColumn("v", r("v"))


@query("array_comparison", _CELLS + """SELECT (SELECT bool_and(a.v = b.v) FROM c a JOIN c b ON a.i = b.i AND a.j = 63 - (63 - b.j)) AS equal,
    (SELECT bool_and(a.v = b.v) FROM c a JOIN c b ON a.i = b.i AND a.j = 63 - b.j) AS mirrored, (SELECT bool_and(abs(v - v * (1 + 1e-7)) <= 1e-8 + 1e-5 * abs(v * (1 + 1e-7))) FROM c) AS near""")
def array_comparison(spark, sf):
    m = _matrix(spark, sf)
    got = m.array_equal(m.flip(1).flip(1)), m.array_equal(m.flip(1)), m.array_equal(m.map(lambda v: v * (1 + 1e-7)), 1e-5, 1e-8)
    return spark.createDataFrame([got], "equal boolean, mirrored boolean, near boolean")


@query("take_rows", _CELLS + "SELECT k AS i0, j AS i1, v FROM c, m, (SELECT unnest([0, 1, 2]) AS k, unnest([5, 3, -4]) AS f) WHERE i = f OR i = n + f")
def take_rows(spark, sf):
    index = NdFrame(spark.createDataFrame([(0, 5), (1, 3), (2, -4)], "i0 long, v long"), (3,))
    return _matrix(spark, sf).take(index, 0).cells


@query("kron_outer", _CELLS + "SELECT j * 2 + k AS i0, round(avg(v) * w, 6) AS v FROM c, (SELECT unnest([0, 1]) AS k, unnest([0.5, 2.0]) AS w) GROUP BY j, k, w")
def kron_outer(spark, sf):
    row = _matrix(spark, sf).reduce(F.avg, axis=0, keepdims=True)
    two = NdFrame(spark.createDataFrame([(0, 0, 0.5), (0, 1, 2.0)], "i0 long, i1 long, v double"), (1, 2))
    return linalg.kron(row, two).cells.select(F.col("i1").alias("i0"), r("v").alias("v"))


@query("outer_reduce", "SELECT a.n_nationkey AS i0, max(a.n_nationkey * 2 + b.r_regionkey)::BIGINT AS v FROM nation a, region b GROUP BY 1")
def outer_reduce(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i0"), (F.col("n_nationkey") * 2).cast("long").alias("v"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("i0"), F.col("r_regionkey").cast("long").alias("v"))
    return UFUNC_OBJECTS["maximum"].reduce(UFUNC_OBJECTS["add"].outer(a, b), "v", ["i0"])


@query("linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def linear_fit(spark, sf):
    c = linalg.lstsq(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(c[1]), 4), round(float(c[0]), 2))], "slope double, intercept double")


# -- strings and masks --------------------------------------------------------------------------------------------------


@query(
    "strings",
    """SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS lo, lpad(c_custkey::VARCHAR, 9, '0') AS filled, instr(c_name, '0') - 1 AS found,
              replace(c_name, '0', 'o') AS swapped, starts_with(c_name, 'Cust') AS starts, length(c_name) AS n, reverse(c_name) AS back,
              split_part(c_name, '#', 1) AS head FROM customer""",
)
def strings_query(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", strings.upper(n).alias("up"), strings.lower(n).alias("lo"), strings.zfill(F.col("c_custkey").cast("string"), 9).alias("filled"),
        strings.find(n, "0").cast("long").alias("found"), strings.replace(n, "0", "o").alias("swapped"), strings.startswith(n, "Cust").alias("starts"),
        strings.str_len(n).cast("long").alias("n"), strings.reverse(n).alias("back"), strings.partition(n, "#")["head"].alias("head"),
    )


@query("masked_reduce", "SELECT l_returnflag, round(sum(CASE WHEN l_discount >= 0.05 THEN l_extendedprice END), 2) AS total, count(*) FILTER (WHERE l_discount >= 0.05) AS n, round(avg(CASE WHEN l_discount >= 0.05 THEN l_extendedprice ELSE 0 END), 4) AS filled FROM lineitem GROUP BY 1")
def masked_reduce(spark, sf):
    df = masked.masked_where(table(spark, sf, "lineitem"), F.col("l_discount") < 0.05, "l_extendedprice")
    return df.groupBy("l_returnflag").agg(
        r(F.sum("l_extendedprice"), 2).alias("total"), masked.count("l_extendedprice").alias("n"), r(F.avg(masked.filled("l_extendedprice", 0.0)), 4).alias("filled")
    )
