"""Queries of whole columns as one lane, each with its SQL: scans, neighbours, as-of joins, selection, convolution, exact integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.ieee import int_floor_divide
from ..functions.ufuncs import BINARY, UNARY
from ..operators import arrange, order, reduce, signal
from .catalog import query
from .queries import r, table


@query(
    "accumulate_whole",
    """SELECT event_id, max(value) OVER w AS hi, min(value) OVER w AS lo, round(product(1 + value / 1e7) OVER w, 8) AS prod, round(sum(value) OVER w, 4) AS total,
              bool_and(value > -1e9) OVER w AS every, bool_or(value > 60) OVER w AS some
       FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def accumulate_whole(spark, sf):
    """Running results of six associative functions over all events as one lane, in one pass."""
    v = F.col("value")
    rows = table(spark, sf, "events").select("event_id", "value")
    folds = {"hi": ("maximum", v), "lo": ("minimum", v), "prod": ("multiply", 1 + v / 1e7), "total": ("add", v), "every": ("logical_and", v > -1e9), "some": ("logical_or", v > 60)}
    got = order.accumulate_many(rows, "event_id", folds)
    return got.select("event_id", "hi", "lo", r("prod", 8).alias("prod"), r("total", 4).alias("total"), "every", "some")


@query(
    "accumulate_lanes",
    "SELECT event_id, max(value) OVER w AS hi, round(product(1 + value / 1e7) OVER w, 8) AS prod FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
)
def accumulate_lanes(spark, sf):
    """The same in a few large lanes."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    got = order.accumulate_many(rows, "event_id", {"hi": ("maximum", F.col("value")), "prod": ("multiply", 1 + F.col("value") / 1e7)}, ["event_type"])
    return got.select("event_id", "hi", r("prod", 8).alias("prod"))


@query(
    "differences_whole",
    """WITH g AS (SELECT event_id, value, row_number() OVER w AS n, count(*) OVER () AS m, lag(value) OVER w AS a, lead(value) OVER w AS b, lag(value, 2) OVER w AS aa FROM events WINDOW w AS (ORDER BY event_id))
       SELECT event_id, round(value - 2 * a + aa, 6) AS second, round(CASE WHEN n = 1 THEN b - value WHEN n = m THEN value - a ELSE (b - a) / 2 END, 6) AS slope FROM g WHERE n > 2""",
)
def differences_whole(spark, sf):
    """Second differences and the gradient of one lane."""
    rows = table(spark, sf, "events").select("event_id", "value")
    second = order.diff(rows, "event_id", "value", n=2, as_col="second").select("event_id", r("second").alias("second"))
    slope = order.gradient(rows, "event_id", "value", as_col="slope").select("event_id", r("slope").alias("slope"))
    return second.join(slope, "event_id")


@query(
    "unwrap_whole",
    """WITH p AS (SELECT event_id, ((event_id * 7) % 11)::DOUBLE AS v FROM events),
       s AS (SELECT *, v - lag(v) OVER (ORDER BY event_id) AS d FROM p),
       m AS (SELECT *, d + 2 - floor((d + 2) / 4) * 4 - 2 AS w FROM s),
       c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < 2 THEN 0 WHEN w = -2 AND d > 0 THEN 2 - d ELSE w - d END AS t FROM m)
       SELECT event_id, v + sum(t) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS unwrapped FROM c""",
)
def unwrap_whole(spark, sf):
    """Phases with many jumps of odd half turns, of both signs: whole numbers, so nothing is rounded."""
    phases = table(spark, sf, "events").select("event_id", (F.col("event_id") * 7 % 11).cast("double").alias("v"))
    return order.unwrap(phases, "event_id", "v", period=4.0).select("event_id", "unwrapped")


@query(
    "runs_whole",
    """WITH f AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (ORDER BY event_id) AS isl FROM f WHERE value > 20)
       SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY isl""",
)
def runs_whole(spark, sf):
    return order.runs(table(spark, sf, "events"), "event_id", F.col("value") > 20)


@query(
    "sliding_whole",
    """SELECT event_id, round(CASE WHEN count(*) OVER w = 50 THEN avg(value) OVER w END, 6) AS mean, CASE WHEN count(*) OVER w = 50 THEN min(value) OVER w END AS min
       FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
)
def sliding_whole(spark, sf):
    got = order.sliding(table(spark, sf, "events").select("event_id", "value"), "event_id", "value", 50)
    return got.select("event_id", r("mean").alias("mean"), "min")


@query(
    "correlate_whole",
    """WITH g AS (SELECT value, lag(value) OVER w AS a, lag(value, 2) OVER w AS b, event_id AS x, lag(event_id) OVER w AS xa FROM events WINDOW w AS (ORDER BY event_id))
       SELECT count(b) AS n, round(sum(0.5 * b - 2 * a + value) / count(b), 6) AS mean, round(sum((x - xa) * (value + a) / 2) / count(a), 6) AS area FROM g""",
)
def correlate_whole(spark, sf):
    """A short kernel along one lane, and the mean of its trapezoids."""
    rows = table(spark, sf, "events").select("event_id", "value")
    got = order.correlate(rows, "event_id", "value", [0.5, -2.0, 1.0]).agg(F.count("correlated").alias("n"), r(F.avg("correlated")).alias("mean"), (F.count(F.lit(1)) - 1).alias("steps"))
    area = order.trapezoid(rows, "event_id", "value")
    return got.join(F.broadcast(area)).select("n", "mean", r(F.col("area") / F.col("steps")).alias("area"))  # one row each


@query(
    "interp_whole",
    """WITH k AS (SELECT o_totalprice AS x, avg(o_custkey) AS y FROM orders GROUP BY 1), q AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 4 AS x FROM lineitem),
       a AS (SELECT q.*, k.x AS ax, k.y AS ay FROM q ASOF LEFT JOIN k ON q.x >= k.x), b AS (SELECT a.*, k.x AS bx, k.y AS yb FROM a ASOF LEFT JOIN k ON a.x < k.x)
       SELECT l_orderkey, l_linenumber, round(CASE WHEN ax IS NULL THEN yb WHEN bx IS NULL THEN ay ELSE ay + (yb - ay) * (x - ax) / (bx - ax) END, 4) AS y FROM b""",
)
def interp_whole(spark, sf):
    """All of lineitem against a long table of knots, without groups."""
    knots = table(spark, sf, "orders").groupBy(F.col("o_totalprice").alias("kx")).agg(F.avg("o_custkey").alias("ky"))
    q = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 4).alias("x"))
    return order.interp(q, "x", knots, "kx", "ky").select("l_orderkey", "l_linenumber", r("y", 4).alias("y"))


@query(
    "searchsorted_whole",
    """WITH k AS (SELECT o_totalprice AS x, sum(count(*)) OVER (ORDER BY o_totalprice) AS upto FROM orders GROUP BY 1)
       SELECT l_orderkey, l_linenumber, coalesce(a.upto, 0)::BIGINT AS below, coalesce(b.upto, 0)::BIGINT AS upto
       FROM lineitem ASOF LEFT JOIN k a ON l_extendedprice > a.x ASOF LEFT JOIN k b ON l_extendedprice >= b.x""",
)
def searchsorted_whole(spark, sf):
    """Places of all prices of lineitem among all order totals, on both sides."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    knots = table(spark, sf, "orders").select("o_totalprice")
    got = order.searchsorted_table(rows, "l_extendedprice", knots, "o_totalprice", as_col="below")
    got = order.searchsorted_table(got, "l_extendedprice", knots, "o_totalprice", as_col="upto", side="right")
    return got.select("l_orderkey", "l_linenumber", "below", "upto")


@query(
    "digitize_fine",
    "WITH e AS (SELECT k * 37.5 + (k % 3) AS e FROM range(3000) t(k)) SELECT o_orderkey, (SELECT count(*) FROM e WHERE e.e <= o_totalprice)::INT AS bin FROM orders",
)
def digitize_fine(spark, sf):
    """Thousands of uneven edges that the plan holds."""
    edges = [k * 37.5 + k % 3 for k in range(3000)]
    return order.digitize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", edges).select("o_orderkey", "bin")


_INFLATED = "CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice ELSE 0 END"


@query(
    "quantiles_inflated",
    f"""WITH v AS (SELECT l_returnflag AS g, {_INFLATED} AS v FROM lineitem)
        SELECT g, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.93), 6) AS p93, round(quantile_cont(v, 0.999), 6) AS p999 FROM v GROUP BY g
        UNION ALL SELECT '*', round(quantile_cont(v, 0.5), 6), round(quantile_cont(v, 0.9), 6), round(quantile_cont(v, 0.93), 6), round(quantile_cont(v, 0.999), 6) FROM v""",
)
def quantiles_inflated(spark, sf):
    """Of a column that is zero in nine of ten rows, by group and of the whole."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.expr(_INFLATED).cast("double").alias("v"))
    qs, names = [0.5, 0.9, 0.93, 0.999], ["p50", "p90", "p93", "p999"]
    columns = [r(f"q_{i}").alias(n) for i, n in enumerate(names)]
    whole = reduce.quantiles(rows, [], "v", qs).select(F.lit("*").alias("g"), *columns)
    return reduce.quantiles(rows, ["g"], "v", qs).select("g", *columns).unionByName(whole)


_BIG = 9007199254740993


@query(
    "exact_integers",
    f"""WITH b AS (SELECT o_orderkey AS k, {_BIG} + 2 * o_orderkey AS x, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_custkey % 7) AS y, 1700000000123456999 + o_orderkey * 1000000007 AS ns FROM orders)
        SELECT k, lcm(x, 1) AS l, CASE WHEN y = 0 THEN 0 ELSE x // y - (x % y <> 0 AND (x % y < 0) <> (y < 0))::INT END AS q, CASE WHEN y = 0 THEN 0 ELSE -x // y - (-x % y <> 0 AND (-x % y < 0) <> (y < 0))::INT END AS nq,
               ns // 1000 AS us, -ns // 1000 - (ns % 1000 <> 0)::INT AS nus, (x // 1000003) % 1000003 AS high, x % 1000003 AS low
        FROM b""",
)
def exact_integers(spark, sf):
    """Whole numbers beyond what a double holds: multiples, floor division, units of time, places of a flat index."""
    k = F.col("o_orderkey")
    x, y = k * 2 + _BIG, F.when(k % 2 == 0, -1).otherwise(1) * (F.col("o_custkey") % 7)
    ns = k * 1000000007 + 1700000000123456999
    high, low = arrange.unravel_index(x, (1000003, 1000003))
    return table(spark, sf, "orders").select(
        k.alias("k"), BINARY["lcm"](x, F.lit(1)).alias("l"), int_floor_divide(x, y).alias("q"), int_floor_divide(-x, y).alias("nq"),
        dates.rescale(ns, "ns", "us").alias("us"), dates.rescale(-ns, "ns", "us").alias("nus"), high.alias("high"), low.alias("low"),
    )


@query(
    "signed_spacing",
    """SELECT o_orderkey, nextafter(o_totalprice, 'infinity'::DOUBLE) - o_totalprice AS up, nextafter(-o_totalprice, '-infinity'::DOUBLE) + o_totalprice AS down,
              nextafter(pow(2.0, o_orderkey % 50), 'infinity'::DOUBLE) - pow(2.0, o_orderkey % 50) AS power FROM orders""",
)
def signed_spacing(spark, sf):
    x = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", UNARY["spacing"](x).alias("up"), UNARY["spacing"](-x).alias("down"), UNARY["spacing"](F.pow(F.lit(2.0), F.col("o_orderkey") % 50)).alias("power")
    )


@query(
    "geometric_means",
    """WITH v AS (SELECT user_id, event_id % 40 = 0 AS zero, event_id % 97 = 0 AS negative, CASE WHEN event_id % 97 = 0 THEN -value WHEN event_id % 40 = 0 THEN 0 ELSE abs(value) + 1 END AS v FROM events)
       SELECT user_id, CASE WHEN min(v) < 0 THEN 'nan'::DOUBLE WHEN min(v) = 0 THEN 0 ELSE round(exp(avg(ln(CASE WHEN v > 0 THEN v END))), 8) END AS gmean FROM v GROUP BY user_id""",
)
def geometric_means(spark, sf):
    """With zeros and negative values among them."""
    e = F.col("event_id")
    v = F.when(e % 97 == 0, -F.col("value")).when(e % 40 == 0, 0.0).otherwise(F.abs("value") + 1)
    got = table(spark, sf, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(reduce.gmean("v").alias("gmean"))
    return got.select("user_id", F.when(F.isnan("gmean"), F.col("gmean")).otherwise(r("gmean", 8)).alias("gmean"))


_TAPS = 301
_KERNEL = f"SELECT k, cos(k * 0.37) / (1 + k) AS w FROM range({_TAPS}) t(k)"
_CONVOLVED = f"""WITH x AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS v, count(*) OVER () AS n FROM events), k AS ({_KERNEL}),
       f AS (SELECT x.i + k.k AS i, sum(v * w) AS v FROM x, k GROUP BY 1), n AS (SELECT count(*) AS n FROM events)"""


@query(
    "convolve_modes",
    f"""{_CONVOLVED}
        SELECT 'full' AS mode, i, round(v, 5) AS v FROM f UNION ALL SELECT 'same', i - {(_TAPS - 1) // 2}, round(v, 5) FROM f, n WHERE i >= {(_TAPS - 1) // 2} AND i < {(_TAPS - 1) // 2} + n
        UNION ALL SELECT 'valid', i - {_TAPS - 1}, round(v, 5) FROM f, n WHERE i >= {_TAPS - 1} AND i < n""",
)
def convolve_modes(spark, sf):
    """All events as one lane with a kernel of some hundred places, by blocks with halos."""
    lane = order.ranked(table(spark, sf, "events").select("event_id", "value"), ["event_id"], "i")
    n = lane.count()
    kernel = spark.range(_TAPS).select(F.col("id").alias("k"), (F.cos(F.col("id") * 0.37) / (1 + F.col("id"))).alias("w"))
    out = None
    for mode in signal.MODES:
        got = signal.convolve(lane, "i", "value", n, kernel, mode, block=512).select(F.lit(mode).alias("mode"), "i", r("v", 5).alias("v"))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "correlate_columns",
    """WITH x AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal / 1000 AS v FROM customer), k AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_acctbal / 1000 AS w FROM supplier),
       n AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM k) AS m)
       SELECT x.i - k.k AS i, round(sum(v * w), 5) AS v FROM x, k, n WHERE x.i - k.k >= 0 AND x.i - k.k <= n - m GROUP BY 1""",
)
def correlate_columns(spark, sf):
    """One column slid along another: a kernel that is itself a table, in pieces."""
    lane = order.ranked(table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("v")), ["c_custkey"], "i")
    kernel = order.ranked(table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("w")), ["s_suppkey"], "k").select("k", "w")
    return signal.correlate(lane, "i", "v", lane.count(), kernel).select("i", r("v", 5).alias("v"))


def _next_prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@query(
    "chirp_transform",
    """WITH x AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS j, c_acctbal / 1000 AS v FROM customer),
       p AS (SELECT min(p) AS p FROM range(2, 400000) t(p) WHERE p >= (SELECT count(*) FROM x) AND p < (SELECT count(*) FROM x) + 400 AND NOT EXISTS (SELECT 1 FROM range(2, 700) d(d) WHERE d * d <= p AND p % d = 0)),
       k AS (SELECT unnest(range(p)) AS k, p FROM p)
       SELECT k, round(sum(v * cos(2 * pi() * ((j * k) % p) / p)), 5) + 0.0 AS re, round(-sum(v * sin(2 * pi() * ((j * k) % p) / p)), 5) + 0.0 AS im FROM x, k GROUP BY k""",
)
def chirp_transform(spark, sf):
    """The transform of all balances, at the next prime length."""
    lane = order.ranked(table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("v")), ["c_custkey"], "j")
    n = _next_prime(lane.count())
    got = signal.chirp_fft(lane, [], "j", "v", n)
    return got.select("k", (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"))
