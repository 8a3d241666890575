"""Further queries: transforms, polynomials, windows, dates, complex numbers, differentiation, masks, event time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import autodiff, dates, strings, tapers
from ..functions import complex as cx
from ..functions.polynomials import Series, fit
from ..operators import fft, linalg, masked, order, random, reduce
from ..streaming import windows
from .catalog import query
from .queries import _matrix, masked_union, r, table


@query("fft_energy", "SELECT vec_id, round(64 * sum(v * v), 3) AS energy, round(sum(v), 4) AS dc FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def fft_energy(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("lane"))
    f = fft.fft(e, "lane")
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    return f.select("vec_id", r(power, 3).alias("energy"), r(F.get("re", F.lit(0)), 4).alias("dc"))


@query(
    "dft",
    """WITH c AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
       SELECT vec_id, k::INT AS k, round(sum(v * cos(-2 * pi() * j * k / 64)), 5) + 0.0 AS re FROM c, range(64) t(k) GROUP BY ALL""",
)
def dft(spark, sf):
    c = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    got = fft.dft(c.withColumn("v", F.col("v").cast("double")), ["vec_id"], "j", "v", 64)
    return got.select("vec_id", "k", (r("re", 5) + 0.0).alias("re"))


@query(
    "long_fft",
    """WITH x AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer), n AS (SELECT (10 * ceil(max(i + 1) / 10))::BIGINT AS n FROM x)
       SELECT k, round(sum(v * cos(2 * pi() * ((i * k) % n) / n)), 3) + 0.0 AS re, round(-sum(v * sin(2 * pi() * ((i * k) % n) / n)), 3) + 0.0 AS im FROM x, n, range(n) t(k) GROUP BY k""",
)
def long_fft(spark, sf):
    """One lane of all balances in order of their keys, in two passes of short transforms."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), "c_acctbal")
    n = -(-(c.agg(F.max("i")).first()[0] + 1) // 10) * 10
    return fft.long_fft(c, [], "i", "c_acctbal", n).select("k", (r("re", 3) + 0.0).alias("re"), (r("im", 3) + 0.0).alias("im"))


@query(
    "matrix_norms",
    """WITH c AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
       SELECT 'fro' AS ord, round(sqrt(sum(v * v)), 6) AS v FROM c UNION ALL SELECT 'one', round(max(s), 6) FROM (SELECT sum(abs(v)) AS s FROM c GROUP BY j)
       UNION ALL SELECT 'inf', round(max(s), 6) FROM (SELECT sum(abs(v)) AS s FROM c GROUP BY i) UNION ALL SELECT 'neg', round(min(s), 6) FROM (SELECT sum(abs(v)) AS s FROM c GROUP BY i)""",
)
def matrix_norms(spark, sf):
    m = _matrix(spark, sf)
    orders = (("fro", "fro"), ("one", 1), ("inf", float("inf")), ("neg", float("-inf")))
    return masked_union([linalg.matrix_norm(m, o).select(F.lit(n).alias("ord"), r("v").alias("v")) for n, o in orders])


@query(
    "tall_qr",
    """WITH c AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
       SELECT a.j AS i0, b.j AS i1, round(sum(a.v * b.v), 4) AS gram, (a.j = b.j)::INT::DOUBLE AS unit FROM c a JOIN c b ON a.i = b.i GROUP BY ALL""",
)
def tall_qr(spark, sf):
    """What defines the factors: R'R is the Gram matrix, Q'Q the unit one."""
    rows, factor = linalg.tall_qr(table(spark, sf, "embeddings").select("embedding"), "embedding", 64)
    product = factor.T @ factor
    cells = spark.createDataFrame([(i, j, round(float(product[i, j]), 4)) for i in range(64) for j in range(64)], "i0 long, i1 long, gram double")
    return cells.join(linalg.gram(rows, "q", 64), ["i0", "i1"]).select("i0", "i1", "gram", F.abs(F.round("v", 6)).alias("unit"))


@query(
    "date_ticks",
    """SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE AS later, epoch_us(o_orderdate) // 1000 + o_custkey * 1000 AS ms, epoch_us(o_orderdate) // 86400000000 - 7 AS days,
              date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate) AS hours FROM orders""",
)
def date_ticks(spark, sf):
    o = table(spark, sf, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        "o_orderkey", dates.shift("o_orderdate", F.lit(90), "m").alias("later"), dates.add_ticks(dates.rescale(us, "us", "ms"), "ms", "o_custkey", "s")[0].alias("ms"),
        dates.subtract_ticks(dates.rescale(us, "us", "D"), "D", F.lit(7), "D")[0].alias("days"), dates.difference("o_orderdate", F.lit("1992-01-01").cast("timestamp_ntz"), "h").alias("hours"),
    )


@query("polynomials", "SELECT l_orderkey, l_linenumber, round(1 + 2 * (l_quantity / 50) + 3 * pow(l_quantity / 50, 2), 8) AS power, round(1 + 2 * (l_quantity / 50) + 3 * (2 * pow(l_quantity / 50, 2) - 1) + (4 * pow(l_quantity / 50, 3) - 3 * l_quantity / 50), 8) AS cheb, round(1 + 2 * (l_quantity / 50) + 3 * (3 * pow(l_quantity / 50, 2) - 1) / 2, 8) AS leg, round(2 + 6 * (l_quantity / 50), 8) AS slope FROM lineitem")
def polynomials(spark, sf):
    x = F.col("x") / 50
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))
    p = Series((1.0, 2.0, 3.0))
    return df.select("l_orderkey", "l_linenumber", r(p(x), 8).alias("power"), r(Series((1.0, 2.0, 3.0, 1.0), "chebyshev")(x), 8).alias("cheb"), r(Series((1.0, 2.0, 3.0), "legendre")(x), 8).alias("leg"), r(p.deriv()(x), 8).alias("slope"))


@query("polyfit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS c1, round(regr_intercept(l_extendedprice, l_quantity), 1) AS c0 FROM lineitem")
def polyfit(spark, sf):
    c = fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 1).coefficients
    return spark.createDataFrame([(round(c[1], 3), round(c[0], 1))], "c1 double, c0 double")


@query(
    "tapers",
    """WITH w AS (SELECT i::BIGINT AS i, 0.5 - 0.5 * cos(2 * pi() * i / 49) AS hann, 0.54 - 0.46 * cos(2 * pi() * i / 49) AS hamming, 1 - abs(2 * i / 49 - 1) AS bartlett, exp(-pow((i - 24.5) / 7, 2) / 2) AS gaussian FROM range(50) t(i))
       SELECT l_orderkey, l_linenumber, round(hann * l_extendedprice, 4) AS hann, round(hamming * l_extendedprice, 4) AS hamming, round(bartlett * l_extendedprice, 4) AS bartlett, round(gaussian * l_extendedprice, 4) AS gaussian
       FROM lineitem JOIN w ON w.i = l_quantity - 1""",
)
def tapers_query(spark, sf):
    """The price of every line item under windows of 50 points, at the place that its quantity names."""
    i = F.col("l_quantity") - 1
    named = {n: tapers.taper(n, i, 50, *a) for n, a in (("hann", ()), ("hamming", ()), ("bartlett", ()), ("gaussian", (7.0,)))}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[r(w * F.col("l_extendedprice"), 4).alias(n) for n, w in named.items()])


@query(
    "dates",
    """SELECT o_orderkey, isodow(o_orderdate) - 1 AS wd, isodow(o_orderdate) < 6 AS open, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
              (SELECT count(*) FROM range(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) t(k) WHERE isodow(DATE '1992-01-01' + k::INT) < 6) AS busdays
       FROM orders""",
)
def dates_query(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.weekday(d).cast("long").alias("wd"), dates.is_busday(d).alias("open"), dates.truncate(d, "M").alias("month"),
        dates.busday_count(F.lit(dt.date(1992, 1, 1)), d).alias("busdays"),
    )


_HOLIDAYS = [dt.date(1995, 12, 25), dt.date(1996, 1, 1), dt.date(1996, 7, 4), dt.date(1998, 12, 25)]


@query(
    "business_days",
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, DATE '1996-06-15' AS b, [DATE '1995-12-25', DATE '1996-01-01', DATE '1996-07-04', DATE '1998-12-25'] AS h FROM orders),
       s AS (SELECT *, CASE WHEN a <= b THEN a ELSE b + 1 END AS lo, CASE WHEN a <= b THEN b ELSE a + 1 END AS hi FROM o)
       SELECT o_orderkey, (CASE WHEN a <= b THEN 1 ELSE -1 END) * (SELECT count(*) FROM range(hi - lo) t(k) WHERE isodow(lo + k::INT) < 6 AND NOT list_contains(h, lo + k::INT)) AS busdays,
              list_filter(list_transform(range(30), lambda k: a + k::INT), lambda d: isodow(d) < 6 AND NOT list_contains(h, d))[4] AS after,
              list_filter(list_transform(range(30), lambda k: a - k::INT), lambda d: isodow(d) <> 5 AND isodow(d) <> 6 AND isodow(d) <> 7)[3] AS earlier
       FROM s""",
)
def business_days(spark, sf):
    """Both ways from one date, with holidays; steps on and, in a week of four days, back."""
    a, b = F.col("o_orderdate"), F.lit(dt.date(1996, 6, 15))
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.busday_count(a, b, _HOLIDAYS).alias("busdays"), dates.busday_offset(a, 3, "forward", _HOLIDAYS).alias("after"),
        dates.busday_offset(a, -2, "backward", weekmask="1111000").alias("earlier"),
    )


@query("complex_numbers", "SELECT o_orderkey, round(a * a - 4, 6) AS re, round(4 * a, 6) AS im, round(sqrt(a * a + 4), 6) AS size FROM (SELECT o_orderkey, o_custkey / 100 AS a FROM orders)")
def complex_numbers(spark, sf):
    z = cx.make(F.col("o_custkey") / 100, F.lit(2.0))
    sq = cx.multiply(z, z)
    return table(spark, sf, "orders").select("o_orderkey", r(sq["re"]).alias("re"), r(sq["im"]).alias("im"), r(cx.absolute(z)).alias("size"))


@query(
    "complex_functions",
    """SELECT l_orderkey, l_linenumber, round(sin(a) * cosh(b), 8) AS sin_re, round(cos(a) * sinh(b), 8) AS sin_im, round(exp(a) * cos(b), 8) AS exp_re, round(ln(a * a + b * b) / 2, 8) AS log_re,
              round(atan2(b, a), 8) AS log_im, round(sqrt((sqrt(a * a + b * b) + a) / 2), 8) AS sqrt_re, round(cosh(a) * cos(b), 8) AS cosh_re, round(a / (a * a + b * b), 8) AS inverse_re
       FROM (SELECT *, l_quantity / 10 AS a, l_discount * 10 + 0.5 AS b FROM lineitem)""",
)
def complex_functions(spark, sf):
    z = cx.make(F.col("l_quantity") / 10, F.col("l_discount") * 10 + 0.5)
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"))
    s, e, g, q, c, i = (f(F.col("z")) for f in (cx.sin, cx.exp, cx.log, cx.sqrt, cx.cosh, cx.reciprocal))
    return df.select(
        "l_orderkey", "l_linenumber", r(s["re"], 8).alias("sin_re"), r(s["im"], 8).alias("sin_im"), r(e["re"], 8).alias("exp_re"), r(g["re"], 8).alias("log_re"),
        r(g["im"], 8).alias("log_im"), r(q["re"], 8).alias("sqrt_re"), r(c["re"], 8).alias("cosh_re"), r(i["re"], 8).alias("inverse_re"),
    )


@query(
    "covariance_matrix",
    """WITH c AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
       SELECT a.j AS i0, b.j AS i1, round(covar_samp(a.v, b.v), 7) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY ALL""",
)
def covariance_matrix(spark, sf):
    return linalg.covariance_matrix(table(spark, sf, "embeddings"), "embedding", 64).withColumn("v", r("v", 7))


@query("derivatives", "SELECT l_orderkey, l_linenumber, round(x0 * sin(x0) + exp(-x0), 8) AS y, round(sin(x0) + x0 * cos(x0) - exp(-x0), 8) AS dy FROM (SELECT *, l_quantity / 10 + l_tax AS x0 FROM lineitem)")
def derivatives(spark, sf):
    f = lambda x: x * x.sin() + (-x).exp()
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10 + F.col("l_tax")).alias("x"))
    y, dy = autodiff.value_and_derivative(f, F.col("x"))
    return df.select("l_orderkey", "l_linenumber", r(y, 8).alias("y"), r(dy, 8).alias("dy"))


@query("random_moments")
def random_moments(spark, sf):
    """Draws by the row number of every line item; no SQL draws the same numbers (see philox_draws for those that it does)."""
    i = F.xxhash64("l_orderkey", "l_linenumber")
    df = table(spark, sf, "lineitem").select(
        random.uniform(i, 1).alias("u"), random.normal(i, 2).alias("z"), random.poisson(i, 3, 4.0).alias("p"), random.exponential(i, 4).alias("e"), random.poisson(i, 5, 760.0).alias("large"), random.binomial(i, 6, 1000, 0.3).alias("trials")
    )
    return df.agg(*[r(f(c), 1).alias(f"{n}_{c}") for c in df.columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@query("random_distributions")
def random_distributions(spark, sf):
    """Means of distributions made by rejection, mixture and factoring, a draw of each for every line item."""
    i = F.xxhash64("l_orderkey", "l_linenumber")
    df = table(spark, sf, "lineitem").select(
        random.gamma(i, 1, 2.5, 2.0).alias("gamma"), random.beta(i, 2, 2.0, 3.0).alias("beta"), random.standard_t(i, 3, 9.0).alias("t"), random.vonmises(i, 4, 0.5, 2.0).alias("vonmises"),
        random.zipf(i, 5, 4.0).alias("zipf"), random.wald(i, 6, 2.0, 5.0).alias("wald"), random.negative_binomial(i, 7, 3.0, 0.4).alias("negative_binomial"),
        random.hypergeometric(i, 8, 7, 13, 6).alias("hypergeometric"), random.multinomial(i, 9, 10, [1.0, 3.0, 6.0])[1].alias("multinomial"),
        random.dirichlet(i, 10, [1.0, 2.0, 3.0])[2].alias("dirichlet"), random.multivariate_normal(i, 11, [1.0, 2.0], [[2.0, 0.6], [0.6, 1.0]])[1].alias("normal"),
    )
    return df.agg(*[r(F.avg(c), 2).alias(c) for c in df.columns])


@query("sample_rows")
def sample_rows(spark, sf):
    """A sampling operator: the limit is the feature."""
    return random.sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 7)


@query("tumbling_windows", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '6 hours' AS stop, event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    got = windows.windowed(table(spark, sf, "events"), "ts", "value", "6 hours", by=["event_type"])
    return got.withColumns({"total": r("total", 4), "mean": r("mean", 8), "std": r("std", 4)})


@query("session_counts", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "2 hours", ["user_id"])


@query(
    "masked_clumps",
    """WITH f AS (SELECT user_id, event_id, value > 40 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
       g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM f WHERE bad)
       SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, isl""",
)
def masked_clumps(spark, sf):
    m = masked.masked_greater(table(spark, sf, "events"), "value", 40)
    return masked.clump_masked(m, "event_id", "value", ["user_id"])


@query("anomalies", "SELECT event_id, round(v - avg(v) OVER (PARTITION BY event_type), 6) AS a FROM (SELECT *, CASE WHEN value <= 40 THEN value END AS v FROM events)")
def anomalies(spark, sf):
    m = masked.masked_greater(table(spark, sf, "events"), "value", 40)
    return masked.anomalies(m, "value", ["event_type"]).select("event_id", r("anomaly").alias("a"))


@query("masked_rows", "SELECT user_id, event_id, CASE WHEN bool_or(value > 95) OVER (PARTITION BY user_id) THEN NULL ELSE value END AS value FROM events")
def masked_rows(spark, sf):
    """The whole lane of a user with a masked value is masked."""
    m = masked.masked_greater(table(spark, sf, "events").select("user_id", "event_id", "value"), "value", 95)
    return masked.mask_rowcols(m, ["user_id"], "value")


@query("trapezoid", "SELECT user_id, round(coalesce(sum((event_id - pe) * (value + pv) / 2), 0), 3) AS area FROM (SELECT *, lag(event_id) OVER w AS pe, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def trapezoid(spark, sf):
    return order.trapezoid(table(spark, sf, "events"), "event_id", "value", ["user_id"]).withColumn("area", r("area", 3))


@query("iqr", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1")
def iqr(spark, sf):
    return reduce.iqr(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").withColumn("iqr", r("iqr", 4))


@query("quantiles_whole", "SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q_0, round(quantile_cont(l_extendedprice, 0.99), 6) AS q_1 FROM lineitem")
def quantiles_whole(spark, sf):
    got = reduce.quantiles(table(spark, sf, "lineitem").select("l_extendedprice"), [], "l_extendedprice", [0.25, 0.99])
    return got.select(r("q_0").alias("q_0"), r("q_1").alias("q_1"))


@query("string_classes", "SELECT c_custkey, regexp_full_match(substr(c_name, 10), '[0-9]+') AS digits, c_name = upper(c_name) AS up, rpad(left(c_name, 3), 6, '*') AS padded, regexp_extract(c_name, '([0-9]+)', 1) AS num, length(c_name) - length(replace(c_name, '0', '')) AS zeros FROM customer")
def string_classes(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", strings.isdigit(F.substring(n, 10, 100)).alias("digits"), (n == strings.upper(n)).alias("up"), strings.ljust(F.substring(n, 1, 3), 6, "*").alias("padded"),
        strings.regex_extract(n, "([0-9]+)", 1).alias("num"), strings.count(n, "0").cast("long").alias("zeros"),
    )


@query("string_cuts", "SELECT c_custkey, c_name[-3:] AS tail, c_name[2:5] AS inner, strpos(c_name, '0') - 1 + length(c_name) - length(rtrim(c_name)) AS first, c_name < 'Customer#000000075' AS low, printf('%s/%05d', c_mktsegment, c_custkey) AS filled, string_split(c_name, '#')[1] AS head FROM customer")
def string_cuts(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", strings.slice(n, -3).alias("tail"), strings.slice(n, 1, 5).alias("inner"), strings.index(n, "0").cast("long").alias("first"),
        strings.less(n, F.lit("Customer#000000075")).alias("low"), strings.mod("%s/%05d", "c_mktsegment", "c_custkey").alias("filled"), strings.rsplit(n, "#", 1)[0].alias("head"),
    )
