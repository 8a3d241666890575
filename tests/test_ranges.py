"""Whole lanes over ranges against NumPy: ties, equal rows, a value that fills the column, lanes of all sizes, and the plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.search import place_among
from gridloom.operators import order, ranges, reduce


@pytest.fixture(autouse=True)
def _released():
    yield
    ranges.release()


@pytest.fixture(scope="module")
def lanes(spark):
    """Lane 0 has most rows; many lanes have one or two."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        lane = 0 if rng.random() < 0.6 else int(rng.integers(1, 400))
        v = None if rng.random() < 0.05 else float(rng.integers(-9, 9))
        rows.append((i, lane if lane != 7 else None, v))
    return rows, spark.createDataFrame(rows, "k long, g long, v double").repartition(6).cache()


def _by_lane(rows):
    out = {}
    for k, g, v in sorted(rows):
        out.setdefault(g, []).append((k, v))
    return out


@pytest.mark.parametrize("by", [None, ["g"]])
@pytest.mark.parametrize("name", ["add", "maximum", "minimum", "multiply", "fmax", "fmin"])
def test_scans(lanes, name, by):
    rows, df = lanes
    if name == "multiply":
        df = df.withColumn("v", F.col("v") / 9 + 1.01)
    got = {r["k"]: r["s"] for r in ranges.scan(df, ["k"], "v", "s", name, by).collect()}
    f = {"add": np.add, "maximum": np.maximum, "minimum": np.minimum, "multiply": np.multiply, "fmax": np.fmax, "fmin": np.fmin}[name]
    for lane in (_by_lane(rows) if by else {None: sorted((k, v) for k, _, v in rows)}).values():
        total = None
        for k, v in lane:
            if v is not None:
                v = v / 9 + 1.01 if name == "multiply" else v
                total = v if total is None else float(f(total, v))
            assert (got[k] is None) if total is None else math.isclose(got[k], total, rel_tol=1e-9, abs_tol=1e-12)


def test_scan_of_flags_and_bits(spark):
    df = spark.range(400).select("id", (F.col("id") != 250).alias("b"), (F.lit(1).cast("long") * F.col("id")).alias("x")).repartition(5)
    got = ranges.scans(df, ["id"], {"every": ("logical_and", F.col("b")), "some": ("logical_or", ~F.col("b")), "xor": ("bitwise_xor", F.col("x")), "or_": ("bitwise_or", F.col("x"))}).orderBy("id").collect()
    x = np.arange(400)
    assert [r["every"] for r in got] == [i < 250 for i in range(400)] and [r["some"] for r in got] == [i >= 250 for i in range(400)]
    assert [r["xor"] for r in got] == np.bitwise_xor.accumulate(x).tolist() and [r["or_"] for r in got] == np.bitwise_or.accumulate(x).tolist()


def test_nan_in_running_minimum(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 60 else float(100 - i)) for i in range(120)], "k long, v double").repartition(4)
    got = [r["s"] for r in ranges.scan(df, ["k"], "v", "s", "minimum").orderBy("k").collect()]
    assert got[59] == 41.0 and all(math.isnan(x) for x in got[60:])


@pytest.mark.parametrize("by", [None, ["g"]])
def test_windows_across_boundaries(lanes, by):
    rows, df = lanes
    filled = df.withColumn("v", F.coalesce("v", F.lit(0.5)))
    n = {r["k"]: r["d"] for r in order.diff(filled, "k", "v", by, n=3, as_col="d").collect()}
    slopes = {r["k"]: r["s"] for r in order.gradient(filled, "k", "v", by, as_col="s").collect()}
    slid = {r["k"]: (r["sum"], r["min"]) for r in order.sliding(filled, "k", "v", 40, by).collect()}
    unwrapped = {r["k"]: r["u"] for r in order.unwrap(filled, "k", "v", by, as_col="u").collect()}
    assert len(slopes) == len(rows)
    for lane in (_by_lane(rows) if by else {None: sorted((k, v) for k, _, v in rows)}).values():
        keys, v = [k for k, _ in lane], np.array([0.5 if v is None else v for _, v in lane])
        assert [n.get(k) for k in keys] == [None] * min(3, len(v)) + np.diff(v, 3).tolist()
        if len(v) > 1:
            assert np.allclose([slopes[k] for k in keys], np.gradient(v))
        for i, k in enumerate(keys):
            part = v[max(0, i - 39) : i + 1]
            assert slid[k] == ((part.sum(), part.min()) if len(part) == 40 else (None, None))
        assert np.allclose([unwrapped[k] for k in keys], np.unwrap(v))


def test_unwrap_of_odd_half_turns(spark):
    v = [0.0, -3 * math.pi, 2.0, 2.0 + 3 * math.pi, 0.0, math.pi, -math.pi]
    df = spark.createDataFrame(list(enumerate(v)), "k long, v double")
    got = [r["unwrapped"] for r in order.unwrap(df, "k", "v").orderBy("k").collect()]
    assert np.allclose(got, np.unwrap(v))


def test_interpolation_of_a_whole_column(spark):
    rng = np.random.default_rng(5)
    kx = np.unique(rng.normal(size=500))
    ky, x = rng.normal(size=len(kx)), np.concatenate([rng.normal(size=2000) * 1.5, kx[:50], [np.nan]])
    knots = spark.createDataFrame(list(zip(kx.tolist(), ky.tolist(), strict=True)), "kx double, ky double").repartition(3)
    q = spark.createDataFrame(list(enumerate(x.tolist())), "i long, x double").repartition(3)
    got = [r["y"] for r in order.interp(q, "x", knots, "kx", "ky").orderBy("i").collect()]
    assert np.allclose(got, np.interp(x, kx, ky), equal_nan=True)
    for side in ("left", "right"):
        places = [r["at"] for r in order.searchsorted_table(q, "x", knots, "kx", side=side).orderBy("i").collect()]
        assert places == np.searchsorted(kx, x, side).tolist()


def _largest(parts):
    counts = [r["n"] for r in parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(counts) / (sum(counts) / len(counts))


def test_a_value_that_fills_the_column_is_many_tasks_work(spark):
    """Nine of ten rows are equal, once in one column and once in all."""
    tied = spark.range(40_000, numPartitions=8).select("id", F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(0.0).alias("v"))
    assert _largest(ranges.ranged(tied, [], ["v"])) < 2
    assert _largest(ranges.ranged(tied.select("v"), [], ["v"])) < 2
    got = order.ranked(tied.select("v"), ["v"], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(40_000)) and [r["v"] for r in got] == sorted(r["v"] for r in got)


@pytest.mark.parametrize("method", ["linear", "hazen", "closest_observation", "inverted_cdf", "median_unbiased", "lower"])
def test_quantiles_by_selection(spark, method):
    rng = np.random.default_rng(8)
    groups = {
        "zeros": np.where(rng.random(30_000) < 0.9, 0.0, rng.normal(size=30_000)), "smooth": rng.normal(size=20_000), "short": rng.normal(size=7), "one": np.array([3.0]),
        "far": np.concatenate([rng.normal(size=9000), [np.inf, -np.inf]]), "steps": rng.integers(0, 5, 12_000).astype(float),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.95, 0.9995, 1.0]
    got = {r["g"]: [r[f"q_{i}"] for i in range(len(qs))] for r in reduce.quantiles(df, ["g"], "v", qs, method).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        with np.errstate(invalid="ignore"):
            expected = np.quantile(v, qs, method=method)
        known = ~np.isnan(expected)  # NumPy makes NaN of an infinity that counts for nothing
        assert np.allclose(np.array(got[g])[known], expected[known]), g
    whole = reduce.quantiles(df, [], "v", qs, method).collect()
    with np.errstate(invalid="ignore"):
        expected = np.quantile(np.concatenate(list(groups.values())), qs, method=method)
    known = ~np.isnan(expected)
    assert np.allclose(np.array(whole[0])[known], expected[known])


def test_quantiles_count_few_rows_between_brackets(spark):
    """What the second scan leaves is a small part of the rows."""
    df = spark.range(200_000, numPartitions=8).select(F.rand(3).alias("v"))
    got = reduce.quantiles(df, [], "v", [0.5])
    held = ranges._held[-1][0].count()  # the counted values that were ranged
    assert held < 200_000 * 12 * reduce.SKETCH_ERROR
    assert abs(got.first()[0] - 0.5) < 0.01


@pytest.mark.parametrize("size", [0, 1, 5, 8, 9, 100, 1023, 1024])
def test_binary_search_in_a_plan(spark, size):
    edges = np.sort(np.random.default_rng(size).integers(0, 60, size) / 4).tolist()
    x = [i / 8 for i in range(-4, 130)] + [float("nan"), float("inf"), None]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    for side in ("left", "right"):
        got = [r["p"] for r in df.select("i", place_among(F.col("x"), edges, side).alias("p")).orderBy("i").collect()]
        assert got[:-1] == np.searchsorted(edges, x[:-1], side).tolist() and got[-1] is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_lane_goes_to_one_partition(spark):
    df = spark.range(2000, numPartitions=4).select("id", F.rand(2).alias("v"))
    knots = df.select(F.col("v").alias("kx"), F.col("id").cast("double").alias("ky"))
    for got in (
        ranges.scan(df, ["id"], "v", "s", "maximum"), ranges.scan(df, ["id"], "v", "s", "multiply"), order.diff(df, "id", "v"), order.gradient(df, "id", "v"), order.unwrap(df, "id", "v"), order.runs(df, "id", F.col("v") > 0.5),
        order.sliding(df, "id", "v", 9), order.interp(df, "v", knots, "kx", "ky"), order.searchsorted_table(df, "v", knots, "kx"), order.argsort(df, [], "v", "id"),
    ):
        assert "SinglePartition" not in _plan(got)


def test_release_gives_back_what_is_held(spark):
    df = order.ranked(spark.range(100).select((-F.col("id")).alias("v")), ["v"], "i")
    assert df.count() == 100 and ranges._held
    paths = [p for _, p in ranges._held if p]
    ranges.release()
    assert not ranges._held
    for p in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@pytest.mark.parametrize("rule", ["sturges", "sqrt", "rice", "scott", "fd", "doane", "auto", "stone"])
def test_rules_for_histograms(spark, rule):
    rng = np.random.default_rng(13)
    for x in (rng.normal(size=700), rng.gamma(1.5, size=3000), np.array([2.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(3)
        assert np.allclose(reduce.bin_edges(df, "v", rule), np.histogram_bin_edges(x, rule)), (rule, len(x))


def test_ranges_grow_in_number_not_in_size(spark, monkeypatch):
    """Whatever the number of shuffle partitions, a task of a window has one range of about ``ROWS`` rows."""
    monkeypatch.setattr(ranges, "ROWS", 500)
    df = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("mark"))
    parts, n = ranges._ranged(df, [], ["k"])
    assert n == 18 and parts.groupBy("__p").count().agg(F.max("count")).first()[0] < 1000
    in_tasks = ranges.dealt(parts, n).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("__p").alias("ranges"))
    assert in_tasks.agg(F.max("ranges")).first()[0] == 1
    got = {r["k"]: (r["low"], r["high"]) for r in ranges.nearest(df, ["k"], "mark", "low", "high").collect()}
    marks = [k for k in range(9000) if k % 700 == 3]
    for k in range(9000):
        assert got[k] == (max((m for m in marks if m <= k), default=None), min((m for m in marks if m > k), default=None))
