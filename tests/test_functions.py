"""Elementwise functions and operators against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import dtypes
from gridloom.functions import autodiff, dates, ieee, strings, tapers
from gridloom.functions.polynomials import Series
from gridloom.functions.ufuncs import BINARY, UNARY, clip, round_to
from gridloom.operators import fft, linalg, masked, order, random, reduce, setops
from gridloom.operators.frame import NdFrame
from gridloom.sources import npy, text

VALUES = [-np.inf, -2.5, -1.0, -0.5, -0.0, 0.0, 0.25, 0.5, 1.0, 1.5, 2.5, 3.7, 12.0, np.inf, np.nan]


@pytest.fixture(scope="module")
def column(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(VALUES)], "i int, x double")


NUMPY = {n: getattr(np, n) for n in ("fabs", "negative", "square", "sqrt", "cbrt", "reciprocal", "sign", "sin", "cos", "tan", "arcsin", "arccos", "arctan",
         "sinh", "cosh", "tanh", "arcsinh", "arccosh", "degrees", "radians", "exp", "exp2", "expm1", "log", "log2", "log10", "log1p", "floor", "ceil", "trunc",
         "rint", "isnan", "isinf", "isfinite", "signbit", "sinc", "i0", "absolute", "nan_to_num")}


@pytest.mark.parametrize("name", sorted(NUMPY))
def test_unary(column, name):
    got = np.array([r[0] for r in column.select("i", UNARY[name](F.col("x")).alias("y")).orderBy("i").select("y").collect()])
    with np.errstate(all="ignore"):
        expected = NUMPY[name](np.array(VALUES))
    if name == "i0":
        got, expected = got[np.isfinite(VALUES)], expected[np.isfinite(VALUES)]
    np.testing.assert_allclose(got.astype(float), expected.astype(float), rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("name", ["divide", "floor_divide", "remainder", "fmod", "maximum", "minimum", "fmax", "fmin", "hypot", "logaddexp", "copysign", "equal", "less", "greater_equal", "heaviside"])
def test_binary(spark, name):
    finite = [v for v in VALUES if not math.isinf(v)]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in finite for b in finite)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in pairs], "i int, a double, b double")
    got = np.array([r[0] for r in df.orderBy("i").select(BINARY[name]("a", "b")).collect()], float)
    with np.errstate(all="ignore"):
        expected = getattr(np, name)(np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])).astype(float)
    np.testing.assert_allclose(got, expected, rtol=1e-12)


def test_integers(spark):
    pairs = [(a, b) for a in (-7, -6, 0, 5, 7) for b in (-3, -1, 0, 2, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", ieee.int_floor_divide("a", "b"), ieee.int_remainder("a", "b"), BINARY["gcd"]("a", "b"), BINARY["lcm"]("a", "b")).collect()
    for a, b, q, m, g, c in got:
        assert (q, m) == ((a // b, a % b) if b else (0, 0)) and (g, c) == (math.gcd(a, b), math.lcm(a, b))


def test_clip_and_round(column):
    rows = column.select("x", clip("x", -1.0, 2.0), round_to("x")).collect()
    for x, c, r in rows:
        np.testing.assert_equal((c, r), (np.clip(x, -1, 2), np.round(x)))


@pytest.mark.parametrize("method", reduce.METHODS)
def test_quantiles(spark, method):
    x = np.random.default_rng(3).normal(size=41).round(1)
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 5.0)], "g int, v double")
    qs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q_{i}"] for i in range(len(qs))] for r in reduce.quantiles(df, ["g"], "v", qs, method).collect()}
    np.testing.assert_allclose(got[1], np.quantile(x, qs, method=method), rtol=1e-12)
    assert got[2] == [5.0] * len(qs)


def test_nan_reductions(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 3.0), (2, float("nan"))], "g int, v double")
    row = {r["g"]: r for r in reduce.reduce_by(df, ["g"], lo=reduce.minimum("v"), m=reduce.nanmean("v"), s=reduce.nansum("v"), hi=reduce.nanmax("v")).collect()}
    assert math.isnan(row[1]["lo"]) and (row[1]["m"], row[1]["s"], row[1]["hi"]) == (2.0, 4.0, 3.0)
    assert math.isnan(row[2]["m"]) and row[2]["s"] == 0.0
    assert reduce.total("v") is not None and df.limit(0).agg(reduce.total("v"), reduce.product("v")).first()[:] == (0.0, 1.0)


def test_t_test(spark):
    df = spark.createDataFrame([(float(v),) for v in (5.1, 4.9, 5.6, 5.8, 6.1, 4.4)], "v double")
    t, p = reduce.ttest_1samp(df, "v", 5.0)
    x = np.array([5.1, 4.9, 5.6, 5.8, 6.1, 4.4])
    assert abs(t - (x.mean() - 5) / (x.std(ddof=1) / math.sqrt(6))) < 1e-12
    at = np.linspace(-t, t, 200_001)  # the density of Student's t with five degrees of freedom
    density = math.gamma(3) / (math.sqrt(5 * math.pi) * math.gamma(2.5)) * (1 + at**2 / 5) ** -3
    assert abs(p - (1 - np.trapezoid(density, at))) < 1e-9


def test_running_over_the_whole_table(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v")).repartition(5)
    got = [r["cumsum"] for r in order.cumsum(df, "i", "v").orderBy("i").collect()]
    assert got == np.cumsum(np.arange(1000) % 7).tolist()
    assert [r["k"] for r in order.ranked(df, ["i"], "k").orderBy("i").collect()] == list(range(1000))


def test_sets_and_nan(spark):
    """NaN equals nothing, on one side it counts once."""
    nan = float("nan")
    a = spark.createDataFrame([(1.0,), (0.0,), (-0.0,), (nan,), (nan,), (3.0,)], "k double")
    b = spark.createDataFrame([(2.0,), (nan,), (3.0,)], "k double")

    def values(df):
        return np.sort([r["k"] for r in df.collect()])

    x, y = np.array([1.0, 0.0, -0.0, nan, nan, 3.0]), np.array([2.0, nan, 3.0])
    np.testing.assert_array_equal(values(setops.union1d(a, b, "k")), np.union1d(x, y))
    np.testing.assert_array_equal(values(setops.intersect1d(a, b, "k")), np.intersect1d(x, y))
    np.testing.assert_array_equal(values(setops.setdiff1d(a, b, "k")), np.setdiff1d(x, y))
    np.testing.assert_array_equal(values(setops.setxor1d(a, b, "k")), [0.0, 1.0, 2.0, nan, nan])
    hit = {str(r["k"]): r["isin"] for r in setops.isin(a, a, "k").collect()}
    assert hit["nan"] is False and hit["1.0"] is True
    assert setops.setxor1d(a.select(F.col("k").cast("string")), b.select(F.col("k").cast("string")), "k").count() == 4


def test_masked_sets_and_rows(spark):
    a = spark.createDataFrame([(1,), (None,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    values = lambda df: sorted((r["k"] for r in df.collect()), key=str)
    for f, with_null, without in ((masked.ma_union1d, [1, 2, 3, None], [2, 3]), (masked.ma_intersect1d, [2], [2, 3]), (masked.ma_setdiff1d, [1, None], []), (masked.ma_setxor1d, [1, 3, None], [])):
        assert values(f(a, b, "k")) == with_null and values(f(b, b, "k")) == without
    assert values(masked.ma_intersect1d(a, a, "k")) == [1, 2, None] and values(masked.ma_unique(a, "k")) == [1, 2, None]
    assert sorted(((r["k"], r["isin"]) for r in masked.ma_isin(a, b, "k").collect()), key=str) == [(1, False), (2, True), (None, None), (None, None)]
    cells = spark.createDataFrame([(i, j, None if (i, j) == (1, 2) else 1.0) for i in range(3) for j in range(3)], "i0 int, i1 int, v double")
    got = {(r["i0"], r["i1"]): r["v"] for r in masked.mask_rowcols(cells, ["i0", "i1"], "v").collect()}
    x = np.ma.array(np.ones((3, 3)), mask=[[0, 0, 0], [0, 0, 1], [0, 0, 0]])
    assert {k for k, v in got.items() if v is None} == {(i, j) for i, j in zip(*np.nonzero(np.ma.mask_rowcols(x).mask), strict=True)}
    assert masked.masked_values(cells, "v", 1.0 + 1e-7).where("v IS NOT NULL").count() == 0
    events = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 5.0)], "g string, v double")
    assert sorted((str(r["g"]), r["anomaly"]) for r in masked.anomalies(events.where("v IS NOT NULL"), "v", ["g"]).collect()) == [("None", 0.0), ("a", -1.0), ("a", 1.0)]


def test_frame(spark):
    a = np.arange(12.0).reshape(3, 4)
    f = NdFrame(npy.from_array(spark, a), (3, 4))

    def back(x):
        return npy.to_array(x.cells, x.shape)

    np.testing.assert_array_equal(back(f.transpose()), a.T)
    np.testing.assert_array_equal(back(f.reshape((2, -1))), a.reshape(2, -1))
    np.testing.assert_array_equal(back(f.roll(1, 1)), np.roll(a, 1, 1))
    np.testing.assert_array_equal(back(f.slice(1, 1, 4, 2)), a[:, 1:4:2])
    np.testing.assert_array_equal(back(f.reduce(F.sum, 0)), a.sum(0))
    np.testing.assert_array_equal(back(f.ufunc("add", f.reduce(F.max, 1, True))), a + a.max(1, keepdims=True))
    np.testing.assert_array_equal(back(f.repeat(2, 0)), np.repeat(a, 2, 0))
    np.testing.assert_array_equal(back(f.tile(2, 1)), np.tile(a, (1, 2)))
    np.testing.assert_array_equal(back(f.triu(1)), np.triu(a, 1))
    np.testing.assert_array_equal(back(f.concatenate(f, 0)), np.concatenate([a, a]))
    np.testing.assert_array_equal(back(f.diagonal(1)), np.diagonal(a, 1))
    np.testing.assert_array_equal(back(linalg.einsum("ij,kj->ik", f, f)), a @ a.T)
    np.testing.assert_array_equal(back(linalg.multi_dot(f, f.transpose(), f)), a @ a.T @ a)
    np.testing.assert_array_equal(back(linalg.tensordot(f, f.transpose(), 1)), np.tensordot(a, a.T, 1))
    np.testing.assert_array_equal(back(linalg.block_matmul(f, f.transpose(), 2)), a @ a.T)
    np.testing.assert_array_equal(back(NdFrame.linspace(spark, 0, 1, 5)), np.linspace(0, 1, 5))
    assert f.array_equal(f) and not f.array_equal(f.flip(0))
    with pytest.raises(ValueError, match="broadcast"):
        f.ufunc("add", f.transpose())


def test_dense(spark):
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    df = spark.createDataFrame([(1, a.ravel().tolist(), [1.0, 2.0])], "k int, a array<double>, b array<double>")
    np.testing.assert_allclose(linalg.inv(df, "k", "a", 2).first()["result"], np.linalg.inv(a).ravel())
    np.testing.assert_allclose(linalg.solve(df, "k", "a", "b", 2).first()["result"], np.linalg.solve(a, [1, 2]))
    np.testing.assert_allclose(linalg.eigvalsh(df, "k", "a", 2).first()["result"], np.linalg.eigvalsh(a))
    assert abs(linalg.det(df, "k", "a", 2).first()["result"][0] - 11) < 1e-12


def test_fft(spark):
    x = np.random.default_rng(1).normal(size=37)
    df = spark.createDataFrame([(1, x.tolist())], "k int, lane array<double>")
    f = fft.fft(df, "lane")
    row = f.first()
    np.testing.assert_allclose(np.array(row["re"]) + 1j * np.array(row["im"]), np.fft.fft(x), rtol=1e-10)
    back = fft.ifft(f, "re", "im").first()
    np.testing.assert_allclose(back["re"], x, rtol=1e-10)
    np.testing.assert_allclose(fft.fftshift(df, "lane").first()["lane"], np.fft.fftshift(x))


@pytest.mark.parametrize("basis", ["power", "chebyshev", "legendre", "hermite", "hermite_e", "laguerre"])
def test_polynomials(spark, basis):
    from gridloom.functions.polynomials import _CLASSES

    c = (1.0, -2.0, 0.5, 3.0, 0.25)
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-1, 1, 9)], "x double")
    got = [r[0] for r in df.orderBy("x").select(Series(c, basis)("x")).collect()]
    np.testing.assert_allclose(got, _CLASSES[basis](c)(np.linspace(-1, 1, 9)), rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("name", ["hann", "hamming", "blackman", "bartlett", "kaiser"])
def test_tapers(spark, name):
    ref = {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "bartlett": np.bartlett, "kaiser": lambda n: np.kaiser(n, 8.6)}[name]
    got = [r["v"] for r in tapers.window(spark, name, 33, *([8.6] if name == "kaiser" else [])).orderBy("i0").collect()]
    np.testing.assert_allclose(got, ref(33), rtol=1e-9, atol=1e-12)


def test_strings(spark):
    df = spark.createDataFrame([("hello wörld's 3rd",), ("-42",), ("a\tb",), ("",)], "s string")
    rows = df.select("s", strings.title("s"), strings.zfill("s", 6), strings.rfind("s", "r"), strings.center("s", 8, "*"), strings.expandtabs("s", 4), strings.swapcase("s"), strings.capitalize("s")).collect()
    for s, title, zfill, rfind, center, tabs, swap, cap in rows:
        assert (title, zfill, rfind, tabs, cap) == (s.title(), s.zfill(6), s.rfind("r"), s.expandtabs(4), s.capitalize())
        assert len(center) == max(8, len(s)) and swap == s.swapcase()
    assert df.limit(1).select(strings.partition("s", "w")).first()[0][:] == ("hello ", "w", "örld's 3rd")


HOLIDAYS = [None, ["2024-01-03", "2024-01-06", "2024-01-09", "2024-01-10", "2024-01-31"]]


@pytest.mark.parametrize("holidays", HOLIDAYS)
@pytest.mark.parametrize("mask", ["1111100", "1111111", "0000011", "1010100", "0001000"])
def test_business_days(spark, mask, holidays):
    """Counts both ways, also with the later day first, and steps with every way of rolling."""
    import datetime as dt

    start = dt.date(2023, 12, 25)
    rows = [(start + dt.timedelta(days=a), start + dt.timedelta(days=b), n) for a in range(0, 45, 2) for b in range(0, 45, 5) for n in (-6, -1, 0, 1, 7)]
    df = spark.createDataFrame(rows, "a date, b date, n int")
    off = [dt.date.fromisoformat(h) for h in holidays or []]
    rolls = ["forward", "following", "backward", "preceding", "modifiedfollowing", "modifiedpreceding"]
    got = df.select(
        "a", "b", "n", dates.busday_count("a", "b", off, mask).alias("c"), dates.is_busday("a", off, mask).alias("o"),
        *[dates.busday_offset("a", F.col("n"), x, off, mask).alias(x) for x in (*rolls, "nat")],
    ).collect()
    for r in got:
        assert r["c"] == np.busday_count(r["a"], r["b"], weekmask=mask, holidays=off), r
        assert r["o"] == np.is_busday(r["a"], weekmask=mask, holidays=off)
        for x in rolls:
            assert r[x] == np.busday_offset(r["a"], r["n"], roll=x, weekmask=mask, holidays=off).astype(dt.date), (x, r)
        assert (r["nat"] is None) == (not r["o"])
    with pytest.raises(Exception, match="not a business day"):
        df.select(dates.busday_offset("a", 1, "raise", off, "0001000")).collect()


def test_derivative(spark):
    df = spark.createDataFrame([(0.7, 1.3)], "x double, y double")
    dx, dy = df.select(*autodiff.gradient(lambda x, y: x * y.sin() + x**3, "x", "y")).first()
    assert abs(dx - (math.sin(1.3) + 3 * 0.49)) < 1e-12 and abs(dy - 0.7 * math.cos(1.3)) < 1e-12


def test_masked(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 5.0)], "i int, v double")
    m = masked.masked_invalid(df, "v")
    assert m.agg(masked.count("v"), masked.count_masked("v"), F.sum("v")).first()[:] == (2, 1, 6.0)
    assert [r[0] for r in m.orderBy("i").select(masked.filled("v", -1.0)).collect()] == [1.0, -1.0, 5.0]


def test_promotion():
    for a in ("bool", "int8", "uint8", "int32", "uint32", "int64", "float32", "float64", "complex64"):
        for b in ("bool", "int8", "uint16", "int64", "float32", "complex128"):
            assert dtypes.result_type(a, b) == np.result_type(a, b).name, (a, b)
    assert dtypes.can_cast("int32", "float64") and not dtypes.can_cast("int64", "int32") and dtypes.can_cast("int64", "int32", "same_kind")


def test_array_files(spark, tmp_path):
    a = np.arange(10.0).reshape(2, 5)
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", x=a, y=a[0])
    got = npy.read_arrays(spark, str(tmp_path / "a.npy")).orderBy("pos").collect()
    assert [r["v"] for r in got] == a.ravel().tolist()
    assert npy.read_arrays(spark, str(tmp_path / "b.npz")).groupBy("member").count().orderBy("member").collect() == [("x", 10), ("y", 5)]
    assert npy.shapes(spark, str(tmp_path / "a.npy")).first()["shape"] == [2, 5]


def test_text_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# head\n1, 2.5\n\n3,4 # tail\n")
    assert [tuple(r) for r in text.load(spark, str(tmp_path / "t.csv"), 2).collect()] == [(1.0, 2.5), (3.0, 4.0)]
    (tmp_path / "bad.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="ragged"):
        text.load(spark, str(tmp_path / "bad.csv"), 2).collect()


def test_stream_equals_batch(spark, tmp_path):
    from gridloom.streaming import windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", "value", "6 hours", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    a = {r["start"]: r["n"] for r in spark.table("w").collect()}
    assert a == {r["start"]: r["n"] for r in windows.windowed(events, "ts", "value", "6 hours").collect()}


def test_more_statistics(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=60).round(2), rng.normal(0.4, 1.2, size=45).round(2)
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(1, float(v)) for v in y], "g int, v double")
    every = np.concatenate([x, y])
    gap = max(abs((x <= v).mean() - (y <= v).mean()) for v in every)
    far, p = reduce.ks_2samp(df, "v", "g")
    root = math.sqrt(60 * 45 / 105)
    lam = (root + 0.12 + 0.11 / root) * gap
    assert abs(far - gap) < 1e-12 and abs(p - 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))) < 1e-12
    np.testing.assert_allclose(reduce.bin_edges(df, "v", "sturges"), np.histogram_bin_edges(every, "sturges"))
    np.testing.assert_allclose(reduce.bin_edges(df, "v", "scott"), np.histogram_bin_edges(every, "scott"))
    assert df.agg(reduce.median("v")).first()[0] == np.median(every)
    counts = {(r["b0"], r["b1"]): r["n"] for r in reduce.histogramdd(df.withColumn("w", F.col("g") + 0.5), ["v", "w"], [[-3.0, 0.0, 3.0], [0.0, 1.0, 2.0]]).collect()}
    assert counts[0, 0] == ((x >= -3) & (x < 0)).sum()
    table = spark.createDataFrame([("a", "p")] * 10 + [("a", "q")] * 5 + [("b", "p")] * 4, "a string, b string")
    stat, p, dof = reduce.chi2_contingency(table, "a", "b")
    o, e = np.array([[10, 5], [4, 0]]), np.outer([15, 4], [14, 5]) / 19
    assert dof == 1 and abs(stat - ((o - e) ** 2 / e).sum()) < 1e-9 and abs(p - math.erfc(math.sqrt(stat / 2))) < 1e-12


def test_user_functions(spark):
    from gridloom.operators import udf

    a = np.random.default_rng(2).normal(size=(4, 5))
    f = NdFrame(npy.from_array(spark, a), a.shape)
    got = udf.apply_along_axis(f, 1, np.median)
    np.testing.assert_allclose(npy.to_array(got.cells, got.shape), np.median(a, 1))
    wide = udf.apply_along_axis(f, 0, np.sort, 4)
    np.testing.assert_allclose(npy.to_array(wide.cells, wide.shape), np.sort(a, 0))
    both = udf.apply_over_axes(f, F.sum, [0, 1])
    np.testing.assert_allclose(npy.to_array(both.cells, both.shape), [[a.sum()]])
    cube = udf.vectorize(lambda x: x**3)
    np.testing.assert_allclose([r[0] for r in f.cells.orderBy("i0", "i1").select(cube("v")).collect()], (a**3).ravel())


def test_lanes(spark):
    x = np.cumsum(np.random.default_rng(4).uniform(0, 2, 40)) % (2 * np.pi)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, v double")
    np.testing.assert_allclose([r["unwrapped"] for r in order.unwrap(df, "i", "v", ["g"]).orderBy("i").collect()], np.unwrap(x))
    got = [r["correlated"] for r in order.correlate(df, "i", "v", [1.0, -2.0, 0.5], ["g"]).orderBy("i").collect()][2:]
    np.testing.assert_allclose(got, np.correlate(x, [1.0, -2.0, 0.5], "valid"))


def test_correlation_tests(spark):
    """p of Pearson and Spearman against the t density, ties included; Welch and equal variances; constants."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, 40).astype(float)
    y = 0.4 * x + rng.normal(size=40).round(1)
    df = spark.createDataFrame([(float(a), float(b), int(k % 2)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, g int")

    def two_sided(t, dof):
        at = np.linspace(0, abs(t), 400_001)
        c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
        return 1 - 2 * np.trapezoid(c * (1 + at**2 / dof) ** (-(dof + 1) / 2), at)

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for got, (a, b) in ((reduce.pearsonr(df, "x", "y"), (x, y)), (reduce.spearmanr(df, "x", "y"), (ranks(x), ranks(y)))):
        r = np.corrcoef(a, b)[0, 1]
        np.testing.assert_allclose(got, (r, two_sided(r * math.sqrt(38 / (1 - r * r)), 38)), rtol=1e-9)
    a, b = y[::2], y[1::2]
    va, vb = a.var(ddof=1) / 20, b.var(ddof=1) / 20
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    np.testing.assert_allclose(reduce.ttest_ind(df, "y", "g"), (t, two_sided(t, (va + vb) ** 2 / (va**2 / 19 + vb**2 / 19))), rtol=1e-9)
    np.testing.assert_allclose(reduce.ttest_ind(df, "y", "g", True), (t, two_sided(t, 38)), rtol=1e-9)
    flat = df.withColumn("x", F.lit(1.0))
    assert all(map(math.isnan, reduce.pearsonr(flat, "x", "y"))) and all(map(math.isnan, reduce.ttest_ind(flat, "x", "g")))
    for dof in (1, 2, 3, 4, 7, 10):
        at = np.linspace(0, 5.0, 2_000_001)[1:]
        density = np.exp((dof / 2 - 1) * np.log(at) - at / 2 - dof / 2 * math.log(2) - math.lgamma(dof / 2))
        if dof > 2:
            assert abs(reduce.chi2_tail(5.0, dof) - (1 - np.trapezoid(density, at))) < 1e-5
    assert abs(reduce.chi2_tail(5.0, 1) - math.erfc(math.sqrt(2.5))) < 1e-14 and abs(reduce.chi2_tail(5.0, 2) - math.exp(-2.5)) < 1e-14


def test_grouped_orders(spark):
    """Ranks and running sums of groups that span partitions, with ties; quantiles of a group that has most rows."""
    rng = np.random.default_rng(6)
    rows = [(("hot" if rng.random() < 0.7 else f"g{rng.integers(5)}") if k % 50 else None, int(rng.integers(0, 40)), float(rng.integers(0, 9)), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v double, k int").repartition(7)
    got = order.running(df, ["o"], "v", "s", ["g"]).collect()
    ranks = {r["k"]: r["n"] for r in order.ranked(df, ["o"], "n", ["g"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((o, v, k) for a, o, v, k in rows if a == g)
        sums = dict(zip([k for _, _, k in own], np.cumsum([v for _, v, _ in own]), strict=True))
        assert {r["k"]: r["s"] for r in got if r["g"] == g} == sums
        assert [ranks[k] for _, _, k in own] == list(range(len(own)))
        q = reduce.quantiles(df.where(F.col("g").eqNullSafe(F.lit(g))), ["g"], "v", [0.3, 0.5]).first()
        np.testing.assert_allclose(q[1:], np.quantile([v for _, v, _ in own], [0.3, 0.5]))
    part = {r["k"]: r["part"] for r in order.partition(df, "v", "k", 100).collect()}
    every = sorted((v, k) for _, _, v, k in rows)
    assert [part[k] for _, k in every] == [-1] * 100 + [0] + [1] * 2899
    steps = order.ediff1d(df, "k", "v", [9.0], [7.0, 8.0]).orderBy("i0").collect()
    assert [r["v"] for r in steps] == np.ediff1d([r[2] for r in sorted(rows, key=lambda r: r[3])], [7.0, 8.0], [9.0]).tolist()
    z = spark.createDataFrame([(1.0, 2.0), (1.0, -2.0), (0.5, 9.0), (float("nan"), 0.0)], "re double, im double")
    placed = {r["i"]: (r["re"], r["im"]) for r in order.sort_complex(z, "re", "im").collect()}
    assert [placed[k] for k in range(3)] == [(0.5, 9.0), (1.0, -2.0), (1.0, 2.0)]
    uneven = spark.createDataFrame([(0, float(t), float(t) ** 2) for t in (0, 1, 3, 4, 7)], "g int, t double, y double")
    grad = [r["gradient"] for r in order.gradient(uneven, "t", "y", ["g"], spacing="t").orderBy("t").collect()]
    np.testing.assert_allclose(grad, np.gradient(np.array([0.0, 1, 9, 16, 49]), [0, 1, 3, 4, 7]))


def test_bincount_and_histogram_edges(spark):
    df = spark.createDataFrame([(5,), (5,), (0,), (None,)], "v int")
    assert [r["n"] for r in reduce.bincount(df, "v").orderBy("i0").collect()] == [1, 0, 0, 0, 0, 2]
    with pytest.raises(ValueError, match="negative"):
        reduce.bincount(spark.createDataFrame([(-1,)], "v int"), "v")
    edges = [float(x) for x in np.linspace(0, 1, 11)]
    x = np.concatenate([np.linspace(0, 1, 11), np.random.default_rng(1).random(300), [np.nan, -0.1, 1.1], np.nextafter(np.linspace(0, 1, 11), 0)])
    got = reduce.histogram(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", edges).orderBy("bin").collect()
    assert [r["n"] for r in got] == np.histogram(x[np.isfinite(x)], edges)[0].tolist()


def test_string_slices_and_splits(spark):
    texts = ["one two  three", "", "a,b,,c", "  lead", "né,é", "xx"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    cuts = [(None, 3), (-3, None), (1, -1), (4, 2), (-99, 99)]
    rows = df.select("s", *[strings.slice("s", *c) for c in cuts], strings.rsplit("s", ",", 1), strings.rsplit("s", None, 1), strings.rsplit("s", ","), strings.mod("<%s|%5d>", "s", F.length("s")), strings.compare_chararrays("s", F.lit("b "), "<")).collect()
    for s, *got in rows:
        assert got[:5] == [s[slice(*c)] for c in cuts]
        assert got[5:8] == [s.rsplit(",", 1), s.rstrip().rsplit(None, 1), s.rsplit(",")]
        assert got[8] == f"<{s}|{len(s):5d}>" and got[9] == (s.rstrip() < "b")
    assert df.where("s = 'one two  three'").select(strings.rindex("s", "t")).first()[0] == 9
    with pytest.raises(Exception, match="substring not found"):
        df.select(strings.rindex("s", "q")).collect()


def test_text_options(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# head\nskip me\na;b;c\n1;2.5;3\n4;5;6 # tail\n")
    got = text.load(spark, str(tmp_path / "t.csv"), 3, ";", skiprows=1, usecols=[2, 0], names=True)
    assert got.columns == ["c", "a"] and sorted(map(tuple, got.collect())) == [(3.0, 1.0), (6.0, 4.0)]
    got = text.load(spark, str(tmp_path / "t.csv"), 3, ";", skiprows=2, usecols=[1], names=["x"])
    assert got.columns == ["x"] and sorted(r["x"] for r in got.collect()) == [2.5, 5.0]
    df = spark.createDataFrame([(k, k / 4) for k in range(100)], "i long, v double").repartition(5)
    text.save(df, str(tmp_path / "out"), ["i", "v"], " ", ["%d", "%.2f"], ["i"], header="two\nlines", footer="end")
    lines = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part*"))).splitlines()
    assert lines == ["# two", "# lines", *[f"{k} {k / 4:.2f}" for k in range(100)], "# end"]
    np.testing.assert_array_equal(np.loadtxt(lines), [[k, k / 4] for k in range(100)])


def test_array_files_without_loss(spark, tmp_path):
    whole = np.array([2**62 + 1, -(2**53) - 1, 0])
    np.save(tmp_path / "i.npy", whole)
    np.save(tmp_path / "u.npy", np.array([2**64 - 1, 1], np.uint64))
    np.save(tmp_path / "z.npy", np.array([[1 + 2j, -3j]]).T)
    np.save(tmp_path / "r.npy", np.array([(1, 2.5, "x"), (2, -1.0, "yy")], [("a", "i4"), ("b", "f8"), ("c", "U3")]))
    assert [r["v"] for r in npy.read_arrays(spark, str(tmp_path / "i.npy"), "long").orderBy("pos").collect()] == whole.tolist()
    assert [int(r["v"]) for r in npy.read_arrays(spark, str(tmp_path / "u.npy"), "unsigned").orderBy("pos").collect()] == [2**64 - 1, 1]
    assert [(r["re"], r["im"]) for r in npy.read_arrays(spark, str(tmp_path / "z.npy"), "complex").orderBy("pos").collect()] == [(1.0, 2.0), (0.0, -3.0)]
    assert [tuple(r)[1:] for r in npy.read_records(spark, str(tmp_path / "r.npy")).orderBy("pos").collect()] == [(0, 1, 2.5, "x"), (1, 2, -1.0, "yy")]
    with pytest.raises(Exception, match="whole numbers"):
        npy.read_arrays(spark, str(tmp_path / "z.npy"), "long").collect()
    df = spark.createDataFrame([(g, k, float(g * 10 + k)) for g in (1, 2) for k in range(3)], "g int, k int, v double")
    assert npy.save_arrays(df, ["g"], "k", "v", f"file://{tmp_path}/sink").count() == 2
    assert np.load(tmp_path / "sink" / "2.npy").tolist() == [20.0, 21.0, 22.0]


MOMENTS = {
    "gamma": (lambda i: random.gamma(i, 1, 2.5, 2.0), 5.0, 10.0), "gamma_small": (lambda i: random.gamma(i, 2, 0.4), 0.4, 0.4),
    "beta": (lambda i: random.beta(i, 3, 2.0, 3.0), 0.4, 0.04), "chisquare": (lambda i: random.chisquare(i, 4, 3.0), 3.0, 6.0),
    "f": (lambda i: random.f(i, 5, 4.0, 12.0), 1.2, 2 * 144 * 14 / (4 * 100 * 8)), "standard_t": (lambda i: random.standard_t(i, 6, 9.0), 0.0, 9 / 7),
    "noncentral_chisquare": (lambda i: random.noncentral_chisquare(i, 7, 3.0, 2.0), 5.0, 14.0), "wald": (lambda i: random.wald(i, 8, 2.0, 5.0), 2.0, 1.6),
    "vonmises": (lambda i: F.cos(random.vonmises(i, 9, 0.0, 2.0)), 0.697775, 0.5 * (1 + 0.302225) - 0.697775**2),
    "zipf": (lambda i: (random.zipf(i, 10, 2.5) == 1).cast("double"), 1 / 1.341487, 1 / 1.341487 * (1 - 1 / 1.341487)),
    "logseries": (lambda i: random.logseries(i, 11, 0.6), 0.6 / (0.4 * 0.916291), 0.6 * (0.916291 - 0.6) / (0.16 * 0.916291**2)),
    "negative_binomial": (lambda i: random.negative_binomial(i, 12, 3.0, 0.4), 4.5, 11.25), "hypergeometric": (lambda i: random.hypergeometric(i, 13, 7, 13, 6), 2.1, 6 * 0.35 * 0.65 * 14 / 19),
    "multinomial": (lambda i: random.multinomial(i, 14, 10, [1.0, 3.0, 6.0])[1], 3.0, 2.1), "multivariate_hypergeometric": (lambda i: random.multivariate_hypergeometric(i, 15, [5, 9, 6], 4)[2], 1.2, 4 * 0.3 * 0.7 * 16 / 19),
    "dirichlet": (lambda i: random.dirichlet(i, 16, [1.0, 2.0, 3.0])[2], 0.5, 0.25 / 7), "multivariate_normal": (lambda i: random.multivariate_normal(i, 17, [1.0, 2.0], [[2.0, 0.6], [0.6, 1.0]])[1], 2.0, 1.0),
}


@pytest.mark.parametrize("name", sorted(MOMENTS))
def test_random_moments(spark, name):
    make, mean, var = MOMENTS[name]
    x = np.array([r[0] for r in spark.range(40_000).select(make(F.col("id")).cast("double")).collect()])
    assert abs(x.mean() - mean) < 5 * math.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.1
    assert np.isfinite(x).all() and len(np.unique(x[:100])) > 1


def test_random_vectors(spark):
    i = F.col("id")
    rows = spark.range(20_000).select(random.multivariate_normal(i, 3, [1.0, 2.0], [[2.0, 0.6], [0.6, 1.0]]), random.multinomial(i, 4, 12, [0.2, 0.8]), random.dirichlet(i, 5, [1.0, 2.0]), random.multivariate_hypergeometric(i, 6, [3, 4], 5)).collect()
    z = np.array([r[0] for r in rows])
    np.testing.assert_allclose(np.cov(z.T), [[2.0, 0.6], [0.6, 1.0]], atol=0.07)
    assert all(sum(r[1]) == 12 and abs(sum(r[2]) - 1) < 1e-12 and sum(r[3]) == 5 and r[3][0] <= 3 and r[3][1] <= 4 for r in rows)


@pytest.mark.parametrize("name", ["sin", "cos", "tan", "sinh", "cosh", "tanh", "arcsin", "arccos", "arctan", "arcsinh", "arccosh", "arctanh", "sqrt", "exp", "expm1", "log", "log1p", "log2", "log10", "square", "reciprocal", "negative"])
def test_complex_functions(spark, name):
    from gridloom.functions import complex as cx

    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(size=40) + 1j * rng.normal(size=40), 1e-9 * (rng.normal(size=5) + 1j * rng.normal(size=5)), 12 * (rng.normal(size=10) + 1j * rng.normal(size=10)), [0.5 + 0.25j, -0.5 + 1e-3j, 3 - 2j, -3 + 2j]])
    df = spark.createDataFrame([(i, float(x.real), float(x.imag)) for i, x in enumerate(z)], "i int, re double, im double")
    rows = df.select("i", getattr(cx, name)(cx.make("re", "im")).alias("w")).orderBy("i").collect()
    got = np.array([r["w"]["re"] + 1j * r["w"]["im"] for r in rows])
    np.testing.assert_allclose(got, getattr(np, name)(z), rtol=1e-9, atol=1e-13)


def test_complex_power(spark):
    from gridloom.functions import complex as cx

    z, w = np.array([1 + 2j, -3 + 0.5j, 0j, 0j, 2 - 1j]), np.array([2 - 1j, 0.5 + 0j, 2 + 0j, 0j, -1 + 0j])
    df = spark.createDataFrame([(i, float(a.real), float(a.imag), float(b.real), float(b.imag)) for i, (a, b) in enumerate(zip(z, w, strict=True))], "i int, a double, b double, c double, d double")
    rows = df.select("i", cx.power(cx.make("a", "b"), cx.make("c", "d")).alias("w")).orderBy("i").collect()
    np.testing.assert_allclose([r["w"]["re"] + 1j * r["w"]["im"] for r in rows], z**w, rtol=1e-12, atol=1e-14)


def test_covariance_matrix(spark):
    x = np.random.default_rng(2).normal(size=(50, 4)) + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    for correlation, expected in ((False, np.cov(x.T)), (True, np.corrcoef(x.T))):
        got = npy.to_array(linalg.covariance_matrix(df, "v", 4, correlation=correlation), (4, 4))
        np.testing.assert_allclose(got, expected, rtol=1e-7, atol=1e-9)


def test_more_user_functions(spark, tmp_path):
    from gridloom.operators import udf
    from gridloom.sources import masked as files

    df = spark.createDataFrame([(7, 3), (9, 4)], "a long, b long")
    assert [r[0] for r in df.select(udf.frompyfunc(divmod, 2, 2, "long")("a", "b")).collect()] == [[2, 1], [2, 1]]
    assert [r[0] for r in df.select(udf.frompyfunc(lambda a, b: a * b, 2, 1, "long")("a", "b")).collect()] == [21, 36]
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 5.0), (1, 0, None), (1, 1, None), (1, 2, None)], "i0 long, i1 long, v double")
    got = udf.ma_apply_along_axis(NdFrame(cells, (2, 3)), 1, np.ma.mean).cells
    assert {r["i0"]: r["v"] for r in got.collect()} == {0: 3.0, 1: None}
    files.save(df, str(tmp_path / "m"), "a", F.col("b") > 3)
    assert sorted(map(tuple, files.load(spark, str(tmp_path / "m")).collect()), key=str) == [(7, 3), (None, 4)]
    assert sorted(map(tuple, files.unmasked(files.load(spark, str(tmp_path / "m"), False), "a").collect())) == [(7, 3), (9, 4)]


@pytest.mark.parametrize("n", [1, 2, 12, 60, 61, 128])
@pytest.mark.parametrize("norm", ["backward", "ortho", "forward"])
def test_long_fft(spark, n, norm):
    rng = np.random.default_rng(n)
    z = {g: rng.normal(size=n) + 1j * rng.normal(size=n) for g in ("a", "b")}
    df = spark.createDataFrame([(g, i, float(x.real), float(x.imag)) for g, v in z.items() for i, x in enumerate(v)] + [("a", n, 1.0, 1.0)], "g string, i int, re double, im double").repartition(3)
    for inverse, f in ((False, np.fft.fft), (True, np.fft.ifft)):
        rows = fft.long_fft(df, ["g"], "i", "re", n, "im", inverse, norm).collect()
        assert len(rows) == 2 * n
        for g, v in z.items():
            got = {r["k"]: r["re"] + 1j * r["im"] for r in rows if r["g"] == g}
            np.testing.assert_allclose([got[k] for k in range(n)], f(v, norm=norm), rtol=1e-9, atol=1e-12)


def test_tall_factors(spark):
    x = np.random.default_rng(4).normal(size=(200, 5)) @ np.diag([1, 10, 100, 1, 1e-3])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>").repartition(4)
    rows, r = linalg.tall_qr(df, "v", 5)
    q = np.array([a["q"] for a in rows.orderBy("k").collect()])
    np.testing.assert_allclose(q @ r, x, atol=1e-9)
    np.testing.assert_allclose(q.T @ q, np.eye(5), atol=1e-9)
    assert np.allclose(np.tril(r, -1), 0)
    rows, s, vt = linalg.tall_svd(df, "v", 5)
    u = np.array([a["u"] for a in rows.orderBy("k").collect()])
    np.testing.assert_allclose(s, np.linalg.svd(x, compute_uv=False), rtol=1e-7)
    np.testing.assert_allclose(u * s @ vt, x, atol=1e-9)
    a = NdFrame(npy.from_array(spark, x), x.shape)
    for order in ("fro", 1, -1, np.inf, -np.inf):
        np.testing.assert_allclose(linalg.matrix_norm(a, order).first()["v"], np.linalg.norm(x, order))
    for order in (1, 2, 3, 0, np.inf, -np.inf):
        got = linalg.vector_norms(a, order)
        np.testing.assert_allclose(npy.to_array(got.cells, got.shape), np.linalg.norm(x, order, axis=1))


def test_ticks(spark):
    df = spark.createDataFrame([(10, 3), (-7, None)], "a long, b long")
    rows = df.select(dates.add_ticks("a", "D", "b", "h")[0], dates.subtract_ticks("a", "ms", "b", "s")[0], dates.rescale("a", "h", "D")).collect()
    assert [tuple(r) for r in rows] == [(243, -2990, 0), (None, None, -1)]
    assert dates.promoted("D", "ms") == "ms"
