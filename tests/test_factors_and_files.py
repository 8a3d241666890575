"""Distributed factors, convolutions, folds of one's own, published draws, large-rate draws and array files, against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import factor, fft, linalg, random, signal, udf
from gridloom.sources import npy_source


def _matrix(spark, a, extra=None):
    rows = [(i, x.tolist(), *([extra[i].tolist()] if extra is not None else [])) for i, x in enumerate(a)]
    return spark.createDataFrame(rows, "i long, a array<double>" + (", b array<double>" if extra is not None else "")).repartition(5)


@pytest.mark.parametrize("panel", [7, 16, 50])
def test_lu_and_solutions(spark, panel):
    rng = np.random.default_rng(panel)
    a, b = rng.normal(size=(50, 50)), rng.normal(size=(50, 3))
    a[3, 3] = a[0, 0] = 0.0
    got = factor.lu(_matrix(spark, a), "i", "a", 50, panel=panel)
    lower, upper = np.eye(50), np.zeros((50, 50))
    for r in got.rows.collect():
        lower[r["place"], : r["place"]] = r["lower"]
        upper[r["place"], r["place"] :] = r["upper"]
        assert got.pivots[r["place"]] == r["i"]
    assert np.allclose(lower @ upper, a[got.pivots]) and np.abs(lower).max() < 50
    sign, log = np.linalg.slogdet(a)
    assert got.slogdet() == pytest.approx((sign, log)) and got.det() == pytest.approx(np.linalg.det(a))
    x = np.array([r["x"] for r in factor.solve(_matrix(spark, a, b), "i", "a", "b", 50, 3, panel).orderBy("k").collect()])
    assert np.allclose(a @ x, b)


def test_singular_and_malformed_matrices(spark):
    a = np.ones((6, 6))
    with pytest.raises(ValueError):
        factor.lu(_matrix(spark, a), "i", "a", 6, panel=3)
    with pytest.raises(ValueError):
        factor.lu(_matrix(spark, a[:4]), "i", "a", 6)
    a = np.diag([1.0, 2.0, 0.0])
    assert factor.lu(_matrix(spark, a), "i", "a", 3).det() == 0.0


def test_leading_singular_triples(spark):
    rng = np.random.default_rng(2)
    left, right = np.linalg.qr(rng.normal(size=(200, 12)))[0], np.linalg.qr(rng.normal(size=(40, 12)))[0]
    s = 2.0 ** -np.arange(12)
    a = left * s @ right.T
    rows, values, vt = factor.leading_svd(_matrix(spark, a), "a", 40, 5)
    assert np.allclose(values, s[:5], rtol=1e-6)
    for r in rows.collect():
        assert np.allclose(np.array(r["a"]) @ vt.T, np.array(r["u"]) * values, atol=1e-8)
    assert np.allclose(vt @ vt.T, np.eye(5))
    deficient = factor.leading_svd(_matrix(spark, a[:, :8] * 0 + left[:, :2] @ rng.normal(size=(2, 8))), "a", 8, 6)
    assert len(deficient[1]) == 2


def test_least_squares_of_dependent_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 2))
    data = np.column_stack([x, x[:, 0] * 2 - x[:, 1], 3 + x @ [1.0, -2.0] + rng.normal(size=100) * 0.01])
    df = spark.createDataFrame(data.tolist(), "a double, b double, c double, y double")
    expected = np.linalg.lstsq(np.column_stack([np.ones(100), data[:, :3]]), data[:, 3], rcond=None)[0]
    assert np.allclose(linalg.lstsq(df, ["a", "b", "c"], "y"), expected)
    plain = np.linalg.lstsq(np.column_stack([np.ones(100), data[:, :2]]), data[:, 3], rcond=None)[0]
    assert np.allclose(linalg.lstsq(df, ["a", "b"], "y"), plain)


@pytest.mark.parametrize("n,m,block", [(100, 9, 16), (37, 37, 8), (5, 40, 16), (1, 1, 4), (64, 16, 16), (300, 100, 32)])
def test_convolutions(spark, n, m, block):
    rng = np.random.default_rng(n)
    x, k = rng.normal(size=(2, n)), rng.normal(size=m)
    df = spark.createDataFrame([(g, i, float(x[g, i])) for g in (0, 1) for i in range(n)], "g int, i long, v double").repartition(3)
    for kernel in (k.tolist(), spark.createDataFrame(list(enumerate(k.tolist())), "k long, w double")):
        for mode in signal.MODES:
            got = signal.convolve(df, "i", "v", n, kernel, mode, ["g"], block).collect()
            for g in (0, 1):
                own = [r["v"] for r in sorted(r for r in got if r["g"] == g)]
                assert np.allclose(own, np.convolve(x[g], k, mode))
    one = [r["v"] for r in signal.correlate(df.where("g = 0").drop("g"), "i", "v", n, k.tolist(), "full").orderBy("i").collect()]
    assert np.allclose(one, np.correlate(x[0], k, "full"))


@pytest.mark.parametrize("n", [1, 2, 7, 97, 251])
def test_chirp_transforms(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    z = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    df = spark.createDataFrame([(g, i, float(z[g, i].real), float(z[g, i].imag)) for g in (0, 1) for i in range(n)], "g int, i long, re double, im double")
    monkeypatch.setattr(fft, "LONG_LINE", 50)  # long_fft goes this way for long lines without factors
    for inverse, f in ((False, np.fft.fft), (True, np.fft.ifft)):
        for norm in ("backward", "ortho"):
            for transform in (signal.chirp_fft, fft.long_fft):
                rows = transform(df, ["g"], "i", "re", n, "im", inverse=inverse, norm=norm).collect()
                got = np.zeros((2, n), complex)
                for r in rows:
                    got[r["g"], r["k"]] = r["re"] + 1j * r["im"]
                assert len(rows) == 2 * n and np.allclose(got, f(z, norm=norm))


def test_user_folds(spark):
    rng = np.random.default_rng(6)
    g = np.where(rng.random(5000) < 0.6, 0, rng.integers(1, 300, 5000))
    v = rng.integers(0, 1000, 5000)
    df = spark.createDataFrame([(int(a), i, None if i % 97 == 0 else int(b)) for i, (a, b) in enumerate(zip(g, v, strict=True))], "g int, k long, v long").repartition(7)
    gcd = {r["g"]: r["v"] for r in udf.reduce_with(df, ["g"], "v", np.gcd, kind="long").collect()}
    digits = lambda a, b: (a * 31 + b * 0 + b) % 1_000_003
    affine = lambda a, b: (a // 1000 * (b // 1000)) % 997 * 1000 + (a % 1000 * (b // 1000) + b % 1000) % 997
    del digits
    composed = df.withColumn("v", (F.col("v") % 996 + 1) * 1000 + F.col("k") % 997)
    ordered = {r["g"]: r["v"] for r in udf.reduce_with(composed, ["g"], "v", affine, "k", "long").collect()}
    for group in set(g.tolist()):
        rows = [(i, int(v[i])) for i in range(5000) if g[i] == group and i % 97]
        if not rows:
            assert group not in gcd
            continue
        assert gcd[group] == math.gcd(*[x for _, x in rows])
        total = None
        for i, x in rows:  # composition of affine maps modulo a prime: associative, not commutative
            step = (x % 996 + 1) * 1000 + i % 997
            total = step if total is None else int(affine(np.int64(total), np.int64(step)))
        assert ordered[group] == total
    assert udf.reduce_with(df, [], "v", np.maximum, kind="long").first()["v"] == max(int(x) for i, x in enumerate(v) if i % 97)
    assert udf.reduce_with(df.where("k < 0"), [], "v", np.maximum).count() == 0


@pytest.mark.parametrize(
    "counter,key,words",
    [
        ([0] * 4, 0, [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]),
        ([0xFFFFFFFF] * 4, 0xFFFFFFFFFFFFFFFF, [0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD]),
        ([0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344], 0x299F31D0A4093822, [0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1]),
    ],
)
def test_philox_known_answers(spark, counter, key, words):
    """Published answers for a counter and a key."""
    got = spark.range(1).select(random.philox([F.lit(c).cast("long") for c in counter], key).alias("w")).first()["w"]
    assert got == words


@pytest.mark.parametrize("lam", [0.5, 11.0, 13.0, 760.0, 1e5])
def test_poisson_of_any_rate(spark, lam):
    got = spark.range(40_000).select(random.poisson(F.col("id"), 5, lam).alias("x")).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.min("x").alias("lo")).first()
    assert abs(got["m"] - lam) < 5 * math.sqrt(lam / 40_000) and abs(got["v"] / lam - 1) < 0.06 and got["lo"] >= 0


@pytest.mark.parametrize("n,p", [(20, 0.3), (40, 0.1), (1000, 0.3), (1000, 0.97), (10**6, 1e-6), (10**7, 0.5)])
def test_binomial_of_any_size(spark, n, p):
    got = spark.range(40_000).select(random.binomial(F.col("id"), 6, n, p).alias("x")).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spread = n * p * (1 - p)
    assert abs(got["m"] - n * p) < 5 * math.sqrt(spread / 40_000) and abs(got["v"] / spread - 1) < 0.06 and got["lo"] >= 0 and got["hi"] <= n


def test_small_counts_have_their_chances(spark):
    """Rejection and inversion agree with the chances of single values."""
    for draw, chance in ((random.poisson(F.col("id"), 8, 14.0), lambda k: math.exp(k * math.log(14.0) - 14.0 - math.lgamma(k + 1))), (random.binomial(F.col("id"), 9, 60, 0.25), lambda k: math.comb(60, k) * 0.25**k * 0.75 ** (60 - k))):
        counts = {r["x"]: r["n"] for r in spark.range(100_000).select(draw.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in range(5, 26):
            assert abs(counts.get(k, 0) - 100_000 * chance(k)) < 5 * math.sqrt(100_000 * chance(k)) + 1


def test_large_mixtures(spark):
    rows = spark.range(20_000).select(random.negative_binomial(F.col("id"), 7, 1000.0, 0.4).alias("x"), random.multinomial(F.col("id"), 9, 5000, [1.0, 3.0, 0.0, 6.0]).alias("m"))
    got = rows.agg(F.avg("x").alias("a"), F.var_samp("x").alias("v"), *[F.avg(F.col("m")[k]).alias(f"m{k}") for k in range(4)], F.min(F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
    assert abs(got["a"] - 1500) < 3 and abs(got["v"] / 3750 - 1) < 0.06
    assert [round(got[f"m{k}"] / 50, 0) for k in range(4)] == [10, 30, 0, 60] and got["t"] == 5000


def test_weighted_sampling(spark):
    df = spark.createDataFrame([(k, float(w)) for k, w in enumerate([1, 2, 3, 4, 0, 10])], "k long, w double")
    firsts = np.zeros(6)
    many = spark.range(4000).join(F.broadcast(df)).select((F.col("id") * 6 + F.col("k")).alias("key"), "id", "k", "w")
    drawn = many.where("w > 0").withColumn("e", -F.log1p(-random.philox_uniform(F.col("key"), 3)) / F.col("w"))
    for r in drawn.groupBy("id").agg(F.min_by("k", "e").alias("k")).groupBy("k").count().collect():
        firsts[r["k"]] = r["count"] / 4000
    assert np.allclose(firsts, np.array([1, 2, 3, 4, 0, 10]) / 20, atol=0.04)
    got = [r["k"] for r in random.weighted_sample(df, "k", "w", 10, 3).collect()]
    assert sorted(got) == [0, 1, 2, 3, 5]


@pytest.mark.parametrize("shape,order", [((1000,), "C"), ((50, 7), "C"), ((50, 7), "F"), ((20, 3, 4), "F"), ((20, 3, 4), "C"), ((0,), "C")])
@pytest.mark.parametrize("kind", ["<f8", ">i4", "u1", "?"])
def test_array_files_by_ranges_of_rows(spark, tmp_path, shape, order, kind):
    a = np.asarray(np.random.default_rng(1).integers(0, 2 if kind == "?" else 100, shape).astype(kind), order=order)
    np.save(tmp_path / "a.npy", a)
    npy_source.register(spark)
    df = spark.read.format("npy").option("path", str(tmp_path / "a.npy")).option("rows", "13").load()
    assert df.rdd.getNumPartitions() == max(1, -(-shape[0] // 13))
    rows = df.orderBy("i0").collect()
    assert [r["i0"] for r in rows] == list(range(shape[0]))
    got = np.array([r["v"] for r in rows]).astype(a.dtype).reshape(a.shape)
    assert (got == a).all()


def test_array_files_are_written_and_committed(spark, tmp_path):
    npy_source.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(1000, numPartitions=4).select((F.col("id") / 3).alias("v"))
    df.write.format("npy").mode("append").save(path)
    assert len(list((tmp_path / "out").glob("*.npy"))) == 4 and not list((tmp_path / "out").glob("_*"))
    got = spark.read.format("npy").option("path", path).load()
    assert [r["v"] for r in got.orderBy("i0").collect()] == [i / 3 for i in range(1000)]
    df.limit(5).coalesce(1).write.format("npy").mode("overwrite").save(path)
    assert spark.read.format("npy").option("path", path).load().count() == 5
    bad = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        bad.write.format("npy").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.npy")) if (tmp_path / "bad").exists() else True
