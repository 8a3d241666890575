"""Draws by rejection and inversion: the same values as a plain reckoning of the method, and folds that draws seldom enter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import random


def test_rejection_makes_most_draws_before_any_fold(spark):
    """A fold runs through all its attempts for every row: the first ones stand outside it, the long fold comes last."""
    text = spark.range(5).select(random.gamma(F.col("id"), 1, 2.5).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text.count("aggregate(") == 2 and "coalesce(" in text


def test_gamma_against_the_method(spark):
    """The first attempt that the rule takes, attempt by attempt, from the same uniforms."""
    a, seed, n = 2.5, 3, 400
    d_, c = a - 1 / 3, 1 / math.sqrt(9 * (a - 1 / 3))
    i = F.col("id")
    uniforms = [random.uniform(i, seed, 100 + s).alias(f"u{s}") for s in range(3 * 12)]
    for r in spark.range(n).select(random.standard_gamma(i, seed, a).alias("got"), *uniforms).collect():
        for k in range(12):
            u, w, t = (r[f"u{3 * k + j}"] for j in range(3))
            x = math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * w)
            v = (1 + c * x) ** 3
            if v > 0 and math.log(t) < 0.5 * x * x + d_ - d_ * v + d_ * math.log(v):
                break
        assert math.isclose(r["got"], d_ * v, rel_tol=1e-9)


@pytest.mark.parametrize("lam", [0.0, 0.3, 4.0, 11.9])
def test_inversion_by_search_and_by_stretches(spark, lam):
    """A rate that the plan knows and the same rate in a column, against the running sums."""
    i = F.col("id")
    got = spark.range(2000).select(random.uniform(i, 5).alias("u"), random.poisson(i, 5, lam).alias("known"), random._poisson_of(i, 5, F.lit(lam) + 0 * i).alias("column"))
    assert "aggregate(" not in spark.range(1).select(random.poisson(i, 5, lam))._jdf.queryExecution().analyzed().toString()
    p = math.exp(-lam)
    sums = [p]
    for k in range(1, 90):
        p *= lam / k
        sums.append(sums[-1] + p)
    for r in got.collect():
        assert r["known"] == r["column"] == int(np.searchsorted(sums, r["u"], "left"))


def test_search_among_sums_that_stop_growing(spark):
    """Beyond all sums the count is the last one that inversion looks at."""
    got = spark.range(1).select(random._inverted_by(F.lit(1.0), 0.5, lambda k: 0.0).alias("x"), random._inverted(F.lit(1.0), F.lit(0.5), lambda k: F.lit(0.0)).alias("y")).first()
    assert got["x"] == got["y"] == 90


DRAWS = {
    "poisson": lambda i: random.poisson(i, 5, 760.0), "binomial": lambda i: random.binomial(i, 6, 1000, 0.3), "gamma": lambda i: random.gamma(i, 1, 2.5),
    "beta": lambda i: random.beta(i, 2, 2.0, 3.0), "vonmises": lambda i: random.vonmises(i, 4, 0.5, 2.0), "zipf": lambda i: random.zipf(i, 5, 4.0), "dirichlet": lambda i: random.dirichlet(i, 10, [1.0, 2.0, 3.0]),
}


@pytest.mark.parametrize("name", sorted(DRAWS))
def test_first_attempts_hold_no_lambda_function(spark, name):
    """Spark doesn't compile those, and goes through them for every row."""
    text = spark.range(5).select(DRAWS[name](F.col("id")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in text[: text.index("aggregate(")]


def test_counts_of_a_known_small_rate_are_compiled(spark):
    text = spark.range(5).select(random.poisson(F.col("id"), 3, 4.0).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in text


def test_many_parts_are_not_written_out_with_their_sum_each(spark):
    size = lambda n: spark.range(1).select(random.dirichlet(F.col("id"), 1, [1.0] * n))._jdf.queryExecution().analyzed().toString().count("xxhash64(")
    assert size(24) == 2 * size(12)


def _log_factorial(k):
    return math.lgamma(k + 1)


def test_large_counts_against_the_method(spark):
    """Poisson and binomial counts of large means, attempt by attempt, from the same uniforms; so many rows that some take a third attempt."""
    lam, n, p, rows = 760.0, 1000, 0.3, 2000
    i = F.col("id")
    df = spark.range(rows).select(
        random.poisson(i, 5, lam).alias("poisson"), random.binomial(i, 6, n, p).alias("binomial"), random.binomial(i, 6, n, 1 - p).alias("turned"),
        *[random.uniform(i, seed, 100 + s).alias(f"u{seed}_{s}") for seed in (5, 6) for s in range(2 * 10)],
    )
    b = 0.931 + 2.53 * math.sqrt(lam)
    spread = math.sqrt(n * p * (1 - p))
    b2 = 1.15 + 2.53 * spread
    a2, middle, alpha = -0.0873 + 0.0248 * b2 + 0.01 * p, math.floor((n + 1) * p), (2.83 + 5.1 / b2) * spread

    def poisson(u, v):
        us, a = 0.5 - abs(u), -0.059 + 0.02483 * b
        x = math.floor((2 * a / us + b) * u + lam + 0.43)
        if us >= 0.07 and v <= 0.9277 - 3.6224 / (b - 2):
            return x
        if x >= 0 and not (us < 0.013 and v > us) and math.log(v * (1.1239 + 1.1328 / (b - 3.4)) / (a / (us * us) + b)) <= -lam + x * math.log(lam) - _log_factorial(x):
            return x

    def binomial(u, v):
        us = 0.5 - abs(u)
        x = math.floor((2 * a2 / us + b2) * u + n * p + 0.5)
        if not 0 <= x <= n:
            return None
        likely = _log_factorial(middle) + _log_factorial(n - middle) - _log_factorial(x) - _log_factorial(n - x) + (x - middle) * math.log(p / (1 - p))
        if (us >= 0.07 and v <= 0.92 - 4.2 / b2) or math.log(v * alpha / (a2 / (us * us) + b2)) <= likely:
            return x

    most = 0
    for r in df.collect():
        for name, seed, rule in (("poisson", 5, poisson), ("binomial", 6, binomial)):
            taken = [rule(r[f"u{seed}_{2 * k}"] - 0.5, r[f"u{seed}_{2 * k + 1}"]) for k in range(10)]
            k = next(k for k, x in enumerate(taken) if x is not None)
            most = max(most, k)
            assert r[name] == taken[k]
        assert r["turned"] == n - r["binomial"]
    assert most >= 2
