"""Random draws by a counter: a draw is a hash of (seed, stream, index), so it doesn't depend on partitions, order or
retries, and any range of it can be made on its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Proposals that a rejection method makes for one draw; each is taken with a chance over 0.4, most with over 0.9.
ATTEMPTS = 40


def uniform(index: Column, seed: int, stream: int | Column = 0) -> Column:
    """In (0, 1)."""
    h = F.xxhash64(index, F.lit(seed), stream if isinstance(stream, Column) else F.lit(stream))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def integers(index: Column, seed: int, low: int, high: int) -> Column:
    return (F.floor(uniform(index, seed) * (high - low)) + low).cast("long")


def _gauss(index: Column, seed: int, a: int | Column, b: int | Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(index, seed, a))) * F.cos(uniform(index, seed, b) * (2 * math.pi))


def normal(index: Column, seed: int, mean: float = 0.0, std: float = 1.0) -> Column:
    return _gauss(index, seed, 0, 1) * std + mean


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _plain(value: Column, body) -> Column:
    """``body`` of a value that is written out wherever ``body`` names it: Spark's compiled code computes equal parts of what
    every row needs once.  Lambda functions aren't compiled, so within one ``_once`` is better."""
    return body(value)


def _first_taken(propose, otherwise: Column, first=_plain) -> Column:
    """The first proposal that is taken: ``propose`` of an attempt's number and of what names values gives the value, or NULL if it isn't.

    A fold has no early end, so most draws are made by two attempts before any fold, which are compiled unless ``first`` is
    ``_once``, and nearly all others by a short one.
    """

    def among(first: int, stop: int) -> Column:
        tries = F.array(*[F.lit(k) for k in range(first, stop)])
        return F.aggregate(tries, F.lit(None).cast("double"), lambda got, k: F.when(got.isNotNull(), got).otherwise(propose(k, _once)))

    return F.coalesce(propose(F.lit(0), first), propose(F.lit(1), first), among(2, 8), among(8, ATTEMPTS), otherwise)


def standard_gamma(index: Column, seed: int, shape: float, first=_plain) -> Column:
    """By cubes of shifted normals; a shape under 1 by one more and a power."""
    if shape <= 0:
        raise ValueError("a positive shape")
    a = shape if shape >= 1 else shape + 1
    d_, c = a - 1 / 3, 1 / math.sqrt(9 * (a - 1 / 3))

    def propose(k: Column, once) -> Column:
        def judged(x: Column, v: Column) -> Column:
            good = F.log(uniform(index, seed, k * 3 + 102)) < 0.5 * x * x + d_ - d_ * v + d_ * F.log(F.greatest(v, F.lit(1e-300)))
            return F.when((v > 0) & good, v * d_)

        return once(_gauss(index, seed, k * 3 + 100, k * 3 + 101), lambda x: once(F.pow(1 + c * x, F.lit(3.0)), lambda v: judged(x, v)))

    out = _first_taken(propose, F.lit(d_), first)
    return out if shape >= 1 else out * F.pow(uniform(index, seed, 99), F.lit(1 / shape))


def gamma(index, seed, shape, scale=1.0): return standard_gamma(index, seed, shape) * scale  # noqa: E704
def chisquare(index, seed, df): return standard_gamma(index, seed, df / 2) * 2  # noqa: E704


def beta(index: Column, seed: int, a: float, b: float) -> Column:
    x, y = standard_gamma(index, seed, a), standard_gamma(index, seed + 1_000_003, b)
    return x / (x + y)


def f(index: Column, seed: int, dfnum: float, dfden: float) -> Column:
    return chisquare(index, seed, dfnum) / dfnum / (chisquare(index, seed + 1_000_003, dfden) / dfden)


def standard_t(index: Column, seed: int, df: float) -> Column:
    return normal(index, seed) / F.sqrt(chisquare(index, seed + 1_000_003, df) / df)


def noncentral_chisquare(index: Column, seed: int, df: float, nonc: float) -> Column:
    """For more than one degree of freedom one normal carries the shift."""
    if df <= 1:
        raise ValueError("more than one degree of freedom")
    return chisquare(index, seed + 1_000_003, df - 1) + F.pow(normal(index, seed) + math.sqrt(nonc), F.lit(2.0))


def noncentral_f(index: Column, seed: int, dfnum: float, dfden: float, nonc: float) -> Column:
    return noncentral_chisquare(index, seed, dfnum, nonc) / dfnum / (chisquare(index, seed + 2_000_003, dfden) / dfden)


#: Up to so many parts are written out with their sum each.
FEW_PARTS = 4


def dirichlet(index: Column, seed: int, alpha: list[float]) -> Column:
    """An array that sums to 1."""
    few = len(alpha) <= FEW_PARTS
    parts = [standard_gamma(index, seed + k * 1_000_003, a, _plain if few else _once) for k, a in enumerate(alpha)]
    if few:
        return F.array(*[x / sum(parts[1:], parts[0]) for x in parts])
    return _once(F.array(*parts), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, y: s + y)))


def multivariate_normal(index: Column, seed: int, mean: list[float], cov: list[list[float]]) -> Column:
    """An array; the factor of the (small) covariance is taken on the driver."""
    import numpy as np

    factor = np.linalg.cholesky(np.asarray(cov, float))
    z = [_gauss(index, seed, 2 * k, 2 * k + 1) for k in range(len(mean))]
    return F.array(*[sum((F.lit(float(factor[i, j])) * z[j] for j in range(i + 1)), F.lit(float(m))) for i, m in enumerate(mean)])


def wald(index: Column, seed: int, mean: float, scale: float) -> Column:
    """The inverse Gaussian: a root of a quadratic, or its counterpart."""
    y = F.pow(normal(index, seed), F.lit(2.0)) * mean
    x = mean + mean / (2 * scale) * (y - F.sqrt(4 * scale * y + y * y))
    return F.when(uniform(index, seed, 2) <= mean / (mean + x), x).otherwise(mean * mean / x)


def vonmises(index: Column, seed: int, mu: float, kappa: float) -> Column:
    """By a wrapped Cauchy envelope, in (-pi, pi]."""
    if kappa < 1e-8:
        return uniform(index, seed) * (2 * math.pi) - math.pi
    tau = 1 + math.sqrt(1 + 4 * kappa * kappa)
    rho = (tau - math.sqrt(2 * tau)) / (2 * kappa)
    s = (1 + rho * rho) / (2 * rho)

    def propose(k: Column, once) -> Column:
        def judged(w: Column, v: Column) -> Column:
            y = kappa * (s - w)
            side = F.when(uniform(index, seed, k * 3 + 102) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
            good = (y * (2 - y) - v >= 0) | (F.log(y / v) + 1 - y >= 0)
            return F.when(good, side * F.acos(F.greatest(F.lit(-1.0), F.least(w, F.lit(1.0)))))

        w = once(F.cos(uniform(index, seed, k * 3 + 100) * math.pi), lambda z: (1 + s * z) / (s + z))
        return once(w, lambda w: once(uniform(index, seed, k * 3 + 101), lambda v: judged(w, v)))

    turned = _first_taken(propose, F.lit(0.0)) + mu + math.pi
    return turned - F.floor(turned / (2 * math.pi)) * (2 * math.pi) - math.pi


def zipf(index: Column, seed: int, a: float) -> Column:
    """By rejection from a power of a uniform."""
    if a <= 1:
        raise ValueError("an exponent over 1")
    b = 2 ** (a - 1)

    def propose(k: Column, once) -> Column:
        def judged(x: Column, t: Column) -> Column:
            return F.when((x < 9.0e18) & (uniform(index, seed, k * 2 + 101) * x * (t - 1) / (b - 1) <= t / b), x)

        x = F.floor(F.pow(uniform(index, seed, k * 2 + 100), F.lit(-1 / (a - 1)))).cast("double")
        return once(x, lambda x: once(F.pow(1 + 1 / x, F.lit(a - 1)), lambda t: judged(x, t)))

    return _first_taken(propose, F.lit(1.0)).cast("long")


def logseries(index: Column, seed: int, p: float) -> Column:
    v, q = uniform(index, seed), 1 - F.exp(math.log1p(-p) * uniform(index, seed, 1))
    return F.when(v >= p, 1).when(v <= q * q, F.floor(1 + F.log(v) / F.log(q))).when(v >= q, 1).otherwise(2).cast("long")


def _log_factorial(k: Column) -> Column:
    """Of whole numbers from 0: the first few by their values, the others by Stirling's series."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(k.cast("double"), F.lit(1.0))
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < 16, F.get(small, F.greatest(k, F.lit(0)).cast("int"))).otherwise(series)


#: Means from which counts are drawn by rejection instead of inversion.
LARGE = 12.0
_INVERTED = 90  # a count of a mean under LARGE is beyond this with a chance under 1e-40


def _inverted(u: Column, first: Column, ratio) -> Column:
    """The count at which the running sum of chances passes ``u``; ``ratio`` of k is the chance of k over that of k - 1.

    A fold has no early end, so the next stretch of counts is only gone through if the one before hasn't passed ``u``.
    """
    stretches = [(1, 6), (7, 14), (15, 30), (31, _INVERTED)]

    def passed(u: Column, state: Column, left: list[tuple[int, int]]) -> Column:
        def step(a: Column, k: Column) -> Column:
            more = _once(a["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (a["c"] + p).alias("c"), k.alias("k")))
            return F.when(u <= a["c"], a).otherwise(more)

        (low, high), *rest = left
        ks = F.array(*[F.lit(k) for k in range(low, high + 1)])
        return F.aggregate(ks, state, step, (lambda a: F.when(u <= a["c"], a["k"]).otherwise(passed(u, a, rest))) if rest else (lambda a: a["k"]))

    start = lambda p: F.struct(p.alias("p"), p.alias("c"), F.lit(0).alias("k"))
    return _once(u, lambda u: _once(first, lambda p: passed(u, start(p), stretches)))


def _inverted_by(u: Column, first: float, ratio) -> Column:
    """The same for chances that the plan knows: a search among the running sums."""
    sums, p = [first], first
    for k in range(1, _INVERTED):
        p = p * ratio(k)
        sums.append(sums[-1] + p)

    def search(u: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        while middle > low and sums[middle - 1] == sums[high - 1]:  # these sums don't differ any more
            middle -= 1
        above = F.lit(high) if sums[middle] == sums[high - 1] else search(u, middle + 1, high)
        return F.when(u <= sums[middle], search(u, low, middle)).otherwise(above)

    return search(u, 0, _INVERTED)  # the compiled code computes u once


def _poisson_of(index: Column, seed: int, lam: Column | float) -> Column:
    """Of a rate that may be a column: small ones by inversion, large ones by transformed rejection with squeeze."""
    known = isinstance(lam, float)
    if known:
        if lam < LARGE:
            return _inverted_by(uniform(index, seed), math.exp(-lam), lambda k: lam / k).cast("long")
        lam = F.lit(lam)
    few = _inverted(uniform(index, seed), F.exp(-F.least(lam, F.lit(LARGE))), lambda k: lam / k)
    b = 0.931 + 2.53 * F.sqrt(lam)
    a = -0.059 + 0.02483 * b
    inverse, squeeze = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

    def propose(k: Column, once) -> Column:
        def judged(us: Column, v: Column, x: Column) -> Column:
            exact = F.log(v * inverse / (a / (us * us) + b)) <= -lam + x * F.log(lam) - _log_factorial(x)
            return F.when(((us >= 0.07) & (v <= squeeze)) | ((x >= 0) & ~((us < 0.013) & (v > us)) & exact), x)

        def placed(u: Column, us: Column) -> Column:
            x = F.floor((2 * a / us + b) * u + lam + 0.43).cast("double")
            return once(uniform(index, seed, k * 2 + 101), lambda v: once(x, lambda x: judged(us, v, x)))

        return once(uniform(index, seed, k * 2 + 100) - 0.5, lambda u: once(0.5 - F.abs(u), lambda us: placed(u, us)))

    return F.when(lam < LARGE, few).otherwise(_first_taken(propose, F.floor(lam).cast("double"), _plain if known else _once)).cast("long")


def negative_binomial(index: Column, seed: int, n: float, p: float) -> Column:
    """Failures before ``n`` successes: a Poisson variable whose rate is a gamma one."""
    return _once(standard_gamma(index, seed + 1_000_003, n, _once) * ((1 - p) / p), lambda lam: _poisson_of(index, seed, lam))


def hypergeometric(index: Column, seed: int, good: int, bad: int, n: int) -> Column:
    """Good ones among ``n`` taken without replacement, one by one (for n up to some hundreds)."""
    if n > good + bad:
        raise ValueError("more are taken than there are")
    left = F.lit(float(good + bad))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(max(n - 1, 0))), F.lit(0),
        lambda got, k: got + F.when(F.lit(n > 0) & (uniform(index, seed, k) * (left - k) < F.lit(float(good)) - got), 1).otherwise(0),
    )


def multivariate_hypergeometric(index: Column, seed: int, colors: list[int], n: int) -> Column:
    """Counts of each colour among ``n`` taken without replacement: the k-th taken is some place of what is left."""
    zero = F.array(*[F.lit(0) for _ in colors])

    def take(got: Column, k: Column) -> Column:
        at = uniform(index, seed, k) * (F.lit(float(sum(colors))) - k)
        lefts = [F.lit(c) - F.get(got, F.lit(j)) for j, c in enumerate(colors)]
        upto = [sum(lefts[: j + 1], F.lit(0)) for j in range(len(colors))]
        return F.array(*[F.get(got, F.lit(j)) + F.when((at < upto[j]) & (at >= (upto[j - 1] if j else F.lit(0))), 1).otherwise(0) for j in range(len(colors))])

    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(n)), F.lit(1), F.lit(n)), zero, take)


def multinomial(index: Column, seed: int, n: int, weights: list[float]) -> Column:
    """Counts of each outcome among ``n`` draws: a few are drawn one by one, many as binomial counts of what is left."""
    total, edges = sum(weights), [0.0]
    if n > FEW_TRIALS:
        def shared(left: Column, j: int, rest: float) -> Column:
            if j == len(weights) - 1:
                return F.array(left)
            chance = min(1.0, weights[j] / rest) if rest > 0 else 0.0
            draw = lambda m: _binomial_of(index, seed + j * 1_000_003, m, chance)
            return _once(left, lambda m: _once(draw(m), lambda got: F.concat(F.array(got), shared(m - got, j + 1, rest - weights[j]))))

        return shared(F.lit(n).cast("long"), 0, total)
    for w in weights:
        edges.append(edges[-1] + w / total)
    edges[-1] = 2.0
    draws = F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda k: uniform(index, seed, k))
    counts = lambda u: F.array(*[F.size(F.filter(u, _between(lo, hi))) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    return F.transform(F.array(draws), counts)[0] if n else F.array(*[F.lit(0) for _ in weights])


def _between(low: float, high: float):
    return lambda x: (x >= low) & (x < high)


def exponential(index, seed, scale=1.0): return -F.log(uniform(index, seed)) * scale  # noqa: E704
def lognormal(index, seed, mean=0.0, sigma=1.0): return F.exp(normal(index, seed, mean, sigma))  # noqa: E704
def laplace(index, seed, loc=0.0, scale=1.0):  # noqa: E302
    u = uniform(index, seed) - 0.5
    return -F.signum(u) * F.log(1 - 2 * F.abs(u)) * scale + loc


def logistic(index, seed, loc=0.0, scale=1.0):
    u = uniform(index, seed)
    return F.log(u / (1 - u)) * scale + loc


def gumbel(index, seed, loc=0.0, scale=1.0): return -F.log(-F.log(uniform(index, seed))) * scale + loc  # noqa: E704
def weibull(index, seed, a): return F.pow(-F.log(uniform(index, seed)), F.lit(1.0 / a))  # noqa: E704
def pareto(index, seed, a): return F.pow(uniform(index, seed), F.lit(-1.0 / a)) - 1  # noqa: E704
def power(index, seed, a): return F.pow(uniform(index, seed), F.lit(1.0 / a))  # noqa: E704
def rayleigh(index, seed, scale=1.0): return F.sqrt(-2 * F.log(uniform(index, seed))) * scale  # noqa: E704
def standard_cauchy(index, seed): return F.tan((uniform(index, seed) - 0.5) * math.pi)  # noqa: E704
def geometric(index, seed, p): return F.ceil(F.log(uniform(index, seed)) / math.log1p(-p)).cast("long")  # noqa: E704
def bernoulli(index, seed, p): return (uniform(index, seed) < p).cast("int")  # noqa: E704


def triangular(index, seed, left, mode, right):
    u, cut = uniform(index, seed), (mode - left) / (right - left)
    return F.when(u < cut, F.sqrt(u * ((right - left) * (mode - left))) + left).otherwise(right - F.sqrt((1 - u) * ((right - left) * (right - mode))))


#: Up to so many trials are drawn one by one.
FEW_TRIALS = 32


def _binomial_of(index: Column, seed: int, n: Column | int, p: float) -> Column:
    """Of a number of trials that may be a column: small means by inversion, large ones by transformed rejection with squeeze."""
    if p > 0.5:
        return n - _binomial_of(index, seed, n, 1 - p)
    if p <= 0:
        return F.lit(0).cast("long")
    known = isinstance(n, int)
    if known:
        n = F.lit(n)
    size, odds = n.cast("double"), p / (1 - p)
    few = _inverted(uniform(index, seed), F.exp(F.least(size, F.lit(LARGE / p)) * math.log1p(-p)), lambda k: F.greatest(size - k + 1, F.lit(0.0)) * odds / k)
    spread = F.sqrt(size * (p * (1 - p)))
    b = 1.15 + 2.53 * spread
    a, middle = -0.0873 + 0.0248 * b + 0.01 * p, F.floor((size + 1) * p).cast("double")
    squeeze, alpha = 0.92 - 4.2 / b, (2.83 + 5.1 / b) * spread

    def propose(k: Column, once) -> Column:
        def judged(us: Column, v: Column, x: Column) -> Column:
            likely = _log_factorial(middle) + _log_factorial(size - middle) - _log_factorial(x) - _log_factorial(size - x) + (x - middle) * math.log(odds)
            inside = (x >= 0) & (x <= size)
            return F.when(inside & (((us >= 0.07) & (v <= squeeze)) | (F.log(v * alpha / (a / (us * us) + b)) <= likely)), x)

        def placed(u: Column, us: Column) -> Column:
            x = F.floor((2 * a / us + b) * u + size * p + 0.5).cast("double")
            return once(uniform(index, seed, k * 2 + 101), lambda v: once(x, lambda x: judged(us, v, x)))

        return once(uniform(index, seed, k * 2 + 100) - 0.5, lambda u: once(0.5 - F.abs(u), lambda us: placed(u, us)))

    return F.when(size * p < LARGE, few).otherwise(_first_taken(propose, middle, _plain if known else _once)).cast("long")


def binomial(index: Column, seed: int, n: int, p: float) -> Column:
    """Successes in n trials: a few are drawn one by one, many by their number."""
    if n > FEW_TRIALS:
        return _binomial_of(index, seed, n, p)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, k: a + F.when((F.shiftrightunsigned(F.xxhash64(index, k, F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52) < p, 1).otherwise(0))


def poisson(index: Column, seed: int, lam: float) -> Column:
    """Counts of any rate."""
    return _poisson_of(index, seed, float(lam))


def choice(index: Column, seed: int, weights: list[float]) -> Column:
    """A position drawn by weight."""
    total, run, out = sum(weights), 0.0, F.lit(0)
    u = uniform(index, seed)
    for w in weights[:-1]:
        run += w / total
        out = out + F.when(u >= run, 1).otherwise(0)
    return out


def permuted(df: DataFrame, key: str, seed: int, as_col: str = "place") -> DataFrame:
    """A random order: every row's place, by a distributed sort of hashes."""
    from .order import ranked

    return ranked(df.withColumn("__h", F.xxhash64(key, F.lit(seed))), ["__h", key], as_col).drop("__h")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: those of the smallest hashes, by top-n per partition and a merge."""
    return df.withColumn("__h", F.xxhash64(key, F.lit(seed))).orderBy("__h", key).limit(n).drop("__h")


# -- a published counter-based generator, bit for bit ----------------------------------------------------------------

# Multipliers and key increments of the 4 x 32 bit Philox generator of ten rounds.
PHILOX_MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
PHILOX_WEYL = (0x9E3779B9, 0xBB67AE85)
PHILOX_ROUNDS = 10
_WORD = (1 << 32) - 1


def philox(counter: list[Column], key: int) -> Column:
    """The four 32-bit words (as longs) of a 128-bit counter, given as four words from the lowest on, under a 64-bit key."""
    if len(counter) != 4:
        raise ValueError("a counter of four words")
    word = F.lit(_WORD).cast("long")

    def product(x: Column, m: int) -> tuple[Column, Column]:
        """High and low word of a product, from halves of ``m`` so that nothing exceeds 63 bits."""
        upper, lower = x * (m >> 16), x * (m & 0xFFFF)
        high = F.shiftright(upper + F.shiftright(lower, 16), 16)
        return high, (F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + lower.bitwiseAND(word)).bitwiseAND(word)

    keys = [tuple(((key >> 32 * j) + r * w) & _WORD for j, w in enumerate(PHILOX_WEYL)) for r in range(PHILOX_ROUNDS)]
    rounds = F.expr("array(" + ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in keys) + ")")
    first = F.array(*[c.cast("long").bitwiseAND(word) for c in counter])

    def step(c: Column, k: Column) -> Column:
        h0, l0 = product(c[0], PHILOX_MULTIPLIERS[0])
        h1, l1 = product(c[2], PHILOX_MULTIPLIERS[1])
        return F.array(h1.bitwiseXOR(c[1]).bitwiseXOR(k["a"]), l1, h0.bitwiseXOR(c[3]).bitwiseXOR(k["b"]), l0)

    return F.aggregate(rounds, first, step)


def philox_words(index: Column, key: int, stream: int = 0) -> Column:
    """The words of row ``index`` (a whole number of 64 bits) in one of many streams."""
    i = index.cast("long")
    return philox([i, F.shiftrightunsigned(i, 32), F.lit(stream & _WORD), F.lit(stream >> 32)], key)


def philox_uniform(index: Column, key: int, stream: int = 0) -> Column:
    """In [0, 1): 53 bits of the first two words."""
    return F.transform(F.array(philox_words(index, key, stream)), lambda w: (F.shiftright(w[0], 5) * (1 << 26) + F.shiftright(w[1], 6)).cast("double") / float(1 << 53))[0]


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, each next one taken in proportion to its weight among the rest: the rows with the least
    exponential draws of rate ``weight``, by top-n per partition and a merge.  Rows of no or negative weight are never taken."""
    w = F.col(weight).cast("double")
    drawn = df.where(w > 0).withColumn("__e", -F.log1p(-philox_uniform(F.col(key), seed)) / w)
    return drawn.orderBy("__e", key).limit(n).drop("__e")
