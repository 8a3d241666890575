"""Products of arrays as joins and sums; dense matrices of a bounded size through NumPy in Arrow tasks.

``einsum`` contracts operands pairwise, the smallest intermediate first; each contraction is one equi-join on the shared
labels and one grouped sum.  ``block_matmul`` is for large dense matrices: cells are packed into square blocks, blocks
that meet are multiplied by NumPy, and partial products are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ieee import divide
from .frame import NdFrame, sent

BLOCK = 256
#: Blocks along each side of a task's part of a product: tile * tile * 512 KB of sums.
TILE = 8


def parse(subscripts: str, ranks: list[int]) -> tuple[list[str], str]:
    """The labels of every operand and of the result; ``...`` stands for the axes that an operand's labels leave, aligned
    from the right."""
    text = subscripts.replace(" ", "")
    left, arrow, out = text.partition("->")
    terms = left.split(",")
    if len(terms) != len(ranks):
        raise ValueError(f"{subscripts!r} has {len(terms)} operands, not {len(ranks)}")
    spare = [c for c in map(chr, range(0x3B1, 0x3CA)) if c not in text]  # labels that no one wrote
    most, full = 0, []
    for term, rank in zip(terms, ranks, strict=True):
        head, dots, tail = term.partition("...")
        free = rank - len(head) - len(tail) if dots else 0
        if free < 0 or "." in head + tail:
            raise ValueError(f"labels {term!r} for an array of {rank} axes")
        most = max(most, free)
        full.append(head + "".join(spare[:free][::-1]) + tail)
    every, dotted = "".join(full), "".join(spare[:most][::-1])
    if not arrow:
        out = dotted + "".join(sorted(c for c in set(every) - set(dotted) if every.count(c) == 1))
    out = out.replace("...", dotted)
    if set(out) - set(every) or len(set(out)) != len(out):
        raise ValueError(f"{subscripts!r}: the result has labels of no operand, or twice")
    return full, out


def _labelled(a: NdFrame, term: str) -> tuple[DataFrame, str]:
    """Cells with a column per label; a repeated label takes the diagonal."""
    if len(term) != a.ndim:
        raise ValueError(f"labels {term!r} for an array of {a.ndim} axes")
    df = a.cells
    for k, c in enumerate(term):
        if term.index(c) != k:
            df = df.where(F.col(f"i{k}") == F.col(f"i{term.index(c)}"))
    labels = "".join(dict.fromkeys(term))
    return df.select(*[F.col(f"i{term.index(c)}").alias(f"l_{c}") for c in labels], "v"), labels


def einsum(subscripts: str, *operands: NdFrame) -> NdFrame:
    terms, out = parse(subscripts, [a.ndim for a in operands])
    size: dict[str, int] = {}
    for term, a in zip(terms, operands, strict=True):
        for c, n in zip(term, a.shape, strict=False):
            if 1 not in (n, size.setdefault(c, n)) and size[c] != n:
                raise ValueError(f"label {c!r} has lengths {size[c]} and {n}")
            size[c] = max(size[c], n)
    todo = []
    for a, term in zip(operands, terms, strict=True):
        df, labels = _labelled(a, term)
        # an axis of length 1 stretches to any length: its label goes
        wide = "".join(c for c in labels if a.shape[term.index(c)] == size[c])
        todo.append((df.select(*[f"l_{c}" for c in wide], "v"), wide))

    def volume(labels: str) -> int:
        v = 1
        for c in labels:
            v *= size[c]
        return v

    def kept(labels: set[str], others: list[tuple[DataFrame, str]]) -> str:
        wanted = set(out).union(*[set(x) for _, x in others]) if others else set(out)
        return "".join(sorted(labels & wanted))

    while len(todo) > 1:
        pairs = [(i, j) for i in range(len(todo)) for j in range(i)]

        def cost(pair: tuple[int, int]) -> tuple[bool, int]:
            (_, x), (_, y) = todo[pair[0]], todo[pair[1]]
            others = [t for k, t in enumerate(todo) if k not in pair]
            return not set(x) & set(y), volume(kept(set(x) | set(y), others))

        i, j = min(pairs, key=cost)
        (a, x), (b, y) = todo[i], todo[j]
        todo = [t for k, t in enumerate(todo) if k not in (i, j)]
        shared = [f"l_{c}" for c in x if c in y]
        b = b.withColumnRenamed("v", "w")
        if shared:
            joined = a.join(b, shared)
        else:
            first = NdFrame(a, tuple(size[c] for c in x))
            joined = F.broadcast(a).join(b) if sent(first, NdFrame(b, tuple(size[c] for c in y))) is first else a.join(F.broadcast(b))
        keep = kept(set(x) | set(y), todo)
        product = (F.col("v") * F.col("w")).alias("v")
        joined = joined.select(*[f"l_{c}" for c in keep], product)
        if set(keep) != set(x) | set(y):
            joined = joined.groupBy(*[f"l_{c}" for c in keep]).agg(F.sum("v").alias("v"))
        todo.append((joined, keep))
    df, labels = todo[0]
    if set(labels) != set(out):
        df = df.groupBy(*[f"l_{c}" for c in out]).agg(F.sum("v").alias("v"))
    return NdFrame(df.select(*[F.col(f"l_{c}").alias(f"i{k}") for k, c in enumerate(out)], "v"), tuple(size[c] for c in out))


def tensordot(a: NdFrame, b: NdFrame, axes: int = 2) -> NdFrame:
    x = "".join(chr(97 + k) for k in range(a.ndim))
    y = x[a.ndim - axes :] + "".join(chr(97 + a.ndim + k) for k in range(b.ndim - axes))
    return einsum(f"{x},{y}->{x[: a.ndim - axes]}{y[axes:]}", a, b)


def outer(a: NdFrame, b: NdFrame) -> NdFrame:
    return einsum("i,j->ij", a, b)


def inner(a: NdFrame, b: NdFrame) -> NdFrame:
    return einsum("i,i->", a, b) if a.ndim == 1 else einsum("ik,jk->ij", a, b)


def kron(a: NdFrame, b: NdFrame) -> NdFrame:
    p = einsum("ij,kl->ijkl", a, b)
    n, m, r, s = p.shape
    cells = p.cells.select((F.col("i0") * r + F.col("i2")).alias("i0"), (F.col("i1") * s + F.col("i3")).alias("i1"), "v")
    return NdFrame(cells, (n * r, m * s))


def trace(a: NdFrame) -> NdFrame:
    return einsum("ii->", a)


def multi_dot(*factors: NdFrame) -> NdFrame:
    """A chain of matrices in the order of least work, by dynamic programming over their shapes."""
    n = len(factors)
    p = [factors[0].shape[0], *[f.shape[1] for f in factors]]
    best = {(i, i): (0, i) for i in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            best[i, j] = min((best[i, k][0] + best[k + 1, j][0] + p[i] * p[k + 1] * p[j + 1], k) for k in range(i, j))

    def build(i: int, j: int) -> NdFrame:
        if i == j:
            return factors[i]
        k = best[i, j][1]
        return build(i, k).matmul(build(k + 1, j))

    return build(0, n - 1)


def _blocks(a: NdFrame, block: int) -> DataFrame:
    """(bi, bj, data): square blocks as dense row-major float64 bytes."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = np.zeros((block, block))
        out[rows["i0"].to_numpy() % block, rows["i1"].to_numpy() % block] = rows["v"].to_numpy()
        return pa.table({"bi": [key[0].as_py()], "bj": [key[1].as_py()], "data": [out.tobytes()]})

    cells = a.cells.select(F.expr(f"i0 div {block}").alias("bi"), F.expr(f"i1 div {block}").alias("bj"), "i0", "i1", "v")
    return cells.groupBy("bi", "bj").applyInArrow(pack, "bi long, bj long, data binary")


def block_matmul(a: NdFrame, b: NdFrame, block: int = BLOCK, tile: int = TILE) -> NdFrame:
    """Product of large dense matrices, block by block.

    A task makes a tile of ``tile`` by ``tile`` blocks of the result and adds up every product in place, in order of the
    shared axis, so partial products never move; a block of an operand goes to one task per ``tile`` result blocks.
    """
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} don't multiply")
    n, m = a.shape[0], b.shape[1]
    rows, cols = -(-n // (block * tile)), -(-m // (block * tile))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(k - 1, 0)).cast("long")))
    left = _blocks(a, block).select(F.expr(f"bi div {tile}").alias("ti"), every(cols).alias("tj"), F.col("bj").alias("k"), F.lit(0).alias("side"), F.col("bi").alias("at"), "data")
    right = _blocks(b, block).select(every(rows).alias("ti"), F.expr(f"bj div {tile}").alias("tj"), F.col("bi").alias("k"), F.lit(1).alias("side"), F.col("bj").alias("at"), "data")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile_at, step, held, sums = None, None, {}, {}

        def cells() -> Iterator[pa.RecordBatch]:
            for (bi, bj), out in sums.items():
                i, j = np.meshgrid(np.arange(block) + bi * block, np.arange(block) + bj * block, indexing="ij")
                inside = (i < n) & (j < m)
                yield pa.RecordBatch.from_arrays([pa.array(i[inside]), pa.array(j[inside]), pa.array(out[inside])], ["i0", "i1", "v"])

        for batch in batches:
            for ti, tj, k, side, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ti, tj) != tile_at:
                    yield from cells()
                    tile_at, step, sums = (ti, tj), None, {}
                if k != step:
                    step, held = k, {}
                square = np.frombuffer(data).reshape(block, block)
                if side == 0:
                    held[at] = square
                    continue
                for bi, other in held.items():
                    if (bi, at) in sums:
                        sums[bi, at] += other @ square
                    else:
                        sums[bi, at] = other @ square
        yield from cells()

    both = left.unionByName(right).repartition("ti", "tj").sortWithinPartitions("ti", "tj", "k", "side", "at")
    return NdFrame(both.mapInArrow(multiply, "i0 long, i1 long, v double"), (n, m))


# -- dense matrices, one per row: (key, row-major array of n * m) ---------------------------------------------------------


def per_matrix(df: DataFrame, key: str, data: str, shape: tuple[int, int], f, width: int | None = None) -> DataFrame:
    """``f`` of each matrix (a flat array column) as a flat array column; tasks work on Arrow batches."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.ravel(f(np.asarray(x, float).reshape(shape))) for x in batch[data]]
            yield pd.DataFrame({key: batch[key], "result": out})

    return df.select(key, data).mapInPandas(run, f"{key} {kind}, result array<double>")


def det(df, key, data, n):
    return per_matrix(df, key, data, (n, n), np.linalg.det)


def inv(df, key, data, n):
    return per_matrix(df, key, data, (n, n), np.linalg.inv)


def pinv(df, key, data, shape):
    return per_matrix(df, key, data, shape, np.linalg.pinv)


def cholesky(df, key, data, n):
    return per_matrix(df, key, data, (n, n), np.linalg.cholesky)


def qr_r(df, key, data, shape):
    return per_matrix(df, key, data, shape, lambda a: np.linalg.qr(a)[1])


def svdvals(df, key, data, shape):
    return per_matrix(df, key, data, shape, lambda a: np.linalg.svd(a, compute_uv=False))


def eigvalsh(df, key, data, n):
    return per_matrix(df, key, data, (n, n), np.linalg.eigvalsh)


def matrix_power(df, key, data, n, power):
    return per_matrix(df, key, data, (n, n), lambda a: np.linalg.matrix_power(a, power))


def matrix_rank(df, key, data, shape):
    return per_matrix(df, key, data, shape, np.linalg.matrix_rank)


def norm(df, key, data, shape, order=None):
    return per_matrix(df, key, data, shape, lambda a: np.linalg.norm(a, order))


def solve(df, key, data, rhs, n):
    """x of A x = b, b an array column."""
    joined = df.select(key, F.concat(data, rhs).alias("both"))
    return per_matrix(joined, key, "both", (1, n * n + n), lambda a: np.linalg.solve(a[0, : n * n].reshape(n, n), a[0, n * n :]))


def gram(df: DataFrame, vector: str, n: int) -> DataFrame:
    """The n by n matrix of sums of products of vector components, in one scan: each task adds up its batches and
    sends n * n partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((n, n))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().astype(float).reshape(-1, n)
            out += x.T @ x
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(out.ravel())], ["i0", "i1", "v"])

    v = F.col(vector)
    whole = v.isNull() | ((F.size(v) == n) & ~F.exists(v, lambda x: x.isNull()))
    checked = F.when(whole, v).otherwise(F.raise_error(F.lit(f"a vector that hasn't {n} elements, none of them null")))
    parts = df.select(checked.alias("v")).where("v IS NOT NULL").mapInArrow(run, "i0 long, i1 long, v double")
    return parts.groupBy("i0", "i1").agg(F.sum("v").alias("v"))


def lstsq(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Least squares with an intercept by the normal equations: one aggregate of fixed width.

    Of dependent features (singular values under 1e-7 of the largest) the answer of least norm."""
    names = ["1", *features, target]
    cols = [F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in names]
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i + 1)]
    row = df.agg(*sums).first()
    full = np.array([[row[f"s{max(i, j)}_{min(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
    values, vectors = np.linalg.eigh(full[:-1, :-1])
    kept = values > values.max() * 1e-14
    return vectors[:, kept] @ ((vectors[:, kept].T @ full[:-1, -1]) / values[kept])


def covariance_matrix(df: DataFrame, vector: str, n: int, ddof: int = 1, correlation: bool = False) -> DataFrame:
    """(i0, i1, v): covariances of the n components of vectors, or their correlations, in one more scan than the means: products
    of what the means leave, so nothing cancels."""
    means = df.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m"))  # n rows
    row = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("m")).first()
    centre = F.array(*[F.lit(float(m)) for m in row["m"] or [0.0] * n])
    centred = df.select(F.zip_with(F.col(vector), centre, lambda x, m: x.cast("double") - m).alias("c"))
    products = gram(centred, "c", n)
    count = df.where(F.col(vector).isNotNull()).count()
    if not correlation:
        return products.withColumn("v", F.col("v") / max(count - ddof, 0) if count > ddof else F.lit(float("nan")))
    own = products.where("i0 = i1").select(F.col("i0").alias("k"), F.sqrt("v").alias("s"))  # n rows
    x, y = own.select(F.col("k").alias("i0"), F.col("s").alias("sx")), own.select(F.col("k").alias("i1"), F.col("s").alias("sy"))
    return products.join(x, "i0").join(y, "i1").select("i0", "i1", divide(F.col("v"), F.col("sx") * F.col("sy")).alias("v"))


# -- tall matrices: rows over the cluster, a Gram matrix of the few columns on the driver -----------------------------------


def gram_local(df: DataFrame, vector: str, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for r in gram(df, vector, n).collect():  # n * n cells
        out[r["i0"], r["i1"]] = r["v"]
    return out


def times(df: DataFrame, vector: str, matrix: np.ndarray, as_col: str) -> DataFrame:
    """Each row vector times a small matrix, as a further column."""
    n = matrix.shape[0]
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy().astype(float).reshape(-1, n) @ matrix
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * matrix.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*batch.schema.names, as_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(as_col, T.ArrayType(T.DoubleType()))]))


def tall_qr(df: DataFrame, vector: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with their part ``q`` of an orthonormal factor, and the triangular factor R, by two Cholesky factors of Gram
    matrices (the second takes away what rounding left in the first)."""
    r1 = np.linalg.cholesky(gram_local(df, vector, n)).T
    once = times(df, vector, np.linalg.inv(r1), "__q")
    r2 = np.linalg.cholesky(gram_local(once, "__q", n)).T
    return times(once, "__q", np.linalg.inv(r2), "q").drop("__q"), r2 @ r1


def tall_svd(df: DataFrame, vector: str, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows with their part ``u``, singular values in falling order and the transposed right vectors: those of R."""
    rows, r = tall_qr(df, vector, n)
    u, s, vt = np.linalg.svd(r)
    return times(rows, "q", u, "u").drop("q"), s, vt


def matrix_norm(a: NdFrame, order: str | float = "fro") -> DataFrame:
    """(v): the Frobenius norm, or the largest or smallest (negative ``order``) sum of a column (1) or a row (inf)."""
    if order == "fro":
        return a.cells.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))
    if abs(order) not in (1, float("inf")):
        raise ValueError(f"order {order!r}")
    sums = a.cells.groupBy("i1" if abs(order) == 1 else "i0").agg(F.sum(F.abs("v")).alias("s"))
    return sums.agg((F.max("s") if order > 0 else F.min("s")).alias("v"))


def vector_norms(a: NdFrame, order: float = 2, axis: int = 1) -> NdFrame:
    """Norms along an axis: a power, 0 (how many aren't 0), or an infinity."""
    v = F.abs(F.col("v"))
    if order == float("inf"):
        f = F.max(v)
    elif order == float("-inf"):
        f = F.min(v)
    elif order == 0:
        f = F.count_if(v != 0).cast("double")
    else:
        f = F.pow(F.sum(F.pow(v, F.lit(float(order)))), F.lit(1.0 / order))
    return a.reduce(lambda _: f, axis)
