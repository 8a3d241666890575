"""Factors of matrices that no task holds: rows over the cluster, a panel of columns at a time.

:func:`lu` eliminates ``panel`` columns per step.  Pivots come from a tournament: every task proposes the pivot rows of its own
rows, the proposals are eliminated against each other, and the winners' rows, ``panel`` of them, are sent to all tasks, which
update their rows in place.  What reaches the driver is ``panel`` rows a step; rows are written once a step, so lineage stays short.

:func:`leading_svd` finds leading singular triples by a randomised range: a thin random product, power passes with orthonormal
factors between them, and the small matrix that is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import gram_local, times
from .ranges import written

PANEL = 64
#: Numbers that a step may send to every task (128 MB).
MOST_SENT = 1 << 24


def _pivots(rows: np.ndarray) -> list[int]:
    """Which rows elimination with row exchanges takes as pivots, in order: as many as there are columns, or rows."""
    a, left, out = rows.copy(), np.arange(len(rows)), []
    for j in range(min(a.shape)):
        best = j + int(np.abs(a[j:, j]).argmax())
        a[[j, best]], left[[j, best]] = a[[best, j]], left[[best, j]]
        out.append(int(left[j]))
        if a[j, j] != 0:
            a[j + 1 :, j:] -= np.outer(a[j + 1 :, j] / a[j, j], a[j, j:])
    return out


@dataclass
class Factors:
    """P A = L U of an ``n`` by ``n`` matrix with ``extra`` columns eliminated along.

    ``parts``: a table for each panel, (i, place, lower, upper): the original row, its place after exchanges, its multipliers
    before the diagonal, and its part of U from the diagonal on, followed by the extra columns.  ``pivots``: the original row in
    each place; ``diagonal`` of U.
    """

    n: int
    extra: int
    parts: list[DataFrame]
    pivots: np.ndarray
    diagonal: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def slogdet(self) -> tuple[float, float]:
        """Sign and logarithm of the absolute determinant."""
        if (self.diagonal == 0).any():
            return 0.0, -math.inf
        swaps, seen = 0, np.zeros(self.n, bool)
        for i in range(self.n):  # a cycle of length m is m - 1 exchanges
            length = 0
            while not seen[i]:
                seen[i], i, length = True, int(self.pivots[i]), length + 1
            swaps += max(length - 1, 0)
        return float((-1.0) ** swaps * np.prod(np.sign(self.diagonal))), float(np.log(np.abs(self.diagonal)).sum())

    def det(self) -> float:
        sign, log = self.slogdet()
        return sign * math.exp(log)


def lu(df: DataFrame, index: str, vector: str, n: int, extra: str | None = None, width: int = 0, panel: int = PANEL) -> Factors:
    """Factors of the rows (``index`` from 0, an array of ``n`` numbers), and of ``width`` further columns in the array ``extra``."""
    if panel * (n + width) > MOST_SENT:
        raise ValueError(f"a panel of {panel} rows of {n + width} numbers is over {MOST_SENT}")
    both = F.concat(vector, extra) if extra else F.col(vector)
    checked = F.when(F.size(both) == n + width, both).otherwise(F.raise_error(F.lit(f"a row that hasn't {n + width} numbers")))
    none = F.array().cast("array<double>")
    rest = written(df.select(F.col(index).cast("long").alias("i"), checked.cast("array<double>").alias("a"), none.alias("lower")))
    if rest.count() != n:
        raise ValueError(f"{rest.count()} rows of a matrix of {n}")
    done, pivots, diagonal = [], [], []
    for first in range(0, n, panel):
        size = min(panel, n - first)

        def proposed(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            held: tuple[np.ndarray, np.ndarray] | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                i, a = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)[:, :size]
                if held:
                    i, a = np.concatenate([held[0], i]), np.concatenate([held[1], a])
                best = _pivots(a)
                held = i[best], a[best]
            if held:
                ends = pa.array(np.arange(len(held[0]) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.ListArray.from_arrays(ends, pa.array(held[1].ravel()))], names=["i", "a"])

        short = rest.select("i", F.slice("a", 1, size).alias("a"))
        some = short.mapInArrow(proposed, "i long, a array<double>").coalesce(256).mapInArrow(proposed, "i long, a array<double>")
        some = sorted(some.collect())  # at most a panel of rows for each of 256 tasks
        won = [some[k]["i"] for k in _pivots(np.array([r["a"] for r in some]))]
        top = {r["i"]: r for r in rest.where(F.col("i").isin(won)).collect()}  # a panel of rows
        order = won[:size]
        a = np.array([top[i]["a"] for i in order])
        lower = np.eye(size)
        for j in range(size):
            if a[j, j] != 0:
                lower[j + 1 :, j] = a[j + 1 :, j] / a[j, j]
                a[j + 1 :] -= np.outer(lower[j + 1 :, j], a[j])
                a[j + 1 :, j] = 0
        if (np.abs(np.diag(a)) == 0).any() and first + size < n:
            raise ValueError("singular matrix: a panel without pivots")
        diagonal += np.diag(a).tolist()
        ready = [(i, first + k, [*top[i]["lower"], *lower[k, :k].tolist()], a[k, k:].tolist()) for k, i in enumerate(order)]
        done.append(written(df.sparkSession.createDataFrame(ready, "i long, place long, lower array<double>, upper array<double>")))
        pivots += order
        if first + size == n:
            break
        sent = df.sparkSession.sparkContext.broadcast((np.linalg.inv(a[:, :size]), a[:, size:]))

        def updated(batches: Iterator[pa.RecordBatch], size: int = size, sent=sent) -> Iterator[pa.RecordBatch]:
            inverse, upper = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = x[:, :size] @ inverse
                y = x[:, size:] - own @ upper
                before = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel())) for z in (y, np.hstack([before, own]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["i", "a", "lower"])

        rest = written(rest.where(~F.col("i").isin(order)).mapInArrow(updated, rest.schema))
    return Factors(n, width, done, np.array(pivots), np.array(diagonal))


def solve(df: DataFrame, index: str, vector: str, rhs: str, n: int, width: int, panel: int = PANEL) -> DataFrame:
    """(k, x): row k of the solution of A X = B, where ``rhs`` is an array with the row's ``width`` numbers of B."""
    if n * width > MOST_SENT:
        raise ValueError(f"a solution of {n} by {width} numbers is over {MOST_SENT}")
    got = lu(df, index, vector, n, rhs, width, panel)
    x = np.zeros((n, width))
    for part in reversed(got.parts):
        for r in sorted(part.collect(), key=lambda r: -r["place"]):  # a panel of rows, from the last on
            k, u = r["place"], np.array(r["upper"])
            x[k] = (u[n - k :] - u[1 : n - k] @ x[k + 1 :]) / u[0]
    return df.sparkSession.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "k long, x array<double>")


def _orthonormal(df: DataFrame, vector: str, width: int) -> tuple[DataFrame, int]:
    """The rows with their part ``q`` of an orthonormal base of the columns of ``vector``, dependent ones left out."""
    for out in ("__once", "q"):
        values, vectors = np.linalg.eigh(gram_local(df, vector, width))
        kept = values > max(values.max(initial=0.0), 0.0) * 1e-14
        if not kept.any():
            raise ValueError("a matrix of zeros has no range")
        df, old = times(df, vector, vectors[:, kept] / np.sqrt(values[kept]), out), vector
        vector, width = out, int(kept.sum())
        df = df.drop(old) if old.startswith("__") else df
    return df, width


def cross(df: DataFrame, left: str, n: int, right: str, m: int) -> np.ndarray:
    """Sums over all rows of products of the components of two vectors: n by m, added up within tasks first."""
    if n * m > MOST_SENT:
        raise ValueError(f"{n} by {m} sums are over {MOST_SENT}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, m))
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) for c in (0, 1))
            total += x.T @ y
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=["i", "row"])

    parts = df.select(left, right).mapInArrow(run, "i long, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((n, m))
    got = sums.toArrow()  # n * m sums
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    return out


def leading_svd(df: DataFrame, vector: str, n: int, k: int, oversample: int = 8, power: int = 2, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows (arrays of ``n`` numbers) with ``u``, the leading singular values in falling order, and their right vectors as rows.

    ``k`` triples, or as many as the matrix has; exact where ``k + oversample`` reaches its rank, else the closer the faster the
    singular values fall.
    """
    width = min(n, k + oversample)
    thin = np.random.default_rng(seed).standard_normal((n, width))
    for step in range(power + 1):
        base, width = _orthonormal(times(df, vector, thin, "__y"), "__y", width)
        base = written(base)
        small = cross(base, vector, n, "q", width)  # A^T Q
        if step < power:
            thin, _ = np.linalg.qr(small)
            width = thin.shape[1]
    left, s, vt = np.linalg.svd(small.T, full_matrices=False)
    k = min(k, len(s))
    return times(base, "q", left[:, :k], "u").drop("q"), s[:k], vt[:k]
