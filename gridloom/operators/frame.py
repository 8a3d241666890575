"""Arrays as tables: ``NdFrame`` is a table of cells (i0, ..., ik, v) with a shape.

Broadcasting, slicing, gathering and rearranging are arithmetic on index columns and equi-joins on them; nothing depends
on the order of rows.  Cells that are absent are masked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ufuncs import BINARY, UNARY


#: Cells of the smaller operand of an outer product at most; beyond it use blocks (``linalg.block_matmul``).
MAX_OUTER = 1 << 20


def sent(a: NdFrame, b: NdFrame) -> NdFrame:
    """The smaller of two arrays that are combined cell by cell with each other; refused when it is large."""
    small = a if a.size <= b.size else b
    if small.size > MAX_OUTER:
        raise ValueError(f"an outer product of shapes {a.shape} and {b.shape}: one side may have {MAX_OUTER} cells at most")
    return small


@dataclass(frozen=True)
class NdFrame:
    cells: DataFrame
    shape: tuple[int, ...]

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @property
    def size(self) -> int:
        out = 1
        for n in self.shape:
            out *= n
        return out

    # -- making --------------------------------------------------------------------------------------------------

    @staticmethod
    def from_vectors(df: DataFrame, key: str, vector: str, shape: tuple[int, int]) -> NdFrame:
        """Rows of arrays as a matrix; ``key`` is the row number."""
        cells = df.select(F.col(key).cast("long").alias("i0"), F.posexplode(vector).alias("i1", "v"))
        return NdFrame(cells.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), shape)

    def to_vectors(self) -> DataFrame:
        """(i0, vector) of a matrix."""
        got = self.cells.groupBy("i0").agg(F.array_sort(F.collect_list(F.struct("i1", "v"))).alias("c"))
        return got.select("i0", F.transform("c", lambda x: x["v"]).alias("vector"))

    @staticmethod
    def from_function(spark: SparkSession, shape: tuple[int, ...], f) -> NdFrame:
        """Cells computed from their indexes."""
        n = 1
        for s in shape:
            n *= s
        df, rest = spark.range(n), n
        for k, s in enumerate(shape):
            rest //= max(s, 1)
            df = df.withColumn(f"i{k}", F.expr(f"(id div {max(rest, 1)}) % {max(s, 1)}"))
        axes = [F.col(f"i{k}") for k in range(len(shape))]
        return NdFrame(df.select(*axes, f(*axes).alias("v")), shape)

    @staticmethod
    def full(spark: SparkSession, shape: tuple[int, ...], value: float) -> NdFrame:
        return NdFrame.from_function(spark, shape, lambda *_: F.lit(float(value)))

    @staticmethod
    def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> NdFrame:
        n = max(0, -int(-(stop - start) // step))
        return NdFrame.from_function(spark, (n,), lambda i: F.lit(float(start)) + i * float(step))

    @staticmethod
    def linspace(spark: SparkSession, start: float, stop: float, n: int = 50, endpoint: bool = True) -> NdFrame:
        step = (stop - start) / max(n - 1 if endpoint else n, 1)
        value = lambda i: F.when((i == n - 1) & F.lit(endpoint and n > 1), F.lit(float(stop))).otherwise(F.lit(float(start)) + i * step)
        return NdFrame.from_function(spark, (n,), value)

    @staticmethod
    def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> NdFrame:
        return NdFrame.from_function(spark, (n, m or n), lambda i, j: F.when(j - i == k, 1.0).otherwise(0.0))

    # -- elementwise ---------------------------------------------------------------------------------------------

    def map(self, f) -> NdFrame:
        return NdFrame(self.cells.withColumn("v", f(F.col("v"))), self.shape)

    def apply(self, name: str, *more) -> NdFrame:
        return self.map(lambda v: UNARY[name](v, *more))

    def combine(self, other: NdFrame, f) -> NdFrame:
        """Broadcasting: axes align from the right, one of length 1 stretches; the join is on the axes that don't."""
        n = max(self.ndim, other.ndim)
        a, b = self._padded(n), other._padded(n)
        shape, keys = [], []
        for k, (x, y) in enumerate(zip(a.shape, b.shape, strict=True)):
            if x != y and 1 not in (x, y):
                raise ValueError(f"shapes {self.shape} and {other.shape} don't broadcast")
            shape.append(y if x == 1 else x)
            if x != 1 and y != 1:
                keys.append(k)
        left = a.cells.select(*[F.col(f"i{k}").alias(f"a{k}") for k in range(n)], F.col("v").alias("x"))
        right = b.cells.select(*[F.col(f"i{k}").alias(f"b{k}") for k in range(n)], F.col("v").alias("y"))
        if keys:
            joined = left.join(right, [F.col(f"a{k}") == F.col(f"b{k}") for k in keys])
        else:  # an outer combination: one side is sent to every task, so its size is checked
            joined = left.join(F.broadcast(right)) if sent(b, a) is b else F.broadcast(left).join(right)
        axes = [F.col(f"b{k}" if a.shape[k] == 1 else f"a{k}").alias(f"i{k}") for k in range(n)]
        return NdFrame(joined.select(*axes, f(F.col("x"), F.col("y")).alias("v")), tuple(shape))

    def ufunc(self, name: str, other: NdFrame) -> NdFrame:
        return self.combine(other, BINARY[name])

    def _padded(self, n: int) -> NdFrame:
        more = n - self.ndim
        axes = [F.lit(0).cast("long").alias(f"i{k}") for k in range(more)]
        axes += [F.col(f"i{k}").alias(f"i{k + more}") for k in range(self.ndim)]
        return NdFrame(self.cells.select(*axes, "v"), (1,) * more + self.shape)

    # -- reducing ------------------------------------------------------------------------------------------------

    def reduce(self, aggregate, axis: int | Sequence[int] | None = None, keepdims: bool = False) -> NdFrame:
        gone = set(range(self.ndim)) if axis is None else {a % self.ndim for a in ([axis] if isinstance(axis, int) else axis)}
        keep = [k for k in range(self.ndim) if k not in gone]
        got = self.cells.groupBy(*[f"i{k}" for k in keep]).agg(aggregate(F.col("v")).alias("v"))
        if keepdims:
            axes = [F.col(f"i{k}") if k in keep else F.lit(0).cast("long").alias(f"i{k}") for k in range(self.ndim)]
            return NdFrame(got.select(*axes, "v"), tuple(self.shape[k] if k in keep else 1 for k in range(self.ndim)))
        return NdFrame(got.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(keep)], "v"), tuple(self.shape[k] for k in keep))

    # -- rearranging ---------------------------------------------------------------------------------------------

    def transpose(self, order: Sequence[int] | None = None) -> NdFrame:
        order = list(order) if order is not None else list(range(self.ndim))[::-1]
        return NdFrame(self.cells.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(order)], "v"), tuple(self.shape[k] for k in order))

    def flat(self) -> Column:
        out, step = F.lit(0).cast("long"), 1
        for k in reversed(range(self.ndim)):
            out, step = out + F.col(f"i{k}") * step, step * self.shape[k]
        return out

    def reshape(self, shape: tuple[int, ...]) -> NdFrame:
        """Another shape of as many cells; one length may be -1."""
        if sum(s == -1 for s in shape) > 1 or any(s < -1 for s in shape):
            raise ValueError(f"shape {shape}: one length may be -1")
        known = 1
        for s in shape:
            known *= s if s != -1 else 1
        if -1 in shape:
            if not known or self.size % known:
                raise ValueError(f"{self.size} cells don't fill {shape}")
            shape = tuple(self.size // known if s == -1 else s for s in shape)
        elif known != self.size:
            raise ValueError(f"{self.size} cells don't fill {shape}")
        df, rest = self.cells.withColumn("__f", self.flat()), self.size
        axes = []
        for k, s in enumerate(shape):
            rest //= max(s, 1)
            axes.append(F.expr(f"(__f div {max(rest, 1)}) % {max(s, 1)}").alias(f"i{k}"))
        return NdFrame(df.select(*axes, "v"), shape)

    def ravel(self) -> NdFrame:
        return self.reshape((self.size,))

    def flip(self, axis: int) -> NdFrame:
        return NdFrame(self.cells.withColumn(f"i{axis}", self.shape[axis] - 1 - F.col(f"i{axis}")), self.shape)

    def roll(self, shift: int, axis: int) -> NdFrame:
        return NdFrame(self.cells.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + shift, F.lit(self.shape[axis]))), self.shape)

    def slice(self, axis: int, start: int | None = None, stop: int | None = None, step: int = 1) -> NdFrame:
        """As a Python slice: ends may be negative or left out, a negative step goes backwards."""
        places = range(*slice(start, stop, step).indices(self.shape[axis]))
        i, first, n = F.col(f"i{axis}"), places.start, len(places)
        at = (i - first) if step > 0 else (F.lit(first) - i)
        inside = (at >= 0) & (at < max(n, 1) * abs(step)) & (at % abs(step) == 0) & F.lit(n > 0)
        to = f"(i{axis} - {first}) div {abs(step)}" if step > 0 else f"({first} - i{axis}) div {abs(step)}"
        return NdFrame(self.cells.where(inside).withColumn(f"i{axis}", F.expr(to)), (*self.shape[:axis], n, *self.shape[axis + 1 :]))

    def expand_dims(self, axis: int) -> NdFrame:
        axes = [F.col(f"i{k}") for k in range(axis)] + [F.lit(0).cast("long").alias(f"i{axis}")]
        axes += [F.col(f"i{k}").alias(f"i{k + 1}") for k in range(axis, self.ndim)]
        return NdFrame(self.cells.select(*axes, "v"), (*self.shape[:axis], 1, *self.shape[axis:]))

    def concatenate(self, other: NdFrame, axis: int = 0) -> NdFrame:
        if self.ndim != other.ndim or any(a != b for k, (a, b) in enumerate(zip(self.shape, other.shape, strict=True)) if k != axis):
            raise ValueError(f"shapes {self.shape} and {other.shape} differ beside axis {axis}")
        moved = other.cells.withColumn(f"i{axis}", F.col(f"i{axis}") + self.shape[axis])
        n = self.shape[axis] + other.shape[axis]
        return NdFrame(self.cells.unionByName(moved), (*self.shape[:axis], n, *self.shape[axis + 1 :]))

    def stack(self, other: NdFrame, axis: int = 0) -> NdFrame:
        return self.expand_dims(axis).concatenate(other.expand_dims(axis), axis)

    def repeat(self, n: int, axis: int) -> NdFrame:
        i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("__r")
        cells = self.cells.select("*", i).withColumn(f"i{axis}", F.col(f"i{axis}") * n + F.col("__r")).drop("__r")
        return NdFrame(cells, (*self.shape[:axis], self.shape[axis] * n, *self.shape[axis + 1 :]))

    def tile(self, n: int, axis: int) -> NdFrame:
        i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("__r")
        cells = self.cells.select("*", i).withColumn(f"i{axis}", F.col(f"i{axis}") + F.col("__r") * self.shape[axis]).drop("__r")
        return NdFrame(cells, (*self.shape[:axis], self.shape[axis] * n, *self.shape[axis + 1 :]))

    def triu(self, k: int = 0) -> NdFrame:
        return NdFrame(self.cells.withColumn("v", F.when(F.col("i1") - F.col("i0") >= k, F.col("v")).otherwise(F.lit(0.0))), self.shape)

    def tril(self, k: int = 0) -> NdFrame:
        return NdFrame(self.cells.withColumn("v", F.when(F.col("i1") - F.col("i0") <= k, F.col("v")).otherwise(F.lit(0.0))), self.shape)

    def diagonal(self, k: int = 0) -> NdFrame:
        cells = self.cells.where(F.col("i1") - F.col("i0") == k).select(F.least("i0", "i1").alias("i0"), "v")
        n = max(0, min(self.shape[0] - max(-k, 0), self.shape[1] - max(k, 0)))
        return NdFrame(cells, (n,))

    # -- gathering and scattering --------------------------------------------------------------------------------

    def take(self, index: NdFrame, axis: int) -> NdFrame:
        """Along ``axis`` the places that a one-dimensional index names, by an equi-join."""
        at = index.cells.select(F.col("i0").alias("__to"), F.pmod(F.col("v").cast("long"), F.lit(self.shape[axis])).alias("__from"))
        joined = self.cells.join(at, F.col(f"i{axis}") == F.col("__from"))
        axes = [F.col("__to").alias(a) if k == axis else F.col(a) for k, a in enumerate(self.axes)]
        return NdFrame(joined.select(*axes, "v"), (*self.shape[:axis], index.shape[0], *self.shape[axis + 1 :]))

    def take_along_axis(self, index: NdFrame, axis: int) -> NdFrame:
        at = index.cells.select(*[F.col(a).alias(f"__{a}") for a in index.axes], F.pmod(F.col("v").cast("long"), F.lit(self.shape[axis])).alias("__from"))
        on = [F.col(a) == (F.col("__from") if k == axis else F.col(f"__{a}")) for k, a in enumerate(self.axes)]
        return NdFrame(self.cells.join(at, on).select(*[F.col(f"__{a}").alias(a) for a in self.axes], "v"), index.shape)

    def put(self, cells: DataFrame) -> NdFrame:
        """Values replaced where ``cells`` has one for the same index."""
        new = cells.withColumnRenamed("v", "__new")
        return NdFrame(self.cells.join(new, self.axes, "left").select(*self.axes, F.coalesce("__new", "v").alias("v")), self.shape)

    def boolean_index(self, condition) -> DataFrame:
        return self.cells.where(condition(F.col("v")))

    def nonzero(self) -> DataFrame:
        return self.cells.where((F.col("v") != 0) | F.isnan("v")).select(*self.axes)

    def array_equal(self, other: NdFrame, rtol: float = 0.0, atol: float = 0.0) -> bool:
        from ..functions.ieee import isclose

        if self.shape != other.shape:
            return False
        near = F.coalesce(isclose("v", "__o", rtol, atol), F.lit(False))
        got = self.cells.join(other.cells.withColumnRenamed("v", "__o"), self.axes, "full_outer").agg(F.coalesce(F.bool_and(near), F.lit(True)))
        return bool(got.first()[0])

    # -- products ------------------------------------------------------------------------------------------------

    def matmul(self, other: NdFrame) -> NdFrame:
        from .linalg import einsum

        return einsum("ij,jk->ik", self, other)
