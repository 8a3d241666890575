"""Rearranging, joining, padding and scattering of ``NdFrame``: arithmetic on index columns and equi-joins on them.

A shape is known to the driver, so every check is made before a plan is built; cells never pass through it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import NdFrame


def _axis(a: NdFrame, axis: int) -> int:
    if not -a.ndim <= axis < a.ndim:
        raise ValueError(f"axis {axis} of an array of {a.ndim} axes")
    return axis % a.ndim


def _moved(a: NdFrame, axis: int, at: Column, n: int, cells: DataFrame | None = None) -> NdFrame:
    """The cells with another index along one axis."""
    df = a.cells if cells is None else cells
    axes = [at.cast("long").alias(f"i{k}") if k == axis else F.col(f"i{k}") for k in range(a.ndim)]
    return NdFrame(df.select(*axes, "v"), (*a.shape[:axis], n, *a.shape[axis + 1 :]))


def _index(n: int, values: Sequence[int]) -> list[int]:
    out = [v + n if v < 0 else v for v in values]
    if any(not 0 <= v < n for v in out):
        raise IndexError(f"an index beyond an axis of length {n}")
    return out


# -- axes ------------------------------------------------------------------------------------------------------------


def moveaxis(a: NdFrame, source: int | Sequence[int], to: int | Sequence[int]) -> NdFrame:
    source = [_axis(a, s) for s in ([source] if isinstance(source, int) else source)]
    to = [_axis(a, t) for t in ([to] if isinstance(to, int) else to)]
    if len(source) != len(to) or len(set(source)) != len(source) or len(set(to)) != len(to):
        raise ValueError("as many different sources as destinations")
    order = [k for k in range(a.ndim) if k not in source]
    for t, s in sorted(zip(to, source, strict=True)):
        order.insert(t, s)
    return a.transpose(order)


def rollaxis(a: NdFrame, axis: int, start: int = 0) -> NdFrame:
    """``axis`` moved before the place ``start``."""
    axis, start = _axis(a, axis), start + a.ndim if start < 0 else start
    if not 0 <= start <= a.ndim:
        raise ValueError(f"start {start} of an array of {a.ndim} axes")
    return moveaxis(a, axis, start - 1 if start > axis else start)


def swapaxes(a: NdFrame, x: int, y: int) -> NdFrame:
    order = list(range(a.ndim))
    x, y = _axis(a, x), _axis(a, y)
    order[x], order[y] = order[y], order[x]
    return a.transpose(order)


def squeeze(a: NdFrame, axis: int | Sequence[int] | None = None) -> NdFrame:
    """Without axes of length 1: all, or the named ones."""
    named = [k for k, n in enumerate(a.shape) if n == 1] if axis is None else [_axis(a, x) for x in ([axis] if isinstance(axis, int) else axis)]
    if any(a.shape[k] != 1 for k in named):
        raise ValueError(f"an axis of {a.shape} to be squeezed has a length other than 1")
    keep = [k for k in range(a.ndim) if k not in named]
    return NdFrame(a.cells.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(keep)], "v"), tuple(a.shape[k] for k in keep))


def atleast_nd(a: NdFrame, n: int) -> NdFrame:
    """Leading axes of length 1 up to ``n``."""
    while a.ndim < n:
        a = a.expand_dims(0)
    return a


def rot90(a: NdFrame, k: int = 1, axes: tuple[int, int] = (0, 1)) -> NdFrame:
    """Quarter turns from the first of ``axes`` towards the second."""
    x, y = (_axis(a, t) for t in axes)
    if x == y:
        raise ValueError("two different axes")
    k %= 4
    if k == 0:
        return a
    if k == 2:
        return a.flip(x).flip(y)
    return swapaxes(a.flip(y), x, y) if k == 1 else swapaxes(a, x, y).flip(y)


def broadcast_to(a: NdFrame, shape: tuple[int, ...]) -> NdFrame:
    """Axes of length 1 stretched and leading ones added: each cell is repeated, which its shape bounds."""
    if len(shape) < a.ndim or any(x not in (1, y) for x, y in zip(a.shape[::-1], shape[::-1], strict=False)):
        raise ValueError(f"{a.shape} doesn't broadcast to {shape}")
    a = atleast_nd(a, len(shape))
    df = a.cells
    for k, (x, y) in enumerate(zip(a.shape, shape, strict=True)):
        if x != y:
            df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(y - 1).cast("long"))) if y else F.explode(F.array().cast("array<long>")))
    return NdFrame(df.select(*[f"i{k}" for k in range(len(shape))], "v"), tuple(shape))


# -- joining and splitting ---------------------------------------------------------------------------------------------


def vstack(*arrays: NdFrame) -> NdFrame:
    return _chain([atleast_nd(a, 2) for a in arrays], 0)


def hstack(*arrays: NdFrame) -> NdFrame:
    return _chain(list(arrays), 0 if arrays[0].ndim == 1 else 1)


def dstack(*arrays: NdFrame) -> NdFrame:
    def deep(a: NdFrame) -> NdFrame:
        return atleast_nd(a, 2).expand_dims(2) if a.ndim < 3 else a

    return _chain([deep(a) for a in arrays], 2)


def column_stack(*arrays: NdFrame) -> NdFrame:
    return _chain([a.expand_dims(1) if a.ndim == 1 else a for a in arrays], 1)


def _chain(arrays: list[NdFrame], axis: int) -> NdFrame:
    out = arrays[0]
    for a in arrays[1:]:
        out = out.concatenate(a, axis)
    return out


def block(rows: list[list[NdFrame]]) -> NdFrame:
    """A matrix of matrices as one."""
    return _chain([_chain(list(row), 1) for row in rows], 0)


def array_split(a: NdFrame, parts: int | Sequence[int], axis: int = 0) -> list[NdFrame]:
    """As many parts as asked for, the first ones longer by one where need be, or cut at the given places."""
    axis, n = _axis(a, axis), a.shape[axis]
    if isinstance(parts, int):
        if parts < 1:
            raise ValueError("one part at least")
        size, more = divmod(n, parts)
        ends = [0]
        for k in range(parts):
            ends.append(ends[-1] + size + (k < more))
    else:
        ends = [0, *parts, n]
    return [a.slice(axis, x, y) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def split(a: NdFrame, parts: int | Sequence[int], axis: int = 0) -> list[NdFrame]:
    """As :func:`array_split`, but a number of parts must divide the length."""
    if isinstance(parts, int) and (parts < 1 or a.shape[_axis(a, axis)] % parts):
        raise ValueError(f"{a.shape[_axis(a, axis)]} isn't {parts} equal parts")
    return array_split(a, parts, axis)


def append(a: NdFrame, b: NdFrame, axis: int | None = None) -> NdFrame:
    """Without an axis both are flattened."""
    return a.ravel().concatenate(b.ravel(), 0) if axis is None else a.concatenate(b, _axis(a, axis))


def insert(a: NdFrame, at: int | Sequence[int], values: NdFrame | float, axis: int = 0) -> NdFrame:
    """A slice before each place (places count in ``a``): of one number, or those of an array as long as there are places."""
    axis, n = _axis(a, axis), a.shape[_axis(a, axis)]
    places = [at] if isinstance(at, int) else list(at)
    order = sorted(range(len(places)), key=lambda k: (_index(n + 1, [places[k]])[0], k))
    places = [_index(n + 1, [places[k]])[0] for k in order]
    before = sum((F.when(F.col(f"i{axis}") >= p, 1).otherwise(0) for p in places), F.lit(0))
    moved = _moved(a, axis, F.col(f"i{axis}") + before, n + len(places))
    target = [p + k for k, p in enumerate(places)]
    if isinstance(values, NdFrame):
        want = (*a.shape[:axis], len(places), *a.shape[axis + 1 :])
        if values.shape != want:
            raise ValueError(f"values of shape {values.shape}, not {want}")
        back = {k: j for j, k in enumerate(order)}
        new = _moved(values, axis, F.get(F.array(*[F.lit(target[back[k]]) for k in range(len(places))]), F.col(f"i{axis}").cast("int")), n + len(places))
    else:
        full = NdFrame.full(a.cells.sparkSession, (*a.shape[:axis], len(places), *a.shape[axis + 1 :]), values)
        new = _moved(full, axis, F.get(F.array(*[F.lit(t) for t in target]), F.col(f"i{axis}").cast("int")), n + len(places))
    return NdFrame(moved.cells.unionByName(new.cells), moved.shape)


def delete(a: NdFrame, at: int | Sequence[int], axis: int = 0) -> NdFrame:
    axis = _axis(a, axis)
    gone = sorted(set(_index(a.shape[axis], [at] if isinstance(at, int) else list(at))))
    i = F.col(f"i{axis}")
    before = sum((F.when(i > p, 1).otherwise(0) for p in gone), F.lit(0))
    return _moved(a, axis, i - before, a.shape[axis] - len(gone), a.cells.where(~i.isin(gone)) if gone else a.cells)


def resize(a: NdFrame, shape: tuple[int, ...]) -> NdFrame:
    """Another shape, the cells in order and over again as often as it takes."""
    n = 1
    for s in shape:
        n *= s
    if not a.size or not n:
        return NdFrame.full(a.cells.sparkSession, shape, 0.0)
    flat = a.ravel()
    times = -(-n // a.size)
    again = flat.cells.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    every = again.select((F.col("i0") + F.col("__t") * a.size).alias("i0"), "v")
    return NdFrame(every.where(F.col("i0") < n), (n,)).reshape(shape)


def pad(a: NdFrame, widths: int | Sequence[tuple[int, int]], mode: str = "constant", value: float = 0.0) -> NdFrame:
    """Cells before and after along every axis: a constant, the edge, a reflection about the edge (``reflect``) or behind it
    (``symmetric``), or the other end (``wrap``)."""
    widths = [(widths, widths)] * a.ndim if isinstance(widths, int) else [tuple(w) for w in widths]
    if len(widths) != a.ndim or any(x < 0 or y < 0 for x, y in widths):
        raise ValueError("a width before and after every axis, none negative")
    out = a
    for axis, (x, y) in enumerate(widths):
        n = out.shape[axis]
        total = n + x + y
        i = F.col(f"i{axis}")
        if mode == "constant":
            kept = _moved(out, axis, i + x, total)
            shape = list(kept.shape)
            parts = kept.cells
            for lo, k in ((0, x), (n + x, y)):
                if k:
                    shape[axis] = k
                    new = NdFrame.full(a.cells.sparkSession, tuple(shape), value)
                    parts = parts.unionByName(_moved(new, axis, i + lo, total).cells)
            out = NdFrame(parts, kept.shape)
            continue
        if not n and total:
            raise ValueError("an empty axis has no cells to pad with")
        # where each cell of the source stands in the padded axis
        if mode == "edge":
            lo = F.when(i == 0, F.lit(0)).otherwise(i + x)
            hi = F.when(i == n - 1, F.lit(total - 1)).otherwise(i + x)
            to = F.sequence(lo.cast("long"), hi.cast("long"))
        elif mode in ("wrap", "reflect", "symmetric"):
            period = {"wrap": n, "symmetric": 2 * n, "reflect": max(2 * n - 2, 1)}[mode]
            images = [i] if mode == "wrap" or (mode == "reflect" and n == 1) else [i, (F.lit(period - 1) - i) if mode == "symmetric" else F.pmod(F.lit(period) - i, F.lit(period))]
            runs = [F.sequence(F.pmod(p + x, F.lit(period)).cast("long"), F.lit(total - 1 + period).cast("long"), F.lit(period).cast("long")) for p in images]
            to = F.filter(F.array_distinct(F.concat(*runs)), lambda t: t < total)
        else:
            raise ValueError(f"mode {mode!r}")
        df = out.cells.withColumn("__to", F.explode(to))
        out = _moved(out, axis, F.col("__to"), total, df)
    return out


def trim_zeros(a: NdFrame, which: str = "fb") -> NdFrame:
    """A one-dimensional array without the zeros at its front and back."""
    lo, hi = a.cells.where((F.col("v") != 0) | F.isnan("v")).agg(F.min("i0"), F.max("i0")).first()
    if lo is None:
        return a.slice(0, 0, 0)
    return a.slice(0, lo if "f" in which else 0, hi + 1 if "b" in which else None)


# -- making ------------------------------------------------------------------------------------------------------------


def meshgrid(*axes: NdFrame, indexing: str = "xy") -> list[NdFrame]:
    """Each one-dimensional array along its axis of a grid of all."""
    order = list(range(len(axes)))
    if indexing == "xy" and len(axes) > 1:
        order[0], order[1] = 1, 0
    shape = tuple(axes[k].shape[0] for k in order)
    out = []
    for j, a in enumerate(axes):
        place = order.index(j)
        line = a
        for _ in range(place):
            line = line.expand_dims(0)
        for _ in range(len(axes) - place - 1):
            line = line.expand_dims(line.ndim)
        out.append(broadcast_to(line, shape))
    return out


def indices(spark: SparkSession, shape: tuple[int, ...]) -> list[NdFrame]:
    """For each axis an array of the cells' indexes along it."""
    return [NdFrame.from_function(spark, shape, lambda *i, k=k: i[k].cast("double")) for k in range(len(shape))]


def ix_(a: NdFrame, *index: NdFrame) -> NdFrame:
    """The cells at every combination of the indexes, one one-dimensional array for each leading axis."""
    for axis, at in enumerate(index):
        a = a.take(at, axis)
    return a


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> NdFrame:
    return NdFrame.from_function(spark, (n, m or n), lambda i, j: F.when(j - i <= k, 1.0).otherwise(0.0))


def vander(a: NdFrame, n: int | None = None, increasing: bool = False) -> NdFrame:
    """Powers of a one-dimensional array as columns."""
    n = a.shape[0] if n is None else n
    power = F.col("i1") if increasing else F.lit(n - 1) - F.col("i1")
    cells = a.cells.select("i0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i1"), "v")
    return NdFrame(cells.select("i0", "i1", F.pow(F.col("v"), power.cast("double")).alias("v")), (a.shape[0], n))


def logspace(spark: SparkSession, start: float, stop: float, n: int = 50, endpoint: bool = True, base: float = 10.0) -> NdFrame:
    return NdFrame.linspace(spark, start, stop, n, endpoint).map(lambda v: F.pow(F.lit(float(base)), v))


def geomspace(spark: SparkSession, start: float, stop: float, n: int = 50, endpoint: bool = True) -> NdFrame:
    """A constant ratio from ``start`` to ``stop``, which have one sign."""
    import math

    if start * stop <= 0:
        raise ValueError("ends of one sign, neither 0")
    sign = math.copysign(1.0, start)
    made = NdFrame.linspace(spark, math.log(abs(start)), math.log(abs(stop)), n, endpoint)
    ends = lambda i, v: F.when(i == 0, F.lit(float(start))).when((i == n - 1) & F.lit(endpoint), F.lit(float(stop))).otherwise(F.exp(v) * sign)
    return NdFrame(made.cells.select("i0", ends(F.col("i0"), F.col("v")).alias("v")), made.shape)


def diagflat(a: NdFrame, k: int = 0) -> NdFrame:
    """A square matrix with the cells on its k-th diagonal, 0 elsewhere."""
    flat = a.ravel()
    n = flat.shape[0] + abs(k)
    zero = NdFrame.full(a.cells.sparkSession, (n, n), 0.0)
    at = flat.cells.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), "v")
    return zero.put(at)


# -- finding and scattering --------------------------------------------------------------------------------------------


def argwhere(a: NdFrame) -> DataFrame:
    return a.nonzero()


def flatnonzero(a: NdFrame) -> DataFrame:
    """(i0) of the flattened array."""
    return a.ravel().nonzero()


def extract(condition: NdFrame, a: NdFrame) -> DataFrame:
    """The cells of ``a`` where ``condition``, of the same shape, isn't 0."""
    if condition.shape != a.shape:
        raise ValueError(f"shapes {condition.shape} and {a.shape}")
    return a.cells.join(condition.nonzero(), a.axes, "left_semi")


def compress(a: NdFrame, condition: Sequence[bool], axis: int) -> NdFrame:
    """The slices along ``axis`` where ``condition`` holds."""
    axis = _axis(a, axis)
    keep = [k for k, c in enumerate(condition) if c]
    _index(a.shape[axis], keep)
    places = F.array(*[F.lit(k).cast("long") for k in keep]).cast("array<long>")
    i = F.col(f"i{axis}")
    return _moved(a, axis, F.array_position(places, i) - 1, len(keep), a.cells.where(i.isin(keep)) if keep else a.cells.where(F.lit(False)))


def put_along_axis(a: NdFrame, index: NdFrame, values: NdFrame, axis: int) -> NdFrame:
    """Values at the places that ``index`` names along ``axis``; of several for one place the last in order stays."""
    axis = _axis(a, axis)
    if index.shape != values.shape:
        raise ValueError(f"shapes {index.shape} and {values.shape}")
    at = F.pmod(F.col("v").cast("long"), F.lit(a.shape[axis]))
    to = index.cells.select(*index.axes, at.alias("__at")).join(values.cells.withColumnRenamed("v", "__v"), index.axes)
    axes = [F.col("__at").alias(f"i{k}") if k == axis else F.col(f"i{k}") for k in range(a.ndim)]
    new = to.select(*axes, F.col(f"i{axis}").alias("__k"), "__v").groupBy(*a.axes).agg(F.max_by("__v", "__k").alias("v"))
    return a.put(new)


def putmask(a: NdFrame, mask: NdFrame, values: Sequence[float]) -> NdFrame:
    """Cells under the mask replaced; cell k of the flattened array takes value k, over again."""
    at = F.array(*[F.lit(float(v)) for v in values])
    hit = mask.nonzero().withColumn("__hit", F.lit(True))
    new = F.when(F.col("__hit"), F.get(at, (a.flat() % len(values)).cast("int"))).otherwise(F.col("v"))
    return NdFrame(a.cells.join(hit, a.axes, "left").select(*a.axes, new.alias("v")), a.shape)


def place(a: NdFrame, mask: NdFrame, values: Sequence[float]) -> NdFrame:
    """Cells under the mask replaced in order; the k-th of them takes value k, over again."""
    from .order import ranked

    at = F.array(*[F.lit(float(v)) for v in values])
    flat = NdFrame(mask.cells, mask.shape).flat()
    hit = ranked(mask.cells.where((F.col("v") != 0) | F.isnan("v")).select(*a.axes, flat.alias("__f")), ["__f"], "__k")
    new = F.when(F.col("__k").isNotNull(), F.get(at, (F.col("__k") % len(values)).cast("int"))).otherwise(F.col("v"))
    return NdFrame(a.cells.join(hit.drop("__f"), a.axes, "left").select(*a.axes, new.alias("v")), a.shape)


def copyto(a: NdFrame, source: NdFrame, where: NdFrame | None = None) -> NdFrame:
    """``a`` with the cells of ``source`` (stretched to its shape), all or where ``where`` isn't 0."""
    new = broadcast_to(source, a.shape).cells
    return a.put(new if where is None else new.join(broadcast_to(where, a.shape).nonzero(), a.axes, "left_semi"))


def fill_diagonal(a: NdFrame, value: float) -> NdFrame:
    on = F.lit(True)
    for k in range(1, a.ndim):
        on = on & (F.col(f"i{k}") == F.col("i0"))
    return NdFrame(a.cells.withColumn("v", F.when(on, F.lit(float(value))).otherwise(F.col("v"))), a.shape)


def ravel_multi_index(index: Sequence[Column], shape: tuple[int, ...]) -> Column:
    out, step = F.lit(0).cast("long"), 1
    for c, n in zip(reversed(index), reversed(shape), strict=True):
        out, step = out + c * step, step * n
    return out


def unravel_index(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    out, step = [], 1
    for n in reversed(shape):
        out.append(F.call_function("div", flat.cast("long"), F.lit(step).cast("long")) % n)
        step *= n
    return out[::-1]
