"""User functions over arrays: lanes and batches go to NumPy by Arrow, never row by row where a batch will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import NdFrame


def vectorize(f: Callable[..., np.ndarray], kind: str = "double") -> Callable[..., Column]:
    """A function of arrays as a function of Columns: it is called once per Arrow batch."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(*[c.to_numpy() for c in columns])))

    return run


def frompyfunc(f: Callable, n_in: int, n_out: int = 1, kind: str = "double") -> Callable[..., Column]:
    """A function of single values as a function of Columns; with several results an array of them.  Batches go through
    Arrow, and the function sees one element at a time."""
    many = f"array<{kind}>" if n_out > 1 else kind

    @F.pandas_udf(many)
    def run(*columns: pd.Series) -> pd.Series:
        got = [f(*row) for row in zip(*[c.tolist() for c in columns], strict=True)]
        return pd.Series([list(x) for x in got] if n_out > 1 else got)

    def call(*columns) -> Column:
        if len(columns) != n_in:
            raise ValueError(f"{n_in} arguments, not {len(columns)}")
        return run(*columns)

    return call


def ma_apply_along_axis(a: NdFrame, axis: int, f: Callable[[np.ma.MaskedArray], object]) -> NdFrame:
    """``f`` of each lane as a masked array (absent and NULL cells masked); a masked result is NULL."""

    def lane(x: np.ndarray) -> np.ndarray:
        got = f(np.ma.masked_invalid(x))
        return np.ma.filled(np.ma.atleast_1d(np.ma.asarray(got, float)), np.nan)

    # masked elements travel as NaN, for which a lane of doubles has room
    full = NdFrame(a.cells.withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))), a.shape)
    out = apply_along_axis(full, axis, lane)
    return out.map(lambda v: F.when(~F.isnan(v), v))


def apply_along_axis(a: NdFrame, axis: int, f: Callable[[np.ndarray], np.ndarray], width: int | None = None) -> NdFrame:
    """``f`` of each lane along ``axis`` (an array of ``width`` values, or one value).  A lane is one group in one task."""
    keep = [k for k in range(a.ndim) if k != axis]
    names = [f"i{k}" for k in keep]
    got = a.cells.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct(f"i{axis}", "v"))), lambda x: x["v"]).alias("lane"))
    schema = ", ".join([f"{n} long" for n in names] + ["r array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.atleast_1d(np.asarray(f(np.asarray(x, float)), float)) for x in batch["lane"]]
            yield batch[names].assign(r=out)

    rows = got.mapInPandas(run, schema)
    if width is None:
        cells = rows.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(keep)], F.get("r", F.lit(0)).alias("v"))
        return NdFrame(cells, tuple(a.shape[k] for k in keep))
    spread = rows.select(*names, F.posexplode("r").alias(f"i{axis}", "v")).withColumn(f"i{axis}", F.col(f"i{axis}").cast("long"))
    return NdFrame(spread.select(*a.axes, "v"), (*a.shape[:axis], width, *a.shape[axis + 1 :]))


def apply_over_axes(a: NdFrame, f: Callable[[Column], Column], axes: list[int]) -> NdFrame:
    """An aggregate over one axis after the other, the axes kept with length 1."""
    for axis in axes:
        a = a.reduce(f, axis, keepdims=True)
    return a


def _folded(values: np.ndarray, starts: np.ndarray, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Each stretch of ``values`` folded by neighbours, in order: ``f`` gets arrays, once per level of the tree."""
    lengths = np.diff(np.append(starts, len(values)))
    while len(values) > len(lengths):
        place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        paired = (place % 2 == 0) & (place + 1 < np.repeat(lengths, lengths))
        kept, left = place % 2 == 0, np.flatnonzero(paired)
        values = values.copy()
        values[left] = f(values[left], values[left + 1])
        values, lengths = values[kept], (lengths + 1) // 2
    return values


def reduce_with(df: DataFrame, by: list[str], value: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray], order: str | None = None, kind: str = "double", as_col: str = "v") -> DataFrame:
    """(by..., ``as_col``): ``f``, any associative function of two arrays, folded over the values of each group; NULL is left out.

    A batch is folded by group before anything moves, so a group of any size leaves a task as one value for each of its batches,
    and these meet in a tree: first within stretches of ``TREE`` of them, then all.  With ``order`` the function need not be
    commutative: rows are dealt by ranges of it and partial results keep their place.  A table without groups gives one row, or none.
    """
    from .ranges import ranged

    rows = df.where(F.col(value).isNotNull())
    if order is not None:
        parts = ranged(rows.select(*by, order, F.col(value).cast(kind).alias("__v")), by, [order]).sortWithinPartitions(*by, order, "__m")
        parts = parts.select(*by, F.col("__p").cast("long").alias("__p"), "__v")
    else:
        parts = rows.select(*by, F.spark_partition_id().cast("long").alias("__p"), F.col(value).cast(kind).alias("__v"))
    kinds = dict(df.dtypes)
    names = [f"__g{k}" for k in range(len(by))]
    schema = ", ".join([*[f"{n} {kinds[b]}" for n, b in zip(names, by, strict=True)], "__p long", "__n long", f"__v {kind}"])

    def batches_folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, batch in enumerate(batches):
            if not len(batch):
                continue
            keys = batch.iloc[:, : len(by)]
            group = keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(batch), int)
            at = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[at], prepend=-1))
            out = batch.iloc[at[starts], : len(by)].copy()
            out.columns = names
            out["__p"], out["__n"] = batch["__p"].to_numpy()[at[starts]], n
            out["__v"] = _folded(batch["__v"].to_numpy()[at], starts, f)
            yield out

    def group_folded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__p", "__n"], kind="stable")
        out = part.iloc[:1].copy()
        out["__v"] = _folded(part["__v"].to_numpy(), np.zeros(1, int), f)
        return out

    partial = parts.mapInPandas(batches_folded, schema)
    stretch = F.call_function("div", F.col("__p"), F.lit(TREE).cast("long")).alias("__s")
    near = partial.groupBy(*names, stretch).applyInPandas(group_folded, schema)
    whole = near.groupBy(*(names or [F.pmod("__n", F.lit(1)).alias("__one")])).applyInPandas(group_folded, schema)
    return whole.select(*[F.col(n).alias(b) for n, b in zip(names, by, strict=True)], F.col("__v").alias(as_col))


#: Ranges or partitions whose partial results meet in one task first.
TREE = 64
