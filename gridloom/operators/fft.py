"""Fourier transforms: short ones as contractions with a table of roots, long lanes in two passes of short ones over the
cluster (:func:`long_fft`), many lanes of moderate length by NumPy in Arrow tasks.

In the last form one lane is one row, so a transform runs in one task; lanes beyond ``MAX_LANE`` elements are refused there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LANE = 1 << 24
NORMS = ("backward", "ortho", "forward")


def lanes(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by..., lane): each lane's values in order as an array."""
    got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("c"))
    return got.select(*by, F.transform("c", lambda x: x[value].cast("double")).alias("lane"))


def per_lane(df: DataFrame, lane: str, f, complex_out: bool = True, imag: str | None = None) -> DataFrame:
    """Rows with ``f`` of their lane: arrays ``re`` and ``im``, or ``out``."""
    keep = [c for c in df.columns if c not in (lane, imag)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + (["re array<double>", "im array<double>"] if complex_out else ["out array<double>"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                x = np.asarray(batch[lane].iloc[k], float)
                if imag:
                    x = x + 1j * np.asarray(batch[imag].iloc[k], float)
                if len(x) > MAX_LANE:
                    raise ValueError(f"a lane of {len(x)} elements; at most {MAX_LANE}")
                rows.append(np.asarray(f(x)))
            out = {c: batch[c] for c in keep}
            out |= {"re": [x.real for x in rows], "im": [np.imag(x) for x in rows]} if complex_out else {"out": [x.real for x in rows]}
            yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)


def fft(df, lane, n=None, norm="backward", imag=None): return per_lane(df, lane, lambda x: np.fft.fft(x, n, norm=norm), imag=imag)  # noqa: E704
def ifft(df, lane, imag, n=None, norm="backward"): return per_lane(df, lane, lambda x: np.fft.ifft(x, n, norm=norm), imag=imag)  # noqa: E704
def rfft(df, lane, n=None, norm="backward"): return per_lane(df, lane, lambda x: np.fft.rfft(x, n, norm=norm))  # noqa: E704
def irfft(df, lane, imag, n=None, norm="backward"): return per_lane(df, lane, lambda x: np.fft.irfft(x, n, norm=norm), False, imag)  # noqa: E704
def hfft(df, lane, imag, n=None, norm="backward"): return per_lane(df, lane, lambda x: np.fft.hfft(x, n, norm=norm), False, imag)  # noqa: E704
def ihfft(df, lane, n=None, norm="backward"): return per_lane(df, lane, lambda x: np.fft.ihfft(x, n, norm=norm))  # noqa: E704


def fft2(df: DataFrame, flat: str, shape: tuple[int, int], norm: str = "backward") -> DataFrame:
    return per_lane(df, flat, lambda x: np.fft.fft2(x.reshape(shape), norm=norm).ravel())


def fftn(df: DataFrame, flat: str, shape: tuple[int, ...], norm: str = "backward") -> DataFrame:
    return per_lane(df, flat, lambda x: np.fft.fftn(x.reshape(shape), norm=norm).ravel())


#: The longest row or column of a lane that one task transforms.
LONG_LINE = 1 << 20


def dft(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """A short transform in plain aggregation: (by..., k, re, im)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    angle = F.lit(-2 * np.pi / n) * F.pmod(F.col(order) * F.col("k"), F.lit(n))
    spread = df.select(*by, order, value, k)
    return spread.groupBy(*by, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))


def long_fft(df: DataFrame, by: list[str], order: str, re: str, n: int, im: str | None = None, inverse: bool = False, norm: str = "backward") -> DataFrame:
    """(by..., k, re, im): transforms of ``n`` places of lanes given as cells; absent cells are 0, those beyond ``n`` left out.

    With n = rows * columns the lane is a matrix: each column is transformed, turned by the roots of the whole, and each row of
    the result is transformed: two exchanges of the cells, and no task holds more than a row or a column of about the square
    root of ``n``.  Where ``n`` has no such factors and a column would be over ``LONG_LINE``, the chirp transform
    (:func:`gridloom.operators.signal.chirp_fft`) takes it to a length that has them."""
    if norm not in NORMS:
        raise ValueError(f"norm {norm!r} is none of {NORMS}")
    rows = max(r for r in range(1, int(n**0.5) + 1) if n % r == 0)
    if n > LONG_LINE and n // rows > LONG_LINE:
        from .signal import chirp_fft

        return chirp_fft(df, by, order, re, n, im, inverse, norm)
    columns, sign = n // rows, (1 if inverse else -1)
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    scale = {"backward": 1 / n if inverse else 1.0, "ortho": n**-0.5, "forward": 1.0 if inverse else 1 / n}[norm]

    def lines(cells: DataFrame, line: str, place: str) -> DataFrame:
        return cells.groupBy(*by, line).agg(F.collect_list(place).alias("at"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))

    def transformed(length: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = len(by)
                for i in range(batch.num_rows):
                    line = batch.column(m)[i].as_py()
                    x = np.zeros(length, complex)
                    at, re_, im_ = (batch.column(m + 1 + j)[i].values.to_numpy() for j in range(3))
                    x[at] = re_ + 1j * im_
                    y = np.fft.fft(x) if not inverse else np.fft.ifft(x) * length
                    k = np.arange(length)
                    if last:  # row k1 of the turned matrix: place k2 is frequency k1 + rows * k2
                        y, place, out_line = y * scale, line + rows * k, np.zeros(length, np.int64)
                    else:  # column j2: frequency k1 of it, turned
                        y, place, out_line = y * np.exp(sign * 2j * np.pi * ((k * line) % n) / n), np.full(length, line), k
                    own = [pa.array([batch.column(j)[i].as_py()] * length, batch.schema.field(j).type) for j in range(m)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(out_line), pa.array(place), pa.array(y.real), pa.array(y.imag)], [*by, "line", "place", "re", "im"])

        return run

    i = F.col(order).cast("long")
    other = F.col(im).cast("double") if im else F.lit(0.0)
    cells = df.where((i >= 0) & (i < n)).select(*by, (i % columns).alias("line"), F.expr(f"cast(`{order}` AS BIGINT) div {columns}").alias("place"), F.col(re).cast("double").alias("re"), other.alias("im"))
    schema = ", ".join(x for x in (keys, "line long, place long, re double, im double") if x)
    first = lines(cells, "line", "place").mapInArrow(transformed(rows, False), schema)
    second = lines(first, "line", "place").mapInArrow(transformed(columns, True), schema)
    return second.select(*by, F.col("place").alias("k"), "re", "im")


def fftfreq(n: int, step: float = 1.0): return np.fft.fftfreq(n, step)  # noqa: E704
def rfftfreq(n: int, step: float = 1.0): return np.fft.rfftfreq(n, step)  # noqa: E704


def fftshift(df: DataFrame, lane: str) -> DataFrame:
    half = F.floor((F.size(lane) + 1) / 2).cast("int")
    return df.withColumn(lane, F.concat(F.slice(F.col(lane), half + 1, F.size(lane) - half), F.slice(F.col(lane), F.lit(1), half)))


def ifftshift(df: DataFrame, lane: str) -> DataFrame:
    half = F.floor(F.size(lane) / 2).cast("int")
    return df.withColumn(lane, F.concat(F.slice(F.col(lane), half + 1, F.size(lane) - half), F.slice(F.col(lane), F.lit(1), half)))
