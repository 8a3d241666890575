"""Convolutions and transforms of long lanes over many tasks.

A lane is given as cells (by..., place from 0, value); absent cells are 0.  :func:`convolve` cuts it into blocks with a halo of the
block before, transforms block by block (overlap-save) and cuts long kernels into pieces; :func:`chirp_fft` turns a transform
of any length, primes too, into a convolution whose length has factors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a block; kernels are cut into pieces of as many.
BLOCK = 4096
#: Blocks grow with a long kernel up to so many places: every block meets every piece, so both get fewer.
LARGEST = 65536
MODES = ("full", "same", "valid")


def mode_range(n: int, m: int, mode: str) -> tuple[int, int]:
    """Where a mode's part of the full convolution of ``n`` and ``m`` places begins and ends."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if mode == "full":
        return 0, n + m - 1
    low, high = min(n, m), max(n, m)
    return ((low - 1) // 2, (low - 1) // 2 + high) if mode == "same" else (low - 1, high)


def _products(batches: Iterator[pa.RecordBatch], keys: int, names: list[str], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            first = batch.column(keys)[r].as_py()
            places, values, piece_places, piece = (batch.column(keys + 1 + k)[r].values.to_numpy() for k in range(4))
            x, y = np.zeros(2 * block), np.zeros(2 * block)
            np.add.at(x, places, values)
            np.add.at(y, piece_places, piece)
            out = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), 2 * block)[block:]
            own = [pa.array([batch.column(k)[r].as_py()] * block, batch.schema.field(k).type) for k in range(keys)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first + np.arange(block)), pa.array(out)], names=names)


def convolve(df: DataFrame, order: str, value: str, n: int, kernel: DataFrame | list[float], mode: str = "full", by: list[str] | None = None, block: int | None = None) -> DataFrame:
    """(by..., i, v): lanes of ``n`` places convolved with one kernel: a list, or cells (k, w) of any number.

    A block of the lane meets a piece of the kernel in one task; it has the places before it that the piece reaches back to, so
    every product is whole and only pieces are added up.  Blocks (of ``BLOCK`` places, more for longer kernels) and pieces are
    exchanged: what they are repeated to is blocks times pieces and must not pass through the driver.
    """
    by, spark = by or [], df.sparkSession
    cells = spark.createDataFrame([(i, float(w)) for i, w in enumerate(kernel)], "k long, w double") if isinstance(kernel, list) else kernel.select(F.col("k").cast("long"), F.col("w").cast("double"))
    m = (cells.agg(F.max("k")).first()[0] if not isinstance(kernel, list) else len(kernel) - 1)
    if m is None or m < 0 or n < 1:
        raise ValueError("a lane and a kernel of one place at least")
    m += 1
    start, stop = mode_range(n, m, mode)
    block = block or min(max(BLOCK, 1 << (m - 1).bit_length()), LARGEST)
    pieces, reach = -(-m // block), min(m - 1, block)
    windows = -(-n // block) + 1
    div = lambda c: F.call_function("div", F.col(c), F.lit(block).cast("long"))
    pairs = lambda place, v: (F.collect_list(place), F.collect_list(v))

    i, own = F.col("__i"), F.struct(div("__i").alias("s"), (F.col("__i") % block + block).alias("at"))
    halo = F.struct((div("__i") + 1).alias("s"), (i % block).alias("at"))
    lane = df.select(*by, F.col(order).cast("long").alias("__i"), F.col(value).cast("double").alias("__v")).where((i >= 0) & (i < n))
    spread = lane.select(*by, F.explode(F.when(i % block >= block - reach, F.array(own, halo)).otherwise(F.array(own))).alias("__c"), "__v")
    at, v = pairs("__c.at", "__v")
    held = spread.groupBy(*by, F.col("__c.s").alias("__s")).agg(at.alias("__at"), v.alias("__x"))
    held = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("__q"))

    at, w = pairs(F.col("k") % block, "w")
    cut = cells.groupBy(div("k").alias("__q")).agg(at.alias("__k"), w.alias("__w"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows - 1).cast("long"))).alias("__s"))
    met = held.hint("merge").join(cut.hint("merge"), ["__s", "__q"]).select(*by, ((F.col("__s") + F.col("__q")) * block).alias("__first"), "__at", "__x", "__k", "__w")
    kinds = dict(df.dtypes)
    names = [*by, "i", "v"]
    out = met.mapInArrow(lambda it: _products(it, len(by), names, block), ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "i long", "v double"]))
    out = out.where((F.col("i") >= start) & (F.col("i") < stop))
    if pieces > 1:
        out = out.groupBy(*by, "i").agg(F.sum("v").alias("v"))
    return out.withColumn("i", F.col("i") - start)


def correlate(df: DataFrame, order: str, value: str, n: int, kernel: DataFrame | list[float], mode: str = "valid", by: list[str] | None = None) -> DataFrame:
    """(by..., i, v): sliding products with a kernel of any length, that is convolution with the kernel turned round."""
    if isinstance(kernel, list):
        turned: DataFrame | list[float] = kernel[::-1]
    else:
        last = kernel.agg(F.max("k")).first()[0]
        turned = kernel.select((F.lit(last) - F.col("k")).alias("k"), "w")
    return convolve(df, order, value, n, turned, mode, by)


def _chirp(place: Column, n: int, sign: int) -> tuple[Column, Column]:
    """exp(sign pi i place**2 / n): the square is taken modulo 2 n in whole numbers."""
    j = place.cast("long")
    angle = ((j * j) % (2 * n)).cast("double") * (sign * math.pi / n)
    return F.cos(angle), F.sin(angle)


def chirp_fft(df: DataFrame, by: list[str], order: str, re: str, n: int, im: str | None = None, inverse: bool = False, norm: str = "backward") -> DataFrame:
    """(by..., k, re, im): a transform of ``n`` places for any ``n``, by three transforms of a power of two of at least 2 n - 1."""
    from .fft import NORMS, long_fft

    if norm not in NORMS:
        raise ValueError(f"norm {norm!r} is none of {NORMS}")
    if n > 3_000_000_000:
        raise ValueError("squares of places must stay whole")
    size, sign = 1 << (2 * n - 2).bit_length(), (1 if inverse else -1)
    spark, i = df.sparkSession, F.col("__i")
    times = lambda a, b, c, d: (a * c - b * d, a * d + b * c)
    other = F.col(im).cast("double") if im else F.lit(0.0)
    lane = df.select(*by, F.col(order).cast("long").alias("__i"), F.col(re).cast("double").alias("__x"), other.alias("__y")).where((i >= 0) & (i < n))
    x, y = times(F.col("__x"), F.col("__y"), *_chirp(i, n, sign))
    a = long_fft(lane.select(*by, "__i", x.alias("__x"), y.alias("__y")), by, "__i", "__x", size, "__y")
    j = F.col("id")
    near = spark.range(n).union(spark.range(1, n).select((F.lit(size) - j).alias("id")))
    c, s = _chirp(F.when(j < n, j).otherwise(F.lit(size) - j), n, -sign)
    b = long_fft(near.select(j.alias("__i"), c.alias("__x"), s.alias("__y")), [], "__i", "__x", size, "__y")
    x, y = times(F.col("re"), F.col("im"), F.col("__br"), F.col("__bi"))
    both = a.join(b.select("k", F.col("re").alias("__br"), F.col("im").alias("__bi")), "k").select(*by, "k", x.alias("__x"), y.alias("__y"))
    back = long_fft(both, by, "k", "__x", size, "__y", inverse=True).where(F.col("k") < n)
    scale = {"backward": 1 / n if inverse else 1.0, "ortho": n**-0.5, "forward": 1.0 if inverse else 1 / n}[norm]
    x, y = times(F.col("re"), F.col("im"), *_chirp(F.col("k"), n, sign))
    return back.select(*by, "k", (x * scale).alias("re"), (y * scale).alias("im"))
