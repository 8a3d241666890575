"""Array files: ``.npy`` and ``.npz`` through Spark's binary reader and writer-side files, text with comments.

Files are read where Spark can read them (any file system); a file is one task's input, so large arrays belong in many
files or in Parquet.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header(data: bytes) -> tuple[tuple[int, ...], bool, str]:
    """Shape, whether columns come first, and element type of an ``.npy`` file from its first bytes."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    return shape, fortran, kind.str


#: How elements of a kind come back: as one column or two, without loss within the kind.
KINDS = {"double": "v double", "long": "v long", "unsigned": "v decimal(20,0)", "complex": "re double, im double", "string": "v string"}


def _columns(part: np.ndarray, kind: str) -> list[pa.Array]:
    if kind == "complex":
        return [pa.array(part.real.astype(float)), pa.array(part.imag.astype(float))]
    if kind == "unsigned":
        return [pa.array([Decimal(int(x)) for x in part], pa.decimal128(20, 0))]
    if kind == "long":
        if not np.can_cast(part.dtype, np.int64):
            raise ValueError(f"elements of type {part.dtype} aren't whole numbers of 64 bits")
        return [pa.array(part.astype(np.int64))]
    return [pa.array([str(x) for x in part])] if kind == "string" else [pa.array(part.astype(float))]


def read_arrays(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(file, member, pos, v): the elements in row-major order of every ``.npy`` file, or member of an ``.npz`` archive, as
    ``kind`` says: whole numbers as ``long`` or ``unsigned`` keep their bits, ``complex`` gives re and im."""
    names = [c.split()[0] for c in KINDS[kind].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                members = {m: got[m] for m in got.files} if hasattr(got, "files") else {"": got}
                for member, a in members.items():
                    flat = np.ascontiguousarray(a).ravel()
                    for at in range(0, len(flat), 1 << 16):
                        part = flat[at : at + (1 << 16)]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([member] * n), pa.array(np.arange(at, at + n)), *_columns(part, kind)], ["file", "member", "pos", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, member string, pos long, {KINDS[kind]}")


_SQL = {"f": "double", "i": "long", "u": "long", "b": "boolean", "U": "string", "S": "string"}


def read_records(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(file, pos, a column per field) of ``.npy`` files of records; ``fields`` names their SQL types, else the first file's header does."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if fields is None:
        first = files.select("path", F.substring("content", 1, 1 << 16).alias("head")).orderBy("path").first()
        f = io.BytesIO(bytes(first["head"]))
        version = np.lib.format.read_magic(f)
        kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[2]
        if kind.names is None:
            raise ValueError("an array without fields: read_arrays")
        fields = {n: _SQL[kind[n].kind] for n in kind.names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False).ravel()
                for at in range(0, len(a), 1 << 16):
                    part = a[at : at + (1 << 16)]
                    cols = []
                    for n, t in fields.items():
                        cols.append(pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in part[n].tolist()]) if t == "string" else pa.array(np.ascontiguousarray(part[n]).astype({"double": float, "long": np.int64, "boolean": bool}[t])))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), *cols], ["file", "pos", *fields])

    return files.mapInArrow(run, "file string, pos long, " + ", ".join(f"`{n}` {t}" for n, t in fields.items()))


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, shape, fortran, dtype) of ``.npy`` files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [header(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(h[0]) for h in heads], pa.list_(pa.int64())), pa.array([h[1] for h in heads]), pa.array([h[2] for h in heads])],
                ["file", "shape", "fortran", "dtype"],
            )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, shape array<long>, fortran boolean, dtype string")


def npy_bytes(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by..., content): each group's values in order as the bytes of an ``.npy`` file, for a binary sink."""
    kinds = dict(df.dtypes)
    lanes = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("lane"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lane in batch.column(len(by)):
                f = io.BytesIO()
                np.save(f, np.array(lane.as_py(), float))
                out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, pa.binary())], [*by, "content"])

    return lanes.mapInArrow(run, ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["content binary"]))


def save_arrays(df: DataFrame, by: list[str], order: str, value: str, path: str) -> DataFrame:
    """Write each group as ``<by>.npy`` under ``path`` (a folder that executors share, of any scheme Arrow knows): (file, bytes).
    The files are written when the result is; a task that runs again writes the same file again."""
    named = npy_bytes(df, by, order, value).select(F.concat_ws("-", *[F.col(b).cast("string") for b in by]).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            files, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}.npy") as out:
                    out.write(content)
                files.append(f"{root}/{name}.npy")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return named.mapInArrow(run, "file string, bytes long")


def from_array(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """Cells (i0, ..., v) of an array on the driver."""
    if a.size > MAX_LOCAL:
        raise ValueError(f"{a.size} elements on the driver; at most {MAX_LOCAL}: read files with read_arrays")
    index = np.indices(a.shape).reshape(a.ndim, -1)
    return spark.createDataFrame(pa.table({**{f"i{k}": index[k].astype(np.int64) for k in range(a.ndim)}, "v": a.ravel().astype(float)}))


#: Elements of an array that passes through the driver at most.
MAX_LOCAL = 1 << 26


def to_array(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """A bounded array on the driver; absent cells are NaN."""
    if math.prod(shape) > MAX_LOCAL:
        raise ValueError(f"an array of shape {shape} for the driver; at most {MAX_LOCAL} elements: write it with save_arrays")
    got = df.toArrow()
    out = np.full(shape, np.nan)
    out[tuple(got.column(f"i{k}").to_numpy() for k in range(len(shape)))] = got.column("v").to_numpy()
    return out
