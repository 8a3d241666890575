"""``.npy`` files as a data source: ``spark.read.format("npy")`` and ``df.write.format("npy")``.

Reading plans by the header alone: a partition is a range of rows along the first axis, so a file of any size is many tasks' work.  The
schema follows from the element type: (i0, v) for one axis, (i0, v array) with the other axes flattened for more.  Writing makes one
``.npy`` file for each task under a name of its own, renamed when the job commits and deleted when it aborts.

Files are reached by :mod:`pyarrow.fs` URIs (local or shared folders, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .npy import header

PARTITION_BYTES = 64 << 20
#: Rows of a batch.
BATCH = 1 << 14
_SQL = {"f2": "float", "f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "b1": "boolean"}
_NUMPY = {pa.float32(): "f4", pa.float64(): "f8", pa.int8(): "i1", pa.int16(): "i2", pa.int32(): "i4", pa.int64(): "i8", pa.bool_(): "b1"}
_WIDE = {"f2": "f4", "u1": "i2", "u2": "i4", "u4": "i8"}


@dataclass
class Array:
    """One file: where its elements begin, and what they are."""

    path: str
    shape: tuple[int, ...]
    fortran: bool
    kind: str
    start: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def _places(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        inside = fs.get_file_info(pafs.FileSelector(at))
        return fs, sorted(x.path for x in inside if x.base_name.endswith(".npy") and not x.base_name.startswith(("_", ".")))
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return fs, [at]


def opened(fs: pafs.FileSystem, path: str) -> Array:
    with fs.open_input_file(path) as f:
        first = f.read(12)
        size = int.from_bytes(first[8:10], "little") + 10 if first[6] == 1 else int.from_bytes(first[8:12], "little") + 12
        f.seek(0)
        shape, fortran, kind = header(f.read(size))
    if not shape:
        raise ValueError(f"{path} holds a single value, not rows")
    if kind.lstrip("<>|=") not in _SQL:
        raise ValueError(f"elements of type {kind} have no column type here; read_arrays reads them")
    return Array(path, shape, fortran and len(shape) > 1, kind, size)


@dataclass
class Rows(InputPartition):
    array: Array
    low: int
    high: int
    offset: int


class Reader(DataSourceReader):
    def __init__(self, path: str, rows: int | None):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        fs, names = _places(self.path)
        out, offset = [], 0
        for a in (opened(fs, n) for n in names):
            step = self.rows or max(1, PARTITION_BYTES // max(1, a.width * np.dtype(a.kind).itemsize))
            out += [Rows(a, low, min(low + step, a.shape[0]), offset) for low in range(0, a.shape[0], step)]
            offset += a.shape[0]
        return out or [Rows(Array("", (0,), False, "<f8", 0), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        a = partition.array
        if partition.high <= partition.low:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")
        kind = np.dtype(a.kind)
        plain = kind.str.lstrip("<>|=")
        with fs.open_input_file(a.path) as f:
            for low in range(partition.low, partition.high, BATCH):
                n = min(BATCH, partition.high - low)
                if a.fortran:  # a column at a time: rows lie side by side in it
                    parts = [np.frombuffer(f.read_at(n * kind.itemsize, a.start + (c * a.shape[0] + low) * kind.itemsize), kind) for c in range(a.width)]
                    flat = np.stack(parts, axis=1)
                    flat = flat.reshape(n, *a.shape[1:][::-1]).transpose(0, *range(len(a.shape) - 1, 0, -1)).reshape(n, -1)
                else:
                    flat = np.frombuffer(f.read_at(n * a.width * kind.itemsize, a.start + low * a.width * kind.itemsize), kind).reshape(n, a.width)
                values = pa.array(np.ascontiguousarray(flat).ravel().astype(_WIDE.get(plain, plain)))
                if len(a.shape) > 1:
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.width), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + low + partition.offset), values], names=["i0", "v"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class Writer(DataSourceArrowWriter):
    """Rows of a column ``v`` (a number, or an array of one length) as one file for each task, in the order of the rows."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:8]

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        batches = [b for b in iterator if b.num_rows]
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.npy"
        if not batches:
            return Written("", 0)
        columns = [b.column(b.schema.get_field_index("v")) for b in batches]
        shape: tuple[int, ...] = (sum(len(c) for c in columns),)
        if pa.types.is_list(columns[0].type):
            widths = {len(x) for c in columns for x in c}
            if len(widths) > 1:
                raise ValueError(f"rows of different lengths: {sorted(widths)[:3]}")
            shape, columns = (*shape, widths.pop()), [c.flatten() for c in columns]
        if any(c.null_count for c in columns):
            raise ValueError("an array has no place for NULL")
        kind = _NUMPY[columns[0].type]
        fs, at = self._folder()
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/_{name}.{context.attemptNumber()}") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": np.dtype(kind).newbyteorder("<").str, "fortran_order": False, "shape": shape})
            for c in columns:
                f.write(c.to_numpy(zero_copy_only=False).astype(kind).tobytes())
        return Written(f"_{name}.{context.attemptNumber()}", shape[0])

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = self._folder()
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(at)):
                if x.base_name.endswith(".npy"):
                    fs.delete_file(x.path)
        for m in messages:
            if m and m.name:
                fs.move(f"{at}/{m.name}", f"{at}/{m.name[1:].rsplit('.', 1)[0]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = self._folder()
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{at}/{m.name}")


class Npy(DataSource):
    """Options: ``path``, and ``rows`` for the rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        fs, names = _places(self.options["path"])
        if not names:
            raise ValueError("no .npy file tells the schema; give one")
        a = opened(fs, names[0])
        element = _SQL[a.kind.lstrip("<>|=")]
        return f"i0 bigint, v {element if len(a.shape) == 1 else f'array<{element}>'}"

    def reader(self, schema) -> Reader:  # noqa: ANN001
        rows = self.options.get("rows")
        return Reader(self.options["path"], int(rows) if rows else None)

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Npy)
