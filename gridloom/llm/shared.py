"""What the operators of this subpackage have in common: the shared folder, cutting lineage, spread joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every text contract: space and the controls from tab to carriage return.
WS = r"\x20\x09-\x0D"
#: The same as a set of characters, for the functions that take one.
WS_CHARS = " \t\n\x0b\x0c\r"
_SHIPPED: dict[str, str] = {}


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: from where it lies on one machine, as an archive that executors fetch from
    the driver on a cluster."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if on_one_machine(spark):
        have = [p for p in sc.environment.get("PYTHONPATH", "").split(":") if p]
        if str(root) not in have:
            sc.environment["PYTHONPATH"] = ":".join([*have, str(root)])
        return
    if _SHIPPED.get(sc.applicationId) is None:
        name = f"{tempfile.mkdtemp(prefix='gridloom-')}/gridloom.zip"  # the driver's own; executors get copies
        with zipfile.ZipFile(name, "w") as out:
            for f in sorted((root / "gridloom").rglob("*.py")):
                out.write(f, f.relative_to(root))
        sc.addPyFile(name)
        _SHIPPED[sc.applicationId] = name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    ``spark.checkpoint.dir`` names it; where that is unset a temporary folder is set on one machine, as in tests, and a
    cluster is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def table_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/gridloom/{what}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back: lineage is cut and a lost
    executor costs no recomputation of what is upstream."""
    spark = df.sparkSession
    path = table_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gridloom/" in name:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(name)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose two sides are both exchanged for this join alone.

    The extra derived key keeps the planner from reusing the partitioning of an aggregate below, so adaptive
    execution may split a partition that one hot key fills.  ``right`` is unique on ``keys``.
    """
    tag = "__spread"
    derived = F.xxhash64(*keys, F.lit(7))
    left, right = left.withColumn(tag, derived), right.withColumn(tag, derived)
    return left.join(right, [*keys, tag], how).drop(tag)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^ws]+`` of a text as an array (empty for a text without words)."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]
