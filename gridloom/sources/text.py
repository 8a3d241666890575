"""Delimited text: comments go before rows are skipped, ragged rows raise, missing fields can be filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def _lines(spark: SparkSession, path: str, comments: str) -> DataFrame:
    """(file, block, id, line) of the lines that hold something besides a comment; ids rise within a file's blocks."""
    line = F.split(F.col("value"), _escaped(comments), 2)[0]
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.btrim(line).alias("line")
    )
    return rows.where("line <> ''")


def _without_first(rows: DataFrame, n: int) -> DataFrame:
    """Without the first ``n`` lines of each file; only the first of each block are compared."""
    first = rows.select("file", "block", "id").withColumn("k", F.row_number().over(W.partitionBy("file").orderBy("block", "id")))
    gone = first.where(F.col("k") <= n).groupBy("file").agg(F.max(F.struct("block", "id")).alias("last"))
    joined = rows.join(gone.withColumnRenamed("file", "of"), F.col("file") == F.col("of"))
    return joined.where(F.struct("block", "id") > F.col("last")).drop("of", "last")


def load(spark: SparkSession, path: str, columns: int, delimiter: str = ",", comments: str = "#", fill: float | None = None,
         skiprows: int = 0, usecols: list[int] | None = None, names: list[str] | bool | None = None) -> DataFrame:
    """Columns as doubles: ``usecols`` of the ``columns`` of each row, named c0, c1, ... or by ``names``; with True the first
    row left after ``skiprows`` names them.  Without ``fill`` a missing or malformed field raises."""
    rows = _lines(spark, path, comments)
    if skiprows:
        rows = _without_first(rows, skiprows)
    cut = _escaped(delimiter)
    if names is True:
        head = rows.orderBy("file", "block", "id").select("line").first()
        names = [x.strip() for x in head["line"].split(delimiter)] if head else [f"c{k}" for k in range(columns)]
        rows = _without_first(rows, 1)
    wanted = list(range(columns)) if usecols is None else [k % columns for k in usecols]
    if names and len(names) == columns:
        titles = [names[k] for k in wanted]
    else:
        titles = list(names) if names else [f"c{k}" for k in wanted]
    if len(titles) != len(wanted):
        raise ValueError(f"{len(titles)} names for {len(wanted)} columns")
    ragged = F.when(F.size("p") != columns, F.raise_error(F.concat(F.lit("ragged row: "), F.col("line"))))
    rows = rows.select("line", F.split("line", cut, -1).alias("p"))
    fields = []
    for k, name in zip(wanted, titles, strict=True):
        text = F.btrim(F.get("p", F.lit(k)))
        value = text.cast("double") if fill is None else F.coalesce(text.try_cast("double"), F.lit(fill))
        fields.append(F.coalesce(ragged.cast("double"), value).alias(name))
    return rows.select(*fields)


def save(df: DataFrame, path: str, columns: list[str], delimiter: str = ",", fmt: str | list[str] = "%.18e", order: list[str] | None = None,
         header: str = "", footer: str = "", comments: str = "# ") -> None:
    """A line per row, in ``order`` over all files by their names; header and footer are comments before and after."""
    forms = [fmt] * len(columns) if isinstance(fmt, str) else fmt

    def value(c: str, form: str) -> Column:
        return F.format_string(form, F.col(c).cast("long" if form.rstrip()[-1:] in "di" else "double"))

    line = F.concat_ws(delimiter, *[value(c, form) for c, form in zip(columns, forms, strict=True)])
    out = df.select(F.lit(1).alias("part"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order or [])], line.alias("value"))
    for part, text in ((0, header), (2, footer)):
        if text:
            rows = [(part, k, comments + x) for k, x in enumerate(text.split("\n"))]
            more = df.sparkSession.createDataFrame(rows, "part int, k int, value string")
            out = out.withColumn("k", F.lit(0)) if "k" not in out.columns else out
            out = out.unionByName(more, allowMissingColumns=True)
    keys = ["part", *(["k"] if "k" in out.columns else []), *[c for c in out.columns if c.startswith("o")]]
    if order or header or footer:
        out = out.orderBy(*keys)
    out.select("value").write.text(path)


def from_regex(spark: SparkSession, path: str, pattern: str, groups: int) -> DataFrame:
    """A row per match over all lines, a column per group."""
    found = F.explode(F.regexp_extract_all(F.col("value"), F.lit(pattern), F.lit(0))).alias("m")
    return spark.read.text(path).select(found).select(*[F.regexp_extract("m", pattern, k + 1).alias(f"c{k}") for k in range(groups)])
