"""Copies of a text are left out of the counts by bitmaps of row numbers."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import pii


@pytest.mark.parametrize("bitmaps", [4096, 0])
def test_copies_are_left_out_without_an_exchange_of_terms(spark, monkeypatch, bitmaps):
    """Rows of many tasks by a bitmap of their numbers, or joined where there are too many."""
    monkeypatch.setattr(pii, "BITMAPS", bitmaps)
    df = spark.range(0, 90_000, 1, 3).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("string").alias("term"))
    df = pii.materialise(df, "rows")
    kept = df.where(F.col("row") % 7 < 2).select("row").repartition(5)
    got = pii.among(df, kept, "row")
    assert got.columns == ["row", "term"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.where(F.col("row") % 7 < 2).collect()))
    if bitmaps:  # only the bitmaps' side may be exchanged
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
