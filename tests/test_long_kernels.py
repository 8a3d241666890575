"""A kernel that is a table: no block or piece is broadcast, and few meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import signal


@pytest.mark.parametrize("m", [40, 700])
def test_pieces_of_a_long_kernel_are_exchanged(spark, monkeypatch, m):
    monkeypatch.setattr(signal, "BLOCK", 64)
    monkeypatch.setattr(signal, "LARGEST", 256)
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=2000), rng.normal(size=m)
    lane = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    kernel = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "k long, w double")
    got = signal.convolve(lane, "i", "v", len(x), kernel)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    values = np.array([r["v"] for r in got.orderBy("i").collect()])
    assert np.allclose(values, np.convolve(x, w))
    slid = signal.correlate(lane, "i", "v", len(x), kernel).orderBy(F.col("i"))
    assert np.allclose([r["v"] for r in slid.collect()], np.correlate(x, w, "valid"))
