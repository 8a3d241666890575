"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is linear in the number of links and cuts its lineage in the shared folder.  A node with very many links
is no hot spot: minima are combined before the exchange, and the joins may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialise, spread_join


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node reachable.  ``edges``: longs a, b."""
    now, before = materialise(_oriented(edges), "links"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
        before = mark
        # large star: each node hands its larger neighbours to the least of its neighbours and itself
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = spread_join(now, least, ["lo"]).select(F.col("m").alias("lo"), "hi").distinct()
        large = materialise(large, "links")
        # small star: each node hands its smaller neighbours to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = spread_join(large, least, ["hi"])
        small = small.select("m", F.col("lo").alias("x")).union(small.select("m", "hi")).where("m <> x")
        new = materialise(small.select(F.col("m").alias("lo"), F.col("x").alias("hi")).distinct(), "links")
        drop_table(now)
        drop_table(large)
        now = new
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
