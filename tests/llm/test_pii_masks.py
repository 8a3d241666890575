"""Entities are masked in pieces of a text, in proportion to its length."""

import random

from pyspark.sql import functions as F

from gridloom.llm import pii


def test_masked_texts_of_many_pieces(spark):
    """Spans that overlap, touch, cross the edges of pieces or fill them, against plain slices."""
    rng = random.Random(4)
    rows = []
    for k, n in enumerate([1, 5, 2047, 2048, 2049, 4096, 9000, 65536, 65537, 140_000]):
        text = "".join(rng.choice("ab \n\r\x01é😀.") for _ in range(n))
        spans = [(a := rng.randrange(n), rng.randrange(4), min(n, a + rng.choice([1, 2, 30, 300, 5000]))) for _ in range(1 + n // 200)]
        rows.append((k, text, sorted(spans)))
    df = spark.createDataFrame(rows, "k int, t string, spans array<struct<start:int,kind:int,stop:int>>")
    for r in df.select("t", "spans", pii.masked(F.col("t"), F.col("spans")).alias("got")).collect():
        want = list(r["t"].replace("\x01", " "))
        for s in r["spans"]:
            want[s["start"] : s["stop"]] = "\x01" * (s["stop"] - s["start"])
        assert r["got"] == "".join(want)


def test_a_text_is_masked_once(spark):
    df = spark.createDataFrame([], "t string, spans array<struct<start:int,kind:int,stop:int>>")
    words = df.select(pii.free_words(F.col("t"), F.col("spans")).alias("w"))
    assert words._jdf.queryExecution().analyzed().toString().count("translate(") == 1
