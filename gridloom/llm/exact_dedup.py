"""Exact deduplication by content-defined chunk recipes.

A text (white-space runs made single spaces) is cut where a rolling hash of its bytes says so.  Each chunk has a
64-bit fingerprint, its length and its SHA-256.  The chunk table holds each distinct chunk once and verifies the
fingerprints: chunks that share a fingerprint but differ get different variant numbers, so an identifier
(fingerprint, variant) names one content.  Texts are equal when their ordered identifier lists are.

Text is read once and never shuffled; what moves is a chunk's few dozen bytes.

Defined cases: null text counts as empty (its recipe is the empty list); a null id sorts after all ids, and of
rows with equal texts and equal ids one stays; an empty table gives an empty result; other columns of the input
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import text_slices
from .shared import materialise, ship, spread_join

#: One chunk ends on average after this many bytes (a power of two), and after eight times as many at the latest.
CHUNK_BYTES = 2048
WINDOW = 16
_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A white-space run that isn't one space already.
_RUN = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")

_SCHEMA = "doc_id long, text_sha256 string, chunks array<struct<fp:long,len:int,sha:binary>>"


def cuts(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> list[int]:
    """Ends of the chunks of ``data``.  Whether a place is a cut depends on the ``WINDOW`` bytes before it (and,
    after eight times ``chunk_bytes`` without one, on the distance from the last)."""
    n = len(data)
    if n == 0:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # h covers the last `step` bytes, then twice as many
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step) if n > step else np.uint32(0)
        h, step = wider, step * 2
    ends = np.flatnonzero((h >> np.uint32(8)) & np.uint32(chunk_bytes - 1) == 0) + 1
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > 8 * chunk_bytes:
            last += 8 * chunk_bytes
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def recipes(batches: Iterator[pa.RecordBatch], chunk_bytes: int, fingerprint_bits: int) -> Iterator[pa.RecordBatch]:
    mask = (1 << fingerprint_bits) - 1
    chunk_type = pa.list_(pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("sha", pa.binary())]))
    for batch in batches:
        ids = batch.column(0)
        for first, end, buf, offsets in text_slices(batch.column(1)):
            raw = buf.tobytes()
            digests, counts, fps, lens, shas = [], [0], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                data = _RUN.sub(" ", raw[a:b].decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
                digests.append(sha256(data).hexdigest())
                at = 0
                for cut in cuts(data, chunk_bytes):
                    piece = data[at:cut]
                    fp = xxhash.xxh3_64_intdigest(piece) & mask
                    fps.append(fp - (1 << 64) if fp >> 63 else fp)
                    lens.append(cut - at)
                    shas.append(sha256(piece).digest())
                    at = cut
                counts.append(len(fps))
            items = pa.StructArray.from_arrays(
                [pa.array(fps, pa.int64()), pa.array(lens, pa.int32()), pa.array(shas, pa.binary())],
                fields=list(chunk_type.value_type),
            )
            chunks = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, end - first), pa.array(digests, pa.string()), chunks],
                names=["doc_id", "text_sha256", "chunks"],
            )


def chunk_table(docs: DataFrame) -> DataFrame:
    """Each distinct chunk once, with its verified identifier (fp, variant) and in how many places it stands."""
    distinct = (
        docs.select(F.explode("chunks").alias("c"))
        .groupBy("c.fp", "c.len", "c.sha")
        .agg(F.count(F.lit(1)).alias("places"))
    )
    # contents under one fingerprint: one, or a handful where fingerprints collide
    variants = distinct.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("len", "sha", "places"))).alias("all"))
    return variants.select("fp", F.posexplode("all").alias("variant", "one")).select(
        "fp", "variant", "one.len", "one.sha", "one.places"
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    fingerprint_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    spark = docs.sparkSession
    ship(spark)
    read = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(lambda it: recipes(it, chunk_bytes, fingerprint_bits), _SCHEMA)
        .withColumn("row", F.monotonically_increasing_id())
    )
    read = materialise(read, "recipes")

    ids = chunk_table(read).select("fp", "len", "sha", "variant")
    places = read.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.fp", "c.len", "c.sha")
    recipe = (
        spread_join(places, ids, ["fp", "len", "sha"])
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "fp", "variant"))).alias("r"))
        .select("row", F.transform("r", lambda x: F.struct(x["fp"], x["variant"])).alias("recipe"))
    )
    nothing = F.array().cast("array<struct<fp:bigint,variant:int>>")
    named = read.select("row", "doc_id", "text_sha256", F.size("chunks").alias("n_chunks")).join(recipe, "row", "left")
    named = materialise(named.withColumn("recipe", F.coalesce("recipe", nothing)), "identifiers")

    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = named.groupBy("recipe").agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return spread_join(named, groups, ["recipe"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        "n_chunks",
    )
