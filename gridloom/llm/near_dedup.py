"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. One pass over the texts gives each document its number of distinct word shingles, a digest of that set and
   ``BANDS`` band keys of ``ROWS`` MinHash samples each.
2. Documents with equal sets form a class; from here on only one row per class moves, so copies make no pairs.
3. Classes that share a band bucket with another get an odd sketch: ``SKETCH_SAMPLES`` MinHash samples folded into a
   bitmap in which each toggles one bit.  The population count of two sketches' XOR estimates their similarity closely
   where it is high.
4. Each band bucket links its members to a few centres (a star, linear in the bucket).  Pairs pass the sketch test and
   the length bound, then the exact test on full sets.
5. Members of a bucket that the stars left in different components are compared with each other, so no link is lost
   for being far from a centre; pairs of one component aren't compared again, and a pair counts in the first bucket
   that it shares.  A bucket of many such members is cut into blocks of ``BLOCK_MEMBERS``, and each pair of blocks is a
   key of its own: the comparisons of a bucket are spread over tasks, and no pair is a row before it has passed.

Sketches and full sets are made only for the documents that need them.  Which these are is sent to the scan as a Bloom
bitmap, sized by their number, whose false positives the later join drops; from ``BLOOM_MOST`` documents on an equi-join
brings their texts instead, so what is sent never exceeds two megabytes a million.

A pair at the threshold of 0.85 shares a bucket with probability 1 - (1 - 0.85**6)**42, all but 3e-9, and its sketch
passes but for about 1e-5; both chances of loss vanish above it.

Defined cases: null text and texts without words have an empty set, are linked with nothing and stay; a text of fewer
words than a shingle has its whole sequence as one; rows that repeat an id are separate rows, of which at most one
stays in :func:`kept_documents`; a null id sorts after all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, fmix, shingle_sets, text_slices
from .shared import materialise, ship, spread_join, text_or_empty

WIDTH = 5
PERCENT = 85
ROWS, BANDS = 6, 42
SAMPLES = ROWS * BANDS
SKETCH_SAMPLES = 1024
SKETCH_BITS = 4096
#: How far below the threshold a sketch may place a pair: over four standard errors at 0.85.
SKETCH_MARGIN = 0.05
#: Documents that a bitmap of 16 bits each names at most (16 MB).
BLOOM_MOST = 1 << 23
CENTRES = 16
BLOCK_MEMBERS = 2000

_rng = np.random.default_rng(20240602)
_A = _rng.integers(0, 1 << 63, SAMPLES + SKETCH_SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES + SKETCH_SAMPLES, dtype=np.uint64)

_SCHEMA = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def samples(values: np.ndarray, bounds: np.ndarray, first: int, count: int) -> np.ndarray:
    """MinHash samples ``first`` to ``first + count`` of non-empty sets given one after the other, a row each."""
    out = np.empty((len(bounds) - 1, count), U64)
    with np.errstate(over="ignore"):
        for i in range(first, first + count):
            out[:, i - first] = np.minimum.reduceat((values ^ _B[i]) * _A[i], bounds[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(1), (len(sig), BANDS)).copy()
        for r in range(ROWS):
            key = fmix(key * U64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
    return key.view(np.int64)


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        at = (fmix(sig * U64(0xD6E8FEB86659FD93) + np.arange(SKETCH_SAMPLES, dtype=U64)) >> U64(52)).astype(np.int64)
    bits = np.zeros((len(sig), SKETCH_BITS), np.uint8)
    rows = np.arange(len(sig))
    for i in range(SKETCH_SAMPLES):
        bits[rows, at[:, i]] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def sketch_limit(percent: int) -> int:
    """Most bits that may differ between the sketches of a candidate pair."""
    low = percent / 100 - SKETCH_MARGIN
    differing = 2 * SKETCH_SAMPLES * (1 - low)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, offsets in text_slices(batch.column(1)):
            values, bounds = shingle_sets(buf, offsets, width)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            starts = np.append(bounds[full], len(values))
            sig = samples(values, starts, 0, SAMPLES) if len(full) else np.zeros((0, SAMPLES), U64)
            raw, at = values.tobytes(), bounds.tolist()
            digests = [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]

            ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(sig).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), bands,
                 *[c.slice(first, end - first) for c in batch.columns[2:]]],
                names=["doc_id", "n_shingles", "set_id", "bands", *batch.schema.names[2:]],
            )


def bloom_places(doc: Column, bits: int) -> Column:
    h = F.xxhash64(doc, F.lit(3))
    mask = F.lit(bits - 1)
    return F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))


def bloom(ids: DataFrame, n: int) -> np.ndarray:
    """A bitmap of about 16 bits for each of the ``n`` rows' ``doc_id``: at most that many bits reach the driver."""
    bits = 1 << max(10, int(16 * max(n, 1) - 1).bit_length())
    words = (
        ids.select(F.explode(bloom_places(F.col("doc_id"), bits)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
    )
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def text_digest(text: str) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(text_or_empty(text), 256)), 1, 16)


class NearDedup:
    """The steps over one table of documents; ``digests`` has :meth:`groups` name each row's :func:`text_digest`, too."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, digests: bool = False):
        ship(docs.sparkSession)
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.more = ["digest"] if digests else []
        read = self.read.withColumn("digest", text_digest("text")) if digests else self.read
        signed = read.mapInArrow(lambda it: signatures(it, width), _SCHEMA + ", digest binary" * digests)
        self.rows = materialise(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        #: set_id -> the row that stands for the class, and its document
        self.classes = materialise(
            self.rows.where("n_shingles > 0").groupBy("set_id").agg(F.min(first).alias("f"))
            .select("set_id", F.col("f.row").alias("node"), F.col("f.doc_id").alias("doc_id")),
            "classes",
        )
        nodes = self.rows.join(self.classes.select(F.col("node").alias("row")), "row", "left_semi")
        self.nodes = materialise(
            nodes.select(F.col("row").alias("node"), "doc_id", "set_id", "n_shingles", "bands"), "nodes"
        )

    def close(self, a: str, b: str) -> Column:
        """The bounds on lengths and sketches that every link meets."""
        na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
        limit, words = sketch_limit(self.percent), SKETCH_BITS // 64
        # an eighth of the bits, with six standard errors to spare, settles most pairs in generated code
        few = reduce(
            lambda x, y: x + y,
            [F.bit_count(F.get(f"{a}.sketch", F.lit(k)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(k)))) for k in range(words // 8)],
        )
        some = limit / 8 + 6 * (limit / 8) ** 0.5
        differing = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        every = F.aggregate(differing, F.lit(0), lambda n, x: n + x)
        lengths = 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)
        return lengths & (few <= int(some)) & (every <= limit)

    def again(self, nodes: DataFrame, what: str) -> DataFrame:
        """(node, s): the full shingle sets of the given nodes, or their sketches, from another scan."""
        wanted = materialise(self.nodes.select("node", "doc_id", "set_id").join(nodes, "node", "left_semi"), "wanted")
        width, least = self.width, F.lit(-(2**63)).cast("long")
        n = wanted.count()
        sent, read = None, self.read
        if n <= BLOOM_MOST:
            bitmap = bloom(wanted, n)
            sent = self.spark.sparkContext.broadcast(bitmap)
            read = read.select("doc_id", "text", bloom_places(F.col("doc_id"), 64 * len(bitmap)).alias("at"))
        else:
            ids = wanted.select(F.coalesce("doc_id", least).alias("d")).distinct()
            read = read.withColumn("d", F.coalesce("doc_id", least)).join(ids, "d", "left_semi").select("doc_id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value if sent is not None else None
            for batch in batches:
                some = batch
                if bits is not None:
                    at = np.array(batch.column(2).flatten().to_numpy()).reshape(-1, 2)
                    some = batch.filter(pa.array(((bits[at >> 6] >> (at & 63)) & 1).all(1)))
                for first, end, buf, offsets in text_slices(some.column(1)):
                    values, bounds = shingle_sets(buf, offsets, width)
                    full = np.flatnonzero(np.diff(bounds))
                    if not len(full):
                        continue
                    raw = values.tobytes()
                    ends = [(int(bounds[i]), int(bounds[i + 1])) for i in full]
                    ids = [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in ends]
                    starts = np.append(bounds[full], len(values))
                    if what == "sketch":
                        rows = odd_sketches(samples(values, starts, SAMPLES, SKETCH_SAMPLES))
                        starts, values = np.arange(len(full) + 1) * rows.shape[1], rows.ravel()
                    s = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
                    docs = some.column(0).slice(first, end - first).take(pa.array(full))
                    yield pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.binary()), s], ["doc_id", "set_id", "s"])

        found = read.mapInArrow(run, "doc_id long, set_id binary, s array<long>")
        some = wanted.select("node", F.coalesce("doc_id", least).alias("d"), "set_id")
        found = found.withColumn("d", F.coalesce("doc_id", least)).join(some, ["d", "set_id"])
        return materialise(found.select("node", "s").dropDuplicates(["node"]), what)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        sets = self.again(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "set")
        one = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
        other = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        both = spread_join(spread_join(pairs.select("a", "b"), one, ["a"]), other, ["b"])
        common = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - F.col("common")
        out = both.withColumn("common", common).where(100 * F.col("common") >= self.percent * union)
        return materialise(out.select("a", "b"), "links")

    def links(self) -> DataFrame:
        """Confirmed links (a, b) between nodes: enough of them that components are right."""
        keyed = self.nodes.select("node", F.explode("bands").alias("bucket"))
        order = F.struct(F.xxhash64("node", F.pmod("bucket", F.lit(CENTRES))).alias("h"), "node")
        shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("c")).where("n > 1")
        members = materialise(
            spread_join(keyed, shared.select("bucket", F.col("c.node").alias("centre")), ["bucket"]), "members"
        )
        inside = members.select("node").distinct()
        sketches = self.again(inside, "sketch").withColumnRenamed("s", "sketch")
        slim = materialise(self.nodes.select("node", "n_shingles", "bands").join(sketches, "node"), "slim")
        pairs = (
            members.where("node <> centre")
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            .distinct()
        )
        near = spread_join(pairs, slim.select(F.col("node").alias("a"), F.struct("n_shingles", "sketch").alias("x")), ["a"])
        near = spread_join(near, slim.select(F.col("node").alias("b"), F.struct("n_shingles", "sketch").alias("y")), ["b"])
        near = materialise(near.where(self.close("x", "y")).select("a", "b"), "pairs")
        links = self.confirmed(near)

        # what the stars left apart within a bucket
        roots = connected_components(links)
        label = F.coalesce("root", "node").alias("label")
        placed = materialise(
            members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", label), "placed"
        )
        mixed = placed.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m")
        apart = placed.join(mixed.select("bucket"), "bucket", "left_semi").join(slim, "node")
        # only lengths of the same or the next class can be similar enough
        size = F.floor(F.log("n_shingles") / -F.log(F.lit(self.percent / 100)) + 1e-9)
        many = apart.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).alias("blocks"))
        apart = spread_join(apart.withColumn("size", size), many, ["bucket"])
        block = F.pmod(F.xxhash64("node", F.lit(9)), "blocks")
        apart = materialise(apart.withColumn("block", block), "apart")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        x = apart.withColumn("key", F.col("size")).withColumn("other", every).alias("x")
        y = apart.withColumn("key", F.explode(F.array("size", F.col("size") + 1))).withColumn("other", every).alias("y")
        ordered = (F.col("x.size") > F.col("y.size")) | (F.col("x.node") < F.col("y.node"))
        first = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.bucket")
        same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.other")) & (F.col("x.other") == F.col("y.block"))
        more = (
            x.hint("merge").join(y, same & (F.col("x.label") != F.col("y.label")) & ordered & self.close("x", "y") & first)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
            .join(near, ["a", "b"], "left_anti")
        )
        more = materialise(more, "pairs")
        if more.isEmpty():
            return links
        return links.union(self.confirmed(more))

    def groups(self) -> DataFrame:
        """One row per input row: doc_id, n_shingles, component_id, kept, and the digest if asked for."""
        roots = connected_components(self.links())
        member = self.classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
        least = member.groupBy("root").agg(F.min(first).alias("keep"))
        named = spread_join(member.select("set_id", "root"), least, ["root"]).select("set_id", "keep")
        rows = self.rows.select("doc_id", "n_shingles", "set_id", "row", *self.more)
        empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *self.more)
        rest = spread_join(rows.where("n_shingles > 0"), named, ["set_id"]).select(
            "doc_id", "n_shingles", F.col("keep.doc_id").alias("component_id"), (F.col("row") == F.col("keep.node")).alias("kept"), *self.more
        )
        return rest.unionByName(empty)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (whether that is the row's own id).

    Rows that repeat an id agree in ``kept``; :func:`kept_documents` keeps one row of a group.
    """
    rows = NearDedup(docs, id_col, text_col, width, percent).groups()
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that :func:`near_dedup` keeps, with all their columns.

    Rows are known by id and text digest.  Of rows that agree in both the one with the least other columns stays; texts
    without words stay however often they are repeated.
    """
    rows = NearDedup(docs, id_col, text_col, width, percent, digests=True).groups()
    keys = rows.groupBy("doc_id", "digest").agg(
        F.bool_or("kept").alias("kept"), ((F.count(F.lit(1)) == 1) | (F.max("n_shingles") == 0)).alias("alone")
    )
    keys = materialise(keys.where("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"), "alone"), "keys")
    marked = docs.select(F.struct(*docs.columns).alias("r"), F.col(id_col).cast("long").alias("m_id"), text_digest(text_col).alias("m_digest"))
    same = F.col("m_id").eqNullSafe(F.col("k_id")) & (F.col("m_digest") == F.col("k_digest"))
    out = marked.join(keys.where("alone"), same, "left_semi").select("r.*")
    twins = keys.where("NOT alone")
    if twins.isEmpty():
        return out
    one = marked.join(twins, same, "left_semi").groupBy("m_id", "m_digest").agg(F.min("r").alias("r"))
    return out.unionByName(one.select("r.*"))
