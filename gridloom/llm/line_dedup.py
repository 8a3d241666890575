"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

State (:class:`LineIndex`) is three tables.  ``references`` is exact: which line key stands in which document; ``counts`` has the
documents of each key.  ``filters`` has a cuckoo filter per shard of the key space; it holds the keys that stand in at least
``min_docs`` documents.  Adding or deleting documents updates the counts, and a key whose count crosses the threshold is
inserted into or deleted from its shard's filter, which a cuckoo filter can do and a Bloom filter cannot.

A change writes what it changes: the references of new documents, the counts of the keys they touch, the filters of the shards in
which a key crossed.  These lie over the older tables as layers; every ``LAYERS`` changes all layers are written as one.  Adding
reads the counts of the keys it touches and no references; deleting also reads the references of these keys.

Applying the index streams each shard's lines past its filter: most lines miss and move no further.  Hits are
confirmed against the exact counts, so a false positive of the filter drops nothing.

Scale: references and lines are a few dozen bytes each; a filter belongs to one shard and is never broadcast; a
shard with over a thousandth of all line places is dealt over several tasks (there are at most a thousand such
shards, so the list of them has a fixed bound).  Texts are shuffled once, by id, to meet their lists of dropped keys.

Defined cases: null or empty text is one empty line, never dropped; each row counts as a document, so rows that
repeat an id count twice and share its fate; rows whose id is null keep all lines and aren't counted; an empty table
gives an empty result; other columns are not read (``columns`` names those to carry along).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WS_CHARS, materialise, ship, spread_join

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys to a shard when an index is built; a shard that outgrows its filter gets a larger one.
SHARD_KEYS = 1 << 13
#: A filter is made anew, twice as large as its keys need, once this share of its places is taken.
FULL = 0.8
KEY_BYTES = 16
#: Changes after which the layers of an index are written as one.
LAYERS = 12
#: Line places up to which a shard is one task's work, whatever the table.
PART_PLACES = 100_000


def line_key(line: str, min_chars: int) -> bytes | None:
    """A 128-bit digest of the stripped line, A-Z in lower case; None if it is too short to count."""
    line = line.strip(WS_CHARS)
    if len(line) < min_chars:
        return None
    return blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=KEY_BYTES).digest()


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; keys that find no place go to an exact stash."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.n_buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 4) / self.SLOTS / 0.85))))
        self.table = np.zeros((self.n_buckets, self.SLOTS), np.uint16)
        self.stash: list[bytes] = []

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as rows of 16 bytes."""
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        fp = (words[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        fp[fp == 0] = 1
        first = (words[:, 1] >> np.uint64(20)).astype(np.int64) & (self.n_buckets - 1)
        return fp, first, first ^ self._hop(fp)

    def _hop(self, fp):
        return (fp * 0x5BD1E995) & (self.n_buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        found = (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)
        if self.stash:
            held = set(self.stash)
            found |= np.fromiter((k.tobytes() in held for k in keys), bool, len(keys))
        return found

    def _put(self, fp: int, bucket: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = fp
        return bool(len(free))

    def insert(self, keys: np.ndarray) -> None:
        for key, fp, a, b in zip(keys, *(x.tolist() for x in self.places(keys)), strict=True):
            if self._put(fp, a) or self._put(fp, b):
                continue
            path, at, moving = [], b, fp
            for kick in range(self.KICKS):
                slot = (moving + kick) % self.SLOTS
                path.append((at, slot))
                out = int(self.table[at, slot])
                self.table[at, slot] = moving
                moving = out
                at ^= self._hop(moving)
                if self._put(moving, at):
                    break
            else:  # undo the moves: the key itself goes to the stash
                for at, slot in reversed(path):
                    out = int(self.table[at, slot])
                    self.table[at, slot] = moving
                    moving = out
                self.stash.append(key.tobytes())

    def delete(self, keys: np.ndarray) -> None:
        """Of keys that were inserted."""
        for key, fp, a, b in zip(keys, *(x.tolist() for x in self.places(keys)), strict=True):
            if key.tobytes() in self.stash:
                self.stash.remove(key.tobytes())
                continue
            at = a if (self.table[a] == fp).any() else b
            held = np.flatnonzero(self.table[at] == fp)
            if len(held):
                self.table[at, held[0]] = 0

    def to_bytes(self) -> bytes:
        return self.n_buckets.to_bytes(8, "little") + self.table.tobytes() + b"".join(self.stash)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.n_buckets = int.from_bytes(data[:8], "little")
        end = 8 + out.n_buckets * cls.SLOTS * 2
        out.table = np.frombuffer(data[8:end], np.uint16).reshape(out.n_buckets, cls.SLOTS).copy()
        out.stash = [data[i : i + KEY_BYTES] for i in range(end, len(data), KEY_BYTES)]
        return out


def key_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEY_BYTES)


def line_places(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, key) of the distinct countable lines of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text and len(text) >= min_chars:
                    own = {k for line in text.split("\n") if (k := line_key(line, min_chars))}
                    ids += [doc] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, key binary")


class LineIndex:
    """Line references, their counts and filters; ``insert`` and ``delete`` give a new index that shares the older tables."""

    def __init__(self, references: DataFrame, n_shards: int, counts: DataFrame, filters: DataFrame, n_keys: int,
                 min_docs: int, min_chars: int, layers: int = 0):
        self.references, self.n_shards, self.counts, self.filters, self.n_keys = references, n_shards, counts, filters, n_keys
        self.min_docs, self.min_chars, self.layers = min_docs, min_chars, layers

    @staticmethod
    def shard(n_shards: int):
        # the first four bytes of a key, so that the filter's own bits are independent of its shard
        return F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % n_shards

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
              min_chars: int = MIN_CHARS, n_shards: int | None = None) -> LineIndex:
        ship(docs.sparkSession)
        refs = materialise(line_places(docs, id_col, text_col, min_chars), "lines")
        counts = materialise(cls._counted(refs), "counts")
        total, n_keys = counts.agg(F.count(F.lit(1)), F.count_if(F.col("n_docs") >= min_docs)).first()
        n_shards = n_shards or max(1, -(-total // SHARD_KEYS))
        held = counts.where(F.col("n_docs") >= min_docs).select("key", F.lit(1).alias("change"))
        filters = materialise(cls._updated(None, held, n_shards), "filters")
        return cls(refs, n_shards, counts, filters, n_keys, min_docs, min_chars)

    @staticmethod
    def _counted(refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))

    @classmethod
    def _updated(cls, filters: DataFrame | None, changes: DataFrame, n_shards: int) -> DataFrame:
        """Filters after inserting (change 1) and deleting (change -1) keys; one shard at a time in memory."""
        none = F.lit(None)
        rows = changes.select(cls.shard(n_shards).alias("shard"), "change", "key", none.cast("long").alias("n"), none.cast("binary").alias("bits"))
        if filters is not None:
            rows = rows.unionByName(filters.select("shard", none.cast("int").alias("change"), none.cast("binary").alias("key"), "n", "bits"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, keep, n = None, None, 0
            held: dict[int, list[bytes]] = {1: [], -1: []}

            def flush():
                filt = keep if keep is not None else CuckooFilter(max(2 * len(held[1]), 1024))
                for change, act in ((-1, filt.delete), (1, filt.insert)):
                    if held[change]:
                        act(np.frombuffer(b"".join(held[change]), np.uint8).reshape(-1, KEY_BYTES))
                now = n + len(held[1]) - len(held[-1])
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([now], pa.int64()), pa.array([filt.to_bytes()], pa.binary())], ["shard", "n", "bits"])

            for batch in batches:
                for s, change, key, had, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != shard:
                        if shard is not None:
                            yield flush()
                        shard, keep, n, held = s, None, 0, {1: [], -1: []}
                    if bits is not None:
                        keep, n = CuckooFilter.from_bytes(bits), had
                    else:
                        held[change].append(key)
            if shard is not None:
                yield flush()

        # the null change, a shard's old filter, sorts first
        return rows.repartition("shard").sortWithinPartitions("shard", "change", "key").mapInArrow(run, "shard long, n long, bits binary")

    def _changed(self, refs: DataFrame, now: DataFrame) -> LineIndex:
        """The index over new references, given (key, was, n_docs, last_doc) of the keys whose references changed."""
        enough = self.min_docs
        now = materialise(now, "crossed")
        change = F.when((F.col("was") < enough) & (F.col("n_docs") >= enough), 1).when((F.col("was") >= enough) & (F.col("n_docs") < enough), -1)
        crossed = now.select("key", change.alias("change")).where("change IS NOT NULL")
        counts = self.counts.join(now.select("key"), "key", "left_anti").unionByName(now.where("n_docs > 0").drop("was"))
        n_keys, n_shards = self.n_keys + (crossed.agg(F.sum("change")).first()[0] or 0), self.n_shards
        held = counts.where(F.col("n_docs") >= enough).select("key", F.lit(1).alias("change"))
        if n_keys > 4 * n_shards * SHARD_KEYS:  # so many that shards are made anew, twice as many as are needed now
            n_shards = 2 * -(-n_keys // SHARD_KEYS)
            filters = materialise(self._updated(None, held, n_shards), "filters")
        else:
            # a filter can't be copied into a larger one, but the counts have its keys
            shard = self.shard(n_shards)
            places = F.expr(f"(octet_length(bits) - 8) div 2 * {FULL}")
            touched = crossed.groupBy(shard.alias("shard")).agg(F.sum("change").alias("more"))
            old = materialise(self.filters.join(touched, "shard").withColumn("full", F.col("n") + F.col("more") > places), "touched")
            full = old.where("full").select("shard")
            others = crossed.withColumn("shard", shard).join(full, "shard", "left_anti").select("key", "change")
            changes, kept = others, old.where("NOT full").select("shard", "n", "bits")
            if not full.isEmpty():
                changes = others.unionByName(held.withColumn("shard", shard).join(full, "shard", "left_semi").select("key", "change"))
            new = materialise(self._updated(kept, changes, n_shards), "filters")
            filters = self.filters.join(new.select("shard"), "shard", "left_anti").unionByName(new)
        layers = self.layers + 1
        if layers >= LAYERS:
            refs, counts, filters, layers = materialise(refs, "lines"), materialise(counts, "counts"), materialise(filters, "filters"), 0
        return LineIndex(refs, n_shards, counts, filters, n_keys, self.min_docs, self.min_chars, layers)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index after adding documents (whose ids it doesn't hold yet)."""
        ship(docs.sparkSession)
        more = materialise(line_places(docs, id_col, text_col, self.min_chars), "lines")
        added = self._counted(more).select("key", F.col("n_docs").alias("added"), F.col("last_doc").alias("new_last"))
        old = self.counts.select("key", F.col("n_docs").alias("was"), "last_doc")
        now = spread_join(added, old, ["key"], "left").select(
            "key", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("added")).alias("n_docs"), F.greatest("last_doc", "new_last").alias("last_doc")
        )
        return self._changed(self.references.unionByName(more), now)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose ids are in the first column of ``ids``."""
        gone = materialise(ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct(), "gone")
        touched = materialise(self.references.join(gone, "doc_id", "left_semi").select("key").distinct(), "touched")
        refs = self.references.join(gone, "doc_id", "left_anti")
        left = self._counted(refs.join(touched, "key", "left_semi"))
        old = self.counts.join(touched, "key", "left_semi").select("key", F.col("n_docs").alias("was"))
        now = old.join(left, "key", "left").select("key", "was", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last_doc")
        return self._changed(refs, now)

    def suspects(self, places: DataFrame) -> DataFrame:
        """The (doc_id, key) rows whose key the filter of its shard may hold."""
        loads = self.counts.groupBy(self.shard(self.n_shards).alias("shard")).agg(F.sum("n_docs").alias("places"))
        total = loads.agg(F.sum("places")).first()[0] or 0
        part = max(PART_PLACES, total // 1000)  # so at most a thousand shards are dealt over several tasks
        heavy = [(r[0], -(-r[1] // part)) for r in loads.where(F.col("places") > part).collect()]
        spark: SparkSession = places.sparkSession
        parts = F.broadcast(spark.createDataFrame(heavy, "shard long, parts long"))

        def dealt(df: DataFrame) -> DataFrame:
            return df.join(parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))

        none = F.lit(None)
        lines = dealt(places.withColumn("shard", self.shard(self.n_shards))).select(
            "shard", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), "doc_id", "key", none.cast("binary").alias("bits")
        )
        every = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
        filters = dealt(self.filters).select(
            "shard", F.explode(every).alias("part"), none.cast("long").alias("doc_id"),
            none.cast("binary").alias("key"), "bits",
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, filt = None, None
            for batch in batches:
                shards, parts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                edge = (shards[1:] != shards[:-1]) | (parts[1:] != parts[:-1])  # each part has its own copy of the filter
                edges = [0, *(np.flatnonzero(edge) + 1).tolist(), len(shards)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    piece = batch.slice(a, b - a)
                    if not len(piece):
                        continue
                    if (shards[a], parts[a]) != at:
                        at, filt = (shards[a], parts[a]), None
                    while len(piece) and piece.column(4)[0].is_valid:  # filters sort before lines
                        filt = CuckooFilter.from_bytes(piece.column(4)[0].as_py())
                        piece = piece.slice(1)
                    if len(piece) and filt is not None:
                        hit = filt.contains(key_rows(piece.column(3)))
                        yield pa.RecordBatch.from_arrays(piece.filter(pa.array(hit)).columns[2:4], ["doc_id", "key"])

        n = spark.conf.get("spark.sql.shuffle.partitions")
        return (
            lines.unionByName(filters)
            .repartition(int(n), "shard", "part")
            .sortWithinPartitions("shard", "part", F.col("bits").isNull())
            .mapInArrow(run, "doc_id long, key binary")
        )

    def dropped(self, places: DataFrame) -> DataFrame:
        """(doc_id, keys): the line keys that each document loses."""
        known = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "last_doc")
        doomed = spread_join(self.suspects(places), known, ["key"]).where(F.col("doc_id") < F.col("last_doc"))
        return doomed.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def clean(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str, min_chars: int, with_text: bool,
          columns: list[str] | None = None) -> DataFrame:
    """Each row without its dropped lines: doc_id, n_lines, n_dropped, kept_sha256, the text if asked for, ``columns``."""
    columns = columns or []
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    # rows without an id, which lose nothing, are dealt by their text; the drops' own share of that key is always 0
    drops = drops.select(F.col("doc_id").alias("d_id"), "keys", F.when(F.col("keys").isNull(), 1).otherwise(0).alias("d_deal"))
    deal = F.when(F.col("d").isNull(), F.hash("t")).otherwise(0)
    joined = (
        docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"), *carried)
        .withColumn("deal", deal)
        .join(drops, (F.col("d") == F.col("d_id")) & (F.col("deal") == F.col("d_deal")), "left")
        .select("d", "t", "keys", *[f"c{i}" for i in range(len(columns))])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, lost, shas, texts = [], [], [], []
            for text, keys in zip(batch.column(1), batch.column(2), strict=True):
                text, keys = text.as_py() or "", keys.as_py()
                if keys:
                    gone = set(keys)
                    lines = text.split("\n")
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                    total.append(len(lines))
                    lost.append(len(lines) - len(stay))
                    text = "\n".join(stay)
                else:
                    total.append(text.count("\n") + 1)
                    lost.append(0)
                shas.append(sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_text:
                    texts.append(text)
            cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*cols, *([pa.array(texts, pa.string())] if with_text else []), *batch.columns[3:]], names=names
            )

    fields = [("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())]
    fields += [("text", T.StringType())] * with_text
    fields += [(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)]
    names = [n for n, _ in fields]
    out = joined.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
    return out.withColumnsRenamed({f"c{i}": f"carried_{c}" for i, c in enumerate(columns)})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
               min_chars: int = MIN_CHARS, with_text: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Index ``docs`` and drop its repeated lines, all but those of the largest id."""
    index = LineIndex.build(docs, id_col, text_col, min_docs, min_chars)
    return clean(docs, index.dropped(index.references), id_col, text_col, min_chars, with_text, columns)
