"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``PERCENT`` of all words; no
source is asked for more than ``MOST`` times what it has, and what it can't give is shared by the others by weight.

Each source's words are packed, document after document, into blocks of a fixed length.  A source needs as many blocks as
its target holds, and all of them fill output shards of ``SHARD_SLOTS`` slots.  Every slot of a shard draws its source by
a seeded hash, so a shard's counts per source are a multinomial draw; a source's counts are then carried, shard after
shard, to the running share of its target, which changes a count by about the draw's own relative error and makes totals
exact.  A slot of a source is mapped to a block by a pseudorandom permutation of the source's block numbers, another one
for each pass over them, and slots meet blocks in an equi-join on (source, block number).

Scale: only ids, sizes and offsets move, never texts.  Running sums are taken within groups (of documents by source and
hash, of shards by source and number) and over the groups' totals, so a hot source is many groups and no window holds
more than a few thousand rows of one; the draw's table of sources has a row per source and per 1/``CELLS`` of the weight.
Permutations are computed per row (Feistel rounds over two digits, walked until within the range), so nothing is sorted.

Defined cases: null texts have size 0 and take nothing; null is a source of its own; rows that repeat an id are mixed
each; an empty table gives an empty result; other columns are not read (``mixed_documents`` carries them along).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WS, let, materialise, text_or_empty, words_of

# The weights that sources take in turn.
WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
ROUNDS = 6
#: Walks of the permutation at most; a walk leaves the range with a chance under the square root of its length's inverse.
WALKS = 16
CELLS = 1024
GROUP = 4096
BUCKET_ROWS, LEAST_BUCKETS = 10_000, 256

_KEY = ["doc_id", "source", "size", "h", "twin"]


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """The image of ``x``, a number from 0 below ``n``, under a permutation that ``seed`` chooses.

    ``x`` is two digits, of which each round shifts one by a hash of the other: a permutation of the pairs, of which there
    are at most ``n`` and its square root.  Pairs from ``n`` on are mapped again until one lies below it, which is a
    permutation of the numbers below ``n``; for ``n`` up to 256 that takes ``WALKS`` steps at most."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def walk(acc: Column, a: Column, b: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            return let(
                F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], *seed, r), a), a),
                lambda low: F.struct(low.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(low, r, *seed), b), b).alias("r")),
            )

        first = F.struct((acc % a).alias("l"), F.expr("0L").alias("r")).withField("r", F.floor(acc / a).cast("long"))
        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), first, step, lambda s: s["l"] + s["r"] * a)

    def image(sides: Column) -> Column:
        def again(s: Column, k: Column) -> Column:
            return F.when((k > 0) & (s < n), s).otherwise(walk(s, sides["a"], sides["b"]))

        return F.aggregate(F.array(*[F.lit(k) for k in range(WALKS)]), x.cast("long"), again)

    got = let(F.struct(a.alias("a"), F.ceil(n / a).cast("long").alias("b")), image)
    return let(got, lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("a permutation didn't settle")).cast("long")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size): a table of the sources alone."""
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("rank", F.row_number().over(by_code) - 1)
    weights = F.array(*[F.lit(float(x)) for x in WEIGHTS])
    w = w.withColumn("weight", F.get(weights, F.col("rank") % len(WEIGHTS))).withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.sum("source_size").over(W.partitionBy()).cast("double") * PERCENT / 100
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    w = w.withColumn("level", (total - before) / left)
    # sources in order of how soon they are exhausted; the first that the level doesn't exhaust sets it
    level = F.first(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return w.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "rank", "source_size", "target")


class Mix:
    """A mixture of one table: ``units`` (a row per document), ``sources``, ``draws`` (a row per piece that is taken)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 block_words: int = BLOCK_WORDS, seed: int = 1):
        self.spark, self.block, self.seed = docs.sparkSession, block_words, seed
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
        read = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("t")
        )
        sized = read.select("doc_id", "source", F.size(words_of(F.col("t"))).cast("long").alias("size"), F.xxhash64("t").alias("h"))
        sized = materialise(sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", F.lit(13)), F.lit(buckets))), "sizes")
        self.sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")

        in_bucket = W.partitionBy("source", "bucket").orderBy("doc_id", "size", "h")
        run = sized.withColumn("twin", F.row_number().over(W.partitionBy("source", "bucket", "doc_id", "size", "h").orderBy("doc_id")))
        run = run.withColumn("local", F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, -1)))
        loads = sized.groupBy("source", "bucket").agg(F.sum("size").alias("load"))
        before = F.sum("load").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        loads = loads.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
        named = self.sources.select(F.col("source").alias("s2"), "rank", "source_size", "target")
        units = (
            run.join(loads, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .join(named, F.col("source").eqNullSafe(F.col("s2")))
            .withColumn("at", F.col("before") + F.coalesce("local", F.lit(0)))
        )
        self.units = materialise(units.select(*_KEY, "rank", "source_size", "target", "at"), "units")

    def wanted(self) -> DataFrame:
        """(rank, blocks, slots): how many blocks each source with words has, and how many it is to give."""
        n = F.ceil(F.col("source_size") / self.block).cast("long")
        s = self.sources.where("source_size > 0").select("rank", n.alias("blocks"), F.round(F.col("target") * n / F.col("source_size")).cast("long").alias("slots"))
        return s.where("slots > 0")

    def counts(self) -> DataFrame:
        """(rank, shard, n): a multinomial draw of sources for the slots of every shard."""
        w = self.wanted()
        total = w.agg(F.sum("slots")).first()[0] or 0
        upto = F.sum("slots").over(W.orderBy("rank"))  # a row per source
        w = w.withColumn("high", upto / F.lit(float(max(total, 1)))).withColumn("low", F.col("high") - F.col("slots") / F.lit(float(max(total, 1))))
        w = w.withColumn("high", F.when(F.col("rank") == F.max("rank").over(W.partitionBy()), F.lit(1.0)).otherwise(F.col("high")))
        w = w.withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("rank")), F.lit(0.0)))
        cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))
        where = w.select("rank", "low", "high", F.explode(cells).alias("cell"))
        # a slot's number in the whole output is shard * SHARD_SLOTS + its place
        slots = self.spark.range(0, total, 1, max(self.partitions, -(-total // (1 << 20))))
        u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(self.seed + 1)), 12).cast("double") + 0.5) / float(1 << 52)
        drawn = slots.select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
        hit = drawn.join(where, "cell").where((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high")))
        return hit.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))

    def slots(self) -> DataFrame:
        """(rank, block, pass, shard): which block of which source fills each slot."""
        c = materialise(self.counts().withColumn("g", F.expr(f"shard div {GROUP}")), "counts")
        groups = c.groupBy("rank", "g").agg(F.sum("n").alias("in_group"))
        by_rank = W.partitionBy("rank").orderBy("g")
        groups = groups.withColumn("upto_group", F.sum("in_group").over(by_rank.rowsBetween(W.unboundedPreceding, W.currentRow)))
        groups = groups.select("rank", "g", (F.col("upto_group") - F.col("in_group")).alias("before_group"))
        upto = F.sum("n").over(W.partitionBy("rank", "g").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
        totals = c.groupBy("rank").agg(F.sum("n").alias("drawn"))
        s = c.withColumn("upto", upto).join(groups, ["rank", "g"]).join(totals, "rank").join(self.wanted(), "rank")
        # the running share of the target: whole slots, all of them in the end
        share = lambda k: F.round(k * F.col("slots") / F.col("drawn")).cast("long")
        s = s.withColumn("first", share(F.col("before_group") + F.col("upto") - F.col("n"))).withColumn("end", share(F.col("before_group") + F.col("upto")))
        s = s.select("rank", "blocks", "shard", "first", "end")
        # a source so small that no slot drew it fills slots of the first shard
        undrawn = self.wanted().join(totals, "rank", "left_anti").select("rank", "blocks", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("slots").alias("end"))
        s = s.unionByName(undrawn).where("end > first").repartition(self.partitions, "rank", "shard")
        s = s.withColumn("q", F.explode(F.sequence(F.col("first"), F.col("end") - 1)))
        s = s.withColumn("pass", F.expr("q div blocks")).withColumn("block", F.expr("q % blocks"))
        block = permuted(F.col("block"), F.col("blocks"), F.lit(self.seed), F.col("rank"), F.col("pass"))
        return s.select("rank", block.alias("block"), "pass", "shard")

    def pieces(self) -> DataFrame:
        """(rank, block, the document's key, start, length): what part of which document stands in each block."""
        b = self.block
        last = F.expr(f"(at + size - 1) div {b}")
        p = self.units.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {b}"), last)))
        start = F.greatest(F.lit(0).cast("long"), F.col("block") * b - F.col("at"))
        end = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("at"))
        return p.select("rank", "block", *_KEY, start.alias("start"), (end - start).alias("length"))

    def draws(self) -> DataFrame:
        """A row per piece of a document in a slot: pass, shard, the document's key, start, length (in words)."""
        # both sides come of small tables by explode, which the planner's size estimates don't see: never broadcast
        return self.slots().hint("merge").join(self.pieces(), ["rank", "block"]).drop("rank", "block")

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken."""
        got = self.draws().groupBy(*_KEY).agg(F.sum("length").alias("taken"))
        got = got.select(*[F.col(k).alias(f"g_{k}") for k in _KEY], "taken")
        same = F.lit(True)
        for k in _KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
        return self.units.join(got.hint("merge"), same, "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    block_words: int = 512, seed: int = 1) -> DataFrame:
    """The mixture as documents: for each pass over a source, a row of each document of which the pass draws
    blocks, with the words drawn (the whole text where all are).  Columns are those of ``docs``."""
    mix = Mix(docs, id_col, text_col, source_col, block_words, seed)
    parts = mix.draws().groupBy(*_KEY, "pass").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"))
    parts = parts.select(*[F.col(k).alias(f"g_{k}") for k in _KEY], "parts")
    key = [k for k in _KEY if k != "twin"]
    marked = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("t"),
    )
    marked = marked.withColumn("h", F.xxhash64("t")).withColumn("size", F.size(words_of(F.col("t"))).cast("long"))

    def same(names: list[str], prefix: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{prefix}_{k}")) for k in names])

    # only rows that repeat all of the key need numbers to tell them apart, and a sort of their texts
    twins = materialise(mix.units.where("twin > 1").select(*[F.col(k).alias(f"t_{k}") for k in key]).distinct(), "twins")
    if twins.isEmpty():
        out = marked.join(parts.drop("g_twin").hint("merge"), same(key, "g"))
    else:
        numbered = marked.join(twins, same(key, "t"), "left_semi").withColumn("twin", F.row_number().over(W.partitionBy(*key).orderBy("doc_id")))
        alone = marked.join(twins, same(key, "t"), "left_anti").withColumn("twin", F.lit(1))
        out = alone.unionByName(numbered).join(parts.hint("merge"), same(_KEY, "g"))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]) == F.col("size")
    words = F.regexp_extract_all("t", F.lit(f"([^{WS}]+[{WS}]*)"), F.lit(1))
    drawn = let(
        words,
        lambda w: F.array_join(
            F.transform("parts", lambda x: F.array_join(F.slice(w, (x["start"] + 1).cast("int"), x["length"].cast("int")), "")), ""
        ),
    )
    out = out.withColumn("mixed", F.when(whole, F.col("t")).otherwise(drawn))
    columns = []
    for i, c in enumerate(docs.columns):
        if c == text_col:
            columns.append(F.col("mixed").alias(c))
        elif c == "n_chars":
            columns.append(F.length("mixed").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"c{i}").alias(c))
    return out.select(*columns)
