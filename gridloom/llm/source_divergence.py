"""How far apart the vocabularies of sources are: counts of terms by language and source, and exact divergences between them.

1. Byte-level tokeniser: a table of 256 entries says which bytes belong to a term, so term boundaries come from one lookup over
   the concatenated UTF-8 bytes of many texts.  xxHash groups the slices; every slice is compared byte by byte with the first one
   of its hash, and slices that differ become groups of their own.
2. A task adds up (language, source, term) over its texts, so that a common term leaves it once; counts are then added up by term.
3. Terms in at least ``MIN_DOCS`` documents of a language are kept.  Terms are dealt to shards; in a shard the counts are a
   sparse matrix by rows (a row for each source, a column for each term), and divergences are sums of its segments (reduceat).
   For a pair of sources only terms that one of them has are looked at; all others add the same constant.
4. Sums of shards give pairs; a shard's ten best terms of each source meet in a ranking.

With N the occurrences of kept terms in a group and V their number, p = 1 + floor(10**9 (count + 2) / (N + 2 V)), and a term adds
floor((p - q)**2 / (p + q)).  All arithmetic is in whole numbers.

Defined cases: null text, language and source count as ''; a group without terms has all counts 0; where no term is kept
pairs have the value 0; rows that repeat an id are documents each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import LOWER, segment_sum, spans, text_slices
from .shared import materialise, ship

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Entries that a task gathers before it passes them on.
HELD = 3_000_000
#: Non-zero counts in a shard, on average.
SHARD_COUNTS = 100_000
#: Entries of the dense columns that a shard holds at once.
DENSE = 1 << 21

IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def group_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The group of every slice, and each group's bytes: grouped by ``digest``, verified byte by byte."""
    raw = buf.tobytes()
    if not len(starts):
        return np.zeros(0, np.int64), []
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    names = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    lengths = ends - starts
    same = lengths == lengths[first][group]
    # the bytes of all slices of the right length, beside those of their group's first
    some = np.flatnonzero(same)
    bounds = np.concatenate([[0], np.cumsum(lengths[some])])
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths[some])
    differ = buf[np.repeat(starts[some], lengths[some]) + within] != buf[np.repeat(starts[first][group[some]], lengths[some]) + within]
    same[some] = segment_sum(differ.astype(np.int64), bounds) == 0
    apart: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        name = raw[starts[i] : ends[i]]
        if name not in apart:
            apart[name] = len(names)
            names.append(name)
        group[i] = apart[name]
    return group, names


class _Held:
    """Counts by group and term that a task has gathered: arrays, added up by key from time to time."""

    def __init__(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, kind: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append(np.stack([(kind << 40) | term, n, docs]))
        self.size += len(n)

    def combine(self) -> None:
        every = np.concatenate(self.parts, axis=1)
        every = every[:, np.argsort(every[0], kind="stable")]
        first = np.flatnonzero(np.diff(every[0], prepend=-1))
        self.parts = [np.concatenate([every[:1, first], np.add.reduceat(every[1:], first, axis=1)])]
        self.size = len(first)

    def out(self) -> Iterator[pa.RecordBatch]:
        """All of it: a row for each group and term, and one with a null term for each group."""
        kinds = [pa.array([k[i] for k in self.kinds], pa.string()) for i in (0, 1)]
        zero = pa.array(np.zeros(len(self.kinds), np.int64))
        yield pa.RecordBatch.from_arrays([*kinds, pa.nulls(len(self.kinds), pa.string()), zero, zero], names=["lang", "source", "term", "n", "docs"])
        if self.parts:
            self.combine()
            terms = pa.array([t.decode() for t in self.terms], pa.string())
            key, n, docs = self.parts[0]
            kind, term = pa.array(key >> 40), pa.array(key & ((1 << 40) - 1))
            rows = pa.RecordBatch.from_arrays([*[k.take(kind) for k in kinds], terms.take(term), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])
            for k in range(0, rows.num_rows, 1 << 16):
                yield rows.slice(k, 1 << 16)
        self.__init__()


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From batches of text, lang, source: occurrences and documents of every term by group; a null term marks a group."""
    held = _Held()
    for batch in batches:
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for first, end, buf, offsets in text_slices(batch.column(0)):
            of_row = np.array([held.kinds.setdefault(k, len(held.kinds)) for k in zip(langs[first:end], sources[first:end], strict=True)], np.int64)
            buf = LOWER[buf]
            starts, ends, row = spans(IN_TERM[buf], offsets)
            group, names = group_slices(buf, starts, ends)
            if not names:
                continue
            m = len(names)
            by_doc, times = np.unique(row * m + group, return_counts=True)
            term = np.array([held.terms.setdefault(name, len(held.terms)) for name in names], np.int64)
            held.add(of_row[by_doc // m], term[by_doc % m], times, np.ones(len(times), np.int64))
            if held.size > HELD:
                held.combine()
                if held.size > HELD // 2:
                    yield from held.out()
    if held.kinds:
        yield from held.out()


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / total) by long division, exact while ``total`` is below 2**63 / 1000."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shard_sums(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, width: int, total: np.ndarray) -> np.ndarray:
    """Divergences of all pairs of sources, summed over ``width`` terms.

    ``rows`` (sources), ``cols`` (terms) and ``counts`` are the non-zero entries, ordered by row; ``total`` is N + 2 V by source.
    """
    k = len(total)
    none = share(np.zeros(k, np.int64), total)
    bounds = np.searchsorted(rows, np.arange(k + 1))
    p = share(counts, total[rows])
    out = np.zeros((k, k), np.int64)
    have = np.diff(bounds)
    for t in range(k):
        column = np.full(width, none[t])
        own = slice(bounds[t], bounds[t + 1])
        column[cols[own]] = p[own]
        held = np.zeros(width, bool)
        held[cols[own]] = True
        both = held[cols]
        f = divergence(p, column[cols])
        # a term of both counts once in each direction, so in [s, t] it counts where s is not above t
        f[both & (rows > t)] = 0
        shared = segment_sum(both.astype(np.int64), bounds)
        out[:, t] += segment_sum(f, bounds)
        # [s, t] and [t, s] are added up below: the terms of neither go with s < t
        rest = (width - (have + have[t] - shared)) * divergence(none, none[t])
        out[:t, t] += rest[:t]
    return out + out.T


def _shard(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """One shard of a language's kept terms: partial sums of pairs, and the best terms of each source."""
    order = np.argsort(np.array([s.encode() for s in groups.column("source").to_pylist()], dtype=object), kind="stable")
    names = [groups.column("source")[int(i)].as_py() for i in order]
    total = groups.column("total").to_numpy()[order]
    number = {s: i for i, s in enumerate(names)}
    items = sorted(set(terms.column("term").to_pylist()), key=str.encode)
    place = {t: i for i, t in enumerate(items)}
    rows = np.array([number[s] for s in terms.column("source").to_pylist()], np.int64)
    cols = np.array([place[t] for t in terms.column("term").to_pylist()], np.int64)
    n, q = terms.column("n").to_numpy(), terms.column("q").to_numpy()
    order = np.lexsort((cols, rows))
    rows, cols, n, q = rows[order], cols[order], n[order], q[order]

    k = len(names)
    sums = np.zeros((k, k), np.int64)
    step = max(1, DENSE // k)
    for at in range(0, len(items), step):
        some = (cols >= at) & (cols < at + step)
        sums += shard_sums(rows[some], cols[some] - at, n[some], min(step, len(items) - at), total)
    a, b = np.nonzero(~np.eye(k, dtype=bool))
    out = [(key[0].as_py(), names[i], "pair", names[j], int(sums[i, j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]

    p = share(n, total[rows])
    f = divergence(p, q)
    high = np.flatnonzero(p > q)
    high = high[np.lexsort((cols[high], -f[high], rows[high]))]
    rank = np.arange(len(high)) - np.searchsorted(rows[high], rows[high])
    for i in high[rank < TOP_TERMS].tolist():
        out.append((key[0].as_py(), names[rows[i]], "term", items[cols[i]], int(f[i])))
    kinds = [pa.string()] * 4 + [pa.int64()]
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from the others of its language (``pair``), and
    the ten terms that set it most apart from its language (``term``)."""
    ship(docs.sparkSession)
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")])
    found = read.mapInArrow(term_counts, _COUNTS)
    # dealt by language and term: what follows by term needs no further exchange
    dealt = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialise(dealt, "terms")
    groups = counts.where("term IS NULL").select("lang", "source")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n")).where(F.col("d") >= min_docs)
    kept = materialise(counts.join(kept.drop("d"), ["lang", "term"]).drop("docs"), "kept")

    # a row for each language, and one for each group
    vocabulary = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = materialise(
        groups.select(
            "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"),
            (F.coalesce("lang_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_total"),
        ),
        "groups",
    )
    langs = groups.groupBy("lang").agg(F.first("lang_total").alias("lang_total"))
    terms = kept.join(langs, "lang")
    terms = terms.withColumn("q", F.expr(f"1 + (cast({SCALE} AS decimal(38,0)) * cast(all_n + 2 AS decimal(28,0))) div lang_total"))
    n = kept.count()
    shards = max(1, -(-n // SHARD_COUNTS))
    dealt = terms.select("lang", "source", "term", "n", "q", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"))
    used = dealt.select(F.col("lang").alias("of"), F.col("shard").alias("at")).distinct()
    sides = groups.where("v > 0").join(used, F.col("lang") == F.col("of")).select("of", "at", "source", "total")
    pieces = dealt.groupBy("lang", "shard").cogroup(sides.groupBy("of", "at")).applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    pieces = materialise(pieces, "pieces")

    bare = groups.where("v = 0").select("lang", "source")
    other = bare.select("lang", F.col("source").alias("item"))
    zero = bare.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = pieces.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(zero)
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    best = pieces.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", rank).unionByName(best)
