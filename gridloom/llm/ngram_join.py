"""Jaccard join of documents on word n-grams by PartEnum signatures: exact, without a sample of the sets.

1. Sizes are cut into bands so that two sets similar enough have sizes of the same or of neighbouring bands.  An instance
   takes two neighbouring bands, and in it such sets differ in at most k features, a number known from the sizes.
2. An instance cuts the feature domain into n1 parts of n2 pieces each.  k differences leave some part with at most k2 of them,
   hence n2 - k2 of its pieces equal: every subset of n2 - k2 pieces of every part is a signature, and similar sets share one.
   Subsets without any feature are left out where a set has enough parts that have none of them (most sets; the others
   give all), so texts don't meet for what they both lack.
3. One scan gives each document's set (its size, a digest and a parity bitmap) and the signatures of each set that is new to the
   task.  Signatures are dealt by value as packed arrays.  A task sends a signature once, whatever number of its documents
   has it, so the documents of a frequent signature never meet in one task.
4. Who shares a signature votes for the first that has it, and each document takes the pair with most votes: one pair each, a
   forest.  Parity bitmaps, in which each feature toggles one bit, differ in no more bits than the sets in features: they
   reject pairs without losing one.  What passes is confirmed on full sets, and components are formed.
5. Of each signature the documents that are still in different components are compared, all with all, by bitmaps, in blocks
   of ``BLOCK_MEMBERS`` that are keys of their own.  Of the pairs that pass, those that could join components, closest first,
   make a spanning forest; these are confirmed on full sets and components are formed again.  Then all pairs that pass and still
   lie between two components are confirmed.  So no link is lost that would change a component, and a group in which all
   resemble each other costs one pair a document.

Sets hold 64-bit hashes of shingles; equal sets are one class, so copies make no pairs.

Defined cases: null text and texts without words have an empty set, are linked with nothing and are components of their own; a
text of fewer words than a shingle has its whole sequence as one; rows that repeat an id are separate rows with one set each; a
null id sorts after all others, so a component has it only if none of its documents has an id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, fmix, segment_sum, shingle_sets, text_slices
from .near_dedup import BLOOM_MOST, bloom, bloom_places
from .shared import drop_table, materialise, ship, spread_join

WIDTH = 5
PERCENT = 80
#: From so many differences on, parts have three pieces and signatures are pairs of them.
TWO_LEVELS = 8
#: Bytes of text whose signatures one task sorts, on average.
TASK_BYTES = 4 << 20
#: Signatures that a scan holds before it sends them.
HELD = 1 << 20
BLOCK_MEMBERS = 2000
#: Signatures that vote: those of which this many bits are 0 (votes only choose who is compared first).
VOTING = 7
#: 64-bit words of bitmaps that a comparison holds at once.
COMPARED = 1 << 21
_FLAG = np.uint32(1 << 31)
_LOCAL = (1 << 33) - 1  # the bits of a row's number within its partition
_FORM = "kind int, row long, doc_id long, n long, set_id binary, bits binary, x binary, y binary"
_SET, _SIGNATURES, _PAIRS, _SHARED = range(4)


class Instance(NamedTuple):
    """Two neighbouring size bands up to the size ``high``: up to ``k`` differing features, ``parts`` parts of ``pieces`` pieces."""

    k: int
    parts: int
    pieces: int
    high: int


def most_beyond(n, high, percent: int):
    """In how many features a set of size ``n`` may differ from one of up to ``high`` that is similar enough."""
    return (100 - percent) * (n + np.minimum(high, n * 100 // percent)) // (100 + percent)


def _instance(sizes: list[int], high: int, percent: int) -> Instance:
    """Enough parts that sets of the given sizes rarely lack one without an empty subset (three standard errors)."""
    k = int(most_beyond(high, high, percent))
    pieces = 3 if k >= TWO_LEVELS else 1
    n = np.array(sizes)
    few = most_beyond(n, high, percent) // (2 if pieces == 3 else 1)
    least = parts = int(few.max()) + 1
    while parts < 4 * least:
        gone = np.exp(-n / (parts * pieces))
        weak = 3 * gone**2 - 2 * gone**3 if pieces == 3 else gone
        if (parts * (1 - weak) - 3 * np.sqrt(parts * weak) >= few + 1).all():
            break
        parts += max(1, parts // 64)
    return Instance(k, parts, pieces, high)


def size_bands(percent: int, most: int = 1 << 31) -> tuple[np.ndarray, list[Instance]]:
    """The least size of each band, and the instance of each band with the one below it."""
    low = [1]
    while low[-1] <= most:
        low.append(low[-1] * 100 // percent + 1)
    high = [n * 100 // percent for n in low]
    return np.array(low), [_instance([low[max(i - 1, 0)], high[max(i - 1, 0)], low[i], high[i]], high[i], percent) for i in range(len(low))]


def part_enum(values: np.ndarray, bounds: np.ndarray, percent: int, plan: tuple[np.ndarray, list[Instance]]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sets they are of) of sets given one after the other, each sorted."""
    low, instances = plan
    n = np.diff(bounds)
    band = np.searchsorted(low, n, side="right") - 1
    form = np.array(instances)
    found, owners = [], []
    for up in (0, 1):
        for pieces in (1, 3):
            inst = np.minimum(band + up, len(instances) - 1)
            some = np.flatnonzero((n > 0) & (form[inst, 2] == pieces) & (form[inst, 0] > 0))  # without differences sets are equal
            if not len(some):
                continue
            got, of = _signatures(values, bounds, some, inst[some], form[inst[some]], pieces, percent)
            found.append(got)
            owners.append(of)
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _signatures(values: np.ndarray, bounds: np.ndarray, some: np.ndarray, inst: np.ndarray, form: np.ndarray, pieces: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)[some]
    first = np.concatenate([[0], np.cumsum(n)])
    v = values[np.repeat(bounds[some] - first[:-1], n) + np.arange(first[-1])]
    parts = form[:, 1]
    cells = np.concatenate([[0], np.cumsum(parts * pieces)])
    # sets are sorted, so a piece is a stretch of its set
    with np.errstate(over="ignore"):
        piece = ((v >> U64(32)) * np.repeat((parts * pieces).astype(U64), n)) >> U64(32)
        at = np.repeat(cells[:-1], n) + piece.astype(np.int64)
        count = np.bincount(at, minlength=cells[-1])
        end = np.cumsum(count)
        upto = np.concatenate([np.zeros(1, U64), np.cumsum(fmix(v), dtype=U64)])
        content = fmix(upto[end] - upto[end - count] + U64(0x632BE59BD9B4E019))
        of_part = np.repeat(np.arange(len(some)), parts)
        number = np.arange(len(of_part)) - np.repeat(cells[:-1] // pieces, parts)
        tag = fmix((inst[of_part].astype(U64) << U64(40)) + number.astype(U64))
        content, count = content.reshape(-1, pieces), count.reshape(-1, pieces)
        if pieces == 1:
            sig, full = fmix(content[:, 0] ^ tag)[:, None], count > 0
        else:
            choice = ((0, 1), (0, 2), (1, 2))
            sig = np.stack([fmix(fmix(content[:, a] ^ (tag + U64(c))) + content[:, b] * U64(0x9E3779B97F4A7C15)) for c, (a, b) in enumerate(choice)], axis=1)
            full = np.stack([count[:, a] + count[:, b] > 0 for a, b in choice], axis=1)
    weak = segment_sum((~full).any(axis=1).astype(np.int64), cells // pieces)
    few = most_beyond(n, form[:, 3], percent) // (2 if pieces == 3 else 1)
    every = parts - weak <= few  # too few parts without an empty subset: give all
    given = full | every[of_part][:, None]
    return sig[given], np.broadcast_to(some[of_part][:, None], given.shape)[given]


def parity_bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of two to four bits a feature (a power of two, 64 at least): each feature toggles one bit."""
    out = []
    places = fmix(values ^ U64(0x5851F42D4C957F2D))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = max(64, 1 << int(2 * (b - a) - 1).bit_length()) if b > a else 64
        odd = np.bincount((places[a:b] & U64(size - 1)).astype(np.int64), minlength=size) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they are at a smaller size: places modulo that size."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def most_differing(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """In how many features sets of these sizes may differ; -1 where the sizes alone are too far apart."""
    most = (100 - percent) * (na + nb) // (100 + percent)
    return np.where(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb), most, -1)


def _binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    names = ["bucket", *[c.split()[0] for c in _FORM.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _votes(sig: np.ndarray) -> np.ndarray:
    return (sig & U64(VOTING)) == 0


def _packed(centre: np.ndarray, member: np.ndarray, sig: np.ndarray, listed: np.ndarray) -> Iterator[tuple]:
    """Of members and the centres of their voting signatures: each member's pair with most votes; and who is ``listed`` under
    the shared signatures."""
    pairs, votes = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    if len(member):
        pairs, votes = np.unique(np.stack([member, centre], axis=1), axis=0, return_counts=True)
    order = np.lexsort((pairs[:, 1], -votes, pairs[:, 0]))
    best = order[np.append(True, np.diff(pairs[order, 0]) > 0)] if len(order) else order
    for kind, columns in ((_PAIRS, (pairs[best, 1], pairs[best, 0], votes[best])), (_SHARED, (sig.view(np.int64), listed, None))):
        for k in range(0, len(columns[0]), 1 << 15):
            x, y, n = (None if c is None else _binary(c[k : k + (1 << 15)]) for c in columns)
            yield kind, None, None, None, None, n, x, y


def scan(batches: Iterator[pa.RecordBatch], width: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """From row, doc_id, text: every row's set, and the signatures of the sets that this task sees for the first time."""
    plan = size_bands(percent)
    seen: set[bytes] = set()
    sigs: list[np.ndarray] = []
    rows: list[np.ndarray] = []

    def send() -> Iterator[pa.RecordBatch]:
        sig, row = np.concatenate(sigs), np.concatenate(rows)
        sigs.clear()
        rows.clear()
        order = np.argsort(sig, kind="stable")
        sig, row = sig[order], row[order]
        lead = np.ones(len(sig), bool)
        lead[1:] = sig[1:] != sig[:-1]
        start = np.flatnonzero(lead)
        run = np.cumsum(lead) - 1
        twice = np.diff(np.append(start, len(sig))) > 1
        base = int(row[0]) & ~_LOCAL
        local = (row & _LOCAL).astype(np.uint32)
        more = np.flatnonzero(~lead)
        salt = int(row[0])
        voting = more[_votes(sig[more])]
        for k, packed in enumerate(_packed(row[start][run[voting]], row[voting], sig[more], row[more])):
            yield _batch([(int(fmix(np.array([salt + k], U64))[0] % U64(buckets)), *packed)])
        s, who = sig[start], local[start] | np.where(twice, _FLAG, np.uint32(0))
        bucket = (((s >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1)) if buckets < len(s) else np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(s))
        out = [(int(bucket[a]), _SIGNATURES, base, None, None, None, None, _binary(s[a:b]), _binary(who[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a]
        for k in range(0, len(out), 256):
            yield _batch(out[k : k + 256])

    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for first, end, buf, offsets in text_slices(batch.column(2)):
            values, bounds = shingle_sets(buf, offsets, width)
            raw, at = values.tobytes(), bounds.tolist()
            ids = [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            own = numbers[first:end]
            spread = (fmix(own.astype(U64)) % U64(buckets)).astype(np.int64)
            count = end - first
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(np.zeros(count, np.int32)), pa.array(own), batch.column(1).slice(first, count), pa.array(np.diff(bounds).astype(np.int64)), pa.array(ids, pa.binary()),
                 pa.array(parity_bitmaps(values, bounds), pa.binary()), pa.nulls(count, pa.binary()), pa.nulls(count, pa.binary())],
                names=["bucket", *[c.split()[0] for c in _FORM.split(", ")]],
            )
            fresh = []
            for i, name in enumerate(ids):
                if at[i + 1] > at[i] and name not in seen:
                    seen.add(name)
                    fresh.append(i)
            if not fresh:
                continue
            fresh = np.array(fresh)
            n = np.diff(bounds)[fresh]
            some = np.concatenate([[0], np.cumsum(n)])
            sig, of = part_enum(values[np.repeat(bounds[fresh] - some[:-1], n) + np.arange(some[-1])], some, percent, plan)
            sigs.append(sig)
            rows.append(own[fresh][of])
            if sum(map(len, sigs)) > HELD:
                yield from send()
    if sum(map(len, sigs)):
        yield from send()


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signatures of some buckets meet: votes of those who share one, and who shares it."""
    names = [c.split()[0] for c in _FORM.split(", ")]
    sigs, rows, flags = [], [], []
    for batch in batches:
        kind = batch.column(1).to_numpy()
        rest = batch.filter(pa.array(kind != _SIGNATURES))
        if rest.num_rows:
            yield pa.RecordBatch.from_arrays(rest.columns[1:], names=names)
        for i in np.flatnonzero(kind == _SIGNATURES).tolist():
            who = np.frombuffer(batch.column(8)[i].as_py(), np.uint32)
            sigs.append(np.frombuffer(batch.column(7)[i].as_py(), U64))
            rows.append((who & ~_FLAG).astype(np.int64) + batch.column(2)[i].as_py())
            flags.append((who & _FLAG) > 0)
    if not sigs:
        return
    sig, row, flag = np.concatenate(sigs), np.concatenate(rows), np.concatenate(flags)
    order = np.argsort(sig, kind="stable")
    sig, row, flag = sig[order], row[order], flag[order]
    lead = np.ones(len(sig), bool)
    lead[1:] = sig[1:] != sig[:-1]
    start, run = np.flatnonzero(lead), np.cumsum(lead) - 1
    size = np.diff(np.append(start, len(sig)))
    local = np.maximum.reduceat(flag, start)
    least = np.minimum.reduceat(row, start)
    linked = np.flatnonzero((size[run] > 1) & (row != least[run]) & _votes(sig))
    listed = np.flatnonzero(((size > 1) | local)[run])
    for packed in _packed(least[run[linked]], row[linked], sig[listed], row[listed]):
        yield pa.RecordBatch.from_arrays(_batch([(0, *packed)]).columns[1:], names=names)


def _longs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)) for v in row], names=names)


def close_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs a, b, na, nb, bits_a, bits_b those that sizes and bitmaps allow: a, b, and in how many bits they differ."""
    for batch in batches:
        a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
        bits = [batch.column(i) for i in (4, 5)]
        most = most_differing(na, nb, percent)
        sizes = np.stack([np.array([len(x.as_py()) // 8 for x in c], np.int64) for c in bits], axis=1)
        differ = np.zeros(len(a), np.int64)
        for wa, wb in np.unique(sizes, axis=0).tolist():
            some = np.flatnonzero((sizes == (wa, wb)).all(axis=1))
            x, y = (np.frombuffer(b"".join(c.take(pa.array(some)).to_pylist()), U64).reshape(-1, w) for c, w in zip(bits, (wa, wb), strict=True))
            words = min(wa, wb)
            differ[some] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(axis=1)
        ok = differ <= most
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(differ[ok])], names=["a", "b", "differ"])


def _compare(node: np.ndarray, label: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs of different labels that the bitmaps allow, and in how many bits these differ."""
    step = max(1, COMPARED // max(1, len(right) * bits.shape[1]))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        differ = np.bitwise_count(bits[some][:, None, :] ^ bits[right][None, :, :]).sum(axis=2)
        ok = (differ <= most_differing(n[some][:, None], n[right][None, :], percent)) & (label[some][:, None] != label[right][None, :])
        i, j = np.nonzero(ok)
        yield some[i], right[j], differ[i, j].astype(np.int64)


def _joined(x: int, y: int, root: np.ndarray) -> bool:
    """Whether two labels were apart, which they are no longer."""
    ends = []
    for at in (x, y):
        while root[at] != at:
            root[at] = root[root[at]]
            at = root[at]
        ends.append(at)
    root[max(ends)] = min(ends)
    return ends[0] != ends[1]


#: Pairs of one key that are held before the closest of them are kept.
HELD_PAIRS = 1 << 20


def _spanning(pairs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y, differ), closest first, make a forest of the labels."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 2]))]
    both = np.sort(labels[pairs[:, :2]], axis=1)
    _, first = np.unique(both[:, 0] * (labels.max() + 1) + both[:, 1], return_index=True)  # of two labels the closest pair alone
    first.sort()
    root = np.arange(int(labels.max()) + 1)
    taken = [k for k in first.tolist() if _joined(int(labels[pairs[k, 0]]), int(labels[pairs[k, 1]]), root)]
    return pairs[taken]


def compare_blocks(batches: Iterator[pa.RecordBatch], percent: int, every_pair: bool) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of a signature (sig, low, high, block, node, label, n, bits), ordered by these: the pairs that bitmaps
    allow, all or a spanning forest of the labels.

    Pairs of one label aren't compared, so who belongs to the most frequent one meets only the others.
    """

    def of_key(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        low, block, node, label, n = (rows.column(c).to_numpy() for c in ("low", "block", "node", "label", "n"))
        high = rows.column("high")[0].as_py()
        raw = rows.column("bits").to_pylist()
        words = min(map(len, raw)) // 8
        bits = np.concatenate([folded(np.frombuffer(x, U64)[None, :], words) for x in raw])
        names, number, times = np.unique(label, return_inverse=True, return_counts=True)
        large, every = number == times.argmax(), np.arange(len(node))
        sides = [(every, every)] if high == low[0] else [(every[block == low[0]], every[block == high])]
        tasks = [(x[~large[x]], y) for x, y in sides] + [(x[large[x]], y[~large[y]]) for x, y in sides if high != low[0]]
        held, size = [np.zeros((0, 3), np.int64)], 0
        for x, y in tasks:
            for i, j, differ in _compare(node, label, n, bits, x, y, percent):
                if high == low[0]:  # both directions are seen, but for pairs with the most frequent label
                    once = (node[i] < node[j]) | large[j]
                    i, j, differ = i[once], j[once], differ[once]
                held.append(np.stack([i, j, differ], axis=1))
                size += len(i)
                if size > HELD_PAIRS:
                    if every_pair:
                        yield from batch_of(node, np.concatenate(held))
                        held, size = [], 0
                    else:
                        held = [_spanning(np.concatenate(held), number)]
                        size = len(held[0])
        pairs = np.concatenate([np.zeros((0, 3), np.int64), *held])
        yield from batch_of(node, pairs if every_pair else _spanning(pairs, number))

    def batch_of(node: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(pairs):
            a, b = node[pairs[:, 0]], node[pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = np.stack([rest.column(c).to_numpy() for c in ("sig", "low", "high")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        at = 0
        for end in cuts.tolist():
            yield from of_key(rest.slice(at, end - at))
            at = end
        rest = rest.slice(at)
    if rest is not None and rest.num_rows:
        yield from of_key(rest)


class NgramJoin:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT):
        if not 50 <= percent <= 100:
            raise ValueError("the similarity is a percentage from 50 to 100")
        ship(docs.sparkSession)
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        size = self.read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        tasks = max(1, -(-size // TASK_BYTES))
        buckets = 4 * tasks
        numbered = self.read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        sent = numbered.mapInArrow(lambda it: scan(it, width, percent, buckets), f"bucket long, {_FORM}")
        self.found = materialise(sent.repartition(tasks, "bucket").mapInArrow(gather, _FORM), "found")
        rows = self.found.where(f"kind = {_SET}")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        classes = rows.where("n > 0").groupBy("set_id").agg(F.min(first).alias("f")).select("set_id", F.col("f.row").alias("node"))
        #: every row with words, and the row that stands for its class
        self.rows = materialise(spread_join(rows.where("n > 0").select("row", "doc_id", "n", "set_id", "bits"), classes, ["set_id"]), "rows")
        self.empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        self.nodes = self.rows.where("row = node").select("node", "doc_id", "set_id", "n", "bits")

    def _exploded(self, kind: int, **columns: str) -> DataFrame:
        """Packed columns of the given names as rows, under new names."""
        names = list(columns)
        some = self.found.where(f"kind = {kind}").select(*columns.values())
        return some.mapInArrow(lambda it: _longs(it, names), ", ".join(f"{n} long" for n in names))

    def stars(self) -> DataFrame:
        """(a, b, differ): each class with the one that most of its signatures vote for, as far as bitmaps allow."""
        number = self.rows.select("row", "node")
        votes = self._exploded(_PAIRS, x="x", y="y", n="bits").groupBy("y", "x").agg(F.sum("n").alias("n"))
        pairs = votes.groupBy("y").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("x"))
        for old, new in (("x", "a"), ("y", "b")):
            pairs = spread_join(pairs, number.select(F.col("row").alias(old), F.col("node").alias(new)), [old]).drop(old)
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for c in ("a", "b"):
            side = self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
            pairs = spread_join(pairs, side, [c])
        percent = self.percent
        pairs = pairs.select("a", "b", "na", "nb", "bits_a", "bits_b")
        return materialise(pairs.mapInArrow(lambda it: close_pairs(it, percent), "a long, b long, differ long"), "stars")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, s): the full sets of some classes, from another scan."""
        wanted = materialise(self.nodes.select("node", "doc_id", "set_id").join(nodes, "node", "left_semi"), "wanted")
        n, width = wanted.count(), self.width
        sent, read = None, self.read
        none = F.lit(-(2**63)).cast("long")
        if n <= BLOOM_MOST:
            bitmap = bloom(wanted, n)
            sent = self.spark.sparkContext.broadcast(bitmap)
            read = read.select("doc_id", "text", bloom_places(F.col("doc_id"), 64 * len(bitmap)).alias("at"))
        else:
            ids = wanted.select(F.coalesce("doc_id", none).alias("d")).distinct()
            read = read.withColumn("d", F.coalesce("doc_id", none)).join(ids, "d", "left_semi").select("doc_id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if sent is not None:
                    bits, at = sent.value, np.array(batch.column(2).flatten().to_numpy()).reshape(-1, 2)
                    batch = batch.filter(pa.array(((bits[at >> 6] >> (at & 63)) & 1).all(1)))
                for first, end, buf, offsets in text_slices(batch.column(1)):
                    values, bounds = shingle_sets(buf, offsets, width)
                    raw, at = values.tobytes(), bounds.tolist()
                    ids = [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                    s = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(ids, pa.binary()), s], ["doc_id", "set_id", "s"])

        found = read.mapInArrow(run, "doc_id long, set_id binary, s array<long>").withColumn("d", F.coalesce("doc_id", none))
        some = wanted.select("node", F.coalesce("doc_id", none).alias("d"), "set_id")
        return materialise(found.join(some, ["d", "set_id"]).select("node", "s").dropDuplicates(["node"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = pairs.select("a", "b")
        for c in ("a", "b"):
            both = spread_join(both, sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")), [c])
        common = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - F.col("common")
        links = materialise(both.withColumn("common", common).where(100 * F.col("common") >= self.percent * union).select("a", "b"), "links")
        drop_table(sets)
        return links

    def mixed(self, roots: DataFrame) -> DataFrame:
        """(sig, node): who shares a signature whose documents are in different components, once for the same documents."""
        named = self.rows.select("row", "node").join(roots, "node", "left").select("row", "node", F.coalesce("root", "node").alias("label"))
        placed = materialise(spread_join(self._exploded(_SHARED, sig="x", row="y"), named, ["row"]).select("sig", "node", "label"), "placed")
        low = F.lit((1 << 31) - 1).cast("long")
        prints = [F.sum(F.xxhash64("node", F.lit(k)).bitwiseAND(low)).alias(f"f{k}") for k in range(3)]
        several = placed.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("rows"), *prints).where("l <> m")
        several = several.groupBy("rows", "f0", "f1", "f2").agg(F.min("sig").alias("sig")).select("sig")
        return materialise(spread_join(placed.select("sig", "node").distinct(), several, ["sig"]), "mixed")

    def apart(self, mixed: DataFrame, roots: DataFrame, every_pair: bool) -> DataFrame:
        """(a, b): pairs that share a signature, are in different components and pass the bitmaps: all, or what joins components."""
        placed = spread_join(mixed, roots.withColumnRenamed("root", "label"), ["node"], "left").withColumn("label", F.coalesce("label", "node"))
        placed = materialise(placed, "placed")
        several = placed.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("rows")).where("l <> m")
        several = several.select("sig", F.ceil(F.col("rows") / BLOCK_MEMBERS).alias("blocks"))
        members = spread_join(spread_join(placed, several, ["sig"]), self.nodes.select("node", "n", "bits"), ["node"])
        block = F.pmod(F.xxhash64("node", F.lit(9)), "blocks")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        keyed = members.withColumn("block", block).withColumn("other", every)
        keyed = keyed.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "n", "bits")
        dealt = keyed.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high", "node")
        percent = self.percent
        found = dealt.mapInArrow(lambda it: compare_blocks(it, percent, every_pair), "a long, b long").distinct()
        return found

    def links(self) -> DataFrame:
        """Confirmed links (a, b) between classes: enough of them that components are right."""
        tried = self.stars().select("a", "b")
        links = self.confirmed(tried)
        roots = materialise(connected_components(links), "roots")
        mixed = self.mixed(roots)
        for every_pair in (False, True):
            more = materialise(self.apart(mixed, roots, every_pair).join(tried, ["a", "b"], "left_anti"), "more")
            if more.isEmpty():
                continue
            new = self.confirmed(more)
            tried, links = tried.unionByName(more), links.unionByName(new)
            if not every_pair and not new.isEmpty():
                roots = materialise(connected_components(links), "roots")
        return links

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        roots = connected_components(self.links())
        member = self.rows.select("node", "doc_id", "n").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "n")
        member = materialise(member, "members")
        least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        out = spread_join(member, least, ["root"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return out.unionByName(self.empty)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) of every row: documents whose sets of word
    n-grams have a Jaccard similarity of ``percent`` or more are linked."""
    return NgramJoin(docs, id_col, text_col, width, percent).documents()
