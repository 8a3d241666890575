"""Packing documents into sequences along a space-filling curve.

Texts are tokenised; the hashed vector of a document's tokens is projected to three dimensions, whose Hilbert index is
the document's place on the curve.  Documents are range-sorted by it (with a hash of the id to split equal places) and
each range is packed on its own: neighbours follow each other, cut where a sequence is full, so no sequence but a range's
last is short.  What is left at a range's end becomes sequences of powers of two, which need no padding.

The vocabulary file's path is a parameter.  Where the file's rules are those that :meth:`WordTokenizer.cuts` knows, each
run of letters or punctuation is tokenised once per worker and kept (at most ``CACHE_WORDS``); with any other rules whole
texts are encoded.

Scale: one materialised table of token ids and one range exchange of it; a task streams its sorted range and holds one
sequence at a time.  Sequence ids are the task's number and a count, so no task needs another's.

Defined cases: null and empty texts give the end id alone; rows that repeat an id are packed each; null ids are packed
too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import IS_SPACE, LOWER, U64, fmix, row_bounds, segment_sum, span_hashes, spans, text_slices
from .shared import materialise, ship

LENGTH = 2048
END_ID = 1
DIMS, GRID_BITS = 3, 20
VECTOR = 256
CACHE_WORDS = 500_000
#: Bytes of text that a task works on at once; what it holds besides is in proportion.
SLICE_BYTES = 1 << 19

# The pre-tokeniser pattern under which a text falls apart into the pieces of `pieces`.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_TOKENIZERS: dict[str, WordTokenizer] = {}

_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[IS_SPACE] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0xC3:0xCA] = _KIND[0x80:0xC0] = _LETTER  # two-byte letters of Latin scripts, but for those that `pieces` names
_KIND[[0x27, *range(32), *range(0xC0, 0xC3), *range(0xCA, 256)]] = _WHOLE
_KIND[IS_SPACE] = _SPACE


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case; start, end and row of the pieces that no token crosses; whether each is a word as it stands.

    Pieces are runs of Latin letters, single digits and runs of ASCII punctuation.  A word with anything else (other
    scripts and marks, an apostrophe, the start of a special token) is one piece, as it stands.
    """
    kind = _KIND[buf]
    odd = kind == _WHOLE
    if len(buf) > 1:  # a multiplication or division sign, a letter whose lower case is two characters, "<|"
        a, b = buf[:-1], buf[1:]
        odd[:-1] |= ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0x3C) & (b == 0x7C))
    at = np.flatnonzero(odd)
    if len(at):
        s, e, _ = spans(kind != _SPACE, offsets)
        for w in np.unique(np.searchsorted(s, at, side="right") - 1):
            kind[s[w] : e[w]] = _WHOLE
    n = len(kind)
    if not n:
        none = np.zeros(0, np.int64)
        return buf, none, none, none, none.astype(bool)
    edge = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[:-1] |= kind == _DIGIT
    edge[offsets] = True
    word = kind != _SPACE
    s, e = np.flatnonzero(edge[:-1] & word), np.flatnonzero(edge[1:] & word) + 1
    low = np.where(kind == _WHOLE, buf, LOWER[buf])
    return low, s, e, np.searchsorted(offsets, s, side="right") - 1, kind[s] == _WHOLE


class WordTokenizer:
    """Token ids of texts, piece by piece, with the pieces seen so far kept.

    Pieces are only cut where the vocabulary file's own rules do (:meth:`cuts`); with other rules whole texts are encoded.
    """

    JOINED = 2000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size()
        self.by_piece = self.cuts(self.model)
        rng = np.random.default_rng(20240603)
        bucket = fmix(np.arange(self.vocabulary, dtype=U64) + U64(1))
        sign = np.where(bucket >> U64(63), 1.0, -1.0)
        #: what one token adds to the projection of its document's hashed vector
        self.projection = rng.normal(size=(VECTOR, DIMS))[(bucket % U64(VECTOR)).astype(int)] * sign[:, None]
        #: tokens that end a word of the pre-tokeniser
        self.ends = np.zeros(self.vocabulary, bool)
        if self.by_piece:
            suffix = self.model.model.end_of_word_suffix
            self.ends[[i for t, i in self.model.get_vocab(False).items() if t.endswith(suffix)]] = True
        self.clear()

    @staticmethod
    def cuts(model) -> bool:
        """Whether the file's rules cut texts where :func:`pieces` does: words end in a suffix, case and white space fall away."""
        state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        steps = state(model.pre_tokenizer).get("pretokenizers", [])
        split = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        bytewise = split and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        normal = [x["type"] for x in state(model.normalizer).get("normalizers", [])]
        suffix = getattr(model.model, "end_of_word_suffix", None) and getattr(model.model, "dropout", 0) is None
        special = all(t.content.startswith("<|") and not t.lstrip and not t.rstrip and not t.normalized for t in model.get_added_tokens_decoder().values())
        return bool(bytewise and normal == ["NFC", "Replace", "Lowercase"] and suffix and special)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def clear(self) -> None:
        #: hashes of the known pieces in order, and where their ids stand in the pool
        self.known, self.starts, self.lengths = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _encoded(self, plain: list[bytes], whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces of one word each, then of pieces of any rules, and the number of each piece's ids."""
        parts = []
        for i in range(0, len(plain), self.JOINED):  # an encoding holds much besides its ids: one at a time
            joined = b" ".join(plain[i : i + self.JOINED]).decode()
            parts += [np.array(e.ids, np.int32) for e in self.model.encode_batch_fast([joined], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        lengths = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(lengths) != len(plain):
            raise ValueError("the tokeniser's words are not the pieces of the text")
        if whole:
            got = [e.ids for e in self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False)]
            ids = np.concatenate([ids, *[np.array(x, np.int32) for x in got]])
            lengths = np.concatenate([lengths, [len(x) for x in got]])
        return ids, lengths

    def _learn(self, hashes: np.ndarray, plain: list[bytes], whole: list[bytes]) -> None:
        """Add pieces; ``hashes`` are those of ``plain``, then of ``whole``."""
        ids, lengths = self._encoded(plain, whole)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = (self.used + np.cumsum(lengths) - lengths).astype(np.int32)
        self.used += len(ids)
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.starts, self.lengths = np.insert(self.starts, at, starts[order]), np.insert(self.lengths, at, lengths[order].astype(np.int32))

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        return (self.known[np.minimum(at, len(self.known) - 1)] != hashes) if len(self.known) else np.ones(len(hashes), bool)

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of every row, one row after the other, and their n + 1 bounds."""
        if not self.by_piece:
            return self._plain(buf, offsets)
        low, s, e, row, odd = pieces(buf, offsets)
        h, first, back = np.unique(span_hashes(low, s, e), return_index=True, return_inverse=True)
        new = np.flatnonzero(self._missing(h))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.clear()
            if len(h) > CACHE_WORDS:  # a single text of more different words than are kept
                return self._plain(buf, offsets)
            new = np.arange(len(h))
        if len(new):
            raw, whole = low.tobytes(), odd[first[new]]
            new = np.concatenate([new[~whole], new[whole]])
            texts = [raw[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            n = int((~whole).sum())
            self._learn(h[new], texts[:n], texts[n:])
        place = np.searchsorted(self.known, h)[back]
        n = self.lengths[place].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        flat = np.arange(total) + np.repeat(self.starts[place] - (ends - n), n)
        bounds = np.concatenate([[0], ends])[row_bounds(row, len(offsets) - 1)]
        return self.pool[flat], bounds

    def _plain(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        got = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in got])])
        return np.array([i for ids in got for i in ids], np.int32), bounds


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of grid points (n rows of unsigned coordinates below ``2 ** bits``)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations and reflections of each level, coarsest first
        low = level - 1
        for d in range(dims):
            up = (x[d] & level) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_places(ids: np.ndarray, bounds: np.ndarray, projection: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(bounds), 1)
    y = segment_sum(projection[ids], bounds) / n[:, None]
    cell = np.floor((np.tanh(y) + 1) / 2 * ((1 << GRID_BITS) - 1))
    return hilbert(cell.astype(np.int64), GRID_BITS)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """doc_id, place on the curve, number of ids with the end id, and the ids as 32-bit (or 16-bit) integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordTokenizer.of(path)
        kind = "<u2" if model.vocabulary <= 1 << 16 else "<u4"
        for batch in batches:
            for first, end, buf, offsets in text_slices(batch.column(1), SLICE_BYTES):
                ids, bounds = model.ids(buf, offsets)
                places = curve_places(ids, bounds, model.projection)
                raw, size = ids.astype(kind), int(kind[-1])
                stop = np.array([end_id], kind).tobytes()
                rows = [raw[a:b].tobytes() + stop for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(places),
                     pa.array(np.full(end - first, size, np.int32)), pa.array(rows, pa.binary())],
                    names=["doc_id", "place", "id_bytes", "ids"],
                )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, place long, id_bytes int, ids binary")


class _Sequence:
    """Pieces that wait for their sequence to fill."""

    def __init__(self, length: int, base: int):
        self.length, self.next_id = length, base
        self.pieces: list[tuple[int, int, int, np.ndarray, int]] = []  # doc, start, doc_tokens, ids, offset
        self.filled = 0

    def rows(self) -> Iterator[tuple]:
        for doc, start, total, ids, offset in self.pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            yield doc, start, len(ids), crc, total, self.next_id, offset
        self.pieces, self.filled = [], 0
        self.next_id += 1

    def add(self, doc: int, ids: np.ndarray, total: int, start: int = 0) -> Iterator[tuple]:
        while len(ids):
            take = min(self.length - self.filled, len(ids))
            self.pieces.append((doc, start, total, ids[:take], self.filled))
            self.filled += take
            start, ids = start + take, ids[take:]
            if self.filled == self.length:
                yield from self.rows()

    def finish(self) -> Iterator[tuple]:
        """The rest as sequences of falling powers of two."""
        left, waiting, whole = self.filled, self.pieces, self.length
        self.pieces, self.filled = [], 0
        at = 0
        while left:
            self.length = 1 << (left.bit_length() - 1)
            need = self.length
            while need:
                doc, start, total, ids, _ = waiting[at]
                take = min(need, len(ids))
                yield from self.add(doc, ids[:take], total, start)
                need -= take
                if take == len(ids):
                    at += 1
                else:
                    waiting[at] = (doc, start + take, total, ids[take:], 0)
            left -= self.length
        self.length = whole


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    tokens = materialise(tokenised(docs, tokenizer, id_col, text_col, end_id), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        seq = _Sequence(length, (context.partitionId() if context else 0) << 32)
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_PIECES)

        for batch in batches:
            for doc, size, ids in zip(*batch.columns, strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{size.as_py()}")
                out += seq.add(doc.as_py(), ids, len(ids))
                if len(out) >= 20_000:
                    yield batch_of()
        out += seq.finish()
        if out:
            yield batch_of()

    order = ["place", "tie", "doc_id", "ids"]
    return (
        tokens.withColumn("tie", F.xxhash64("doc_id", F.lit(5)))
        .repartitionByRange("place", "tie")
        .sortWithinPartitions(*order)
        .select("doc_id", "id_bytes", "ids")
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
