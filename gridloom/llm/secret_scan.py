"""Secrets: patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over characters, one of random keys and one of ordinary words and identifiers, score a token by
their log-likelihood ratio.  Random strings are labelled samples drawn with a fixed seed from the usual alphabets
(base 64, base 32, hexadecimal, letters and digits).  The ordinary model counts every word of every document; words joined
as in identifiers (snake, kebab, camel and upper case, paths, numbers at the end) are labelled ordinary too, and since
their letters are independent of each other their transitions follow from the counts of first and last letters.

A token is reported as a ``markov`` span if it has ``MIN_TOKEN`` characters or more, a letter and a digit (without a digit
upper and lower case and ``MIN_LETTERS`` characters), a mean ratio of ``THRESHOLD`` a transition and a total of
``EVIDENCE``, so that short tokens need a higher mean, unless a pattern has found the place.

Two scans and one exchange of at most a few thousand counts per task; the model is a table of fixed size.  Ratios of all
tokens of a batch are sums over its bytes; only texts with a candidate are looked at one by one.

Defined cases: null text counts as empty; an empty table, or one without ordinary words, leaves the model that the
samples alone give; repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import spans, text_slices
from .shared import ship

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key")

MIN_TOKEN, MIN_LETTERS = 12, 20
THRESHOLD = 0.5
EVIDENCE = 14.0
RANDOM_SAMPLES = 20_000
#: Share of all words that stand, joined to another, in identifiers of each form.
FORM_SHARE = 0.05

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = np.full(256, len(_ALPHABET), np.int64)
_INDEX[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
_STATES = len(_ALPHABET) + 1
_IN_TOKEN = _INDEX < len(_ALPHABET)
_UPPER = np.array([_ALPHABET.index(c.upper()) for c in _ALPHABET] + [_STATES - 1])
_IN_DIGIT, _IN_LOWER, _IN_UPPER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_IN_HEX = np.zeros(256, bool)
_IN_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def random_samples(n: int = RANDOM_SAMPLES) -> list[str]:
    """Strings labelled random."""
    rng = np.random.default_rng(20240604)
    sets = (_ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:26] + "234567", "0123456789abcdef", _ALPHABET[26:62])
    return ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(20, 64)))) for i in range(n)]


def log_transitions(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of each next character, smoothed by half a count."""
    counts = counts + 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


def random_counts(tokens: list[str]) -> np.ndarray:
    counts = np.zeros((_STATES, _STATES))
    for token in tokens:
        at = _INDEX[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]
        np.add.at(counts, (at[:-1], at[1:]), 1)
    return counts


def ordinary_counts(within: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Transitions of words, and of words joined as in identifiers, from those within words and their first and last letters."""
    n = max(last.sum(), 1.0)
    out = within + FORM_SHARE * _moved(within)
    capital = np.bincount(_UPPER, weights=first, minlength=_STATES)
    out += FORM_SHARE * np.outer(last, capital) / n  # camelCase
    for joiner in "_-/":
        j = _ALPHABET.index(joiner)
        out[:, j] += FORM_SHARE * last
        out[j] += FORM_SHARE * first
    up_last = np.bincount(_UPPER, weights=last, minlength=_STATES)
    j = _ALPHABET.index("_")  # UPPER_CASE
    out[:, j] += FORM_SHARE * up_last
    out[j] += FORM_SHARE * capital
    digits = slice(_ALPHABET.index("0"), _ALPHABET.index("9") + 1)
    out[:, digits] += FORM_SHARE * last[:, None] / 10  # name2024
    out[digits, digits] += 3 * FORM_SHARE * n / 100
    for joiner in "_-/":
        j = _ALPHABET.index(joiner)
        out[j, digits] += FORM_SHARE * n / 30
        out[digits, j] += FORM_SHARE * n / 30
    return out


def _moved(within: np.ndarray) -> np.ndarray:
    """The counts of the same words in upper case."""
    out = np.zeros_like(within)
    np.add.at(out, (_UPPER[:, None], _UPPER[None, :]), within)
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): transitions within words of letters (code from * states + to), then first and last letters."""
    size = _STATES * _STATES
    counts = np.zeros(size + 2 * _STATES, np.int64)
    letter = _IN_LOWER | _IN_UPPER
    for batch in batches:
        for _, _, buf, offsets in text_slices(batch.column(0)):
            s, e, _ = spans(_IN_TOKEN[buf], offsets)
            index = _INDEX[buf]
            outside = np.concatenate([[0], np.cumsum(~letter[buf])])
            good = (outside[e] == outside[s]) & (e - s >= 2)  # tokens of letters alone
            s, e = s[good], e[good]
            n = e - s - 1
            at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            counts[:size] += np.bincount(index[at] * _STATES + index[at + 1], minlength=size)
            counts[size : size + _STATES] += np.bincount(index[s], minlength=_STATES)
            counts[size + _STATES :] += np.bincount(index[e - 1], minlength=_STATES)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["code", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The log-likelihood ratio of each character transition: random over ordinary, the latter from all documents."""
    ship(docs.sparkSession)
    read = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = read.mapInArrow(count_words, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # a row per transition
    counts = np.zeros(_STATES * _STATES + 2 * _STATES)
    for code, n in rows:
        counts[code] = n
    within, first, last = counts[: _STATES**2].reshape(_STATES, _STATES), counts[_STATES**2 : -_STATES], counts[-_STATES:]
    return log_transitions(random_counts(random_samples())) - log_transitions(ordinary_counts(within, first, last))


def is_random(total: np.ndarray, n: np.ndarray, digits: np.ndarray, lower: np.ndarray, upper: np.ndarray, threshold: float, slack: float = 0.0):
    """The rule for tokens of ``n`` characters whose transitions' ratios sum to ``total``."""
    mixed = np.where(digits, lower | upper, lower & upper & (n >= MIN_LETTERS))
    return mixed & (n >= MIN_TOKEN) & (total >= threshold * (n - 1) - slack) & (total >= EVIDENCE - slack)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the pattern matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def judged(token: str, model: np.ndarray, threshold: float = THRESHOLD) -> bool:
    b = np.frombuffer(token.encode("ascii", "replace"), np.uint8)
    at = _INDEX[b]
    has = (x[b].any() for x in (_IN_DIGIT, _IN_LOWER, _IN_UPPER))
    return bool(is_random(model[at[:-1], at[1:]].sum(), np.int64(len(b)), *has, threshold))


def markov_spans(text: str, known: list[tuple[int, int, int]], model: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Random tokens that touch none of the known spans, which are in order of their starts."""
    starts, reach = [a for a, _, _ in known], list(accumulate((b for _, _, b in known), max))
    out = []
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < MIN_TOKEN:
            continue
        before = bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        if judged(m[0], model, threshold):
            out.append((m.start(), 3, m.end()))
    return out


def _random_runs(buf: np.ndarray, s: np.ndarray, e: np.ndarray, model: np.ndarray, threshold: float) -> np.ndarray:
    """Which runs of token characters the rule takes, with a little slack for the order of summation."""
    index = _INDEX[buf]
    sums = np.concatenate([[0.0], np.cumsum(model[index[:-1], index[1:]])])
    has = [np.concatenate([[0], np.cumsum(x[buf])]) for x in (_IN_DIGIT, _IN_LOWER, _IN_UPPER)]
    return is_random(sums[e - 1] - sums[s], e - s, *[x[e] > x[s] for x in has], threshold, 1e-6)


def _candidates(buf: np.ndarray, offsets: np.ndarray, model: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows may hold a span."""
    rows = np.zeros(len(offsets) - 1, bool)
    raw = buf.tobytes()
    at = [m.start() for m in _WORDS.finditer(raw.lower())]
    where = raw.find(b"AKIA")
    while where >= 0:
        at.append(where)
        where = raw.find(b"AKIA", where + 4)
    if at:
        rows[np.searchsorted(offsets, np.array(at), side="right") - 1] = True
    s, e, row = spans(_IN_HEX[buf], offsets)
    rows[row[e - s >= 32]] = True
    s, e, row = spans(_IN_TOKEN[buf], offsets)
    if len(s):
        rows[row[_random_runs(buf, s, e, model, threshold)]] = True
    return rows


def scan(batches: Iterator[pa.RecordBatch], model: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    def text_of(found: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)

    empty = sha256(b"").hexdigest()
    for batch in batches:
        for first, end, buf, offsets in text_slices(batch.column(1)):
            n = end - first
            counts, digests, every = np.zeros((3, n), np.int64), [empty] * n, [""] * n
            raw = buf.tobytes()
            for i in np.flatnonzero(_candidates(buf, offsets, model, threshold)):
                text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass")
                base = base_spans(text)
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digests[i] = sha256(text_of(base).encode()).hexdigest()
                every[i] = text_of(sorted(base + markov_spans(text, base, model, threshold)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), *map(pa.array, counts), pa.array(digests), pa.array(every, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    ship(docs.sparkSession)
    model = fit(docs, text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(
        lambda it: scan(it, model, threshold), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
