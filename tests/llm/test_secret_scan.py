"""Secrets: spans against plain Python, and the models' precision and recall on labelled strings they haven't seen."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import secret_scan

SCHEMA = "doc_id long, text string, spans string, n_hex string"
ALPHABETS = {
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "hex": "0123456789abcdef",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_by_plain_python(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def words_of(texts):
    return [w for t in texts for w in re.findall(r"[A-Za-z0-9+/_=-]+", t) if w.isalpha() and len(w) > 1]


def model_by_plain_python(words):
    """The ratio of two smoothed transition tables, the ordinary one over words and their joined forms in expectation."""
    chars = secret_scan._ALPHABET
    share, ordinary = secret_scan.FORM_SHARE, {}

    def add(a, b, n):
        ordinary[a, b] = ordinary.get((a, b), 0) + n

    n = len(words) or 1.0
    firsts = {c: sum(w[0] == c for w in words) for c in chars}
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            add(a, b, 1)
            add(a.upper(), b.upper(), share)
        for f, k in firsts.items():
            add(w[-1], f.upper(), share * k / n) if k else None
        for j in "_-/":
            add(w[-1], j, share)
            add(j, w[0], share)
        add(w[-1].upper(), "_", share)
        add("_", w[0].upper(), share)
        for d in "0123456789":
            add(w[-1], d, share / 10)
    for d in "0123456789":
        for d2 in "0123456789":
            add(d, d2, 3 * share * n / 100)
        for j in "_-/":
            add(j, d, share * n / 30)
            add(d, j, share * n / 30)
    chance = {}
    for t in secret_scan.random_samples():
        for a, b in zip(t, t[1:], strict=False):
            chance[a, b] = chance.get((a, b), 0) + 1

    def log_share(table):
        states = [*chars, None]
        total = {a: sum(table.get((a, b), 0) + 0.5 for b in states) for a in chars}
        return {(a, b): math.log((table.get((a, b), 0) + 0.5) / total[a]) for a in chars for b in chars}

    x, y = log_share(chance), log_share(ordinary)
    return {k: x[k] - y[k] for k in x}


def spans_by_plain_python(text, model):
    base = base_by_plain_python(text)
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        t = m[0]
        if len(t) < secret_scan.MIN_TOKEN or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        if not (re.search("[0-9]", t) and re.search("[A-Za-z]", t)) and not (len(t) >= secret_scan.MIN_LETTERS and re.search("[a-z]", t) and re.search("[A-Z]", t)):
            continue
        total = sum(model[a, b] for a, b in zip(t, t[1:], strict=False))
        if total >= secret_scan.THRESHOLD * (len(t) - 1) and total >= secret_scan.EVIDENCE:
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def _text(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _rows():
    rng = random.Random(9)
    prose = [t.as_py() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0)]
    rows = [(i, t) for i, t in enumerate(prose)]
    bits = ["token=", "API_KEY : '", "passwd\"=\"", "secret", "AKIA", "Token:", " ", "\n", "é", ".", "=", "apıkey=", "ſecret=12345678"]
    for k in range(300):
        parts = [rng.choice(bits) if rng.random() < 0.5 else "".join(rng.choices(rng.choice(list(ALPHABETS.values())), k=rng.randrange(1, 50))) for _ in range(rng.randrange(1, 9))]
        rows.append((1000 + k, "".join(parts)))
    return rows + [(None, "token=abcdefgh1"), (5000, None), (5001, ""), (5001, ""), (5002, "x1" * 30_000), (5003, "token=abcdefgh " * 4000), rows[0]]


def test_spans_by_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = secret_scan.secret_scan(docs).collect()
    model = model_by_plain_python(words_of([t or "" for _, t in rows]))
    by_plain = {t: spans_by_plain_python(t or "", model) for _, t in rows}
    expected = []
    for i, t in rows:
        base, every = by_plain[t]
        expected.append((i, *[sum(k == x for _, k, _ in base) for x in range(3)], hashlib.sha256(_text(base).encode()).hexdigest(), _text(every)))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(e[5].count("markov") for e in expected) > 50
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    """Learnt from all documents of one table; the labelled words below come from another."""
    return secret_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(("alphabet", "length", "least"), [("base62", 32, 0.99), ("base62", 20, 0.95), ("base62", 16, 0.9), ("base64", 40, 0.99), ("base32", 32, 0.95), ("hex", 31, 0.95)])
def test_recall_held_out(model, alphabet, length, least):
    rng = np.random.default_rng(99)
    fresh = ["".join(rng.choice(list(ALPHABETS[alphabet]), length)) for _ in range(500)]
    assert np.mean([secret_scan.judged(t, model) for t in fresh]) >= least


def test_false_positives_held_out(model):
    """Words of documents that weren't counted, alone and joined as in identifiers."""
    texts = [t.as_py() or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0)]
    words = sorted({w for t in texts for w in re.findall("[A-Za-z]{3,24}", t)})
    rng = random.Random(1)
    rng.shuffle(words)
    plain = list(words)
    for a, b, c in zip(words[::3], words[1::3], words[2::3], strict=False):
        n = rng.randrange(2100)
        plain += [f"{a}_{b}_{c}", f"{a}-{b}-{n}", f"{a}{b.capitalize()}{c.capitalize()}{n}", f"{a}/{b}/{c}_{n}", f"{a.upper()}_{b.upper()}_{n}", f"{a}{n}"]
    plain += ["2024-01-31T00-00-00", "application_response_management", "identifier-configuration2024", "2001-2002-2003-2004", "v1-2-3-rc1-build-2024"]
    assert len(plain) > 5000
    wrong = [t for t in plain if secret_scan.judged(t, model)]
    assert len(wrong) <= 0.002 * len(plain), wrong[:20]
