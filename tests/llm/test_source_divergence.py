"""Divergences of sources against plain Python with exact integers, and the tokeniser, grouping and arithmetic beneath."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gridloom.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _rows(n=300, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "Éa", "éa", "straße", "中文", "a1b", "don't", "x" * 300, *[f"{a}{b}" for a in "bcdfg" for b in "aeiou"]]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", None])
        some = words[: 8 + 4 * (i % 5)] if source == "s1" else words
        rows.append((i, rng.choice([" ", "\n", "-_"]).join(rng.choices(some, k=rng.randrange(30))), lang, source))
    rows += [(n, None, "en", "s1"), (n, None, "en", "s1"), (n + 1, "", "fr", "s9"), (n + 2, "only once", "fr", "s8"), (None, "123 [] ~", "it", None), (n + 3, "ba " * 20_000, "en", "s2")]
    return rows


def by_plain_python(rows, least=10):
    n, df, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [_lower(t) for t in TERM.findall(text or "")]
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), k in df.items():
        if k >= least:
            kept[lang].append(t)

    def shares(lang, of):
        counts = {t: sum(n[lang, s, t] for s in of) for t in kept[lang]}
        total = sum(counts.values()) + 2 * len(counts)
        return counts, {t: 1 + 10**9 * (c + 2) // total for t, c in counts.items()}

    out = []
    for lang in {g[0] for g in groups}:
        sources = [s for g, s in groups if g == lang]
        q = shares(lang, sources)[1]
        own = {s: shares(lang, [s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            counts, p = own[s]
            pairs = [(o, sum(f(p[t], own[o][1][t]) for t in p)) for o in sources if o != s]
            terms = [(t, f(p[t], q[t])) for t in p if counts[t] > 0 and p[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1) if part == "pair" or k <= 10]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 7) for r in rows], "doc_id long, text string, lang string, source string, term string, part string, n long").repartition(4)


def test_by_brute_force(spark, monkeypatch):
    got = sorted(tuple(r) for r in sd.source_divergence(_frame(spark, _rows())).collect())
    expected = by_plain_python(_rows())
    assert got == expected and len(got) > 100
    assert any(r[2] == "pair" and r[4] == 0 for r in got)  # a language without a kept term


def test_shards_and_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_COUNTS", 7)
    got = sorted(tuple(r) for r in sd.source_divergence(_frame(spark, _rows(150, 2))).collect())
    assert got == by_plain_python(_rows(150, 2))


def test_empty(spark):
    assert sd.source_divergence(_frame(spark, [(1, "a", "b", "c")]).where("doc_id = 0")).count() == 0


def test_slices_of_one_hash_are_told_apart():
    text = b"aa bb aa cc bb aaa"
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = sd.spans(sd.IN_TERM[buf], np.array([0, len(buf)]))
    for digest in (None, lambda b: 5, lambda b: len(b)):
        group, names = sd.group_slices(buf, starts, ends, *([digest] if digest else []))
        assert [names[g] for g in group] == text.split()
        assert len(set(names)) == len(names) == 4


def test_counts_survive_being_sent_in_parts(monkeypatch):
    monkeypatch.setattr(sd, "HELD", 3)
    rows = [("a b a", "l", "s"), ("b c d e f g", "l", "t"), ("a", "l", "s")]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["text", "lang", "source"])
    n, docs = Counter(), Counter()
    for out in sd.term_counts(iter([batch, batch])):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n["s", "a"] == 6 and docs["s", "a"] == 4 and n["t", "b"] == 2 and n["s", None] == 0


def test_shares_are_exact_beyond_double_precision():
    rng = random.Random(1)
    total = [rng.randrange(1, 2**53) for _ in range(1000)]
    count = [rng.randrange(0, t) for t in total]
    got = sd.share(np.array(count), np.array(total))
    assert got.tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count, total, strict=True)]


def test_sparse_sums_equal_dense_ones():
    rng = np.random.default_rng(1)
    k, width = 6, 40
    dense = rng.integers(0, 4, (k, width)) * (rng.random((k, width)) < 0.4)
    total = dense.sum(axis=1) + 2 * width
    rows, cols = np.nonzero(dense)
    p = sd.share(dense, total[:, None])
    expected = np.array([[sd.divergence(p[i], p[j]).sum() for j in range(k)] for i in range(k)])
    assert (sd.shard_sums(rows, cols, dense[rows, cols], width, total) == expected).all()
