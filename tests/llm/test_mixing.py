"""Mixing against plain Python: targets by water-filling, counts, the permutation's spread, documents."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing

WORD = r"[^\x20\x09-\x0D]+"


def targets_by_plain_python(sizes):
    """Rounds of sharing: who can't give its share gives all that it may, the others share the rest."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def table(spark, seed, n, sources):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(sources)
        words = rng.choice([0, 1, 5, 40, 300]) if source != "tiny" else 1
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(f"w{k}x{i}" for i in range(words)) or rng.choice([None, "", " "]), source))
    rows += [rows[3], rows[3], (None, "no id here", sources[0]), (None, "no id here", sources[0])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize(("seed", "sources"), [(1, ["a", "b", "c", "d", None]), (2, ["hot"] * 30 + ["Z", "é", "z", "tiny", None]), (3, ["one"]), (4, ["𐀀", "～", "b", "a"] * 3 + ["tiny"])])
def test_targets_and_totals(spark, seed, sources):
    rows, df = table(spark, seed, 150, sources)
    got = mixing.mixture(df, block_words=8).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(WORD, text or ""))
    expected = targets_by_plain_python(dict(size))
    by_size = defaultdict(set)
    for s, n in size.items():
        by_size[n].add(round(expected[s], 6))
    assert len(got) == len(rows)
    assert all(round(r["target"], 6) in by_size[r["source_size"]] for r in got)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(re.findall(WORD, t or ""))) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for n, values in by_size.items():
        if len(values) == 1 and sum(1 for s in size if size[s] == n) == 1:
            assert abs(sum(r["taken"] for r in got if r["source_size"] == n) - values.pop()) <= 16
    again = mixing.mixture(df.repartition(2), block_words=8).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_counts_are_multinomial(spark, monkeypatch):
    """Counts per shard vary as independent draws do, and add up to the shard's slots before they are carried to the totals."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    rows = [(k, " ".join(["w"] * 400), "ab"[k % 2]) for k in range(200)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8)
    counts = mix.counts().collect()
    per = defaultdict(dict)
    for r in counts:
        per[r["shard"]][r["rank"]] = r["n"]
    assert {sum(x.values()) for x in list(per.values())} <= {100}
    wanted = {r["rank"]: r["slots"] for r in mix.wanted().collect()}
    p = wanted[0] / sum(wanted.values())
    n = [x.get(0, 0) for x in per.values()]
    mean = sum(n) / len(n)
    variance = sum((x - mean) ** 2 for x in n) / (len(n) - 1)
    assert abs(mean - 100 * p) < 4 * (100 * p * (1 - p) / len(n)) ** 0.5
    assert 0.6 < variance / (100 * p * (1 - p)) < 1.5
    got = Counter(r["rank"] for r in mix.slots().select("rank").collect())
    assert dict(got) == wanted


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 50, 255, 256, 257, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("x")).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def test_permutation_reaches_every_place(spark):
    """Over 4000 seeds, the image of one index is uniform over 50 places, and so are pairs of images over 5 by 5 parts."""
    df = spark.range(4000).select(
        *[mixing.permuted(F.lit(x).cast("long"), F.lit(50).cast("long"), F.col("id")).alias(f"p{x}") for x in (0, 1)])
    rows = df.collect()
    one = Counter(r["p0"] for r in rows)
    assert sum((one[k] - 80) ** 2 / 80 for k in range(50)) < 90  # chi-squared of 49 degrees: 85 at 0.1 %
    both = Counter((r["p0"] // 10, r["p1"] // 10) for r in rows)
    expected = {(a, b): 4000 * (10 * (10 - (a == b))) / (50 * 49) for a in range(5) for b in range(5)}
    assert sum((both[k] - e) ** 2 / e for k, e in expected.items()) < 55  # 24 degrees: 51 at 0.1 %


def test_mixed_documents(spark):
    rows, df = table(spark, 5, 120, ["a", "b", None])
    df = df.withColumn("n_chars", F.length("text"))
    mixed = mixing.mixed_documents(df, block_words=8)
    assert mixed.columns == df.columns
    got = mixed.collect()
    taken = Counter()
    for r in mixing.mixture(df, block_words=8).collect():
        taken[r["doc_id"]] += r["taken"]
    drawn = Counter()
    texts = {(i, s): t for i, t, s in rows}
    for r in got:
        words = re.findall(WORD, r["text"])
        drawn[r["doc_id"]] += len(words)
        have = Counter(re.findall(WORD, texts[r["doc_id"], r["source"]]))
        assert not Counter(words) - have and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in drawn.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mixture(df).collect()] == [(0, 0.0)] * 2
    assert mixing.mixture(df.limit(0)).count() == 0
