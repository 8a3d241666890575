"""The n-gram join: signatures, bitmaps and components against brute force, stars that miss, and defined cases."""

import random
import re

import numpy as np
import pytest

from gridloom.llm import ngram_join as nj


def _set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def by_plain_python(rows, percent=80):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def _found(spark, rows, parts=4, percent=80):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, node string, row string, sig string, kind string").repartition(parts)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nj.ngram_join(df, percent=percent).collect())


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def _corpus(seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for size in (1, 3, 4, 5, 6, 7, 9, 12, 20, 35, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for _ in range(5):
                words = _edited(rng, base, rng.randrange(0, 2 + size // 25))
                if rng.random() < 0.5:
                    words += [f"t{rng.randrange(99)}" for _ in range(rng.randrange(1 + size // 4))]
                rows.append((n, " ".join(words)))
                n += 1
    rng.shuffle(rows)
    return rows


def test_components_by_brute_force(spark):
    rows = _corpus() + [(5000, None), (5001, ""), (5001, " \t\n"), (None, None), (None, "one two"), (5002, "ONE  two"), (7, "x" * 200_000), (7, "y z"), (None, "y z"), (None, "alone with a null id")]
    assert _found(spark, rows) == by_plain_python(rows)


def test_other_thresholds(spark):
    rows = _corpus(2)[:200]
    for percent in (60, 95):
        assert _found(spark, rows, 3, percent) == by_plain_python(rows, percent)
    with pytest.raises(ValueError):
        nj.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"), percent=30)


def test_one_template_and_chains(spark):
    """Documents of one template resemble each other below the threshold; a few are links or chains that no star's centre shows."""
    rng = random.Random(9)
    template = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(template[:200] + [f"own{i}x{k}" for k in range(45)])) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(0, 150, 7)]
    words = list(template)
    for i in range(30):  # each a link to the one before, far from the first
        words = words[8:] + [f"c{rng.randrange(10**6)}" for _ in range(8)]
        rows.append((2000 + i, " ".join(words)))
    expected = by_plain_python(rows)
    assert _found(spark, rows, 5) == expected
    assert len({c for d, _, c in expected if int(d) >= 2000}) == 1


def test_blocks_of_a_crowded_signature(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(nj, "COMPARED", 64)
    template = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(template[:200] + [f"own{i}x{k}" for k in range(45)])) for i in range(60)]
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(0, 60, 5)]
    assert _found(spark, rows, 5) == by_plain_python(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_join(none).count() == 0
    assert nj.ngram_join(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).collect() == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [80, 65, 95])
def test_similar_sets_share_a_signature_and_pass_the_bitmaps(percent):
    rng, plan, pairs = np.random.default_rng(percent), nj.size_bands(percent), 0
    for size in [*range(1, 45), 64, 101, 333, 900]:
        for _ in range(25):
            most = size * (100 - percent) // 100 * 2 + 1
            gone = int(rng.integers(0, min(most, size)))
            more = int(rng.integers(0, most + 1 - gone)) if rng.random() < 0.8 else 0
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            if 100 * (len(a) - gone) < percent * (len(a) + more) or not gone + more:
                continue
            pairs += 1
            sig, of = nj.part_enum(values, bounds, percent, plan)
            assert np.intersect1d(sig[of == 0], sig[of == 1]).size, (size, gone, more)
            x, y = (np.frombuffer(m, np.uint64)[None] for m in nj.parity_bitmaps(values, bounds))
            words = min(x.shape[1], y.shape[1])
            differ = np.bitwise_count(nj.folded(x, words) ^ nj.folded(y, words)).sum()
            assert differ <= gone + more <= nj.most_differing(np.array([len(a)]), np.array([len(b)]), percent)[0]
    assert pairs > 150


def test_sets_of_a_kind_meet_rarely_by_chance():
    """Unrelated sets of one size share next to no signature, so candidates grow with the links."""
    rng, plan = np.random.default_rng(1), nj.size_bands(80)
    sets = [np.unique(rng.integers(0, 2**64 - 1, 100, dtype=np.uint64, endpoint=True)) for _ in range(400)]
    sig, of = nj.part_enum(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80, plan)
    _, count = np.unique(sig, return_counts=True)
    assert (count > 1).sum() == 0 and len(sig) < 120 * len(sets)
