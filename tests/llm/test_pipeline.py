"""The pipeline's stages on a small table, each against plain Python on its own input, and edge cases of every stage."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline

from . import test_mixing, test_quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    pieces = docs.collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def _kept_by_brute_force(rows):
    """Of each component over links of 0.85 the least (null last) id stays, of equal rows the least one."""

    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [rb if x == ra else x for x in root]
    out = Counter(r for r, s in zip(rows, sets, strict=True) if not s)
    for k in set(root):
        some = [r for r, s, x in zip(rows, sets, root, strict=True) if x == k and s]
        if some:
            out[min(some, key=lambda r: (r[0] is None, r[0] or 0, r))] += 1
    return out


def test_near_dedup_stage_keeps_rows_not_ids(spark):
    """Repeated ids, repeated rows and null ids: exactly the rows marked kept stay."""
    rng = random.Random(4)
    text = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(8)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in text]
    rows = [(1, text[0], "en", "a", 9), (1, text[0], "en", "a", 9), (1, text[0], "en", "b", 9), (1, text[1], "en", "a", 9)]
    rows += [(2, text[0], "en", "a", 9), (2, near[1], "en", "a", 9), (2, text[2], "en", "a", 9), (3, near[2], "en", "a", 9)]
    rows += [(None, text[3], "en", "a", 9), (None, near[4], "en", "a", 9), (4, text[4], "en", "a", 9)]
    rows += [(None, text[5], "en", "a", 9), (None, text[5], "en", "a", 9), (5, None, "en", "a", 0), (5, "", "en", "a", 0), (5, "", "en", "a", 0)]
    rows += [(None, " ", "en", "a", 1), (None, " ", "en", "a", 1), (6, text[6], "en", "a", 9), (7, near[6], "en", "a", 9), (7, text[7], "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = corpus_pipeline.dedup_near(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == _kept_by_brute_force(rows)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, keep string, row string, h string, k_id string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, shared lines, junk, null and repeated ids, null, empty and long texts, clashing columns; labels."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(300)]
    notice = "this notice of forty characters or more stands below many documents"
    rows, labels = [], []

    def add(i, text, source):
        rows.append((i, text, "en", source, len(text or ""), "s", "k", "r", "h", "i"))

    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice([20, 80, 200]))
        text = " ".join(words) + (f"\n{notice}" if k % 3 == 0 else "")
        add(k, text, rng.choice(["a", "b", None]))
        labels.append((k, 1, 0))
        if k % 5 == 0:  # an exact copy and a near one
            add(100 + k, text, "c")
            add(200 + k, text + " more", "a")
    for k in range(300, 340):
        add(k, " ".join(rng.choices(["buy!!", "now$$", "win", "casino"], k=60)), "b")
        labels.append((k, 0, 0))
    rows += [rows[0], rows[0]]
    add(None, rows[3][1], "a")
    add(None, " ".join(rng.choices(vocabulary, k=50)), None)
    add(None, None, "a")
    add(5, None, "a")
    add(400, "", "b")
    add(400, "", "b")
    add(401, " ".join(rng.choices(vocabulary, k=20_000)), "b")
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def _lines_by_brute_force(rows):
    where = defaultdict(list)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n") if len(x.strip()) >= 40}:
            if i is not None:
                where[k].append(i)
    out = Counter()
    for i, t, *rest in rows:
        stay = [x for x in (t or "").split("\n") if i is None or len(where[key(x)]) < 5 or max(where[key(x)]) == i]
        text = "\n".join(stay)
        out[i, text, rest[0], rest[1], len(text), *rest[3:]] += 1
    return out


def test_stages_by_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        out = corpus_pipeline.materialise(stages[name](spark, docs, folder), f"test-{name}")
        return out, [tuple(r) for r in out.collect()]

    before = [tuple(r) for r in docs.collect()]
    # 1: what the plain learner, taught by the same rows, scores under a half goes
    names = test_quality_classifier.features_by_plain_python
    texts = {}
    for r in sorted(before, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        texts.setdefault(r[0], r[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    taught = [(names(texts[i] or ""), y) for i, y in sorted(labels.items()) if zlib.crc32(str(i).encode()) % 3 != 1]
    score = test_quality_classifier.learn_by_plain_python(taught)
    docs, after = run("quality_classifier")
    assert Counter(after) == Counter(r for r in before if score(names(r[1] or "")) >= 0.5)
    assert not any(300 <= (r[0] or 0) < 340 for r in after) and docs.columns == columns
    # 2
    before = after
    docs, after = run("line_dedup")
    assert Counter(after) == _lines_by_brute_force(before) and docs.columns == columns
    # 3
    before = after
    docs, after = run("near_dedup")
    assert Counter(after) == _kept_by_brute_force(before) and docs.columns == columns
    # 4: totals near the targets, nothing that the documents don't hold
    before = after
    docs, after = run("mixing")
    assert docs.columns == columns
    count = lambda t: len(re.findall(test_mixing.WORD, t or ""))
    sizes, taken, have = Counter(), Counter(), defaultdict(Counter)
    for r in before:
        sizes[r[3]] += count(r[1])
        have[r[0], r[3]].update(re.findall(test_mixing.WORD, r[1] or ""))
    drawn = defaultdict(Counter)
    for r in after:
        taken[r[3]] += count(r[1])
        drawn[r[0], r[3]].update(re.findall(test_mixing.WORD, r[1]))
        assert r[4] == len(r[1])
    for source, target in test_mixing.targets_by_plain_python(dict(sizes)).items():
        assert abs(taken[source] - target) <= 1024
    assert all(n <= 2 * have[k][w] for k, words in drawn.items() for w, n in words.items())
    # 5: every token of every document once, in sequences without holes
    pieces = [tuple(r) for r in corpus_pipeline.pack_sequences(spark, docs, folder).collect()]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], np.array([*model.encode(r[1], add_special_tokens=False).ids, 1], "<u4")) for r in after]
    assert sum(p[2] for p in pieces) == sum(len(x) for _, x in ids)
    whole = Counter((i, zlib.crc32(x.tobytes()), len(x)) for i, x in ids if len(x) <= 40)
    cut = Counter((p[0], p[3], p[2]) for p in pieces if p[2] == p[4] and p[2] <= 40)
    assert not cut - whole
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p[5]].append((p[6], p[2]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_whole_run_repeats(spark, folder):
    """Two runs give the same rows; what a run counts is what its stages count."""
    a, b = ([tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()] for _ in range(2))
    assert sorted(a, key=str) == sorted(b, key=str) and a


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
