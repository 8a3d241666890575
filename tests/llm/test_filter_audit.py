"""The audit of filters against plain counting over every order, and on nulls, repeated rows, empty tables and clashing names."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gridloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, digest string, first string, n string, good string, A string, part string, f string"


def _rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(260):
        text = " ".join(rng.choices(words[: rng.choice([20, 400])], k=rng.choice([150, 199, 200, 260])))
        if rng.random() < 0.3:
            text = text.upper() if rng.random() < 0.5 else text + " A" * rng.randrange(40)
        if rng.random() < 0.3:
            text += " #"
        rows.append((i, text, rng.choice(["a", "b", "", None])))
    rows += [(300 + k, rows[k % 40][1], "a") for k in range(120)]
    rows += [(400, None, "b"), (401, "", "b"), (402, None, None), (402, None, None), (None, rows[0][1], "a"), (None, "", "b"), (5, rows[5][1], "a")]
    rows += [(500, "x" * 300_000 + " $", "b"), (501, " \t\x0b\n", "a")]
    return rows


def _labels():
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 420, 2)]
    return rows + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]


def by_plain_python(docs, labels):
    good, toxic, least = defaultdict(bool), defaultdict(bool), {}
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "")
        fails += ("C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else "") + ("D" if re.search(r"[#$%&*|]", text) else "")
        fails += "E" if i is not None and i > least[text] else ""
        judged.append((source or "", fails, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part in {p for p, *_ in judged}:
        own, total = [x for x in judged if x[0] == part], Counter()
        rows = {}
        for order in permutations("ABCDE"):
            gone = [False] * len(own)
            for step, f in enumerate(order, 1):
                here = [k for k, x in enumerate(own) if not gone[k] and f in x[1]]
                again = sum(gone[k] and f in x[1] for k, x in enumerate(own))
                for k in here:
                    gone[k] = True
                total[f] += len(here)
                rows["".join(order), step] = [len(own) - sum(gone), len(here), again, sum(x[1] == f for x in own), sum(own[k][2] for k in here), sum(own[k][3] for k in here)]
        for (order, step), row in rows.items():
            out[part, order, step] = (*row, total[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["z"] * 7) for r in _rows()], SCHEMA).repartition(5)


def test_by_brute_force(spark, docs):
    labels = spark.createDataFrame(_labels(), "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got}
    expected = by_plain_python(_rows(), _labels())
    assert len(got) == len(expected) == 600 * 3
    assert found == expected
    assert any(v[4] for v in expected.values()) and any(v[5] for v in expected.values())


def test_shapley_values_add_up(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).where("step = 5").groupBy("part").agg(F.sum("removed").alias("r"), F.min("kept").alias("lo"), F.max("kept").alias("hi"), F.max("good_lost").alias("g"))
    for r in got.collect():
        assert r["lo"] == r["hi"] and r["g"] == 0  # whatever the order, the same documents are left


def test_other_filters_and_empty_tables(spark, docs):
    flagged = spark.range(12).select(F.lit("p").alias("part"), (F.col("id") % 2 == 0).alias("X"), (F.col("id") % 3 == 0).alias("Y"), F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit.audit(flagged, "XY").collect()}
    assert got == {("XY", 1): (6, 6, 10), ("XY", 2): (4, 2, 6), ("YX", 1): (8, 4, 6), ("YX", 2): (4, 4, 10)}
    with pytest.raises(ValueError):
        filter_audit.audit(flagged, "")
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
