"""Personal data: base spans and disclosing terms against plain Python, at length, and in cost."""

import hashlib
import math
import random
import time
from collections import Counter

import regex

from gridloom.llm import pii

WORD = r"[^\x20\x09-\x0D]+"


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_by_plain_python(text):
    """The contract's patterns as they stand."""
    out = []
    for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in regex.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in regex.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = regex.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in regex.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(regex.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _term(word):
    return regex.sub(r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "", word).lower()


def spans_by_plain_python(rows):
    """Per row the base spans and the (start, stop, removed) of disclosing words."""
    n, entity_docs, term_docs, both, parsed, seen = len(set(rows)), Counter(), Counter(), Counter(), [], set()
    for text in rows:
        base = base_by_plain_python(text)
        names = set()
        for a, k, b in base:
            names.add(f"{k}:" + (regex.sub("[^0-9]", "", text[a:b]) if k >= 2 else text[a:b]).lower())
            names |= {"host:" + text[a:b].lower().rsplit("@", 1)[1]} if k == 0 else {"net:" + text[a:b].rsplit(".", 1)[0]} if k == 1 else set()
        free = [m for m in regex.finditer(WORD, text) if not any(a < m.end() and m.start() < b for a, _, b in base)]
        terms = {_term(m[0]) for m in free} - {""}
        parsed.append((base, names, free))
        if text in seen:
            continue
        seen.add(text)
        entity_docs.update(names)
        term_docs.update(terms)
        both.update((e, t) for e in names for t in terms)
    told = {}
    for (e, t), k in both.items():
        likely, own = k / term_docs[t], math.log2(n / entity_docs[e])
        if k >= pii.MIN_SUPPORT and likely >= pii.GENERALISE and own > 0 and own + math.log2(likely) >= pii.MIN_SHARE * own:
            told[e, t] = likely
    out = []
    for base, names, free in parsed:
        marks = []
        for m in free:
            best = max((told.get((e, _term(m[0])), 0) for e in names), default=0)
            if best:
                marks.append((m.start(), 4, m.end(), best >= pii.REMOVE))
        out.append((base, marks))
    return out


def _random_rows(n, seed):
    rng = random.Random(seed)
    common = "the of and to in is that it was for on are with as his they".split()
    entities = ["Ann@corp.org", "bob@x.y.z", "10.0.0.1", "010.0.0.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "999.1.1.1", "4111 1111 1111 1112"]
    rare = [f"Rare{k}" for k in range(12)] + ["42", "x9", "(bob)", "«été»", "中文", "a\x01b"]
    rows = []
    for _ in range(n):
        words = rng.choices(common, k=rng.randrange(3, 20))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(entities))
            words.insert(rng.randrange(len(words) + 1), entities[k] + rng.choice(["", ".", ","]))
            if rng.random() < 0.8:
                words.insert(rng.randrange(len(words) + 1), rare[k] + rng.choice(["", "!", ";"]))
        if rng.random() < 0.3:
            words.append(rng.choice(rare))
        rows.append(rng.choice([" ", " ", "\n", "  \t"]).join(words))
    return rows


def _text_of(spans):
    return ",".join(f"{pii.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


def test_spans_by_brute_force(spark):
    rows = _random_rows(400, 5) + ["", " ", "a@b.c"] * 2
    rows += ["1." + "0" * 64 + "1.3.4", "1." + "0" * 70 + "1.2.3 é", "\x01 a@b.c\x01 x", "a@b.c" * 30, "1.2.3.4.5.6.7.8.9", "+1 2 3 4 5 6 7 8 9+1 234567890"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.pii(df).collect()}
    assert len(got) == len(rows)
    marked = 0
    for i, (base, marks) in enumerate(spans_by_plain_python(rows)):
        assert got[i]["base_sha256"] == hashlib.sha256(_text_of(base).encode()).hexdigest(), rows[i]
        assert got[i]["spans"] == _text_of(base + [m[:3] for m in marks]), rows[i]
        kinds = Counter(k for _, k, _ in base)
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [kinds[k] for k in range(4)]
        acts = [x.split(":") for x in got[i]["actions"].split(",") if x]
        assert [(int(a), int(b), k == "remove") for k, a, b in acts] == [(a, b, gone) for a, _, b, gone in marks]
        marked += len(marks)
    assert marked > 100


def test_repeated_rows_ties_and_null(spark):
    """Repeated rows are judged alike and are one document together; null ids and texts come back."""
    rows = [(1, "write zed a@b.org"), (1, "write zed a@b.org"), (None, "write zed a@b.org"), (2, None), (2, None), (None, None)] + [(k, f"write on {k}") for k in range(10, 30)]
    got = pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["spans"] for r in got if r["n_email"]} == {"email:10:17"}  # copies are no evidence
    assert all(r["spans"] == "" for r in got if not r["n_email"])
    rows += [(3, "write zed a@b.org."), (4, "write zed a@b.org!")]
    got = pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["spans"] for r in got if r["n_email"]} == {"term:6:9,email:10:17"}


def test_terms_that_give_a_host_or_network_away(spark):
    """Every address stands in one document; the term stands with the host, or the network, alone."""
    rows = [(k, f"zarquon person{k}@corp.org at {k}") for k in range(6)] + [(10 + k, f"vogon 10.9.8.{k} at {k}") for k in range(6)] + [(100 + k, f"at other{k}@site{k}.net {k}") for k in range(80)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].startswith("term:0:7,email") for k in range(6)) and all(got[10 + k].startswith("term:0:5,ip") for k in range(6))
    assert not any("term" in got[100 + k] for k in range(80))


def test_precision_and_recall_on_planted_terms(spark):
    """Of planted pairs of a person's address and a word of their own, among common words and other addresses."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(2000)]
    rows, planted = [], {}
    for person in range(60):
        for _ in range(rng.randrange(3, 8)):
            words = rng.choices(common, k=60)
            words.insert(rng.randrange(60), f"person{person}@mail{person % 5}.org")
            if rng.random() < 0.9:
                words.insert(rng.randrange(60), f"name{person}")
            rows.append((len(rows), " ".join(words)))
            planted[len(rows) - 1] = f"name{person}"
    rows += [(len(rows) + k, " ".join(rng.choices(common, k=60))) for k in range(600)]
    right = wrong = missed = 0
    for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, name = rows[r["doc_id"]][1], planted.get(r["doc_id"])
        marked = {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"}
        right += name in marked
        missed += name is not None and name in text.split() and name not in marked
        wrong += len(marked - {name})
    assert right / (right + missed) > 0.85 and right / (right + wrong) > 0.95


def test_generalisation(spark):
    """Terms become their class, or go when they tell nearly everything."""
    rows = [(k, f"x{k} Anna, 1234 q7 soon: a@b.org") for k in range(8)] + [(100 + k, "Anna 1234 q7 soon " * (k < 5) + f"y{k}") for k in range(40)]
    rows += [(200 + k, "only a@b.org zed" + "!" * k) for k in range(3)]
    clean = {r["doc_id"]: r["text"] for r in pii.Sanitiser(spark.createDataFrame(rows, "doc_id long, text string")).sanitised().collect()}
    assert clean[3] == "x3 [NAME] [NUMBER] [CODE] [WORD] [EMAIL]"
    assert clean[200].split() == ["[EMAIL]"]  # "only" and "zed" stand with the address alone


def test_long_texts_cost_in_proportion(spark):
    """Twice the addresses and names of pages that repeat each other cost about twice the time; all names disclose."""

    def seconds(n):
        text = " ".join(f"name{k}@host{k}.org word{k}" for k in range(n))
        df = spark.createDataFrame([(k, text + " x" * k) for k in range(3)] + [(10 + k, f"page {k}") for k in range(60)], "doc_id long, text string")
        began = time.perf_counter()
        got = pii.pii(df).where("doc_id = 0").first()
        assert got["n_email"] == n and got["spans"].count("term:") == n
        return time.perf_counter() - began

    seconds(10)
    fixed, one, two = seconds(20), seconds(2000), seconds(4000)
    assert two - fixed < 3.5 * (one - fixed) + 2
