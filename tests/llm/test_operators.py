"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, kernels, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, warc
from gridloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, h string, score string, doc string"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
LONG_LINE = "this line is long enough to count and it is repeated across documents"


def _words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


def _texts():
    base = _words(300, 1)
    near = list(base)
    near[7], near[150] = "changed", "also"
    far = _words(300, 2)
    out = {1: " ".join(base), 2: " ".join(near), 3: " ".join(far), 4: None, 5: "", 6: " \t\n ", 7: "one two", 8: "ONE  two", 9: " ".join(base).replace(" ", "\n", 3)}
    for k in range(10, 17):
        out[k] = f"own line {k}\n{LONG_LINE}\n{' '.join(_words(60, k))}."
    out[20] = "x" * 200_000
    out[21] = "mail a.b@c.org or +1 (743) 555-3824, 10.0.0.256 10.0.0.25; 4111 1111 1111 1111 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    out[22] = "é" * 50 + "\n" + "АБВ " * 30
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "a", "b", "c", "d", "e") for i, t in _texts().items()]
    rows += [rows[0], (None, "text of a row without an id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    expected = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_colliding_fingerprints(docs):
    """Four-bit fingerprints collide; verified identifiers don't."""
    a = exact_dedup.exact_dedup(docs, chunk_bytes=64, fingerprint_bits=4).drop("n_chunks")
    b = exact_dedup.exact_dedup(docs).drop("n_chunks")
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_chunks_are_content_defined():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a = {data[s:e] for s, e in zip([0, *exact_dedup.cuts(data)], exact_dedup.cuts(data), strict=False)}
    moved = b"some bytes before" + data
    b = {moved[s:e] for s, e in zip([0, *exact_dedup.cuts(moved)], exact_dedup.cuts(moved), strict=False)}
    assert len(a & b) >= len(a) - 2
    assert exact_dedup.cuts(b"") == []


def test_quality_classifier(spark, docs, empty):
    good = [(i, " ".join(_words(80, i))) for i in range(100, 300)]
    bad = [(i, " ".join(w + "$$$" for w in _words(80, i))) for i in range(300, 400)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(100, 1, 0), (None, 1, 0), (7, None, 0), (9999, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(good + bad, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(more, table).collect()}
    for ids, label in ((good, 1), (bad, 0)):
        held = [i for i, _ in ids if zlib.crc32(str(i).encode()) % 3 == 1]
        assert all(got[i]["held_out"] for i in held)
        assert np.mean([got[i]["predicted"] == label for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality_classifier.quality_scores(empty, table).count() == 0
    assert {r["score"] for r in quality_classifier.quality_scores(docs, table.limit(0)).collect()} == {0.5}
    weights = quality_classifier.fit(more, table)
    assert quality_classifier.keep_good(docs, weights).columns == docs.columns


def test_warc(spark):
    long = "".join(chr(200 + i % 500) for i in range(50_000))
    rows = [(1, "http://a/x y", "<p>one</p>", "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", long, "z"), (5, "u", long, "z"), (6, "u", "\r\n\r\nWARC/1.1\r\n", "z"), (9, "u", "<p>one</p>", "z"), (None, "u", "lost", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages, segment_bytes=1000).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 9, None}
    first = {}
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        keep = first.setdefault(payload, i)
        assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == warc.digest(payload)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.warc_round_trip(pages, min_bytes=100).collect()}
    assert small[9] == "response" and small[5] == "revisit"


def test_warc_repeated_and_null_ids(spark):
    """Every row has its own records; of one payload the least id, null last, is the response."""
    rows = [(None, "u", "same"), (7, "u", "same"), (7, "u", "same"), (7, "u", "other"), (None, "u", "only"), (None, "u", "only"), (8, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect())
    assert got == Counter([(None, 4, "revisit", 7), (7, 4, "response", None), (7, 4, "revisit", 7), (7, 5, "response", None),
                           (None, 4, "response", None), (None, 4, "revisit", None), (8, 0, "response", None)])


def test_warc_files_are_bounded(spark, tmp_path, monkeypatch):
    """A large page is many records, so that the bound on records bounds a file."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 10)
    pages = spark.createDataFrame([(k, "u", chr(97 + k) * 200_000) for k in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=5000)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    assert len(files) >= 16
    assert {r["size"] for r in warc.payloads(warc.read_records(spark, str(tmp_path / "w"))).collect()} == {200_000}


def test_warc_payloads_and_missing_segment(spark):
    records = warc.records_of(3, 0, "u", b"x" * 5000, (3, 0), 600)
    assert len(records) > 5
    assert warc.unframe(warc.frame(b"abc" * 4000)) == b"abc" * 4000
    parsed = [(f, b) for r in records for f, b in warc.parse(r + b"\r\n\r\n")]
    rows = [(f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]),
             int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f["warc-type"], None,
             f.get("warc-payload-digest", "").removeprefix("sha1:"), b) for f, b in parsed]
    schema = "origin string, number int, total long, kind string, refers_to string, digest string, block binary"
    assert bytes(warc.payloads(spark.createDataFrame(rows[::-1], schema)).first()["payload"]) == b"x" * 5000
    with pytest.raises(Exception, match="segments missing"):
        warc.payloads(spark.createDataFrame(rows[:2] + rows[3:], schema)).collect()


def _drop_lines(rows, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    where = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n") if len(x.strip(" \t\n\x0b\x0c\r")) >= 40}:
            if i is not None:
                where[k].append(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(where[key(x)]) < min_docs or max(where[key(x)]) == i]
        out[i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


def test_line_dedup(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, line_dedup.line_dedup(docs).collect())) == _drop_lines(rows)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_parts_of_a_shard_in_one_partition(spark, docs, monkeypatch):
    """More parts than shuffle partitions: several copies of a shard's filter meet in one task."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    monkeypatch.setattr(line_dedup, "PART_PLACES", 2)
    index = line_dedup.LineIndex.build(docs)
    assert index.references.count() > 2 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = line_dedup.clean(docs, index.dropped(index.references), "doc_id", "text", line_dedup.MIN_CHARS, False)
    assert Counter(map(tuple, found.collect())) == _drop_lines(rows)


def test_line_dedup_is_reversible(spark, docs):
    """Inserting and deleting documents gives what building anew gives."""
    some = docs.where("doc_id < 14")
    index = line_dedup.LineIndex.build(some, n_shards=3).insert(docs.where("doc_id >= 14")).delete(spark.createDataFrame([(16,), (3,)], "doc_id long"))
    left = docs.where("doc_id NOT IN (16, 3)")
    found = line_dedup.clean(left, index.dropped(index.references), "doc_id", "text", 40, False)
    assert Counter(map(tuple, found.collect())) == _drop_lines([(r["doc_id"], r["text"]) for r in left.collect()])
    fewer = index.delete(spark.createDataFrame([(15,), (14,)], "doc_id long"))  # now in four documents only
    assert fewer.dropped(fewer.references).count() == 0


def test_line_index_grows(spark):
    """Inserting far more than an index was built for makes filters anew, and shards where need be."""
    def some(first, n):
        return spark.range(first, first + n).selectExpr("id AS doc_id", "concat('a line that stands in five documents, number ', id div 5) AS text")

    index = line_dedup.LineIndex.build(some(0, 60)).insert(some(60, 30_000))
    assert index.dropped(index.references).count() == 4 * 30_060 // 5
    small = line_dedup.LineIndex.build(some(0, 60))
    line_dedup.SHARD_KEYS, was = 64, line_dedup.SHARD_KEYS
    try:
        small = small.insert(some(60, 3000))
    finally:
        line_dedup.SHARD_KEYS = was
    assert small.n_shards > 1 and small.dropped(small.references).count() == 4 * 3060 // 5
    fewer = small.delete(spark.range(100, 3060).selectExpr("id"))
    assert fewer.dropped(fewer.references).count() == 80


def test_line_index_changes_write_what_they_change(spark, monkeypatch):
    """One document more or less in an index of 50,000 lines writes its lines, their counts and the filters of their shards."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('a line that stands in five documents, number ', id div 5, '\n', 'a line of its own that is long enough, number ', id) AS text")
    index = line_dedup.LineIndex.build(docs)
    written = {}

    def noted(df, what, real=line_dedup.materialise):
        out = real(df, what)
        written[what] = written.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", noted)
    one = spark.createDataFrame([(90_000, "a line that stands in five documents, number 7\na line that nobody else has written so far, at all")], "doc_id long, text string")
    more = index.insert(one)
    assert sum(written.values()) < 20
    assert more.references.count() == index.references.count() + 2 and more.dropped(more.references).count() == 20_000 + 1
    written.clear()
    less = more.delete(spark.createDataFrame([(90_000,), (35,)], "doc_id long"))
    assert sum(written.values()) < 30
    assert less.dropped(less.references).count() == 20_000 - 4  # number 7 is now in four documents
    assert less.counts.where("n_docs = 4").count() == 1


def test_line_dedup_rows_without_an_id_are_spread(spark):
    rows = [(None, f"{LONG_LINE}\nown {k}") for k in range(200)] + [(k, LONG_LINE) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, line_dedup.line_dedup(df).collect())) == _drop_lines(rows)


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 256, (5000, 16), dtype=np.uint8)
    f = line_dedup.CuckooFilter(4000)  # too small: some keys go to the stash
    f.insert(keys)
    assert f.contains(keys).all()
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.02


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(VOCAB)
    pieces = packing.pack(docs.dropDuplicates(["doc_id"]), VOCAB, length=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(empty, VOCAB).count() == 0


def test_word_tokenizer_cache(monkeypatch):
    """Ids by piece are the ids of whole texts: cache overflow, scripts, marks, signs, digits, special tokens."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    tok, model = packing.WordTokenizer(VOCAB), Tokenizer.from_file(VOCAB)
    assert tok.by_piece
    alphabet = [*"abzABZ09.,;!?#$%&|<>()[]\"'-_/\\*+=^~`@:{} \n\t", *"éÉßüÜñçãøØ×÷İıſŁσςΣдЖ中が…–“”\u00a0\u0301\u0338\u0307\u200d\x07\x7f", "<|endoftext|>", "<|", "|>", "'s", "'ll", "l'", "🙂", "\u1e9e"]
    rng = random.Random(3)
    texts = [" ".join(_words(70 if seed % 2 else 20, seed)) + " é <|endoftext|>x İ ﬁ İ. a<b" for seed in range(6)]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400)] + ["", "x" * 5000]
    for i in range(0, len(texts), 7):
        raw = [t.encode() for t in texts[i : i + 7]]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, bounds = tok.ids(data, np.cumsum([0, *map(len, raw)]))
        for t, a, b in zip(texts[i : i + 7], bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_tokenizer_of_other_rules():
    """A vocabulary whose words don't end where pieces do is applied to whole texts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, model = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert not tok.by_piece
    data = np.frombuffer(b"two  words, Here", np.uint8)
    assert tok.ids(data, np.array([0, len(data)]))[0].tolist() == model.encode("two  words, Here", add_special_tokens=False).ids


def test_hilbert():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_near_dedup(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                x, y = sets[i], sets[j]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[i] = root[j] = min((root[i], root[j]), key=lambda v: (v is None, v))
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(sets[i]), root[i]) for i, _ in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_a_template(spark, monkeypatch):
    """Documents of one template, too different to be linked, share buckets; links among them aren't lost in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    rng = random.Random(8)
    base, rows = _words(300, 3), []
    for k in range(90):
        words = list(base)
        for _ in range(7 if k % 9 else 0):
            words[rng.randrange(300)] = f"own{k}"
        rows.append((k, " ".join(words)))
        if k % 10 == 1:
            words[5] = "near"
            rows.append((1000 + k, " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 85 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    assert len(set(root.values())) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()} == root
    monkeypatch.setattr(near_dedup, "BLOOM_MOST", 5)  # the texts come by a join
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()} == root


def test_near_dedup_chain_of_copies(spark):
    """A group whose members are linked only step by step is one component, whatever the centres."""
    words, rows = _words(200, 5), []
    for k in range(60):
        words = list(words)
        words[3 * k % 200] = f"new{k}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if any(a != b and v in (a, b) for a, b in edges)}


def test_mixing(docs, empty):
    got = mixing.mixture(docs, block_words=8).collect()
    again = mixing.mixture(docs.repartition(2), block_words=8).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert len(got) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for size, target in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source_size"] == size) - target) <= 16
    assert mixing.mixture(empty).count() == 0
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    drawn = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    assert drawn == sum(r["taken"] for r in got)


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in pii.pii(docs).collect()}
    t = _texts()[21]
    spans = {tuple(s.split(":")[:1]) + (t[int(s.split(":")[1]) : int(s.split(":")[2])],) for s in got[21]["spans"].split(",")}
    assert spans == {("email", "a.b@c.org"), ("phone", "+1 (743) 555-3824"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111")}
    assert (got[21]["n_email"], got[21]["n_ip"], got[21]["n_card"], got[21]["n_phone"]) == (1, 1, 1, 1)
    assert got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.pii(empty).count() == 0


def test_pii_spans_in_order_and_at_length(spark):
    """Many matches in one text, matches that touch, and runs that a careless pattern takes quadratic time for."""
    text = "é a@b.cd_e@f.g " + "1.2.3.4 " * 600 + "9" * 5000 + " " + "q" * 50_000 + " 1.1.1.1.2.2.2.2 007.1.1.1"
    row = pii.pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    cut = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row["spans"].split(",")) if k != "card"]
    assert cut == ["a@b.cd", "_e@f.g"] + ["1.2.3.4"] * 600 + ["1.1.1.1", "2.2.2.2", "007.1.1.1"]


def _terms(spark, rows, of):
    """The distinct texts of the term spans of one document."""
    text = dict(rows)[of]
    spans = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[of]
    return {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans.split(",")) if k == "term"}


def test_pii_terms_of_frequent_entities(spark):
    """An address in a third of a small table: the term that stands with it alone is found, a common one isn't."""
    rows = [(k, f"write zarquon via boss@corp.org or common n{k}") for k in range(20)] + [(k, f"or write common words n{k}") for k in range(20, 60)]
    assert "zarquon" in _terms(spark, rows, 0) and not {"write", "or", "common"} & _terms(spark, rows, 0)
    # the address counts where no countable neighbour stands, too: in nearly all rows, so the term tells too little
    rows = [(k, f"zarquon boss@corp.org n{k}" if k < 20 else f"boss@corp.org n{k}") for k in range(60)] + [(k, f"zarquon n{k}") for k in range(60, 64)]
    assert _terms(spark, rows, 0) == set()


def test_pii_terms_anywhere_in_the_document(spark):
    """Short terms, terms far from the address, and every place of a term that gives an address away."""
    far = " ".join(["common"] * 40)
    rows = [(k, f"Bob {far} write boss@corp.org. {far} (bob) zarquon {far} Zarquon! n{k}") for k in range(10)]
    rows += [(k, f"{far} write boss{k}@other{k}.org") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [s.split(":") for s in pii.pii(df).where("doc_id = 0").first()["spans"].split(",")]
    assert [rows[0][1][int(a) : int(b)] for k, a, b in spans if k == "term"] == ["Bob", "(bob)", "zarquon", "Zarquon!"]
    clean = pii.Sanitiser(df).sanitised().where("doc_id = 0").first()["text"]
    assert "bob" not in clean.lower() and "zarquon" not in clean.lower() and "common" in clean


def test_kernels():
    import pyarrow as pa

    column = pa.array(["a bc  d", None, "", "é\tf"])
    (first, end, buf, offsets), = kernels.text_slices(column)
    s, e, row = kernels.words(buf, offsets)
    assert [bytes(buf[a:b]).decode() for a, b in zip(s, e, strict=True)] == ["a", "bc", "d", "é", "f"] and row.tolist() == [0, 0, 0, 3, 3]
    h = kernels.span_hashes(buf, s, e)
    assert len(set(h.tolist())) == 5
    assert [x[:2] for x in kernels.text_slices(column, 4)] == [(0, 1), (1, 4)] or len(list(kernels.text_slices(column, 4))) >= 2
