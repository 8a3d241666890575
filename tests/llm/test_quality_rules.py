"""Quality rules: every measure and both verdicts against plain Python, over made-up and given texts."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from gridloom.llm import quality_rules

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, t string, found string, phrases string"


def judge(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost, kept, clean text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for k in range(len(words) - 2) if windows[words[k], words[k + 1], words[k + 2]] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if x.strip(WS)]
    clean, lost = [], 0
    for line in lines:
        own = line.strip(WS)
        parts = re.findall(r"[^\x20\x09-\x0D]+", own)
        bare = sum(map(len, parts))
        symbols = sum(c in "#*$%&|<>" for c in line)
        bars = sum(c in quality_rules.SEPARATORS for c in line)
        phrase = len(line) <= 300 and any(p in line.lower() for p in quality_rules.PHRASES)
        stub = own[-1] not in ".!?:;…。！？\"'»”)]" and len(parts) < 4
        if stub or symbols * 10 > bare or len(re.findall("[!?]{2,}", line)) >= 3 or (bars >= 3 and bars * 12 >= len(line)) or phrase:
            lost += bare
        else:
            clean.append(line)
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, lost, not failed and 100 * lost <= 50 * chars, "\n".join(clean))


def made_up(n, seed):
    rng = random.Random(seed)
    pieces = ["word", "Wort,", "fin.", "!!", "??", "###", "$5", "|", "»", "·", "•", "→", "a", "é…", "中文。", "(ok)", "x" * 30, *quality_rules.PHRASES[::3], "CLICK HERE"]
    out = []
    for _ in range(n):
        lines = [rng.choice([" ", "  ", "\t"]).join(rng.choices(pieces, k=rng.randrange(0, 14))) + rng.choice(["", ".", " ", "\r"]) for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.5:
            lines += rng.choices(lines, k=rng.randrange(1, 6))
        if rng.random() < 0.3:
            lines.append("A sentence of ordinary words says what it has to say, and goes on. " * rng.randrange(1, 9))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("source", ["made up", "given"])
def test_by_brute_force(spark, source):
    if source == "given":
        texts = [t.as_py() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)]
    else:
        texts = [*made_up(500, 3), "", " \n\t\n", "x" * 200_000, "one two three " * 3000, "\n" * 1000, *["the same words again in this row. " * 12] * 2]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(None, texts[0], "a", "b", "c"), (7, None, "a", "b", "c")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text"]
    by_text = {t: judge(t or "") for _, t, *_ in rows}
    expected = Counter((i, *by_text[t]) for i, t, *_ in rows)
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == expected
    verdicts = Counter((e[6], e[8]) for e in expected)
    assert verdicts[True, False] and verdicts[False, False] + verdicts[False, True] and (source == "made up" or verdicts[False, True])
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_furniture_of_four_languages(spark):
    """Menus and notices go, prose of each language stays, also where it holds a phrase."""
    prose = {
        "en": "The archive holds letters and maps, and whoever wants to read more about them may ask at the desk on any working day. ",
        "de": "Das Archiv bewahrt Briefe und Karten auf, und wer darin weiterlesen möchte, kann an jedem Werktag am Schalter danach fragen. ",
        "fr": "Les archives conservent des lettres et des cartes, et qui veut lire la suite peut la demander au guichet tous les jours ouvrables. ",
        "es": "El archivo guarda cartas y mapas, y quien quiera leer más sobre ellos puede preguntar en el mostrador cualquier día laborable. ",
    }
    rows = []
    for k, (lang, text) in enumerate(prose.items()):
        furniture = [f"{p[0].upper()}{p[1:]} · 2024." for p in quality_rules.BOILERPLATE[lang]]
        rows.append((k, "\n".join([text * 4, "Home | News | About | Help", *furniture, text * 3])))
        rows.append((10 + k, "\n".join([text[:60], *[f"{x} {i}" for i in range(5) for x in furniture]])))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in enumerate(prose.values()):
        assert got[k]["clean_text"] == f"{text * 4}\n{text * 3}" and got[k]["kept"] != got[k]["base_failed"]
        assert not got[10 + k]["kept"]
