"""Line-first cleaning with DataFrame functions only.

Every line is judged by three rules: punctuation (a stub without an end mark, strings of ``!!`` or ``??``, or a
tenth of its characters symbols), navigation (columns of separators) and boilerplate (stock phrases of four languages in a
line of ``MAX_FURNITURE`` characters at most, so that a phrase within prose fails nothing).  Failing lines go; a document
that loses more than half of its word characters is rejected.  Base measures of the whole text (length, repeated word
windows) reject on their own.

One scan and no shuffle: all of it is expressions over one row, so a plan is a projection whatever the table's size.
Work in a row is in proportion to its text (windows are compared by their hashes); lines are only searched for phrases
where the text has one.

Defined cases: null text counts as empty (no words: ``base_failed``); an empty table gives an empty result; repeated
rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, WS_CHARS, let, text_or_empty, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"

SEPARATORS = "|»·›•→"
MAX_FURNITURE = 300

# Stock phrases of page furniture, by language, matched without case.
BOILERPLATE = {
    "en": ("all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "read more",
           "released under the", "share this", "sign in", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use", "we use cookies"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "impressum", "javascript aktivieren", "jetzt abonnieren", "nach oben", "newsletter abonnieren",
           "nutzungsbedingungen", "verwendet cookies", "weiterlesen", "zum inhalt springen"),
    "fr": ("activer javascript", "aller au contenu", "cliquez ici", "conditions d'utilisation", "haut de page", "inscrivez-vous à notre newsletter", "lire la suite",
           "mentions légales", "politique de confidentialité", "se connecter", "tous droits réservés", "utilise des cookies"),
    "es": ("aviso legal", "haga clic aquí", "iniciar sesión", "ir al contenido", "leer más", "política de cookies", "política de privacidad", "suscríbete a nuestro boletín",
           "términos de uso", "todos los derechos reservados", "utiliza cookies", "volver arriba"),
}
PHRASES = tuple(p for phrases in BOILERPLATE.values() for p in phrases)


def _count(text: Column, chars: str) -> Column:
    """How many characters of a class there are."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _has_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in PHRASES]))


def repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            again = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, twice))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, 0).otherwise(let(windows, covered))


def line_fails(line: Column, chars: Column, phrases: Column) -> Column:
    """Whether a line with a word breaks a rule; ``chars``: what isn't white space in it, ``phrases``: whether the text has any."""
    trimmed = F.btrim(line, F.lit(WS_CHARS))
    ended = F.contains(F.lit(".!?:;…。！？\"'»”)]"), F.right(trimmed, F.lit(1)))
    stub = ~ended & ~trimmed.rlike(rf"[{WS}][^{WS}]+[{WS}]+[^{WS}]+[{WS}]+[^{WS}]")  # fewer than four words
    shouting = F.regexp_count(line, F.lit(r"[!?]{2,}")) >= 3
    separators = let(_count(line, SEPARATORS), lambda n: (n >= 3) & (n * 12 >= F.length(line)))
    boilerplate = phrases & (F.length(line) <= MAX_FURNITURE) & _has_phrase(line)
    return stub | (_count(line, SYMBOLS) * 10 > chars) | shouting | separators | boilerplate


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, kept, lost_chars and the cleaned text of every row."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{WS}]"))

    def judged(line: Column, phrases: Column) -> Column:
        chars = F.length(line) - _count(line, WS)
        return let(chars, lambda n: F.struct(n.alias("chars"), line_fails(line, n, phrases).alias("fails"), line.alias("line")))

    # bound, as a projection that names a flag once would be merged into the lambda and search the text for every line
    bound = F.struct(lines.alias("lines"), _has_phrase(F.col("t")).alias("phrases"))

    def found(b: Column) -> Column:
        dups = F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))
        return F.struct(dups.alias("dups"), F.transform(b["lines"], lambda x: judged(x, b["phrases"])).alias("judged"))

    measured = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
        .withColumn("word_chars", (F.length("t") - _count(F.col("t"), WS)).cast("long"))
        .withColumn("n_symbols", _count(F.col("t"), SYMBOLS).cast("long"))
        .withColumn("counted", let(words_of(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeats"))))
        .withColumn("found", let(bound, found))
    )
    lost = F.aggregate("found.judged", F.lit(0), lambda a, x: a + F.when(x["fails"], x["chars"]).otherwise(0))
    n, repeats = F.col("counted.n").cast("long"), F.col("counted.repeats").cast("long")
    out = measured.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("found.dups").cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        lost.cast("long").alias("lost_chars"),
        F.array_join(
            F.transform(F.filter("found.judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"
        ).alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars"))
    return out.select("*", kept.alias("kept"))
