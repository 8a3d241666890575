"""Which filter removes what, in any order: an audit of filters by inclusion and exclusion.

1. Each document gets a flag per filter.  The filter for repeated texts compares 256-bit digests of whole texts with the
   smallest id that has the same one.
2. Documents are counted by part, flags and losses: a row for each combination that occurs, combined before the exchange.
3. For every set T of filters, J(T) is the number of documents that fail all of T: a sum of products of flags.
4. Möbius inversion turns joint failures into survivors, N(S) = sum over T within S of (-1)**|T| J(T), and with them into what any
   order of the filters keeps and removes at each step.
5. The game "documents removed by S" has the Harsanyi dividends (-1)**(|T| + 1) J(T); a filter's Shapley value is the sum of the
   dividends of its sets, each divided by its size.  Times the number of orders it is a whole number: what the filter removes,
   summed over all orders.

Defined cases: null texts count as empty and null sources as ''; a document is good (toxic) if some row of the labels with
its id says so; rows that repeat an id each count, and do not make each other a repetition; a row without an id has no
label, repeats nothing, and no other row repeats it; an empty table gives no parts, hence no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, materialise, spread_join, text_or_empty, words_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: The orders of more filters than this are too many to list.
MOST_FILTERS = 6


def text_flags(text: Column) -> Column:
    """A struct of the four filters that look at one text alone."""

    def judged(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        return F.struct(
            (n < LEAST_WORDS).alias("A"),
            (100 * distinct < 50 * n).alias("B"),
            (100 * upper > 2 * F.length(text)).alias("C"),
            text.rlike(r"[#$%&*|]").alias("D"),
        )

    return let(words_of(text), judged)


def flagged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic: a row for each document."""
    text = text_or_empty("text")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_flags(text).alias("f"),
    )
    slim = materialise(read.select("doc_id", "part", "digest", "f.*"), "flags")
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    out = spread_join(slim, firsts, ["digest"], "left").withColumn("E", repeated).drop("digest", "first")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    named, unnamed = out.where("doc_id IS NOT NULL"), out.where("doc_id IS NULL")
    named = spread_join(named, marks, ["doc_id"], "left").drop("doc_id").na.fill(False, ["good", "toxic"])
    return named.unionByName(unnamed.drop("doc_id").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def survivors(joint: list[Column]) -> list[Column]:
    """Möbius inversion: from J(T) at index T (a bit for each filter) to the number of documents that fail none of S."""
    out = list(joint)
    bit = 1
    while bit < len(out):
        out = [out[s ^ bit] - out[s] if s & bit else out[s] for s in range(len(out))]
        bit <<= 1
    return out


def _steps(filters: str) -> Column:
    """An array of (filter_order, step, f, before, after) for every order of the filters and every step of it."""
    rows = []
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            rows.append(f"struct('{name}', {step}, {k}, {before}, {before | 1 << k})")
            before |= 1 << k
    fields = "filter_order string, step int, f int, before int, after int".replace(", ", ",").replace(" ", ":")
    return F.expr(f"cast(array({', '.join(rows)}) AS array<struct<{fields}>>)")


def audit(flagged: DataFrame, filters: str = FILTERS, part: str = "part") -> DataFrame:
    """For each part, order of ``filters`` (names of flag columns of one letter) and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes from one to {MOST_FILTERS} filters")
    n, sets = len(filters), range(1 << len(filters))
    counted = flagged.groupBy(part, *filters, "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    flags = [F.col(f).cast("long") for f in filters]
    weights = {"j": F.col("n"), "g": F.col("n") * F.col("good").cast("long"), "t": F.col("n") * F.col("toxic").cast("long")}
    sums = [
        F.sum(reduce(lambda x, y: x * y, [flags[k] for k in range(n) if s >> k & 1], w)).alias(f"{name}{s}")
        for name, w in weights.items() for s in sets
    ]
    joint = counted.groupBy(part).agg(*sums)

    every = {name: survivors([F.col(f"{name}{s}") for s in sets]) for name in weights}
    alone = [every["j"][-1 ^ 1 << k] - every["j"][-1] for k in range(n)]
    orders = factorial(n)
    shapley = [
        reduce(add, [F.col(f"j{s}") * ((-1) ** (s.bit_count() + 1) * orders // s.bit_count()) for s in sets if s >> k & 1]) for k in range(n)
    ]
    tables = joint.select(
        F.col(part).alias("part"), *[F.array(*v).alias(name) for name, v in every.items()],
        F.array(*[F.col(f"j{1 << k}") for k in range(n)]).alias("failing"), F.array(*alone).alias("alone"), F.array(*shapley).alias("shapley"),
    )
    rows = tables.select("*", F.explode(_steps(filters)).alias("s"))
    at = lambda name, place: F.get(name, F.col(f"s.{place}"))
    removed = at("j", "before") - at("j", "after")
    return rows.select(
        "part", "s.filter_order", "s.step", at("j", "after").alias("kept"), removed.alias("removed"),
        (at("failing", "f") - removed).alias("redundant"), at("alone", "f").alias("unique_fails"),
        (at("g", "before") - at("g", "after")).alias("good_lost"), (at("t", "before") - at("t", "after")).alias("toxic_lost"),
        at("shapley", "f").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over documents, by source."""
    return audit(flagged_documents(docs, labels))
