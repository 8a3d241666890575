"""A corpus from raw documents to packed sequences: each stage works on all rows that the one before it kept.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents.  All but the last return the columns of ``documents``.

Cases that hold for every stage: a null text counts as empty; an empty table gives an empty result; rows are kept or
dropped as rows, also where an id is null or repeated; further columns, whatever their names, are carried along by all
stages but the last, which reads id and text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import quality_classifier
from gridloom.llm.line_dedup import line_dedup
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.near_dedup import kept_documents
from gridloom.llm.packing import pack
from gridloom.llm.shared import materialise


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Empty texts have the score of the model's bias, so they share one verdict; with labels of no use every score is 0.5
    and all documents stay.
    """
    weights = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, weights)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for those of the largest id; documents stay, with the text that is left (empty for a null one).

    Rows that repeat an id each count as a document and share its fate; rows without an id keep all their lines.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = line_dedup(docs, with_text=True, columns=rest)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"carried_{c}").alias(c))
    return found.select(*columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least id, of rows that repeat it one.

    Linked are texts whose five-word shingles agree to 0.85, the operator's own threshold: from 0.8 on any will do here, and
    the higher one loses fewer documents that are merely alike.  Texts without words are linked with nothing and all stay.
    """
    return kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are taken whole, in part, or twice.

    A null source is a source of its own.  Texts without words give nothing to a mixture of words, so they go here.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, neighbours along a Hilbert curve together.

    Rows that repeat an id are packed each; a null id is packed, too, and named as null.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: No SQL: learnt weights, a pseudorandom mixture and a tokeniser are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
