"""From raw documents to packed training sequences, in five stages of the corpus operators.

Every stage but the last returns the columns of ``documents``; its decisions are in the rows and
texts it returns. ``run`` writes each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveloom.llm import language, lines, mixing, packing, simhash
from curveloom.llm.common import stored

#: Output of the language model below which a text is in no known language.
LEAST_SCORE = 0.2
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now (null for a null text)."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go. Without labelled rows
    nothing is known and all go; the language column stays as it is."""
    return language.identified_documents(docs.select(*COLUMNS), LEAST_SCORE)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in the document with the largest id only. A document
    that loses all its lines stays with an empty text."""
    return _documents(lines.drop_repeated_lines(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked by SimHash fingerprints of shingles of three words that differ in two
    bits or fewer, the document with the smallest id stays. Of documents without words one stays, and of rows without an
    id that are linked with none that has one too; an empty table stays empty."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them; those it does not take go. Null texts have no words and
    go; repeated rows are taken row by row; an empty table stays empty."""
    return _documents(mixing.mixed_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 identifiers. A null text is empty: its end identifier only; repeated
    rows are documents of their own; an empty table has no pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("source_mix", mixed_sources),
    ("packing", packed),
]

#: The language model and the fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
