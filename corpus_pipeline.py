"""Training corpus from raw documents: five stages, each written before the next one reads it.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, the sources are mixed to their target weights, and the mix is written as token files.
Part of the subpackage ``llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vocarium.llm import decontamination, mixing, simhash, token_files, toxicity
from vocarium.llm.queries import TOKENIZER
from vocarium.llm.rows import table
from vocarium.session import written

#: Near-duplicate documents share this much of their five-word shingles; see ``simhash.alike``.
SHINGLE = 5
SIMILARITY = 0.8


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of those still there, does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs, SHINGLE, similarity=SIMILARITY)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a second copy is a row of its own."""
    return mixing.mixture(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they say of each document."""
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_duplicates),
    ("decontamination", without_benchmarks),
    ("mix", mixed),
    ("token_files", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are not expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None
