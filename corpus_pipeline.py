"""The training-data pipeline: five stages, each a table that the next one reads.

Languages that can't be told go, one document of each near-duplicate group stays, leaked
benchmark passages take their documents with them, personal data get surrogates, and what
is left is mixed to the sources' target weights.

Defined results: null and blank texts have no language and go with the first stage; repeated rows and
repeated texts leave one document; columns that a stage doesn't know stay as they are up to the mixture;
an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontam, jaccard, langid, mixing, pii
from paperloom.llm.common import discard, read_table, settled
from paperloom.llm.queries import PII_KEY

#: Least share of a document's letters in one language.
MIN_LANGUAGE_SCORE = 0.4
#: Words in a shingle and the similarity, in hundredths, from which documents are near duplicates.
DUPLICATE_WORDS, DUPLICATE_SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, DUPLICATE_WORDS, DUPLICATE_SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.anonymize_in_place(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture itself, a row per slot: shard, slot, source, block, doc_ids and words."""
    return mixing.blocks(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
#: Iterative joins, alignments and fitted models: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus that the stages make of `documents`."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:  # one copy of the texts at a time
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
