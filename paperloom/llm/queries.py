"""One query per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontam, jaccard, langid, minhash, mixing, negatives, pii, quality, secrets, substring, warc, whitening
from paperloom.llm.common import read_table
from paperloom.llm.oracles import ORACLE  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
#: Of the example queries; a user passes their own.
PII_KEY = b"paperloom example key"


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymize(read_table(spark, sf_dir, "documents"), PII_KEY)


def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "spans")


def warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_windows(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read_table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return bpe.token_counts(read_table(spark, sf_dir, "documents"), path(TOKENIZER))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": pii_surrogates,
    "op2_language_spans": language_spans,
    "op3_warc_chain": warc_chain,
    "op4_benchmark_leaks": benchmark_leaks,
    "op5_secret_links": secret_links,
    "op6_window_dedup": window_dedup,
    "op7_quality_divergence": quality_divergence,
    "op8_mixing_blocks": mixing_blocks,
    "op9_jaccard_join": jaccard_join,
    "op10_token_counts": token_counts,
    "op11_hard_negatives": hard_negatives,
    "op12_embedding_whitening": embedding_whitening,
    "op13_minhash_near": minhash_near,
}
