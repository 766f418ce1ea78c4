"""A training-data pipeline in five stages: classify, dedup exactly, dedup near copies, mix, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import bpe, classifier, common, exact, minhash, mixing

#: Documents that score below are rejected.
LEAST_QUALITY = 0.3
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of those at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.fit(docs, labels)
    rows = common.packed(docs, _text=common.text_of("text"))
    return common.unpacked(classifier.score(rows, model, "_text", "_score").filter(F.col("_score") >= LEAST_QUALITY), docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time: one taken twice is there twice."""
    mixed = mixing.mix(docs, whole_rows=True).filter("taken > 0")
    times = F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long"))
    return common.unpacked(mixed.select("_row", F.explode(times).alias("_time")), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives its bytes back."""
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.encode(rows, VOCABULARY, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.encode(common.text_of("text"), "UTF-8")).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Learned scores, hashed signatures and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
