"""The corpus pipeline: quality, near-copies, repeated passages, contamination, packing.

Each stage gets what its predecessor kept, as a table read back from Parquet, and its decision takes
effect: bad documents go, one document of each near-duplicate group stays, repeated passages are cut
out of the texts, contaminated documents go, and what is left is packed. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismwell.llm import decontaminate, near_copies, packing, quality, suffix_dedup
from prismwell.llm.common import scratch_path
from prismwell.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A passage that repeats is cut out from so many bytes on: some 35 words. Fifty words have about 310 bytes, few under 220.
REPEATED_BYTES = 200
#: Near copies share this part of their shingles of so many words, and are found with at least this chance.
SIMILARITY, WORDS, RECALL = 0.8, 5, 0.99


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the least id."""
    return near_copies.keep_one_per_group(docs, words=WORDS, least=SIMILARITY, recall=RECALL)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of ``REPEATED_BYTES`` that also start elsewhere."""
    rest = suffix_dedup.without_repeats(docs, length=REPEATED_BYTES)
    return rest.withColumn("n_chars", F.length("text").cast("long"))


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _shipped(quality_stage)),
    ("SimHash near-dedup", _shipped(near_copy_stage)),
    ("suffix-array dedup", _shipped(repeat_stage)),
    ("benchmark decontamination", _shipped(contamination_stage)),
    ("packing", _shipped(packing_stage)),
]

#: Fingerprints and token ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage applied to the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
