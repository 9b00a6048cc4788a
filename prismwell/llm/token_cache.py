"""Token counts through a digest cache.

A content's digest is the SHA-256 of its UTF-8 bytes, null as empty; a tokenizer's version is the
digest of its file. The cache is a Parquet table (tokenizer, digest, n_tokens) in shared storage.
Contents that it lacks are made distinct before their texts are moved, encoded once each, and
appended; the counts are then joined to every row.

Edge cases: a null or empty text has no tokens; repeated rows get a row each; null ids are kept; an
empty table gives no rows and appends nothing; extra columns are not read. Rows that another job
has appended twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, text_bytes
from .tokens import encoder, version_digest

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def stored_counts(docs: DataFrame, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for one tokenizer version; none if there is no cache yet."""
    spark = docs.sparkSession
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text", id_col: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_tokens, over_limit and the content's digest.

    Encodes only distinct contents that the cache at ``cache_path`` lacks, and appends them to it.
    """
    version = version_digest(tokenizer_path)
    content = docs.select(F.col(id_col).alias("_id"), text_bytes(text).alias("_text"))
    content = content.withColumn("digest", F.sha2("_text", 256))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for pdf in batches:
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": [len(i) // 4 for i in enc.ids(pdf["_text"].tolist())]})
        enc.trim()

    known = stored_counts(docs, cache_path, version)
    missing = content.select("digest", "_text") if known.isEmpty() else content.select("digest", "_text").join(known, "digest", "left_anti")
    fresh = missing.groupBy("digest").agg(F.first("_text").alias("_text")).mapInPandas(encode, "digest string, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = stored_counts(docs, cache_path, version)
    sizes = content.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "digest")
    joined = salted_join(sizes, counts, ["digest"])
    return joined.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
