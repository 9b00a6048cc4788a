"""Lineage: changed files between snapshots, manifests, digests, incremental capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_files(before: DataFrame, after: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """(key, change) of every file of either snapshot: added, changed, unchanged or removed, by its marks."""
    b = before.select(key, F.struct(*marks).alias("_b"))
    a = after.select(key, F.struct(*marks).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def manifest(files: DataFrame, stage: str, size: str) -> DataFrame:
    """Files and bytes of each stage."""
    return files.groupBy(stage).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def status_histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each column's values by grouping sets, in one pass; nulls are left out."""
    n = len(columns)
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    out = rows.select(F.explode(each).alias("x")).where("x.value is not null")
    return out.groupBy(F.col("x.name").alias("name"), F.col("x.value").alias("value")).agg(F.count("*").alias("n")) if n else out.limit(0)


def counters(rows: DataFrame, key: str, cases: dict[str, Column]) -> DataFrame:
    """The total of each key, and how many rows each condition holds for."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in cases.items()])


def rollup(rows: DataFrame, key: str, name: Column, passes: Column) -> DataFrame:
    """(key, passes, failing): whether all rows of a key pass, and the names of those that do not, in order."""
    return rows.groupBy(key).agg(F.bool_and(passes).alias("passes"), F.array_sort(F.collect_list(F.when(~passes, name))).alias("failing"))


def evidence(rows: DataFrame, key: str, cite: str, tag: str, most: int = 8) -> DataFrame:
    """(key, langs, summaries): the different tags of each key, and its first citations in brackets."""
    tags = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("langs"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(cite))).where(F.col("_n") <= most)
    cited = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cite)), lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), " ").alias("summaries"))
    return tags.join(cited, key)
