"""Fusion of several views' scores: weighted scores, hard gates, blends, votes and top tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights, caps and cut-offs of the review score
WEIGHTS = {"lighting": 0.25, "object_integrity": 0.30, "composition": 0.20, "render_quality_semantic": 0.10, "overall": 0.15}
STUDIO, SCENE = (0.5, 0.5), (0.7, 0.3)
INTEGRITY_CAP, GATE_CAP, PASS_FROM, FIX_FROM = 0.69, 0.74, 0.80, 0.55


def review_score(scores: dict[str, Column]) -> Column:
    """The weighted mean of scores 1 to 5 as 0 to 1; a missing score counts as 3."""
    return sum((F.lit(w) * (F.coalesce(scores[k], F.lit(3)) - 1) / 4.0 for k, w in WEIGHTS.items()), F.lit(0.0))


def hybrid_score(review: Column, cv: Column, integrity: Column, gate: Column, scene: bool = False) -> Column:
    """Both scores mixed, capped where integrity is 2 or less or a hard gate failed."""
    a, b = SCENE if scene else STUDIO
    mixed = review * a + cv * b
    mixed = F.when(integrity <= 2, F.least(mixed, F.lit(INTEGRITY_CAP))).otherwise(mixed)
    return F.when(gate, F.least(mixed, F.lit(GATE_CAP))).otherwise(mixed)


def route(score: Column) -> Column:
    return F.when(score >= PASS_FROM, "pass").when(score >= FIX_FROM, "needs_fix").otherwise("reject")


def blend(value: str) -> Column:
    """Seven tenths of the mean and three of the worst."""
    return 0.7 * F.avg(value) + 0.3 * F.min(value)


def majority(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value, votes): the most frequent value, of equals the one seen first."""
    votes = rows.groupBy(key, value).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("_first"))
    ranked = votes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "_first", value)))
    return ranked.where("_n = 1").select(key, value, "votes")


def top_values(rows: DataFrame, key: str, value: str, order: list[str], k: int, leave_out: str | None = None, fallback: str = "none") -> DataFrame:
    """(key, joined): the k most frequent values, of equals those seen first, joined by commas."""
    votes = rows.groupBy(key, value).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("_first"))
    counted = F.lit(True) if leave_out is None else F.col(value) != leave_out
    ranked = votes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(counted), F.desc("votes"), "_first", value)))
    best = F.array_sort(F.collect_list(F.when(counted, F.struct("_n", value))))
    out = ranked.where(F.col("_n") <= k).groupBy(key).agg(best.alias("best"))
    return out.select(key, F.when(F.size("best") == 0, fallback).otherwise(F.array_join(F.transform("best", lambda x: x[value]), ",")).alias("top"))


def worst(rank: Column, names: list[str]) -> Column:
    """The name of the greatest rank in a group; ranks count from zero."""
    return F.element_at(F.array(*map(F.lit, names)), F.max(rank).cast("int") + 1)


def highest_and_first(rows: DataFrame, key: str, rank: str, value: str, order: list[str]) -> DataFrame:
    """(key, highest, first_status): the highest rank of each key, and the value of its first row."""
    return rows.groupBy(key).agg(F.max(rank).alias("highest"), F.min_by(value, F.struct(*order)).alias("first_status"))
