"""Asset lifecycle in batch: stalls, queue claims, stale jobs, registry transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: when an asset counts as stalled, how often it is tried, when a job is stale
GOOD_ENOUGH, LEAST_GAIN, RECURRING_TAGS, MOST_ATTEMPTS, STALE_SECONDS = 0.58, 0.02, 2, 2, 7200


def recurring_tags(rows: DataFrame, key: str, tag: str, round_col: str, rounds: tuple[int, ...] = (1, 2, 3), least: int = 2) -> DataFrame:
    """(key, n): how many tags a key has in at least so many of the rounds."""
    seen = rows.where(F.col(round_col).isin(*rounds)).groupBy(key, tag).agg(F.count_distinct(round_col).alias("r"))
    return seen.groupBy(key).agg(F.count_if(F.col("r") >= least).alias("recurring"))


def stalled(scores: DataFrame, tags: DataFrame, key: str, round_col: str, score: str) -> DataFrame:
    """(key, best, gain, recurring, stalled): no good score in rounds 1 to 3, no gain, the same tags again."""
    by = scores.where(F.col(round_col).between(0, 3)).groupBy(key).agg(
        F.max(F.when(F.col(round_col) > 0, F.col(score))).alias("best"),
        F.max(F.when(F.col(round_col) == 0, F.col(score))).alias("start"),
        F.count_distinct(round_col).alias("rounds"),
    )
    met = by.where("rounds = 4").join(tags, key, "left").withColumn("recurring", F.coalesce("recurring", F.lit(0)))
    gain = F.col("best") - F.col("start")
    stall = (F.col("best") < GOOD_ENOUGH) & (gain < LEAST_GAIN) & (F.col("recurring") >= RECURRING_TAGS)
    return met.select(key, "best", gain.alias("gain"), "recurring", stall.alias("stalled"))


def claim_next(jobs: DataFrame, group: str, order: list[str], status: str = "status") -> DataFrame:
    """``jobs`` with the first queued job of each group running."""
    first = jobs.where(F.col(status) == "queued").groupBy(group).agg(F.min(F.struct(*order)).alias("_head"))
    met = jobs.join(first, group, "left")
    claimed = (F.col(status) == "queued") & (F.struct(*order) == F.col("_head"))
    return met.withColumn("status", F.when(F.coalesce(claimed, F.lit(False)), "running").otherwise(F.col(status))).drop("_head")


def recover_stale(status: Column, started: Column, now: Column, seconds: int = STALE_SECONDS) -> Column:
    """Running jobs without a start or with one too long ago are queued again."""
    age = F.timestamp_diff("SECOND", started, now)
    return F.when((status == "running") & (started.isNull() | (age >= seconds)), "queued").otherwise(status)


def replacement(active: Column, used: Column, most: int = MOST_ATTEMPTS) -> Column:
    """What a deprecated asset gets: nothing while a job is active, a new attempt, or a human."""
    return F.when(active > 0, "active_job").when(used + 1 > most, "manual_reprompt_required").otherwise("enqueued")
