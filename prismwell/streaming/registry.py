"""Incremental operation: registry state by key, and capture of changed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, attempts int, jobs int"
CHANGE = "asset_id long, status string, attempts int, jobs int"


def advance(status: str, attempts: int, jobs: int, event: str, most: int = 2) -> tuple[str, int, int]:
    """One event's effect on an asset: deprecate asks for a new attempt, promote and fail end it."""
    if event == "deprecate":
        if jobs:
            return status, attempts, jobs
        return ("manual_reprompt_required", attempts, 0) if attempts + 1 > most else ("regenerating", attempts + 1, 1)
    if event == "promote" and jobs:
        return "active", attempts, 0
    if event == "fail" and jobs:
        return ("manual_reprompt_required" if attempts >= most else "deprecated"), attempts, 0
    return status, attempts, jobs


def registry(events: DataFrame) -> DataFrame:
    """The state of each asset after the events (asset_id, seq, event) so far; works on streams."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("active", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for event in rows["event"]:
            now = advance(*now, event)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["asset_id", "status", "attempts", "jobs"])

    return events.groupBy("asset_id").applyInPandasWithState(update, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def registry_batch(events: DataFrame) -> DataFrame:
    """The same over a table, as a fold over each asset's events in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"])
    start = F.struct(F.lit("active").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("jobs"))

    def fold(acc, e):
        ask, idle = e == "deprecate", acc["jobs"] == 0
        spent = acc["attempts"] + 1 > 2
        status = (
            F.when(ask & idle & spent, "manual_reprompt_required")
            .when(ask & idle, "regenerating")
            .when((e == "promote") & ~idle, "active")
            .when((e == "fail") & ~idle & (acc["attempts"] >= 2), "manual_reprompt_required")
            .when((e == "fail") & ~idle, "deprecated")
            .otherwise(acc["status"])
        )
        attempts = F.when(ask & idle & ~spent, acc["attempts"] + 1).otherwise(acc["attempts"])
        jobs = F.when(ask & idle & ~spent, 1).when(e.isin("promote", "fail"), 0).otherwise(acc["jobs"])
        return F.struct(status.alias("status"), attempts.alias("attempts"), jobs.alias("jobs"))

    return events.groupBy("asset_id").agg(F.aggregate(ordered, start, fold).alias("s")).select("asset_id", "s.*")
