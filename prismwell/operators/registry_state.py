"""Registry and queue rows between batches: repair, restarts, status changes, snapshots, runs, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .requests import attempt_id, with_geometry_suffix

# fixed values: what a registry entry and a queue's job may be
REGISTRY = ("active", "deprecated_pending_replacement", "manual_reprompt_required", "replacement_failed", "deprecated")
QUEUE = ("queued", "running", "completed", "failed", "cancelled")
MOST_RESTARTS = 2


def repaired(entries: DataFrame, ids: DataFrame, key: str = "canonical_id") -> DataFrame:
    """An entry for each of ``ids`` and ``entries``: what lacks or cannot be is set to its default, the active version is among the versions.

    ``entries``: key, status, attempts_used, restarts, active_version, versions (array of structs version_id, status); unique by key.
    """
    met = ids.select(key).distinct().join(entries, key, "full_outer")
    known = lambda s: F.when(s.isin(*REGISTRY), s).otherwise("active")
    active = F.coalesce(F.nullif(F.trim("active_version"), F.lit("")), attempt_id(F.lit(0)))
    none = F.array().cast("array<struct<version_id:string,status:string>>")
    versions = F.transform(F.coalesce("versions", none), lambda v: F.struct(v["version_id"].alias("version_id"), F.when(v["version_id"] == F.col("active_version"), known(v["status"])).otherwise(v["status"]).alias("status")))
    there = F.exists("versions", lambda v: v["version_id"] == F.col("active_version"))
    own = F.array(F.struct(F.col("active_version").alias("version_id"), F.lit("active").alias("status")))
    out = met.withColumns({"created": F.col("status").isNull() & F.col("active_version").isNull(), "active_version": active, "status": known(F.col("status")), "attempts_used": F.coalesce("attempts_used", F.lit(0)), "restarts": F.coalesce("restarts", F.lit(0))})
    return out.withColumn("versions", versions).withColumn("versions", F.when(there, F.col("versions")).otherwise(F.concat("versions", own)))


def version_of(versions: Column, version_id: Column) -> Column:
    """The first version of that id, null without one."""
    return F.try_element_at(F.filter(versions, lambda v: v["version_id"] == version_id), F.lit(1))


def restart(active_job: Column, restarts: Column, attempt: Column, most: int = MOST_RESTARTS) -> dict[str, Column]:
    """What a request to start over gives: no job while one is active, a manual prompt beyond the limit, else the next attempt."""
    spent = restarts >= most
    asked = ~active_job & ~spent
    return {
        "status": F.when(active_job, F.lit(None).cast("string")).when(spent, "manual_reprompt_required").otherwise("deprecated_pending_replacement"),
        "restarts": F.when(asked, restarts + 1).otherwise(restarts), "job_attempt": F.when(asked, attempt + 1), "enqueued": asked,
    }


def set_status(queue: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``queue`` after the changes (key, attempt, new_status): the first job of that key and attempt takes the status, if it is one."""
    first = F.row_number().over(Window.partitionBy(key, "attempt").orderBy(*order))
    met = queue.withColumn("_n", first).join(changes.dropDuplicates([key, "attempt"]), [key, "attempt"], "left")
    hit = (F.col("_n") == 1) & F.col("new_status").isin(*QUEUE)
    return met.withColumn("status", F.when(hit, F.col("new_status")).otherwise(F.col("status"))).drop("_n", "new_status")


def snapshots(entries: DataFrame, prompts: DataFrame, key: str, add_suffix: Column) -> DataFrame:
    """(key, version_id, prompt): the active versions with the prompts they were made from."""
    met = entries.join(prompts, key, "left")
    return met.select(key, F.col("active_version").alias("version_id"), F.when(add_suffix, with_geometry_suffix(F.col("prompt"))).otherwise(F.col("prompt")).alias("prompt"))


def latest_run(runs: DataFrame, scene: str, run: str, at: str, status: str = "status") -> DataFrame:
    """(scene, run, status): each scene's last run among those whose ids are well formed."""
    ok = runs.where(F.col(run).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"))
    return ok.groupBy(scene).agg(F.max(F.struct(at, run, status)).alias("m")).select(scene, f"m.{run}", f"m.{status}")


def appended(session: DataFrame, evidence: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``evidence`` numbered on from what each session holds already."""
    have = session.groupBy(key).agg(F.count("*").alias("_have"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return evidence.withColumn("_n", n).join(have, key, "left").withColumn("citation_id", F.coalesce("_have", F.lit(0)) + F.col("_n")).drop("_have", "_n")


def with_defaults(state: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """``state`` (key, param, value) with the default of each parameter that a key lacks; ``defaults`` is a short table (param, value)."""
    grid = state.select(key).distinct().crossJoin(defaults.withColumnRenamed("value", "_default"))
    return grid.join(state, [key, "param"], "left").select(key, "param", F.coalesce("value", "_default").alias("value"))


def legal_actions(space: DataFrame) -> DataFrame:
    """(action, grp, target, delta): each action as the first group that has it defines it; ``space`` has grp, grp_pos, pos, action, target, delta."""
    first = space.withColumn("_n", F.row_number().over(Window.partitionBy("action").orderBy("grp_pos", "pos", "grp"))).where("_n = 1")
    return first.select("action", "grp", "target", "delta")


def compound(values: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Each key's values after its compound's steps, in order: (key, target, value, applied, primary).

    ``steps``: key, pos, target, delta_type, delta, lo, hi. Steps on one target follow one another: a product
    or a sum, kept within the bounds. ``primary`` marks the target of the first step that changed a value.
    """
    step = F.struct("pos", "delta_type", "delta", "lo", "hi")
    ordered = steps.groupBy(key, "target").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # the few steps of a compound
    moved = lambda acc, s: F.greatest(s["lo"], F.least(s["hi"], F.when(s["delta_type"] == "mul", acc * s["delta"]).otherwise(acc + s["delta"])))
    out = values.join(ordered, [key, "target"]).select(key, "target", F.col("value").alias("before"), F.aggregate("steps", F.col("value"), moved).alias("value"), F.element_at("steps", 1)["pos"].alias("pos"))
    applied = F.col("value") != F.col("before")
    first = F.min(F.when(applied, F.col("pos"))).over(Window.partitionBy(key))
    return out.select(key, "target", "value", applied.alias("applied"), F.coalesce(applied & (F.col("pos") == first), F.lit(False)).alias("primary"))


def promoted(actions: DataFrame, compounds: DataFrame, key: str, blocked: Column, has_context: Column) -> DataFrame:
    """Each chosen action, or the first compound of its group that holds it and is not blocked, where tags give a context."""
    met = actions.join(compounds, ["grp", "action"], "left").withColumn("_ok", F.col("compound").isNotNull() & ~blocked & has_context)
    best = F.min_by("compound", F.when(F.col("_ok"), F.col("compound_pos")))
    return met.groupBy(key, "action").agg(best.alias("_c")).select(key, F.coalesce("_c", "action").alias("action"))


def active_group(override: Column, said: Column, round_idx: Column, order: tuple[str, ...]) -> Column:
    """The group that is worked on: as demanded, as reviewed, or by turns."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(filled(override), filled(said), F.element_at(F.array(*map(F.lit, order)), (F.pmod(round_idx, F.lit(len(order))) + 1).cast("int")))
