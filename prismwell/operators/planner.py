"""Device leases and backfill cycles by rounds, so that no cluster's queue sits in one task.

The sequential rule: jobs by (priority, job_id) take the first devices that fit and are free; a profile
holds ``most_parallel`` leases at most. Devices only ever go, so a job that does not fit now never will,
and a cluster's next leases are among its first fitting jobs. A round therefore drops the jobs that no
longer fit (a join with the clusters' states), takes each cluster's first few that do (a group limit,
which partitions apply before anything moves), and leases among these in order. As many jobs as a cluster
has devices are taken at most, and each round leases to at least one.

Profiles that share devices (``exclusive`` false) need no rounds: what such a job takes does not depend on
other leases, only on how many of its profile come before it. Jobs of no device are of that kind too.

Edge cases: a job of an unknown profile is rejected; null needs are none, a null limit is no limit; a job
with preferred devices sees no others; equal jobs are told apart by their place; an empty pool rejects all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import spread_join
from ..session import kept

#: Columns of devices, jobs and profiles; a cluster's column may have any name and type.
DEVICE = "device int, free_mib long, utilization int"
PROFILE = "profile string, needed int, min_free long, max_utilization int, most_parallel int, exclusive boolean"
_LAST = (1 << 31) - 1
_STATE = "device: int, free_mib: long, utilization: int, shared_from: struct<priority: int, job_id: string, n: bigint>, taken: boolean"


def _fits(d: Column) -> Column:
    """Whether a device suits a job at all."""
    wanted = F.col("preferred").isNull() | (F.size("preferred") == 0) | F.array_contains("preferred", d["device"])
    return wanted & (d["free_mib"] >= F.col("min_free")) & (d["utilization"] <= F.col("max_utilization"))


def _free(d: Column) -> Column:
    """Whether it is free when the job's turn comes."""
    return ~d["taken"] & (d["shared_from"].isNull() | (d["shared_from"] >= F.col("turn")))


def plan(devices: DataFrame, jobs: DataFrame, profiles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, job_id, profile, devices array<int>, status, reason) of every job.

    ``devices``: cluster and DEVICE; ``jobs``: cluster, job_id, profile, priority and, if there are any,
    preferred (array<int>); ``profiles``: PROFILE, unique by name. A cluster has a bounded number of devices.
    """
    kind = jobs.schema[cluster].dataType.simpleString()
    preferred = F.col("preferred").cast("array<int>") if "preferred" in jobs.columns else F.lit(None).cast("array<int>")
    key = F.col(cluster).cast("string").alias("cluster")
    asked = jobs.select(key, F.col("job_id").cast("string").alias("job_id"), "profile", F.coalesce(F.col("priority").cast("int"), F.lit(_LAST)).alias("priority"), preferred.alias("preferred"), F.monotonically_increasing_id().alias("n"))
    known = profiles.select("profile", F.coalesce("needed", F.lit(0)).alias("needed"), F.coalesce("min_free", F.lit(0)).alias("min_free"), F.coalesce("max_utilization", F.lit(100)).alias("max_utilization"), "most_parallel", F.coalesce("exclusive", F.lit(True)).alias("exclusive"), F.lit(True).alias("known"))
    queue = spread_join(asked, known, ["profile"], ["n"], "left").withColumn("turn", F.struct("priority", "job_id", "n"))
    queue = kept(queue.withColumn("shared", F.col("known") & (~F.col("exclusive") | (F.col("needed") == 0))))
    pool = devices.select(key, F.struct("device", F.col("free_mib").cast("long").alias("free_mib"), F.coalesce("utilization", F.lit(0)).alias("utilization")).alias("d"))
    pool = kept(pool.groupBy("cluster").agg(F.array_sort(F.collect_set("d")).alias("ds")))  # the few devices of a cluster

    # profiles that share: the first fitting devices, for the first jobs of each profile
    shared = spread_join(queue.where("shared"), pool, ["cluster"], ["n"], "left").withColumn("ds", F.coalesce("ds", F.array().cast("array<struct<device:int,free_mib:bigint,utilization:int>>")))
    fit = F.slice(F.transform(F.filter("ds", _fits), lambda d: d["device"]), F.lit(1), F.col("needed"))
    shared = shared.withColumn("devices", fit).where(F.size("devices") >= F.col("needed")).drop("ds")
    # ranks are needed up to a limit only, and limits are those of the profiles
    limits = [r["m"] for r in profiles.select(F.max("most_parallel").alias("m")).collect()]
    rank = F.row_number().over(Window.partitionBy("cluster", "profile").orderBy("turn"))
    bounded = shared.where("most_parallel is not null").withColumn("k", rank).where(F.col("k") <= (limits[0] or 0)).where("k <= most_parallel").drop("k")
    leases = kept(shared.where("most_parallel is null").unionByName(bounded).select("cluster", "profile", "job_id", "turn", "devices"))

    first = leases.select("cluster", "turn", F.explode("devices").alias("device")).groupBy("cluster", "device").agg(F.min("turn").alias("shared_from"))
    each = pool.select("cluster", F.inline("ds")).join(first, ["cluster", "device"], "left")
    state = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("device", "free_mib", "utilization", "shared_from", F.lit(False).alias("taken")))).alias("ds"))
    state = kept(state.withColumn("used", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).withColumn("after", F.lit(None).cast(queue.schema["turn"].dataType)))
    most = state.select(F.max(F.size("ds"))).first()[0] or 0
    open_jobs = queue.where("known and not shared")
    simulated = f"cluster string, profile string, job_id string, turn struct<priority: int, job_id: string, n: bigint>, devices array<int>, ds array<struct<{_STATE}>>, used map<string,int>"
    while most:
        met = spread_join(open_jobs, state, ["cluster"], ["n"]).where("after is null or turn > after")
        may = (F.size(F.filter("ds", lambda d: _fits(d) & _free(d))) >= F.col("needed")) & (F.col("most_parallel").isNull() | (F.coalesce(F.try_element_at("used", "profile"), F.lit(0)) < F.col("most_parallel")))
        turn = F.row_number().over(Window.partitionBy("cluster").orderBy("turn"))
        open_jobs = kept(met.where(may).drop("ds", "used", "after"))
        heads = open_jobs.withColumn("k", turn).where(F.col("k") <= most).drop("k")
        done = kept(heads.join(state.drop("after"), "cluster").groupBy("cluster").applyInPandas(_lease, simulated))
        if done.isEmpty():
            break
        leases = leases.unionByName(done.where("devices is not null").select("cluster", "profile", "job_id", "turn", "devices"))
        now = done.groupBy("cluster").agg(F.max("turn").alias("after"), F.max_by("ds", "turn").alias("ds"), F.max_by("used", "turn").alias("used"))
        state = kept(now.select("cluster", "ds", "used", "after"))

    # why the others got nothing: the limit, where it was reached before their turn
    nth = F.row_number().over(Window.partitionBy("cluster", "profile").orderBy("turn"))
    got = kept(leases)
    capped = spread_join(got, known.where("most_parallel is not null").select("profile", "most_parallel"), ["profile"], ["job_id"]).withColumn("k", nth)
    full = capped.where("k = most_parallel").select("cluster", "profile", F.col("turn").alias("full_at"))
    told = queue.join(got.select("cluster", "turn", "devices"), ["cluster", "turn"], "left")
    told = spread_join(told, full, ["cluster", "profile"], ["n"], "left")
    spent = F.coalesce((F.col("full_at") < F.col("turn")) | (F.col("most_parallel") <= 0), F.lit(False))
    reason = (
        F.when(F.col("devices").isNotNull(), "")
        .when(F.col("known").isNull(), "unknown profile")
        .when(spent, F.concat(F.lit("profile max_parallel="), F.col("most_parallel").cast("string"), F.lit(" reached")))
        .otherwise(F.concat(F.lit("need "), F.col("needed").cast("string"), F.lit(" GPU(s) with >= "), F.col("min_free").cast("string"), F.lit(" MiB free")))
    )
    status = F.when(F.col("devices").isNull(), "rejected").otherwise("leased")
    return told.select(F.col("cluster").cast(kind).alias(cluster), "job_id", "profile", "devices", status.alias("status"), reason.alias("reason"))


def _lease(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lease among a cluster's first fitting jobs, no more than it has devices, in their order."""
    devices = [dict(d) for d in pdf["ds"].iloc[0]]
    held = pdf["used"].iloc[0]
    used = dict(held if isinstance(held, dict) else list(held or []))
    out = []
    key = lambda t: (t["priority"], t["job_id"], t["n"])
    for j in sorted(pdf.to_dict("records"), key=lambda r: key(r["turn"])):
        wanted = set(j["preferred"]) if j["preferred"] is not None and len(j["preferred"]) else None
        fit = [
            d for d in devices
            if (wanted is None or d["device"] in wanted) and d["free_mib"] >= j["min_free"] and d["utilization"] <= j["max_utilization"]
            and not d["taken"] and (d["shared_from"] is None or key(d["shared_from"]) >= key(j["turn"]))
        ]
        count, limit = used.get(j["profile"], 0), j["most_parallel"]
        taken = None
        if len(fit) >= j["needed"] and (limit is None or limit != limit or count < limit):
            taken = [d["device"] for d in fit[: int(j["needed"])]]
            for d in fit[: int(j["needed"])]:
                d["taken"] = True
            used[j["profile"]] = count + 1
        out.append((j["cluster"], j["profile"], j["job_id"], j["turn"], taken, [dict(d) for d in devices], dict(used)))
    return pd.DataFrame(out, columns=["cluster", "profile", "job_id", "turn", "devices", "ds", "used"])


def idle(devices: DataFrame, planned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, device) that no lease holds."""
    return devices.select(cluster, "device").distinct().join(planned.select(cluster, F.explode("devices").alias("device")).distinct(), [cluster, "device"], "left_anti")


def backfill(devices: DataFrame, shards: DataFrame, outputs: DataFrame, profiles: DataFrame, reserved: Column, cluster: str = "cluster") -> DataFrame:
    """A cycle for independent shards: (cluster, job_id, profile, devices, status, reason), with status skipped for those that are done.

    ``shards`` has expected (array of paths) beside a job's columns; one is done if it expects some and
    all are among ``outputs`` (path). ``reserved`` names why a device is not to be used, null if it is.
    """
    rows = kept(shards.withColumn("_n", F.monotonically_increasing_id()))
    paths = rows.select("_n", F.explode(F.array_distinct("expected")).alias("path"))
    there = paths.join(outputs.select("path").distinct().withColumn("_there", F.lit(1)), "path", "left")
    done = there.groupBy("_n").agg((F.count("*") == F.count("_there")).alias("_done")).where("_done").select("_n")
    pending = rows.join(done, "_n", "left_anti").drop("_n", "expected")
    skipped = rows.join(done, "_n", "left_semi")
    planned = plan(devices.where(reserved.isNull()), pending, profiles, cluster)
    none = F.lit(None).cast("array<int>")
    return planned.union(skipped.select(cluster, F.col("job_id").cast("string"), "profile", none, F.lit("skipped"), F.lit("completed")))
