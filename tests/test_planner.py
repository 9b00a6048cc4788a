"""Leases by rounds against the sequential planner."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from prismwell.operators import planner, scheduling
from prismwell.plans.catalog import QUERIES

JOB = "cluster string, job_id string, profile string, priority int, preferred array<int>"
SF = "/root/testdata/sf0.001"


def in_turn(devices: list[tuple], jobs: list[tuple], profiles: dict[str, tuple]) -> list[tuple]:
    """One job after the other, cluster by cluster."""
    out = []
    for cluster in {j[0] for j in jobs}:
        own = sorted(d[1:] for d in devices if d[0] == cluster)
        allocated: set[int] = set()
        used: dict[str, int] = {}
        for _, job, profile, priority, preferred in sorted((j for j in jobs if j[0] == cluster), key=lambda j: (2**31 - 1 if j[3] is None else j[3], j[1])):
            if profile not in profiles:
                out.append((cluster, job, None, "unknown profile"))
                continue
            needed, least, most, limit, exclusive = profiles[profile]
            if limit is not None and used.get(profile, 0) >= limit:
                out.append((cluster, job, None, f"profile max_parallel={limit} reached"))
                continue
            ok = [d for d, free, busy in own if (not preferred or d in preferred) and free >= least and busy <= most and (not exclusive or d not in allocated)]
            if len(ok) < needed:
                out.append((cluster, job, None, f"need {needed} GPU(s) with >= {least} MiB free"))
                continue
            allocated.update(ok[:needed])
            used[profile] = used.get(profile, 0) + 1
            out.append((cluster, job, tuple(ok[:needed]), ""))
    return sorted(out, key=repr)


def planned(spark, devices: list[tuple], jobs: list[tuple], profiles: dict[str, tuple]) -> list[tuple]:
    pool = spark.createDataFrame(devices, "cluster string, " + planner.DEVICE)
    queue = spark.createDataFrame(jobs, JOB).repartition(3)
    known = spark.createDataFrame([(n, *p) for n, p in profiles.items()], planner.PROFILE)
    rows = planner.plan(pool, queue, known).collect()
    assert all((r["status"] == "leased") == (r["devices"] is not None) for r in rows)
    return sorted(((r["cluster"], r["job_id"], tuple(r["devices"]) if r["devices"] is not None else None, r["reason"]) for r in rows), key=repr)


PROFILES = {"big": (1, 60, 20, None, True), "pair": (2, 10, 90, 2, True), "any": (1, 0, 100, None, True), "one": (1, 30, 100, 1, True), "cpu": (0, 0, 100, 3, True), "view": (1, 20, 100, None, False), "view2": (2, 0, 100, 2, False), "none": (1, 0, 100, 0, True)}


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_sequential_planner(spark, seed):
    rng = random.Random(seed)
    devices = [(c, d, rng.randint(0, 80), rng.randint(0, 100)) for c in "abcdef" for d in range(rng.randint(0, 7))]
    jobs = [(c, f"j{k:03d}", rng.choice([*PROFILES, "unknown"]), rng.choice([1, 2, 3, None]), rng.choice([None, None, [], [0, 1, 2], [5]])) for c in "abcdef" for k in range(rng.randint(0, 30))]
    assert planned(spark, devices, jobs, PROFILES) == in_turn(devices, jobs, PROFILES)


def test_the_reasons_of_a_reserved_cluster(spark):
    """Two high-memory jobs do not fit and the third takes the first device; of two that may not run at a time one waits."""
    devices = [("x", 0, 81555, 0), ("x", 1, 81555, 0)]
    profiles = {"pano": (1, 83_000, 100, 1, True), "blender": (1, 0, 100, None, True), "low": (1, 0, 100, 1, True)}
    got = planned(spark, devices, [("x", "a", "pano", 1, None), ("x", "b", "pano", 2, None), ("x", "gate", "blender", 3, None)], profiles)
    assert got == [("x", "a", None, "need 1 GPU(s) with >= 83000 MiB free"), ("x", "b", None, "need 1 GPU(s) with >= 83000 MiB free"), ("x", "gate", (0,), "")]
    got = planned(spark, devices, [("x", "a", "low", 1, None), ("x", "b", "low", 2, None)], profiles)
    assert got == [("x", "a", (0,), ""), ("x", "b", None, "profile max_parallel=1 reached")]


def test_equal_jobs_and_empty_tables(spark):
    got = planned(spark, [("x", 0, 9, 0)], [("x", "a", "any", 1, None)] * 3, PROFILES)
    assert [g[2] for g in got].count((0,)) == 1 and len(got) == 3
    assert planned(spark, [], [("x", "a", "any", 1, None)], PROFILES) == [("x", "a", None, "need 1 GPU(s) with >= 0 MiB free")]
    assert planned(spark, [("x", 0, 9, 0)], [], PROFILES) == []


def test_backfill(spark):
    """Reserved and busy devices are left alone, done shards are skipped, what is left is idle."""
    pool = spark.createDataFrame([("x", 0, 81555, 0, 4), ("x", 1, 81555, 0, 4), ("x", 5, 16604, 0, 64955), ("x", 6, 81555, 0, 4), ("x", 7, 43818, 100, 37741)], "cluster string, " + planner.DEVICE + ", used_mib long")
    shards = spark.createDataFrame([("x", "gate", "scene", 1, None, None), ("x", "rot", "scene", 2, None, ["missing.txt", "done.txt"]), ("x", "audit", "cpu", 3, None, []), ("x", "old", "scene", 1, None, ["done.txt"])], JOB + ", expected array<string>")
    profiles = spark.createDataFrame([("scene", 1, 1000, 90, None, True), ("cpu", 0, 0, 100, None, True)], planner.PROFILE)
    none = F.array().cast("array<int>")
    reserved = scheduling.reservation(F.col("device"), none, none, F.col("used_mib"), F.col("utilization"))
    got = planner.backfill(pool, shards, spark.createDataFrame([("done.txt",)], "path string"), profiles, reserved).cache()
    assert {r["job_id"]: (r["status"], r["devices"]) for r in got.collect()} == {"gate": ("leased", [0]), "rot": ("leased", [1]), "audit": ("leased", []), "old": ("skipped", None)}
    assert [r["device"] for r in planner.idle(pool.where(reserved.isNull()), got).collect()] == [6]


@pytest.mark.parametrize("name", ["device_leases", "greedy_leases"])
def test_queries_equal_the_sequential_planner(spark, name):
    from prismwell.plans import planner_queries

    pool, jobs, profiles = planner_queries.tables_of(spark, SF, name)
    devices = [(str(r[0]), r["device"], r["free_mib"], r["utilization"]) for r in pool.collect()]
    queue = [(str(r[0]), str(r["job_id"]), r["profile"], r["priority"], None) for r in jobs.collect()]
    want = in_turn(devices, queue, {r["profile"]: (r["needed"], r["min_free"], r["max_utilization"], r["most_parallel"], r["exclusive"]) for r in profiles.collect()})
    rows = QUERIES[name](spark, SF).collect()
    if name == "device_leases":
        assert sorted(((str(r["cluster"]), r["job_id"], tuple(r["devices"]) if r["devices"] is not None else None, r["reason"]) for r in rows), key=repr) == want
    else:
        told = {"": "", "profile": "max_parallel", "need": "no_devices"}
        assert sorted((str(r["job_id"]), r["devices"], r["reason"]) for r in rows) == sorted((j, ",".join(map(str, d or ())), told[why.split(" ")[0]]) for _, j, d, why in want)
