"""Queries of device plans: all orders are jobs, clusters are groups of customers, one of which has a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planner
from .register import query, table

_PROFILES = [(f"p{k}{e}", k, 9000 * k, 60 + 10 * k, (None, 2, 3, 4)[k], e == "x") for k in range(4) for e in "xs"]


def tables_of(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(devices, jobs, profiles) of a query."""
    o = table(spark, sf_dir, "orders")
    cluster = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 40 + 1).alias("cluster")
    pool = spark.range(41 * 8).select((F.col("id") % 41).alias("cluster"), F.floor(F.col("id") / 41).cast("int").alias("device"), (F.col("id") * 7919 % 80000).alias("free_mib"), (F.col("id") * 31 % 101).cast("int").alias("utilization"))
    priority = F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")
    if name == "device_leases":
        profile = F.concat(F.lit("p"), (F.col("o_orderkey") % 4).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "s").otherwise("x"))
        return pool, o.select(cluster, F.col("o_orderkey").alias("job_id"), profile.alias("profile"), priority), spark.createDataFrame(_PROFILES, planner.PROFILE)
    needs = spark.createDataFrame([(f"n{n}m{m}", n, 10_000 * m, 100, None, True) for n in (1, 2, 3) for m in range(5)], planner.PROFILE)
    profile = F.concat(F.lit("n"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("m"), (F.col("o_orderkey") % 5).cast("string"))
    return pool, o.select(cluster, F.col("o_orderkey").alias("job_id"), profile.alias("profile"), priority), needs


@query()
def device_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases depend on one another in order, beyond SQL; the test plans one job after the other."""
    return planner.plan(*tables_of(spark, sf_dir, "device_leases"))


@query()
def greedy_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for jobs that may run in any number, with devices as text."""
    p = planner.plan(*tables_of(spark, sf_dir, "greedy_leases"))
    reason = F.when(F.startswith("reason", F.lit("need")), "no_devices").otherwise(F.col("reason"))
    return p.select(F.col("job_id").cast("long").alias("job_id"), F.coalesce(F.array_join("devices", ","), F.lit("")).alias("devices"), "status", reason.alias("reason"))
