"""Training pairs from the frames of rendered objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import signed_turn


def last_frames(frames: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One frame for each key: the last in order."""
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("last")
    return frames.groupBy(*keys).agg(last).select(*keys, "last.*")


def same_level_pairs(frames: DataFrame, obj: str = "obj_id", azimuth: str = "azimuth", elevation: str = "elevation", path: str = "path") -> DataFrame:
    """All ordered pairs of one object's frames at one elevation with different azimuths.

    Object and elevation are equi-join keys; the difference is a residual.
    """
    s = frames.select(F.col(obj).alias("obj_id"), F.col(elevation).alias("elevation"), F.col(azimuth).alias("source_azimuth"), F.col(path).alias("source_image"))
    t = frames.select(F.col(obj).alias("obj_id"), F.col(elevation).alias("elevation"), F.col(azimuth).alias("target_azimuth"), F.col(path).alias("target_image"))
    met = s.join(t, ["obj_id", "elevation"]).where("source_azimuth <> target_azimuth")
    return met.withColumn("azimuth_delta", signed_turn(F.col("source_azimuth"), F.col("target_azimuth")))


def cross_level_pairs(frames: DataFrame, obj: str = "obj_id", azimuth: str = "azimuth", elevation: str = "elevation", path: str = "path") -> DataFrame:
    """All ordered pairs of one object's frames at one azimuth with different elevations."""
    s = frames.select(F.col(obj).alias("obj_id"), F.col(azimuth).alias("azimuth"), F.col(elevation).alias("source_elevation"), F.col(path).alias("source_image"))
    t = frames.select(F.col(obj).alias("obj_id"), F.col(azimuth).alias("azimuth"), F.col(elevation).alias("target_elevation"), F.col(path).alias("target_image"))
    return s.join(t, ["obj_id", "azimuth"]).where("source_elevation <> target_elevation")


def object_split(ids: DataFrame, id_col: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(id, split): exactly floor(train n) and floor(val n) objects, the rest for tests, disjoint.

    Ids are ordered by a digest with the seed. A rank within each of 4096 digest ranges plus the
    number of ids in the ranges below gives the overall rank, so that no task sorts all ids.
    """
    keyed = ids.select(F.col(id_col).alias("id")).distinct()
    keyed = keyed.withColumn("d", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    keyed = keyed.withColumn("g", F.conv(F.substring("d", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy("g").agg(F.count("*").alias("c"))  # 4096 rows at most
    below = sizes.select("g", (F.sum("c").over(Window.orderBy("g")) - F.col("c")).alias("below"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("d", "id"))
    placed = keyed.withColumn("r", rank).join(F.broadcast(below), "g").withColumn("r", F.col("r") + F.col("below"))
    split = F.when(F.col("r") <= F.floor(F.col("n") * train), "train").when(F.col("r") <= F.floor(F.col("n") * train) + F.floor(F.col("n") * val), "val").otherwise("test")
    return placed.select("id", split.alias("split"))


def limit_with_reasons(rows: DataFrame, eligible, order: str, n: int) -> DataFrame:
    """``rows`` with a status: the first n eligible ones are reviewed, the others skipped with a reason.

    The n-th eligible key is found by a top-n, so no task orders all rows.
    """
    last = rows.where(eligible).orderBy(order).limit(n).agg(F.max(order).alias("last"), F.count("*").alias("got"))
    marked = rows.crossJoin(F.broadcast(last))  # one row
    status = F.when(~eligible, "skipped_missing_output").when((F.col("got") < n) | (F.col(order) <= F.col("last")), "reviewed").otherwise("skipped_limit")
    return marked.withColumn("review_status", status).drop("last", "got")


def expected_grid(objects: DataFrame, views: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per object: how many of the expected views exist, and whether all do. ``views`` is a short list."""
    grid = objects.crossJoin(views)
    met = grid.join(found.select(*keys).distinct().withColumn("exists", F.lit(True)), keys, "left")
    own = objects.columns
    return met.groupBy(*own).agg(F.count("*").alias("expected"), F.count("exists").alias("present"), F.bool_and(F.coalesce("exists", F.lit(False))).alias("complete"))


def keyframes(last: Column, most: int) -> Column:
    """The different frames, of 0 to ``last``, at even distances, half to even."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * last / float(most - 1), 0).cast("long"))
    return F.array_sort(F.array_distinct(picks))
