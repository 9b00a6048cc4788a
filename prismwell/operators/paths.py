"""Paths and files as columns: relative and absolute paths, naming schemes, lookups, and what is already done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the modalities of a view in a finished dataset
MODALITIES = ("image", "mask", "depth", "normal", "depth_vis", "normal_vis", "geometry", "render_metadata", "control_state")


def relative_to(path: Column, root: Column) -> Column:
    """The path below ``root``; one that lies elsewhere stays as it is."""
    lead = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, lead), F.substr(path, F.length(lead) + 1)).otherwise(path)


def resolved(df: DataFrame, root: Column, sides: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """All path columns of both sides, those that there are, below ``root``; absolute ones and nulls stay."""
    cols = [f"{s}_{m}" for s in sides for m in MODALITIES if f"{s}_{m}" in df.columns]
    return df.withColumns({c: F.when(F.startswith(c, F.lit("/")), F.col(c)).otherwise(F.concat(root, F.lit("/"), F.col(c))) for c in cols})


def view_name(azimuth: Column, elevation: Column) -> Column:
    """az045_el-10.png and the like."""
    sign = F.when(elevation < 0, "-").otherwise("+")
    return F.concat(F.lit("az"), F.lpad(azimuth.cast("string"), 3, "0"), F.lit("_el"), sign, F.lpad(F.abs(elevation).cast("string"), 2, "0"), F.lit(".png"))


def view_of(name: Column) -> tuple[Column, Column]:
    """(azimuth, elevation) of such a name."""
    part = lambda k: F.regexp_extract(name, r"az(\d{3})_el([+-]\d{2,})\.png$", k).try_cast("int")
    return part(1), part(2)


def enriched(rows: DataFrame, key: str, modalities: dict[str, DataFrame], wanted: tuple[str, ...]) -> DataFrame:
    """``rows`` with the wanted modalities' documents, each a table (key, doc); '{}' where there is none."""
    for name in wanted:
        doc = modalities[name].select(key, F.col("doc").alias(name))
        rows = rows.join(doc, key, "left").withColumn(name, F.coalesce(name, F.lit("{}")))
    return rows


def looked_up(ids: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``table`` for these ids, ids that it lacks)."""
    return ids.join(table, key, "inner"), ids.join(table, key, "left_anti")


def completed(shards: DataFrame, files: DataFrame, key: str = "shard_id", outputs: str = "outputs") -> DataFrame:
    """The ids of shards that name outputs and have them all; ``files`` has a column path."""
    named = shards.select(key, F.explode(outputs).alias("path")).distinct()
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    met = named.join(there, "path", "left")
    return met.groupBy(key).agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("done")).where("done").select(key)


def zipped(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other, as far as both reach."""
    number = lambda order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return left.withColumn("n", number(left_order)).join(right.withColumn("n", number(right_order)), [key, "n"])


def first_existing(candidates: DataFrame, files: DataFrame, key: str, pos: str = "pos", path: str = "path") -> DataFrame:
    """(key, path): the first candidate of each key that exists; null if none does."""
    met = candidates.join(files.select(path).distinct().withColumn("_there", F.lit(True)), path, "left")
    return met.groupBy(key).agg(F.min_by(path, F.when(F.col("_there"), F.col(pos))).alias("first"), F.max(F.coalesce("_there", F.lit(False))).alias("found")).select(key, F.when(F.col("found"), F.col("first")).alias(path))


def latest_round(files: DataFrame, key: str, path: str, pattern: str = r"_r(\d{2})_agg\.json$") -> DataFrame:
    """(key, round, path): the last file of the highest round of each key."""
    found = files.withColumn("round", F.regexp_extract(path, pattern, 1).try_cast("int")).where("round is not null")
    return found.groupBy(key).agg(F.max(F.struct("round", path)).alias("m")).select(key, "m.round", f"m.{path}")


def described(pairs: DataFrame, split: str, obj: str) -> DataFrame:
    """Rows and objects of each split."""
    return pairs.groupBy(split).agg(F.count("*").alias("n_pairs"), F.count_distinct(obj).alias("n_objects"))
