"""Readers of documents, prompts, listings and device inventories, as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept


def json_documents(spark: SparkSession, path: str, schema: str, strict: bool = True, default: list[tuple] | None = None) -> DataFrame:
    """One JSON object a file; a missing path gives the ``default`` rows, a root that is no object fails or is dropped."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(default or [], schema)
    root = F.try_parse_json("value")
    good = F.coalesce(F.startswith(F.schema_of_variant(root), F.lit("OBJECT")), F.lit(False))
    text = text.where(F.assert_true(good, "not a JSON object").isNull()) if strict else text.where(good)
    return text.select(F.from_json("value", schema).alias("d")).select("d.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are left out, a missing file fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt): from JSON with samples or prompts, from JSON lines, or one for each filled line; plain strings are prompts."""
    if path.endswith(".txt") or not path.endswith((".json", ".jsonl")):
        return spark.read.text(path).select(F.trim("value").alias("prompt")).where(F.length("prompt") > 0)
    items = "array<variant>"
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.parse_json("value").alias("v"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        inner = [F.try_variant_get("v", f"$.{k}", items) for k in ("samples", "prompts")]
        filled = F.coalesce(*[F.when(F.size(x) > 0, x) for x in inner], F.try_variant_get("v", "$", items), F.array("v"))
        rows = whole.select(F.explode(filled).alias("v"))
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    return rows.select(F.when(is_object, F.try_variant_get("v", "$.prompt", "string")).otherwise(F.try_variant_get("v", "$", "string")).alias("prompt"))


#: What a prompt file's row may say, by the names of its keys.
PROMPT_FIELDS = (
    "sample_id", "id", "prompt", "text", "user_request", "edit_instruction", "instruction", "negative_prompt", "original_prompt", "rewritten_prompt",
    "original_edit_instruction", "tier", "source_prompt_id", "rewrite_reason", "source_image",
)


def placed(rows: DataFrame) -> DataFrame:
    """``rows``, straight from a file source, with the place of their part of the file: what ``numbered`` needs."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered(rows: DataFrame, name: str = "idx") -> DataFrame:
    """``rows`` (from ``placed``, filtered or not) with their numbers from 0, in the order of files and of rows in them.

    Nothing is sorted: a part's rows follow one another in its task, and parts begin after those before
    them, whose counts, one a part, are all that reaches the driver.
    """
    spark = rows.sparkSession
    told = kept(rows.withColumn("_at", F.monotonically_increasing_id()))
    parts = told.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect()
    starts, before = [], 0
    for r in sorted(parts, key=lambda r: (r["_file"], r["_block"])):
        starts.append((r["_file"], r["_block"], before - r["low"]))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(starts, "_file string, _block long, _shift long"))  # one row a part
    return told.join(shift, ["_file", "_block"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_file", "_block", "_at", "_shift")


def prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    """(idx, PROMPT_FIELDS, constraints): every row of a prompt file with all its fields, in the file's order.

    The kinds of file are those of ``prompts``; a row that is no object is its own prompt. Values that
    are no strings are given as they are written; constraints is a list's JSON text, null for all else.
    """
    if path.endswith((".json", ".jsonl")):
        items = "array<variant>"
        if path.endswith(".jsonl"):
            lines = placed(spark.read.text(path)).where(F.length(F.trim("value")) > 0)
            rows = numbered(lines.withColumn("v", F.parse_json("value"))).select("idx", "v")
        else:
            whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
            inner = [F.try_variant_get("v", f"$.{k}", items) for k in ("samples", "prompts")]
            filled = F.coalesce(*[F.when(F.size(x) > 0, x) for x in inner], F.try_variant_get("v", "$", items), F.array("v"))
            rows = whole.select(F.posexplode(filled).alias("idx", "v"))
    else:
        lines = placed(spark.read.text(path)).where(F.length(F.trim("value")) > 0)
        rows = numbered(lines).select("idx", F.to_variant_object(F.struct(F.trim("value").alias("prompt"))).alias("v"))
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    field = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    of = {k: F.when(is_object, field(k)) for k in PROMPT_FIELDS} | {"prompt": F.when(is_object, field("prompt")).otherwise(F.try_variant_get("v", "$", "string"))}
    listed = F.try_variant_get("v", "$.constraints", "array<variant>")
    constraints = F.when(is_object & listed.isNotNull(), F.to_json(F.try_variant_get("v", "$.constraints", "variant")))
    return rows.select(F.col("idx").cast("int").alias("idx"), *[c.alias(k) for k, c in of.items()], constraints.alias("constraints"))


def action_space(spark: SparkSession, path: str) -> DataFrame:
    """(grp, action, target, delta_type, delta, lo, hi) of an action space's JSON document."""
    action = "struct<target:string,delta_type:string,delta:double,bounds:array<double>>"
    df = json_documents(spark, path, f"groups map<string,struct<actions:map<string,{action}>>>")
    named = df.select(F.explode("groups").alias("grp", "g")).select("grp", F.explode("g.actions").alias("action", "d"))
    return named.select("grp", "action", "d.target", "d.delta_type", "d.delta", F.col("d.bounds")[0].alias("lo"), F.col("d.bounds")[1].alias("hi"))


def seed_concepts(rows: DataFrame) -> DataFrame:
    """(id, name, category) of concepts; fails for one without id or name, for an id told twice, and for none at all."""
    t = rows.select(F.trim("id").alias("id"), F.trim("name").alias("name"), F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("unknown")).alias("category"))
    bad = t.agg(F.count("*").alias("n"), F.count_if((F.coalesce("id", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")).alias("blank"), F.count_distinct("id").alias("ids")).first()  # one row of counts
    if not bad["n"] or bad["blank"] or bad["ids"] < bad["n"]:
        raise ValueError(f"seed concepts: {bad['n']} rows, {bad['blank']} without id or name, {bad['ids']} different ids")
    return t


def overlaid(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with a default where a column is null or absent."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def depth_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, depth): the values of NumPy files, in the order of their names within a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def values(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                d = np.load(io.BytesIO(content), allow_pickle=False).ravel()
                for at in range(0, len(d), 100_000):
                    part = d[at : at + 100_000].astype(float)
                    yield pd.DataFrame({"file": name, "i": np.arange(at, at + len(part)), "depth": part})

    return files.mapInPandas(values, "file string, i long, depth double")


def object_documents(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One document for each object's folder, with the folder's name as obj_id."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/metadata.json")
    return df.withColumn("obj_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metadata\.json$", 1))


def file_listing(spark: SparkSession, root: str, patterns: list[str], digest: bool = False) -> DataFrame:
    """(path, length, modified[, sha256]) of files that match one of the patterns, each once."""
    out = None
    for p in patterns:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(root)
        cols = ["path", "length", F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if digest else [])]
        out = df.select(*cols) if out is None else out.union(df.select(*cols))
    return out.distinct()


def device_inventory(lines: DataFrame, col: str = "value") -> DataFrame:
    """(device, used_mib, total_mib, utilization) from an inventory's comma-separated lines."""
    body = F.regexp_replace(F.col(col), r",\s*P\d+\s*$", "")
    fields = F.transform(F.split(body, ","), lambda x: F.regexp_extract(x, r"^\s*(\d+)(?:\s*(?:MiB|%))?\s*$", 1).try_cast("int"))
    n = F.filter(fields, lambda x: x.isNotNull())
    return lines.select(n.alias("n")).where("size(n) >= 4").select(F.col("n")[0].alias("device"), F.element_at("n", -3).alias("used_mib"), F.element_at("n", -2).alias("total_mib"), F.element_at("n", -1).alias("utilization"))


def split_pairs(spark: SparkSession, root: str, split: str, schema: str) -> DataFrame:
    """The pairs of train, val, test or all; all falls back to train."""
    if split not in ("train", "val", "test", "all"):
        raise ValueError(f"unknown split: {split}")
    try:
        return json_lines(spark, f"{root}/pairs/{split}_pairs.jsonl", schema)
    except AnalysisException:
        if split != "all":
            raise
        return json_lines(spark, f"{root}/pairs/train_pairs.jsonl", schema)
