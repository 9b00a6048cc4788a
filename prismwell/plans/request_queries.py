"""Queries of requests, prompts and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths, requests
from .register import query, table

_q = lambda s: s.replace("'", "''")
_SQUASH = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_BLANK = lambda x: f"nullif({_SQUASH(x)}, '')"
_RAW = "CASE p_partkey % 8 WHEN 0 THEN ' Text-To-Image ' WHEN 1 THEN 'T2I' WHEN 2 THEN 'image_edit' WHEN 3 THEN '3D' WHEN 4 THEN 'text2video' WHEN 5 THEN 'edit' WHEN 6 THEN 'audio' END"
_ROUTES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (requests.ALIASES | {r: r for r in requests.ROUTES}).items())
_ROUTE = f"CASE replace(lower(trim(coalesce(raw, ''))), '-', '_') {_ROUTES} END"


def _raw_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    raw = F.when(k == 0, " Text-To-Image ").when(k == 1, "T2I").when(k == 2, "image_edit").when(k == 3, "3D").when(k == 4, "text2video").when(k == 5, "edit").when(k == 6, "audio")
    return table(spark, sf_dir, "part").withColumn("route", raw)


@query(f"SELECT p_partkey, {_ROUTE} AS route FROM (SELECT p_partkey, {_RAW} AS raw FROM part)")
def route_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_routes(spark, sf_dir).select("p_partkey", requests.route(F.col("route")).alias("route"))


@query(f"""WITH r AS (SELECT *, {_ROUTE} AS route FROM (SELECT *, {_RAW} AS raw FROM part))
           SELECT p_partkey, route, trim(' ' || p_name || ' ') AS user_request, greatest(1, p_size - 20) AS num_samples, greatest(1, p_size // 20 - 1) AS vlm_max_retries,
           CASE WHEN route IS NULL THEN 'unsupported_route' WHEN route = 'edit' AND p_size <= 25 THEN 'input_image_dir_required' END AS error FROM r""")
def request_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_routes(spark, sf_dir).select(
        "p_partkey", "route", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("user_request"), F.lit(None).cast("string").alias("negative_prompt"), (F.col("p_size") - 20).alias("num_samples"),
        F.expr("p_size div 20 - 1").alias("vlm_max_retries"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ").alias("input_image_dir"),
    )
    return requests.build_requests(rows).select("p_partkey", "route", "user_request", "num_samples", "vlm_max_retries", "error")


@query("""WITH m AS (SELECT p_brand AS model_name, min(p_type) AS model_route, '/models/' || p_brand AS default_path FROM part GROUP BY 1),
               d AS (SELECT model_route AS route, min(model_name) AS d FROM m GROUP BY 1),
               q AS (SELECT p_partkey, p_type AS route, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'own-model' WHEN 2 THEN ' ' END AS model_name, CASE WHEN p_partkey % 5 = 0 THEN '/own/' || p_name END AS model_path FROM part),
               n AS (SELECT q.* REPLACE (coalesce(nullif(trim(q.model_name), ''), d) AS model_name) FROM q LEFT JOIN d USING (route))
          SELECT p_partkey, n.route, n.model_name, coalesce(nullif(trim(model_path), ''), default_path) AS model_path, m.model_route IS NOT NULL AS registry_hit, m.model_route IS NOT NULL AND m.model_route <> n.route AS mismatch
          FROM n LEFT JOIN m ON n.model_name = m.model_name""")
def model_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    models = p.groupBy(F.col("p_brand").alias("model_name")).agg(F.min("p_type").alias("model_route")).withColumn("default_path", F.concat(F.lit("/models/"), "model_name"))
    first = models.groupBy("model_route").agg(F.min("model_name").alias("first"))
    models = models.join(first, "model_route").withColumn("is_default", F.col("model_name") == F.col("first")).drop("first")
    k = F.col("p_partkey")
    asked = p.select("p_partkey", F.col("p_type").alias("route"), F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, "own-model").when(k % 4 == 2, " ").alias("model_name"), F.when(k % 5 == 0, F.concat(F.lit("/own/"), "p_name")).alias("model_path"))
    return requests.resolve_models(asked, models).select("p_partkey", "route", "model_name", "model_path", "registry_hit", "mismatch")


_TEMPLATE = lambda t: " || ".join(["base", *[f"'{_q(x)}'" if x != "{n}" else "CAST(idx + 1 AS VARCHAR)" for x in t.replace("{n}", "\0{n}\0").split("\0")]])
_PRESERVED = " OR ".join(f"contains(lower(said), '{w}')" for w in requests.PRESERVE_WORDS)


@query(f"""WITH r AS (SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 't2i' WHEN 1 THEN 'edit' WHEN 2 THEN 'blender' ELSE 't2v' END AS route, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_mktsegment || '  scene' END AS user_request,
                c_custkey % 3 + 1 AS num_samples, 's' || c_nationkey AS sample_prefix, CASE WHEN c_custkey % 5 = 0 THEN 'blur' ELSE '' END AS negative_prompt FROM customer),
           w AS (SELECT *, unnest(range(num_samples)) AS idx FROM r),
           f AS (SELECT o_custkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE ' ' END AS prompt, CASE WHEN o_orderkey % 4 = 0 THEN 'please  preserve ' || o_orderstatus END AS text,
                 CASE WHEN o_orderkey % 5 = 0 THEN 'o' || o_orderkey END AS sample_id, CASE WHEN o_orderkey % 6 = 0 THEN 'orig ' || o_orderkey END AS original_prompt FROM orders),
           b AS (SELECT w.*, coalesce({_BLANK("w.user_request")}, '{requests.NO_REQUEST}') AS base, coalesce({_BLANK("f.prompt")}, {_BLANK("f.text")}) AS told, {_BLANK("f.sample_id")} AS sid, {_BLANK("f.original_prompt")} AS orig FROM w LEFT JOIN f USING (request_id, idx)),
           s AS (SELECT *, CASE route WHEN 't2i' THEN coalesce(told, {_TEMPLATE(requests.T2I_PROMPT)}) WHEN 'edit' THEN coalesce(told, {_TEMPLATE(requests.EDIT_PROMPT)}) WHEN 't2v' THEN coalesce(told, {_TEMPLATE(requests.T2V_PROMPT)}) ELSE {_TEMPLATE(requests.BLENDER_PROMPT)} END AS said FROM b)
           SELECT request_id, CAST(idx AS BIGINT) AS idx, route, coalesce(sid, printf('%s_%04d', sample_prefix, idx + 1)) AS sample_id,
           CASE WHEN route <> 'edit' THEN said WHEN {_PRESERVED} THEN {_SQUASH("said")} ELSE {_SQUASH("said")} || '. {_q(requests.PRESERVATION)}' END AS prompt, coalesce(orig, said) AS original_prompt,
           CASE WHEN route = 't2v' THEN coalesce(nullif(negative_prompt, ''), '{requests.T2V_NEGATIVE}') END AS negative_prompt FROM s""")
def prompt_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.when(k % 4 == 0, "t2i").when(k % 4 == 1, "edit").when(k % 4 == 2, "blender").otherwise("t2v").alias("route"),
        F.when(k % 7 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit("  scene"))).alias("user_request"), (k % 3 + 1).alias("num_samples"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("sample_prefix"), F.when(k % 5 == 0, "blur").otherwise("").alias("negative_prompt"),
    )
    r = r.withColumn("num_samples", F.col("num_samples").cast("int"))
    o = F.col("o_orderkey")
    at = F.expr("row_number() over (partition by o_custkey order by o_orderkey) - 1")
    f = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"), at.alias("idx"), F.when(o % 3 == 0, F.col("o_orderpriority")).otherwise(" ").alias("prompt"), F.when(o % 4 == 0, F.concat(F.lit("please  preserve "), "o_orderstatus")).alias("text"),
        F.when(o % 5 == 0, F.concat(F.lit("o"), o.cast("string"))).alias("sample_id"), F.when(o % 6 == 0, F.concat(F.lit("orig "), o.cast("string"))).alias("original_prompt"),
    )
    return requests.build_prompts(r, f).withColumn("idx", F.col("idx").cast("long"))


@query("""WITH m AS (SELECT conv_id, turn, list_filter([struct_pack(k := 'original_prompt', v := text), struct_pack(k := 'tier', v := nullif(role, 'user')), struct_pack(k := 'rewrite_reason', v := CASE WHEN turn % 2 = 0 THEN '  ' END)], lambda x: x.v IS NOT NULL AND trim(x.v) <> '') AS m FROM conversations)
          SELECT conv_id, turn, array_to_string(list_transform(m, lambda x: x.k || '=' || substr(x.v, 1, 20)), ';') AS meta FROM m""")
def prompt_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    m = requests.row_metadata({"original_prompt": F.col("text"), "tier": F.nullif("role", F.lit("user")), "rewrite_reason": F.when(F.col("turn") % 2 == 0, "  ")})
    shown = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], 1, 20)))
    return c.select("conv_id", "turn", F.array_join(shown, ";").alias("meta"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '{requests.GEOMETRY_SUFFIX}' WHEN p_size % 10 = 1 THEN p_name || ', {requests.GEOMETRY_SUFFIX}' ELSE p_name || ', {requests.GEOMETRY_SUFFIX}' END AS prompt, printf('attempt_%02d', p_size) AS version_id FROM part""")
def geometry_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 10
    given = F.when(k == 0, "").when(k == 1, F.concat("p_name", F.lit(", " + requests.GEOMETRY_SUFFIX))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", requests.with_geometry_suffix(given).alias("prompt"), requests.attempt_id(F.col("p_size")).alias("version_id"))


@query("""WITH t AS (SELECT p_type AS name, min(p_brand) AS material, min(p_name) AS color FROM part WHERE p_size > 48 GROUP BY 1)
          SELECT p_partkey, 'a ' || coalesce(t.color, 'plain') || ' ' || coalesce(t.material, 'matte') || ' ' || p_type || ', ' || CASE WHEN p_size % 3 = 0 THEN 'with ' || p_name ELSE 'simple shape' END || ', studio photo' AS prompt FROM part LEFT JOIN t ON p_type = name""")
def template_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = p.where("p_size > 48").groupBy(F.col("p_type").alias("name")).agg(F.min("p_brand").alias("material"), F.min("p_name").alias("color")).withColumns({"style": F.lit(None).cast("string"), "geometry": F.lit("")})
    c = p.select("p_partkey", F.col("p_type").alias("name"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("with "), "p_name")).alias("features"))
    return requests.templated_prompt(c, t, {"material": "matte", "color": "plain", "style": "studio photo", "geometry": "simple shape"}).select("p_partkey", "prompt")


_PANO = "Unroll the view."


@query(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{_PANO} by hand' WHEN 1 THEN '{_PANO} ' || url ELSE '{_PANO} Preserve the generated ' || CASE WHEN page_id % 2 = 0 THEN 'indoor' ELSE 'outdoor' END || ' scene. Scene description: ' || trim(url) || ' Visual style: soft, warm. Layout constraints: ' || page_id || '.' END AS prompt FROM pages""")
def panorama_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    explicit = F.when(k % 3 == 0, f"{_PANO} by hand").when(k % 3 == 1, F.col("url"))
    made = requests.panorama_prompt(_PANO, explicit, F.col("url"), F.when(k % 2 == 0, "indoor"), F.array(F.lit("soft "), F.lit(" "), F.lit("warm")), F.array(k.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", made.alias("prompt"))


_REPAIR = {"geometry": (("cold", "hot"), "solid closed geometry"), "material": (("steel", "brass"), "clean material"), "lighting": (("widget",), "soft light"), "framing": (("small", "large"), "whole object in frame")}
_CLAUSES = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + f" THEN '{clause}' END" for words, clause in _REPAIR.values())


@query(f"SELECT p_partkey, array_to_string(list_filter([{_CLAUSES}], lambda x: x IS NOT NULL)[1:3], ', ') AS clauses FROM part")
def repair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", requests.repair_clauses(F.col("p_name"), _REPAIR).alias("clauses"))


@query("""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[;\\n]'), lambda p: regexp_replace(p, '^[\\s\\-*]+|[\\s\\-*]+$', '', 'g')), lambda p: length(p) > 0) AS l FROM documents)
          SELECT doc_id, len(l) AS n_items, l[1] AS first_item FROM t""")
def text_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = requests.coerced_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n_items"), F.try_element_at(parts, F.lit(1)).alias("first_item"))


# --- paths ---


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 7) ELSE url END AS path FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.relative_to(F.col("url"), F.lit("http:/")).alias("path"))


_SIDES = [f"{s}_{m}" for s in ("source", "target") for m in paths.MODALITIES]


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderkey % {k + 2} = 0 THEN '/abs/' || o_orderkey WHEN o_orderkey % {k + 3} > 0 THEN '/data/' || o_custkey || '/{c}' END AS {c}" for k, c in enumerate(_SIDES)) + " FROM orders")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    cols = [F.when(o % (k + 2) == 0, F.concat(F.lit("/abs/"), o.cast("string"))).when(o % (k + 3) > 0, F.concat(F.col("o_custkey").cast("string"), F.lit(f"/{c}"))).alias(c) for k, c in enumerate(_SIDES)]
    return paths.resolved(table(spark, sf_dir, "orders").select("o_orderkey", *cols), F.lit("/data"))


@query("""SELECT c_custkey, 'az' || lpad(CAST(c_custkey % 8 * 45 AS VARCHAR), 3, '0') || '_el' || CASE WHEN c_nationkey < 12 THEN '-' ELSE '+' END || lpad(CAST(abs(c_nationkey - 12) AS VARCHAR), 2, '0') || '.png' AS name,
          CAST(c_custkey % 8 * 45 AS INTEGER) AS azimuth, c_nationkey - 12 AS elevation FROM customer""")
def view_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = paths.view_name(F.col("c_custkey") % 8 * 45, F.col("c_nationkey") - 12)
    azimuth, elevation = paths.view_of(F.col("name"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).select("c_custkey", "name", azimuth.alias("azimuth"), elevation.alias("elevation"))


@query("""SELECT o_orderkey, o_custkey, coalesce('{"segment":"' || c_mktsegment || '"}', '{}') AS geometry FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def sample_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('"}'))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), doc.alias("doc"))
    return paths.enriched(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"geometry": c, "mask": c}, ("geometry",)).select("o_orderkey", "o_custkey", "geometry")


@query("SELECT o_custkey AS id, true AS found FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 UNION ALL SELECT o_custkey, false FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    got, missing = paths.looked_up(ids, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id")
    return got.withColumn("found", F.lit(True)).union(missing.withColumn("found", F.lit(False)))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN ['d' || o_custkey, 'd' || (o_custkey + 1)] ELSE [] END AS outs FROM orders), f AS (SELECT 'd' || c_custkey AS path FROM customer WHERE c_acctbal > -500)
          SELECT o_orderkey AS shard_id FROM (SELECT o_orderkey, unnest(outs) AS path FROM s) LEFT JOIN f USING (path) GROUP BY 1 HAVING bool_and(f.path IS NOT NULL)""")
def completed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda x: F.concat(F.lit("d"), x.cast("string"))
    c = F.col("o_custkey")
    shards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shard_id"), F.when(F.col("o_orderkey") % 9 > 0, F.array(name(c), name(c + 1))).otherwise(F.array().cast("array<string>")).alias("outputs"))
    return paths.completed(shards, table(spark, sf_dir, "customer").where("c_acctbal > -500").select(name(F.col("c_custkey")).alias("path")))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
          SELECT a.o_custkey, CAST(a.n AS INTEGER) AS n, a.o_orderkey, b.o_totalprice FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.n = b.n""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    left = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    right = o.where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice", F.col("o_orderkey").alias("k"))
    return paths.zipped(left, right, "o_custkey", ["o_orderkey"], ["o_totalprice", "k"]).drop("k")


@query("""WITH c AS (SELECT p_partkey, unnest([1, 2, 3]) AS pos, unnest([p_brand || '#x', p_type, p_name]) AS path FROM part), f AS (SELECT DISTINCT p_type AS path FROM part WHERE p_size < 3 UNION SELECT p_name FROM part WHERE p_size > 45)
          SELECT p_partkey, min_by(c.path, pos) FILTER (f.path IS NOT NULL) AS path FROM c LEFT JOIN f ON c.path = f.path GROUP BY 1""")
def first_existing_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = p.select("p_partkey", F.posexplode(F.array(F.concat("p_brand", F.lit("#x")), "p_type", "p_name")).alias("pos", "path"))
    files = p.where("p_size < 3").select(F.col("p_type").alias("path")).union(p.where("p_size > 45").select("p_name"))
    return paths.first_existing(c, files, "p_partkey")


@query("""WITH f AS (SELECT o_custkey, o_orderkey % 12 AS r, 'v' || o_orderkey || '_r' || lpad(CAST(o_orderkey % 12 AS VARCHAR), 2, '0') || '_agg.json' AS path FROM orders WHERE o_orderstatus <> 'P')
          SELECT o_custkey, CAST(max(r) AS INTEGER) AS round, max_by(path, (r, path)) AS path FROM f GROUP BY 1""")
def latest_round_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    end = F.when(F.col("o_orderstatus") == "P", "_trace.json").otherwise("_agg.json")
    name = F.concat(F.lit("v"), o.cast("string"), F.lit("_r"), F.lpad((o % 12).cast("string"), 2, "0"), end)
    return paths.latest_round(table(spark, sf_dir, "orders").select("o_custkey", name.alias("path")), "o_custkey", "path")


@query("SELECT o_orderstatus AS split, count(*) AS n_pairs, count(DISTINCT o_custkey) AS n_objects FROM orders GROUP BY 1")
def dataset_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.described(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "split"), "split", "o_custkey")
