"""Queries of reviews, measured scores and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, gates, lineage, requests, reviews, scheduling
from .register import query, table

_ROUND = lambda x, n=4: f"(floor(({x}) * {float(10**n)} + 0.5) / {float(10**n)})"
_ANY = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_LIST = lambda cases: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in cases) + "], lambda x: x IS NOT NULL)"

# --- coercion of what a model says ---

_TAGS = ("underexposed", "color_shift", "shadow_missing")


@query(f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 7 = 1 THEN NULL ELSE CAST(event_id % 11 - 2 AS VARCHAR) END AS s, value / 40.0 AS d, event_type,
                   [CASE WHEN event_id % 3 = 0 THEN 'underexposed' ELSE 'odd' END, CASE WHEN event_id % 4 = 0 THEN 'color_shift' ELSE 'odd' END] AS tags, [CASE WHEN event_id % 2 = 0 THEN 'M_VALUE_UP' ELSE 'FLY' END, 'NO_OP', 'O_LIFT_SMALL'] AS acts,
                   CASE event_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN ' ' ELSE ' broken ' END AS reason FROM events),
           t AS (SELECT *, list_filter(tags, lambda x: x IN ('underexposed', 'color_shift', 'shadow_missing')) AS lt, list_filter(acts[1:2], lambda x: x IN ('M_VALUE_UP', 'O_LIFT_SMALL', 'NO_OP')) AS la FROM r)
           SELECT event_id, greatest(1, least(5, coalesce(TRY_CAST(s AS INTEGER), 3))) AS lighting, greatest(1, least(5, CAST(trunc(d) AS INTEGER))) AS overall, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'good' END AS diagnosis,
           CASE WHEN len(lt) > 0 THEN array_to_string(lt, ',') ELSE 'none' END AS tags, CASE WHEN len(la) > 0 THEN array_to_string(la, ',') ELSE 'NO_OP' END AS actions,
           CASE WHEN lower(trim(reason)) NOT IN ('none', 'null', 'n/a', 'na', '') THEN trim(reason) END AS reason FROM t""")
def review_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    said = F.when(k % 7 == 0, "x").when(k % 7 == 1, F.lit(None).cast("string")).otherwise((k % 11 - 2).cast("string"))
    tags = F.array(F.when(k % 3 == 0, "underexposed").otherwise("odd"), F.when(k % 4 == 0, "color_shift").otherwise("odd"))
    actions = F.array(F.when(k % 2 == 0, "M_VALUE_UP").otherwise("FLY"), F.lit("NO_OP"), F.lit("O_LIFT_SMALL"))
    legal = F.array(F.lit("M_VALUE_UP"), F.lit("O_LIFT_SMALL"))
    reason = F.when(k % 5 == 0, " N/A ").when(k % 5 == 1, " ").otherwise(" broken ")
    return table(spark, sf_dir, "events").select(
        "event_id", reviews.coerced_score(said).alias("lighting"), reviews.coerced_score(F.col("value") / 40.0).alias("overall"), reviews.one_of(F.col("event_type"), ("click", "view"), "good").alias("diagnosis"),
        F.array_join(reviews.kept_tags(tags, _TAGS), ",").alias("tags"), F.array_join(reviews.kept_actions(actions, legal), ",").alias("actions"), reviews.none_to_null(reason).alias("reason"),
    )


# --- free reviews ---

_PIECES = [(words[0], f"p_partkey % {m} = {m - 1}") for (words, _, _, _), m in zip(reviews.FAMILIES.values(), (3, 4, 5, 7, 6, 8, 9, 10, 11, 13), strict=True)]
_PIECES += [("severe", "p_partkey % 2 = 0"), ("acceptable", "p_partkey % 5 = 1"), ("unusable", "p_partkey % 4 = 1"), ("needs regeneration", "p_partkey % 17 = 0"), ("\nAsset viability: Abandon\nAbandon reason: none\nAbandon confidence: low\n", "p_partkey % 19 = 0"), ("\nasset viability: continue\n", "p_partkey % 23 = 0")]
_TEXT_SQL = "concat_ws(' ', p_name, " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in _PIECES) + ")"
_HAS = {n: _ANY("low", f[0]) for n, f in reviews.FAMILIES.items()}
_CAPPED = lambda s: " OR ".join(_HAS[n] for n, f in reviews.FAMILIES.items() if f[3] == s)
_HINT = "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{h.lower()}') THEN '{h}' END" for h in reviews.ABANDON_HINTS) + ")"
_LAST = lambda p: f"list_extract(regexp_extract_all(txt, '{p}', 1), -1)"


@query(f"""WITH t AS (SELECT p_partkey, {_TEXT_SQL} AS txt FROM part), l AS (SELECT *, lower(txt) AS low, lower({_LAST("(?im)^\\s*Asset viability:\\s*(continue|abandon|unclear)\\b")}) AS line, lower({_LAST("(?im)^\\s*Abandon confidence:\\s*(low|medium|high|none)\\b")}) AS sure FROM t),
           v AS (SELECT *, {_HINT} AS hint, {_HAS["wrong"]} AS wrong FROM l),
           a AS (SELECT *, coalesce(line, CASE WHEN hint IS NOT NULL THEN 'abandon' END, 'unclear') AS st, CASE WHEN line IS NULL THEN hint END AS rs, CASE WHEN line IS NOT NULL THEN CASE WHEN sure IN ('low', 'medium', 'high') THEN sure END WHEN hint IS NOT NULL THEN 'high' END AS cf FROM v),
           r AS (SELECT *, {_LIST([(_HAS[n], f[1]) for n, f in reviews.FAMILIES.items() if f[1]])} AS raw, {_LIST([(_HAS[n], x) for n, f in reviews.FAMILIES.items() for x in f[2]])} AS acts FROM a),
           f AS (SELECT *, {_ANY("low", reviews.KEEP_WORDS)} AND len(raw) = 0 AS passes, {_ANY("low", reviews.REJECT_WORDS)} AND len(raw) >= 2 AS rejects, CASE WHEN wrong THEN 'abandon' ELSE st END AS state FROM r),
           d AS (SELECT *, state = 'abandon' AND NOT passes AS dropped, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS ut, list_filter(acts, lambda x, i: list_position(acts, x) = i) AS ua FROM f)
           SELECT p_partkey, CASE WHEN dropped OR rejects THEN 'reject' WHEN passes THEN 'pass' ELSE 'needs_fix' END AS route, {", ".join(f"CASE WHEN {_CAPPED(s)} THEN 2 ELSE 3 END AS {s}" for s in reviews.SCORES[:4])},
           CASE WHEN dropped OR rejects THEN 2 WHEN passes THEN 4 ELSE 3 END AS overall, CASE WHEN len(ut) > 0 THEN array_to_string(ut[1:3], ',') ELSE 'none' END AS issue_tags, CASE WHEN len(ua) > 0 THEN array_to_string(ua[1:2], ',') ELSE 'NO_OP' END AS suggested_actions,
           CASE WHEN {_HAS["light"]} THEN 'scene_light_mismatch' WHEN {_HAS["dark"]} THEN 'underexposed_global' WHEN {_HAS["shadow"]} THEN 'shadow_missing' ELSE 'good' END AS lighting_diagnosis, CASE WHEN wrong THEN 'major_mismatch' ELSE 'good' END AS structure_consistency,
           CASE WHEN {_HAS["color"]} THEN CASE WHEN {_ANY("low", reviews.MAJOR_WORDS)} THEN 'major_shift' ELSE 'minor_shift' END WHEN {_HAS["dark"]} THEN 'minor_shift' ELSE 'good' END AS color_consistency,
           CASE WHEN {_HAS["floating"]} OR {_HAS["sunk"]} THEN 'minor_issue' ELSE 'good' END AS physics_consistency, state AS asset_viability,
           CASE WHEN wrong AND st <> 'abandon' THEN coalesce(rs, 'wrong object geometry') ELSE rs END AS abandon_reason, CASE WHEN wrong AND st <> 'abandon' THEN coalesce(cf, 'high') ELSE cf END AS abandon_confidence FROM d""")
def keyword_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", *[F.when(F.expr(c), F.lit(t)) for t, c in _PIECES])
    got = reviews.keyword_review(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text").drop("text")
    return got.withColumns({c: F.array_join(c, ",") for c in ("issue_tags", "suggested_actions")})


_LOGS = {
    "hyworld_pano_oom": "CUDA out of memory in panogen", "cuda_oom": "torch.OutOfMemoryError", "blender_missing": "blender: command not found",
    "worldmirror_viewmap_mismatch": "WorldMirror reconstruction has only 0 aligned frames", "nccl_collective_failure": "NCCL invalid usage", "unknown": "stopped",
}


@query("SELECT event_id, [" + ", ".join(f"'{k}'" for k in _LOGS) + "][CAST(event_id % 6 AS INTEGER) + 1] AS failure, ['" + "', '".join(scheduling.ACTIONS[k] for k in _LOGS) + "'][CAST(event_id % 6 AS INTEGER) + 1] AS action FROM events")
def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.element_at(F.array(*map(F.lit, _LOGS.values())), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", scheduling.failure_class(log).alias("failure"))
    return e.withColumn("action", scheduling.recommended_action(F.col("failure")))


# --- scores ---


@query("""WITH k AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'text_ban' WHEN 1 THEN 'instruction_following' WHEN 2 THEN 'artifact_quality' ELSE 'edit_locality' END AS kind FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT o_custkey, list_distinct(list(kind)) AS k FROM k GROUP BY 1)
          SELECT o_custkey, CASE WHEN list_contains(k, 'text_ban') AND len(k) > 1 THEN 'text_artifact,prompt_constraint_miss' WHEN list_contains(k, 'text_ban') THEN 'text_artifact' ELSE 'prompt_constraint_miss' END AS tags,
          coalesce(nullif(concat_ws(',', CASE WHEN list_contains(k, 'instruction_following') THEN 'instruction_not_followed' END, CASE WHEN list_contains(k, 'edit_locality') THEN 'edit_not_local' END, CASE WHEN list_contains(k, 'artifact_quality') THEN 'edit_artifact' END), ''), 'edit_constraint_miss') AS edit_tags FROM s""")
def issue_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "text_ban").when(k == 1, "instruction_following").when(k == 2, "artifact_quality").otherwise("edit_locality")
    kinds = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.collect_set(kind).alias("k"))  # four kinds at most
    return kinds.select("o_custkey", F.array_join(reviews.tags_of_kinds(F.col("k")), ",").alias("tags"), F.array_join(reviews.edit_tags_of_kinds(F.col("k")), ",").alias("edit_tags"))


_KINDS = ["instruction_following", "source_preservation", "edit_locality", "identity_consistency", "artifact_quality"]


@query(f"""WITH r AS (SELECT o_custkey, o_orderkey, {_KINDS}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS kind, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'uncertain' ELSE 'pass' END AS status FROM orders)
           SELECT o_custkey, {", ".join(f"CASE WHEN max_by(status, (status = 'uncertain', o_orderkey)) FILTER (kind = '{k}') = 'fail' THEN 2 ELSE 4 END AS {k}" for k in _KINDS)} FROM r WHERE status <> 'pass' GROUP BY 1""")
def edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "uncertain").otherwise("pass")
    return reviews.edit_scores(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("kind"), status.alias("status")), "o_custkey", "o_orderkey", F.lit(4))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity / 50.0 END AS m, l_discount * 10 AS e, l_tax * 12 AS p, l_quantity / 60.0 AS f FROM lineitem)
           SELECT l_orderkey, l_linenumber, CASE WHEN m IS NOT NULL THEN {_ROUND("m * 0.30 + e * 0.25 + p * 0.20 + f * 0.25")} ELSE {_ROUND("e * 0.556 + p * 0.444")} END AS studio, {_ROUND("e * 0.45 + p * 0.35 + f * 0.20")} AS scene FROM s""")
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = [F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 50.0), F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 60.0]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reviews.cv_score(*s).alias("studio"), reviews.cv_score(*s, scene=True).alias("scene"))


def _framing_sql(weak: bool) -> str:
    low, high = (0.08, 0.80) if weak else (0.15, 0.65)
    a, b, c = (0.20, 0.45, 0.35) if weak else (0.45, 0.35, 0.20)
    return f"""CASE WHEN n = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, {a} * (1.0 - sqrt(pow((x0 + x1) / 2.0 - 320.0, 2) + pow((y0 + y1) / 2.0 - 240.0, 2)) / (800.0{"" if weak else " / 2.0"} + 1e-8))
        + {b} * greatest(0.0, CASE WHEN n / 307200.0 < {low} THEN n / 307200.0 / {low} WHEN n / 307200.0 > {high} THEN 1.0 - (n / 307200.0 - {high}) / (1.0::DOUBLE - {high}::DOUBLE) ELSE 1.0 END)
        + {c} * (1.0 - 0.25 * (CAST(y0 < 5 AS INTEGER) + CAST(y1 > 475 AS INTEGER) + CAST(x0 < 5 AS INTEGER) + CAST(x1 > 635 AS INTEGER))))) END"""


@query(f"""WITH b AS (SELECT o_orderkey, CAST(o_orderkey % 300 AS INTEGER) AS x0, CAST(o_orderkey % 200 AS INTEGER) AS y0, CAST(639 - o_orderkey % 310 AS INTEGER) AS x1, CAST(479 - o_orderkey % 210 AS INTEGER) AS y1, CAST(o_custkey % 20 * 15000 AS INTEGER) AS n FROM orders)
           SELECT o_orderkey, round({_framing_sql(False)}, 9) AS framing, round({_framing_sql(True)}, 9) AS weak FROM b""")
def framing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = tuple(x.cast("int") for x in (k % 300, k % 200, 639 - k % 310, 479 - k % 210))
    n = (F.col("o_custkey") % 20 * 15000).cast("int")
    score = lambda weak: F.round(reviews.framing_score(box, n, F.lit(640), F.lit(480), weak), 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", score(False).alias("framing"), score(True).alias("weak"))


@query(f"""SELECT o_custkey, {_ROUND("avg(o_orderkey % 5 + 1)", 2)} AS lighting, {_ROUND("avg(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 / 100.0 END)")} AS mask, bool_or(o_orderstatus = 'P') AS flagged, {_ROUND("0.7 * " + _ROUND("avg(o_orderkey % 100 / 100.0)") + " + 0.3 * min(o_orderkey % 100 / 100.0)")} AS blend FROM orders GROUP BY 1""")
def view_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select("o_custkey", (k % 5 + 1).alias("lighting"), F.when(k % 3 == 0, k % 100 / 100.0).alias("mask"), (F.col("o_orderstatus") == "P").alias("flagged"), (k % 100 / 100.0).alias("q"))
    blends = v.groupBy("o_custkey").agg(reviews.blended_rounded("q").alias("blend"))
    return reviews.view_means(v, "o_custkey", ("lighting",), ("mask",), "flagged").join(blends, "o_custkey")


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'fail' WHEN 'purchase' THEN 'uncertain' END AS s FROM events), c AS (SELECT user_id, count(*) FILTER (s = 'pass') AS passed, count(*) FILTER (s = 'fail') AS failed, count(*) FILTER (s = 'uncertain') AS uncertain, count(s) AS total FROM r GROUP BY 1)
          SELECT *, coalesce(passed / nullif(total, 0), 0.0) AS pass_rate FROM c""")
def video_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return reviews.video_rate(table(spark, sf_dir, "events").select("user_id", F.when(t == "click", "pass").when(t == "view", "fail").when(t == "purchase", "uncertain").alias("status")), "user_id")


@query("""WITH p AS (SELECT l_orderkey, l_quantity * 5 AS r, l_discount * 2500 AS g, l_tax * 3000 AS b, l_linenumber * 36.0 AS y FROM lineitem)
          SELECT l_orderkey, round((avg(r) + avg(g) + avg(b)) / 3, 6) AS mean, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) AS std, round(stddev_pop(y), 6) AS luma_std, count(*) FILTER (y >= 9) / count(*) AS nonblack, count(*) FILTER (y < 247) / count(*) AS nonwhite,
          (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 > 8.0 AND stddev_pop(y) > 6.0 AS nonflat FROM p GROUP BY 1""")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2500).alias("g"), (F.col("l_tax") * 3000).alias("b"), (F.col("l_linenumber") * 36.0).alias("y"))
    return reviews.image_statistics(p, "l_orderkey", ("r", "g", "b"), "y").withColumns({c: F.round(c, 6) for c in ("mean", "std", "luma_std")})


@query("""WITH p AS (SELECT l_suppkey, CAST(l_orderkey % 64 AS INTEGER) AS x, l_linenumber AS y, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS v FROM lineitem), m AS (SELECT l_suppkey, count(*) FILTER (v > 8) AS o, count(*) AS n, min(x) FILTER (v > 8) AS x0, min(y) FILTER (v > 8) AS y0, max(x) FILTER (v > 8) AS x1, max(y) FILTER (v > 8) AS y1 FROM p GROUP BY 1)
          SELECT l_suppkey, o > 0 AS nonempty, o / n AS area_fraction, x0, y0, x1, y1, (x1 - x0 + 1) * (y1 - y0 + 1) / n AS bbox_fraction FROM m""")
def mask_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 64).cast("int").alias("x"), F.col("l_linenumber").alias("y"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0).alias("v"))
    return reviews.mask_statistics(p, "l_suppkey", "x", "y", "v")


# --- gates ---

_SUFFIX = "CASE page_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.gif' WHEN 2 THEN '.avi' ELSE '.webm' END"


@query(f"""WITH v AS (SELECT page_id, lower({_SUFFIX}) AS sx, length(html) AS size, CASE WHEN page_id % 5 > 0 THEN CAST(640 + page_id % 2 AS INTEGER) END AS w, CASE WHEN page_id % 5 > 0 THEN 480 END AS h, CAST(page_id % 12 AS INTEGER) AS n FROM pages),
           i AS (SELECT page_id, {_LIST([("size < CASE WHEN sx = '.gif' THEN 1024 ELSE 4096 END", "output_too_small"), ("sx = '.avi'", "unexpected_video_extension"), ("w IS NULL", "video_metadata_unavailable"), ("w <> 640", "width_mismatch"), ("n < 8", "too_few_frames")])} AS l FROM v)
           SELECT page_id, array_to_string(l, ',') AS issues, CASE WHEN len(list_filter(l, lambda x: x <> 'video_metadata_unavailable')) = 0 THEN 'pass' ELSE 'fail' END AS status FROM i""")
def video_gate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("a.b/v"), F.when(k % 4 == 0, ".MP4").when(k % 4 == 1, ".gif").when(k % 4 == 2, ".avi").otherwise(".webm"))
    probed = lambda x: F.when(k % 5 > 0, x)
    issues = gates.video_issues(path, F.length("html"), probed((640 + k % 2).cast("int")), probed(F.lit(480)), k % 12, (640, 480, 24))
    return table(spark, sf_dir, "pages").select("page_id", issues.alias("i")).select("page_id", F.array_join("i", ",").alias("issues"), gates.video_status(F.col("i")).alias("status"))


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 52.0 AS f, l_discount * 2 AS w, l_tax * 2 AS h, CASE WHEN l_linenumber < 5 THEN l_quantity / 100.0 END AS g, CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS INTEGER) % 20 END AS n FROM lineitem)
           SELECT l_orderkey, l_linenumber, coalesce(nullif(array_to_string({_LIST([("f < 0.01", "foreground_too_small"), ("f > 0.92", "foreground_too_large"), ("w < 0.08", "bbox_too_narrow"), ("h < 0.08", "bbox_too_short"), ("g > 0.25", "foreground_fragmented"), ("n > 12", "too_many_components")])}, ','), ''), 'ok') AS reason FROM c""")
def cutout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    issues = gates.cutout_issues(F.col("l_quantity") / 52.0, F.col("l_discount") * 2, F.col("l_tax") * 2, F.when(line < 5, F.col("l_quantity") / 100.0), F.when(line < 6, F.col("l_quantity").cast("int") % 20))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.nullif(F.array_join(issues, ","), F.lit("")), F.lit("ok")).alias("reason"))


@query("SELECT event_id, coalesce(event_id % 2 = 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_type <> 'error' AND value < 150, false) AS pass FROM events")
def render_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    fields = {"ground_hit_success": k % 2 == 0, "contract_support_plane_used": k % 13 == 0, "joint_3d_render": F.when(k % 17 != 0, F.lit(True)), "is_floating": F.col("event_type") == "error", "is_intersecting_support": F.col("value") >= 150}
    words = {"camera_mode": F.lit("scene_camera_match"), "ground_hit_source": F.lit("mesh_raycast")}
    return table(spark, sf_dir, "events").select("event_id", gates.render_passes(fields | words).alias("pass"))


@query("""WITH r AS (SELECT l_suppkey, stddev_pop(l_quantity) / avg(l_quantity) AS v, (max(l_quantity) - min(l_quantity)) / avg(l_quantity) AS s, stddev_pop(l_discount) / 10 AS dv, max(l_discount) - min(l_discount) AS ds FROM lineitem GROUP BY 1)
          SELECT l_suppkey, CASE WHEN v < 0.01 OR s < 0.01 THEN 'constant_radius_shell' WHEN dv < 0.01 OR ds < 0.01 THEN 'constant_depth' ELSE 'ok' END AS reason FROM r""")
def shell_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda c: (F.max(c) - F.min(c))
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("v"), (q("l_quantity") / F.avg("l_quantity")).alias("s"), (F.stddev_pop("l_discount") / 10).alias("dv"), q("l_discount").alias("ds"))
    return r.select("l_suppkey", gates.shell_reason(F.col("v"), F.col("s"), F.col("dv"), F.col("ds")).alias("reason"))


@query("""WITH c AS (SELECT p_partkey, p_size, CASE WHEN p_size % 9 > 0 THEN p_size % 2 = 0 END AS art, 's' || p_partkey % 4 AS sel, p_brand FROM part)
          SELECT p_partkey, CASE WHEN p_size = 1 THEN 'schema' WHEN p_size = 2 THEN 'status' WHEN coalesce(art, true) THEN 'artificial_support_allowed' WHEN sel NOT IN ('s0', 's1', 's2') THEN 'support_missing' WHEN sel = 's1' THEN 'support_artificial' ELSE 'ok' END AS reason,
          CASE sel WHEN 's0' THEN p_brand WHEN 's1' THEN 'made' WHEN 's2' THEN 'floor' END AS support FROM c""")
def scene_contract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, sel = F.col("p_size"), F.concat(F.lit("s"), (F.col("p_partkey") % 4).cast("string"))
    surface = lambda i, art, name: F.struct(F.lit(i).alias("id"), F.lit(art).alias("artificial"), name.alias("name"))
    surfaces = F.array(surface("s0", False, F.col("p_brand")), surface("s1", True, F.lit("made")), surface("s2", False, F.lit("floor")))
    reason = gates.contract_reason(size != 1, size != 2, F.when(size % 9 > 0, size % 2 == 0), surfaces, sel)
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"), gates.support_of(surfaces, sel)["name"].alias("support"))


@query("""SELECT page_id, CASE WHEN page_id % 3 > 0 AND page_id % 4 = 0 THEN 'not_required' WHEN page_id % 4 = 0 THEN 'contract_missing' WHEN page_id % 5 = 0 THEN 'units' WHEN page_id % 7 = 0 THEN 'up_axis' WHEN page_id % 11 = 0 THEN 'artificial_support' WHEN page_id % 13 = 0 THEN 'support_origin' ELSE 'ok' END AS scene,
          CASE WHEN html IS NULL THEN 'missing' WHEN length(html) < 1024 THEN 'too_small' WHEN page_id % 6 = 0 THEN 'no_texture' ELSE 'ok' END AS output FROM pages""")
def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    scene = gates.scene_reason(k % 3 == 0, k % 4 > 0, F.when(k % 5 == 0, "feet").otherwise("meters"), F.when(k % 7 == 0, "y").otherwise("z"), k % 11 == 0, F.when(k % 13 == 0, "guess").otherwise("reconstruction"))
    return table(spark, sf_dir, "pages").select("page_id", scene.alias("scene"), gates.output_issue(F.length("html"), 1024, k % 6 > 0).alias("output"))


@query(f"""SELECT doc_id, array_to_string({_LIST([("n_chars >= 3000", "missing:title"), ("lang = 'fr'", "missing:lang")])}, ',') AS errors, array_to_string({_LIST([("doc_id % 3 = 0", "empty:tags"), ("doc_id % 5 = 0", "empty:links")])}, ',') AS warnings FROM documents""")
def prior_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    errors, warnings = gates.prior_findings({"title": F.col("n_chars") < 3000, "lang": F.col("lang") != "fr"}, {"tags": k % 3, "links": F.when(k % 5 > 0, k)})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"))


@query("""SELECT p_brand, bool_and(p_size <> 50 OR p_partkey % 2 = 0) AS ready, count(*) FILTER (p_type IN ('ECONOMY', 'PROMO')) AS blocked FROM part GROUP BY 1""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_type") == "ECONOMY", gates.BLOCKING[0]).when(F.col("p_type") == "PROMO", gates.BLOCKING[1]).otherwise("active")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(gates.all_or_not_blocking(F.col("p_size") != 50, F.col("p_partkey") % 2 == 1).alias("ready"), F.count_if(gates.blocks_loop(status)).alias("blocked"))


@query("""SELECT p_brand, count(*) AS total, count(*) FILTER (p_size > 10) AS passed, count(*) FILTER (p_size <= 10) AS failed, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_type = 'PROMO') AS promo FROM part GROUP BY 1""")
def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.counters(table(spark, sf_dir, "part"), "p_brand", {"passed": F.col("p_size") > 10, "failed": F.col("p_size") <= 10, "economy": F.col("p_type") == "ECONOMY", "promo": F.col("p_type") == "PROMO"})


@query("""SELECT p_brand, bool_and(p_size < 50) AS passes, array_to_string(list_sort(list(p_name || ':' || p_partkey) FILTER (p_size >= 50)), ',') AS failing FROM part GROUP BY 1""")
def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lineage.rollup(table(spark, sf_dir, "part"), "p_brand", F.concat_ws(":", "p_name", F.col("p_partkey").cast("string")), F.col("p_size") < 50)
    return out.withColumn("failing", F.nullif(F.array_join("failing", ","), F.lit("")))


@query("""WITH v AS (SELECT p_partkey, p_brand, p_name FROM part) SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 7 END AS n, CASE p_partkey % 3 WHEN 0 THEN 'video_prompt_alignment' WHEN 1 THEN 'c_own' ELSE 'c_prompt_alignment' END AS first, p_name AS instruction FROM v""")
def constraint_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    base = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("c_own"))).otherwise(F.array(F.lit("c_prompt_alignment"), F.lit("c_count"), F.lit("c_no_text")))
    full = constraints.extend_constraints(base, list(constraints.VIDEO))
    edit = constraints.default_edit(F.col("p_name"))
    told = F.regexp_extract(edit[0]["description"], r"requested edit: (.*)$", 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(full).alias("n"), F.element_at(full, 1).alias("first"), told.alias("instruction"))


_BANK = lambda words: F.array(*map(F.lit, words))


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size < 11 THEN 'simple' WHEN p_size < 31 THEN 'relation' ELSE 'hard' END AS tier FROM part) SELECT tier, count(*) AS prompts, count(*) * CASE tier WHEN 'simple' THEN 3 WHEN 'relation' THEN 4 ELSE 9 END AS constraints FROM s GROUP BY tier""")
def prompt_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    part = lambda tier, rows: constraints.bank(rows.select(F.col("p_partkey").alias("id"), "p_name"), tier, F.col("p_name"))
    bank = part("simple", p.where("p_size < 11")).unionByName(part("relation", p.where("p_size between 11 and 30"))).unionByName(part("hard", p.where("p_size > 30")))
    return bank.groupBy("tier").agg(F.count("*").alias("prompts"), F.sum(F.size("constraints")).alias("constraints"))


@query("""SELECT p_partkey, p_type AS tier FROM part WHERE p_type = 'PROMO' AND p_size > 20""")
def prompt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_type").alias("tier"), F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("id"))
    return requests_select(p).select("p_partkey", "tier")


def requests_select(p: DataFrame) -> DataFrame:
    return requests.selected(p, tier="PROMO", ids=[str(k) for k in range(21, 51)])
