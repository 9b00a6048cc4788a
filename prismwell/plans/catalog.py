"""The registered queries: each operator on the driver's tables, with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import derived_seed, paper_id, rounded, slug, word_head
from ..operators import constraints, control, gates, geometry, lifecycle, lineage, pairs, scheduling, scoring, stats, text
from ..sources import dryrun
from ..streaming import registry
from . import control_queries, geometry_queries, mesh_queries, planner_queries, request_queries, review_queries, state_queries  # noqa: F401  they register their queries
from .register import ORACLE, QUERIES, query, table  # noqa: F401

# --- pairs and splits ---


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rendered frames: nation, segment and a multiple of 45 degrees."""
    c = table(spark, sf_dir, "customer")
    f = c.select(F.col("c_nationkey").alias("obj_id"), F.col("c_mktsegment").alias("elevation"), (F.col("c_custkey") % 8 * 45).cast("int").alias("azimuth"), F.col("c_name").alias("path"), F.col("c_custkey").alias("pos"))
    return pairs.last_frames(f, ["obj_id", "elevation", "azimuth"], ["pos"], ["path"])


_FRAMES = """f AS (SELECT c_nationkey AS obj_id, c_mktsegment AS elevation, CAST(c_custkey % 8 * 45 AS INTEGER) AS azimuth, max_by(c_name, c_custkey) AS path
                 FROM customer GROUP BY 1, 2, 3)"""
_TURN = "CASE WHEN (((t.azimuth - s.azimuth) % 360) + 360) % 360 > 180 THEN (((t.azimuth - s.azimuth) % 360) + 360) % 360 - 360 ELSE (((t.azimuth - s.azimuth) % 360) + 360) % 360 END"


@query(f"""WITH {_FRAMES} SELECT s.obj_id, s.elevation, s.azimuth AS source_azimuth, s.path AS source_image, t.azimuth AS target_azimuth, t.path AS target_image, {_TURN} AS azimuth_delta
           FROM f s JOIN f t ON s.obj_id = t.obj_id AND s.elevation = t.elevation AND s.azimuth <> t.azimuth""")
def pair_same_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.same_level_pairs(_frames(spark, sf_dir))


@query(f"""WITH {_FRAMES}, p AS (SELECT s.obj_id, 'azimuth' AS family FROM f s JOIN f t ON s.obj_id = t.obj_id AND s.elevation = t.elevation AND s.azimuth <> t.azimuth
           UNION ALL SELECT s.obj_id, 'elevation' FROM f s JOIN f t ON s.obj_id = t.obj_id AND s.azimuth = t.azimuth AND s.elevation <> t.elevation)
           SELECT obj_id, family, count(*) AS n_pairs FROM p GROUP BY ALL""")
def pair_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    a = pairs.same_level_pairs(f).select("obj_id", F.lit("azimuth").alias("family"))
    e = pairs.cross_level_pairs(f).select("obj_id", F.lit("elevation").alias("family"))
    return a.unionByName(e).groupBy("obj_id", "family").agg(F.count("*").alias("n_pairs"))


@query("""SELECT l_orderkey, l_linenumber, max_by(struct_pack(p := l_partkey, q := l_quantity), struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_extendedprice)).p AS l_partkey,
          max_by(struct_pack(p := l_partkey, q := l_quantity), struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_extendedprice)).q AS l_quantity FROM lineitem GROUP BY ALL""")
def frame_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.last_frames(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_partkey", "l_quantity"])


_SPLIT = """r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY sha256('42:' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT c_custkey FROM customer)),
            o AS (SELECT id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {_SPLIT} SELECT id, split FROM o")
def object_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.object_split(table(spark, sf_dir, "customer"), "c_custkey")


@query(f"""WITH {_SPLIT} SELECT split, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_objects FROM orders JOIN o ON o_custkey = id GROUP BY split""")
def split_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pairs.object_split(table(spark, sf_dir, "customer"), "c_custkey")
    return table(spark, sf_dir, "orders").join(split, F.col("o_custkey") == F.col("id")).groupBy("split").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_objects"))


@query("""WITH e AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS ok FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id),
          x AS (SELECT max(doc_id) AS last, count(*) AS got FROM (SELECT doc_id FROM e WHERE ok ORDER BY doc_id LIMIT 100))
          SELECT doc_id, CASE WHEN NOT ok THEN 'skipped_missing_output' WHEN got < 100 OR doc_id <= last THEN 'reviewed' ELSE 'skipped_limit' END AS review_status FROM e, x""")
def limit_skipped_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("ok", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return pairs.limit_with_reasons(docs, F.col("ok"), "doc_id", 100).drop("ok")


@query("""WITH v AS (SELECT unnest(range(8)) AS view), f AS (SELECT DISTINCT c_nationkey AS n_nationkey, CAST(c_custkey % 8 AS BIGINT) AS view FROM customer WHERE c_acctbal > 8000)
          SELECT n.n_nationkey, count(*) AS expected, count(f.view) AS present, bool_and(f.view IS NOT NULL) AS complete FROM nation n CROSS JOIN v LEFT JOIN f ON f.n_nationkey = n.n_nationkey AND f.view = v.view GROUP BY 1""")
def grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 8).alias("view"))
    return pairs.expected_grid(table(spark, sf_dir, "nation").select("n_nationkey"), spark.range(8).withColumnRenamed("id", "view"), found, ["n_nationkey", "view"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def skip_existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def active_jobs_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(busy, "c_custkey", "left_semi").select("c_custkey", "c_name")


# --- checklists ---


@query("""SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.status_histogram(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("cid"), F.when(F.col("value") < 20, F.lit("  ")).otherwise(F.col("event_type")).alias("description"))


_ITEMS = "i AS (SELECT user_id, event_id AS pos, event_type AS cid, CASE WHEN value < 20 THEN '  ' ELSE event_type END AS description FROM events)"


@query(f"WITH {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, cid ORDER BY pos) AS k FROM i) SELECT user_id, pos, cid FROM n WHERE k = 1 AND trim(description) <> ''")
def checklist_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.normalize_constraints(_items(spark, sf_dir), "user_id", "pos", "cid", "description").drop("description")


@query(f"WITH {_ITEMS} SELECT user_id, min(pos) AS pos, cid FROM i WHERE trim(description) <> '' GROUP BY user_id, cid")
def checklist_normalize_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.normalize_constraints(_items(spark, sf_dir), "user_id", "pos", "cid", "description", blank_first=True).drop("description")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles as constraints, with a status by the length of what was said."""
    c = table(spark, sf_dir, "conversations")
    status = F.when(F.length("text") % 3 == 0, "fail").when(F.length("text") % 3 == 1, "pass").otherwise("uncertain")
    return c.groupBy("conv_id", "role").agg(F.min(F.struct("turn", status.alias("status"))).alias("s")).select("conv_id", "role", "s.status")


_REVIEWS = """s AS (SELECT conv_id, role, turn, CASE length(text) % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'uncertain' END AS status FROM conversations),
              o AS (SELECT conv_id, role, min(struct_pack(turn := turn, status := status)).status AS status FROM s GROUP BY 1, 2),
              d AS (SELECT conv_id, role FROM (SELECT DISTINCT conv_id FROM conversations) CROSS JOIN (VALUES ('user'), ('assistant'), ('critic')) r(role)),
              m AS (SELECT coalesce(d.conv_id, o.conv_id) AS conv_id, coalesce(d.role, o.role) AS role, coalesce(o.status, 'uncertain') AS status FROM d FULL JOIN o ON d.conv_id = o.conv_id AND d.role = o.role),
              n AS (SELECT conv_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'uncertain') AS uncertain, count(*) AS total,
                           count(*) FILTER (status = 'pass') / greatest(1, count(*)) AS pass_rate FROM m GROUP BY 1)"""


def _checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame([("user",), ("assistant",), ("critic",)], "role string")
    declared = table(spark, sf_dir, "conversations").select("conv_id").distinct().crossJoin(F.broadcast(roles))
    return constraints.reconcile(declared, _reviews(spark, sf_dir), ["conv_id", "role"])


@query(f"""WITH {_REVIEWS} SELECT *, CASE WHEN failed = 0 AND uncertain = 0 THEN 'pass' ELSE 'needs_fix' END AS route,
           CASE WHEN failed > 0 THEN least(greatest(1, least(5, CAST(round_even(pass_rate * 5, 0) AS INTEGER))), 3) WHEN uncertain > 0 THEN least(greatest(1, least(5, CAST(round_even(pass_rate * 5, 0) AS INTEGER))), 4)
           ELSE greatest(1, least(5, CAST(round_even(pass_rate * 5, 0) AS INTEGER))) END AS overall FROM n""")
def checklist_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = constraints.checklist_counts(_checklist(spark, sf_dir), "conv_id")
    f, u = F.col("failed"), F.col("uncertain")
    return n.withColumn("route", constraints.route_image(F.lit(None).cast("string"), f, u)).withColumn("overall", constraints.overall_from_rate(F.col("pass_rate"), f, u))


@query(f"""WITH {_REVIEWS} SELECT conv_id, CASE WHEN failed >= 3 THEN 'reject' WHEN failed = 0 AND uncertain = 0 THEN 'pass' ELSE 'needs_fix' END AS route FROM n""")
def edit_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = constraints.checklist_counts(_checklist(spark, sf_dir), "conv_id")
    return n.select("conv_id", constraints.route_edit(F.lit("pass"), F.col("failed"), F.col("uncertain"), F.col("failed") > 0).alias("route"))


_STEPS = """s AS (SELECT conv_id, turn, 'reply' AS cid, max(CASE WHEN length(text) % 2 = 0 THEN 'pass' ELSE 'fail' END) AS status FROM conversations GROUP BY 1, 2, 3),
            l AS (SELECT *, lag(status) OVER w AS was, lag(turn) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY conv_id, cid ORDER BY turn)),
            c AS (SELECT conv_id, turn, count(*) FILTER (status = 'pass' AND was <> 'pass') AS improved, count(*) FILTER (status <> 'pass' AND was = 'pass') AS regressed FROM l WHERE t0 = turn - 1 GROUP BY 1, 2)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    s = c.groupBy("conv_id", "turn", F.lit("reply").alias("cid")).agg(F.max(F.when(F.length("text") % 2 == 0, "pass").otherwise("fail")).alias("status"))
    return constraints.improvements(s, "conv_id", "cid", "turn")


@query(f"WITH {_STEPS} SELECT * FROM c")
def round_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {_STEPS} SELECT conv_id, min(turn) AS to_round, min_by(improved, turn) AS improved FROM c WHERE improved > 0 GROUP BY 1")
def first_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.first_improvement(_changes(spark, sf_dir), "conv_id", "turn")


_LOW = "(' ' || lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) || ' ')"
_ANY = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query(f"""WITH b AS (SELECT item_id, {_LOW} AS low FROM benchmark) SELECT item_id, concat_ws(',', 'c_prompt_alignment', CASE WHEN regexp_matches(low, '{constraints.COUNTED}') THEN 'c_count' END,
           CASE WHEN contains(low, ' left ') OR contains(low, ' right ') THEN 'c_left_right' END, {", ".join(f"CASE WHEN {_ANY(w)} THEN '{n}' END" for n, w in constraints.IMPLIED.items())}) AS constraints FROM b""")
def infer_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(constraints.implied_constraints(F.col("text")), ",").alias("constraints"))


# --- view fusion ---

_VIEW = """v AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 + 1 AS lighting, o_orderkey // 5 % 5 + 1 AS object_integrity, o_orderkey // 25 % 5 + 1 AS composition, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS overall,
                  least(1.0, o_totalprice / 500000.0) AS cv, o_totalprice < 20000 AS gate FROM orders),
           h AS (SELECT *, 0.25 * (lighting - 1) / 4.0 + 0.30 * (object_integrity - 1) / 4.0 + 0.20 * (composition - 1) / 4.0 + 0.10 * 2 / 4.0 + 0.15 * (overall - 1) / 4.0 AS review FROM v),
           m AS (SELECT *, review * 0.5 + cv * 0.5 AS raw FROM h),
           g AS (SELECT *, CASE WHEN object_integrity <= 2 THEN least(raw, 0.69) ELSE raw END AS capped FROM m),
           k AS (SELECT *, CASE WHEN gate THEN least(capped, 0.74) ELSE capped END AS hybrid FROM g)"""


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    o = o.withColumn("lighting", k % 5 + 1).withColumn("object_integrity", F.floor(k / 5) % 5 + 1).withColumn("composition", F.floor(k / 25) % 5 + 1).withColumn("overall", F.substring("o_orderpriority", 1, 1).cast("int"))
    scores = {n: F.col(n) for n in ("lighting", "object_integrity", "composition", "overall")} | {"render_quality_semantic": F.lit(None).cast("int")}
    return o.withColumn("hybrid", scoring.hybrid_score(scoring.review_score(scores), F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0), F.col("object_integrity"), F.col("o_totalprice") < 20000))


@query(f"""WITH {_VIEW} SELECT o_custkey, count(*) AS views, floor((0.7 * avg(hybrid) + 0.3 * min(hybrid)) * 1e4 + 0.5) / 1e4 AS score, floor(min(hybrid) * 1e4 + 0.5) / 1e4 AS worst,
           count(*) FILTER (hybrid >= 0.80) AS passed, count(*) FILTER (hybrid < 0.55) AS rejected FROM k GROUP BY 1""")
def view_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _views(spark, sf_dir).withColumn("route", scoring.route(F.col("hybrid")))
    return v.groupBy("o_custkey").agg(F.count("*").alias("views"), rounded(scoring.blend("hybrid")).alias("score"), rounded(F.min("hybrid")).alias("worst"), F.count_if(F.col("route") == "pass").alias("passed"), F.count_if(F.col("route") == "reject").alias("rejected"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS votes, min(struct_pack(ts := ts, id := event_id)) AS f FROM events GROUP BY 1, 2)
          SELECT user_id, event_type, votes FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f, event_type) = 1""")
def majority_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.majority(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT source, ['good', 'minor', 'major'][CAST(max(CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END) AS INTEGER) + 1] AS worst FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rank = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("quality") == 1, 1).otherwise(2)
    return met.groupBy("source").agg(scoring.worst(rank, ["good", "minor", "major"]).alias("worst"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS votes, min(struct_pack(ts := ts, id := event_id)) AS f FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
          r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f, event_type) AS n FROM g)
          SELECT u.user_id, coalesce(string_agg(event_type, ',' ORDER BY n), 'none') AS top FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON r.user_id = u.user_id AND n <= 3 GROUP BY 1""")
def topk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_values(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], 3, leave_out="view")


@query("SELECT o_custkey, max(o_orderpriority) AS highest, min_by(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_status FROM orders GROUP BY 1")
def max_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.highest_and_first(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus", ["o_orderdate", "o_orderkey"])


# --- lifecycle and control ---

_WEEK = "w AS (SELECT *, CAST(event_id % 4 AS INTEGER) AS round_idx FROM events)"
_TAGS = "t AS (SELECT user_id, count(*) FILTER (r >= 2) AS recurring FROM (SELECT user_id, event_type, count(DISTINCT round_idx) AS r FROM w WHERE round_idx IN (1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("round_idx", (F.col("event_id") % 4).cast("int"))


@query(f"WITH {_WEEK}, {_TAGS} SELECT * FROM t")
def recurring_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.recurring_tags(_rounds(spark, sf_dir), "user_id", "event_type", "round_idx")


@query(f"""WITH {_WEEK}, {_TAGS}, s AS (SELECT user_id, max(CASE WHEN round_idx > 0 THEN value END) / 1000 AS best, max(CASE WHEN round_idx = 0 THEN value END) / 1000 AS start, count(DISTINCT round_idx) AS rounds FROM w GROUP BY 1)
           SELECT s.user_id, floor(best * 1e4 + 0.5) / 1e4 AS best, floor((best - start) * 1e4 + 0.5) / 1e4 AS gain, coalesce(recurring, 0) AS recurring, best < 0.58 AND best - start < 0.02 AND coalesce(recurring, 0) >= 2 AS stalled
           FROM s LEFT JOIN t USING (user_id) WHERE rounds = 4""")
def stall_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rounds(spark, sf_dir).withColumn("score", F.col("value") / 1000)
    tags = lifecycle.recurring_tags(r, "user_id", "event_type", "round_idx")
    out = lifecycle.stalled(r, tags, "user_id", "round_idx", "score")
    return out.withColumn("best", rounded(F.col("best"))).withColumn("gain", rounded(F.col("gain")))


_SIGNS = """d AS (SELECT user_id, ts, event_id, CAST(sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS INTEGER) AS s FROM events),
            p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM d WHERE s <> 0),
            f AS (SELECT *, CASE WHEN was IS NOT NULL AND s <> was THEN 0 ELSE 1 END AS fresh FROM p),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
            c AS (SELECT user_id, ts, event_id, s, count(*) FILTER (fresh = 0) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS flips FROM g)"""


@query(f"""WITH {_SIGNS} SELECT user_id, max_by(s, struct_pack(ts := ts, id := event_id)) AS last_sign, CAST(max_by(flips, struct_pack(ts := ts, id := event_id)) AS INTEGER) AS flips, CAST(max(flips) AS INTEGER) AS most_flips, max(flips) >= 3 AS frozen FROM c GROUP BY 1""")
def sign_flip_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").withColumn("s", F.signum(F.col("value") - F.lag("value").over(w)).cast("int"))
    return control.flip_history(steps.where("s is not null"), "user_id", ["ts", "event_id"], "s")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
                 CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.4 END * CASE WHEN l_discount * 10 > 0 AND l_discount * 10 < 0.65 THEN 1.2 ELSE 1.0 END AS scale FROM lineitem)
          SELECT l_orderkey, l_linenumber, l_partkey, floor(least(1.2, scale) * 1e4 + 0.5) / 1e4 AS step, floor(greatest(0.0, least(60.0, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity * ((1.2 - 1) * least(1.2, scale) + 1) ELSE l_quantity + 5.0 * least(1.2, scale) END)) * 1e4 + 0.5) / 1e4 AS applied FROM s""")
def step_scale_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    scale = control.step_scale(F.col("l_linenumber") % 4, F.col("l_discount") * 10)
    even = F.col("l_suppkey") % 2 == 0
    applied = control.apply_step(F.col("l_quantity").cast("double"), F.when(even, "mul").otherwise("add"), F.when(even, 1.2).otherwise(5.0), scale, F.lit(0.0), F.lit(60.0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", rounded(scale).alias("step"), rounded(applied).alias("applied"))


@query("WITH b AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1) SELECT p_partkey, p_retailprice <= lo + (hi - lo) * 0.05 OR p_retailprice >= hi - (hi - lo) * 0.05 AS dead FROM part JOIN b USING (p_brand)")
def dead_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.join(b, "p_brand").select("p_partkey", control.in_dead_zone(F.col("p_retailprice"), F.col("lo"), F.col("hi")).alias("dead"))


_ACTIONS = [("BUILDING", 0, 0, "L_KEY_UP"), ("BUILDING", 1, 0, "M_VALUE_UP"), ("MACHINERY", 0, 0, "O_LOWER_SMALL"), ("MACHINERY", 0, 1, "O_LIFT_SMALL"), ("AUTOMOBILE", 1, 0, "ENV_ROTATE_30"), ("FURNITURE", 2, 0, "S_CONTACT_SHADOW_UP")]


@query(f"""WITH a(seg, phase, place, action) AS (VALUES {", ".join(map(str, _ACTIONS))}),
           m AS (SELECT c_custkey, phase, place, action FROM customer LEFT JOIN a ON seg = c_mktsegment AND NOT (place = 0 AND c_acctbal < 0))
           SELECT c_custkey, coalesce(min(CASE WHEN action IS NOT NULL THEN struct_pack(p := phase, q := place, a := action) END).a, 'NO_OP') AS action FROM m GROUP BY 1""")
def action_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = spark.createDataFrame(_ACTIONS, "c_mktsegment string, phase int, place int, action string")
    return control.choose_action(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", candidates, ["c_mktsegment"], (F.col("place") == 0) & (F.col("c_acctbal") < 0))


@query("SELECT o_orderkey, o_totalprice > 400000 OR o_custkey > 1200 AS blocked FROM orders")
def compound_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = control.guard_blocks({"price": F.col("o_totalprice"), "customer": F.col("o_custkey")}, {"price": 400000.0, "customer": 1200})
    return table(spark, sf_dir, "orders").select("o_orderkey", blocked.alias("blocked"))


@query("""WITH q AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'running' END AS status, o_orderdate FROM orders),
          s AS (SELECT *, CASE WHEN status = 'running' AND date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') >= 7200 THEN 'queued' ELSE status END AS st FROM q),
          f AS (SELECT o_custkey, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS head FROM s WHERE st = 'queued' GROUP BY 1)
          SELECT o_orderkey, CASE WHEN st = 'queued' AND struct_pack(d := o_orderdate, k := o_orderkey) = head THEN 'running' ELSE st END AS status FROM s LEFT JOIN f USING (o_custkey)""")
def queue_claim_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    jobs = o.select("o_orderkey", "o_custkey", "o_orderdate", lifecycle.recover_stale(status, F.col("o_orderdate"), now).alias("status"))
    return lifecycle.claim_next(jobs, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "status")


@query("""WITH a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS active, count(*) FILTER (o_orderstatus = 'F') % 4 AS used FROM orders GROUP BY 1)
          SELECT o_custkey, CASE WHEN active > 0 THEN 'active_job' WHEN used + 1 > 2 THEN 'manual_reprompt_required' ELSE 'enqueued' END AS outcome FROM a""")
def registry_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("active"), (F.count_if(F.col("o_orderstatus") == "F") % 4).alias("used"))
    return a.select("o_custkey", lifecycle.replacement(F.col("active"), F.col("used")).alias("outcome"))


@query()
def registry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("deprecate", "promote", "fail"))), (F.col("event_id") % 3 + 1).cast("int"))
    return registry.registry_batch(e.select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), kind.alias("event")))


# --- gates ---


@query("""WITH d AS (SELECT doc_id, strlen(text) AS size, n_chars, length(source) AS w FROM documents),
          i AS (SELECT doc_id, concat_ws(',', CASE WHEN size < 1024 THEN 'output_too_small' END, CASE WHEN w <> 5 THEN 'width_mismatch' END, CASE WHEN n_chars % 50 < 1 THEN 'low_information' END,
          CASE WHEN n_chars % 256 < 3 THEN 'near_black' END, CASE WHEN n_chars % 256 > 252 THEN 'near_white' END, CASE WHEN n_chars % 256 > 245 AND n_chars % 50 < 18 THEN 'washed_out' END,
          CASE WHEN n_chars % 100 / 100.0 < 0.005 THEN 'foreground_missing' END, CASE WHEN n_chars % 100 / 100.0 >= 0.005 AND n_chars % 100 / 100.0 < 0.035 THEN 'foreground_too_small' END,
          CASE WHEN n_chars % 100 / 100.0 < 0.08 AND n_chars % 256 > 235 THEN 'weak_separation' END) AS issues FROM d)
          SELECT doc_id, issues, CASE WHEN issues = '' THEN 'pass' WHEN issues = 'output_too_small' THEN 'warn' ELSE 'fail' END AS status FROM i""")
def image_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    issues = gates.image_issues(F.octet_length("text"), F.length("source"), F.lit(1), (5, 1), n % 50, n % 256, n % 256, n % 256, n % 50, n % 100 / 100.0)
    return d.select("doc_id", issues.alias("i")).select("doc_id", F.array_join("i", ",").alias("issues"), gates.image_status(F.col("i")).alias("status"))


@query("""WITH i AS (SELECT page_id, concat_ws(',', CASE WHEN strlen(html) < 4096 THEN 'output_too_small' END, CASE WHEN NOT contains(url, 'https') THEN 'bad_extension' END, CASE WHEN strlen(html) % 2 = 0 THEN 'video_metadata_unavailable' END) AS issues FROM pages)
          SELECT page_id, issues, CASE WHEN issues IN ('', 'video_metadata_unavailable') THEN 'pass' ELSE 'fail' END AS status FROM i""")
def video_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = gates.page_video_issues(F.octet_length("html"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", issues.alias("i")).select("page_id", F.array_join("i", ",").alias("issues"), gates.video_status(F.col("i")).alias("status"))


@query("""SELECT p_partkey, CASE WHEN NOT p_size % 11 <> 0 THEN 'unreadable' WHEN p_size % 7 = 0 THEN 'not_rgba' WHEN p_size >= 49 THEN 'alpha_all_white' WHEN p_retailprice - 900 <= 0 THEN 'alpha_all_black'
          WHEN p_size / 50.0 < 0.05 OR p_size / 50.0 > 0.95 THEN 'fg_ratio_out_of_range' ELSE 'ok' END AS reason,
          CASE WHEN p_size * 10 < 200 THEN 'geometry_too_sparse' WHEN p_size / 50.0 < 0.02 THEN 'bbox_too_flat' WHEN p_size % 7 = 0 THEN 'missing_image_texture' WHEN p_size / 1000.0 < 0.05 THEN 'low_colorfulness' ELSE 'ok' END AS material FROM part""")
def first_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    low = F.when(s >= 49, 255).otherwise(0)
    reason = gates.alpha_reason(s % 11 != 0, s % 7 != 0, low, F.col("p_retailprice") - 900, s / 50.0)
    material = gates.material_reason(s * 10, s / 50.0, s % 7 != 0, s / 1000.0)
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"), material.alias("material"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount / 10 AS gap, l_tax / 100 AS pen, l_quantity / 50.0 AS h, l_quantity >= 50 AS outside, CASE l_returnflag WHEN 'A' THEN 'good' WHEN 'N' THEN 'minor_issue' ELSE 'major_issue' END AS said FROM lineitem),
          c AS (SELECT *, greatest(gap, pen) AS v, gap <= greatest(0.0012, least(0.004, h * 0.005)) AND pen <= greatest(0.0008, least(0.003, h * 0.004)) AND NOT outside AS clean FROM m)
          SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v > 0.05 OR outside THEN 'major_issue' WHEN v > 0.01 AND said = 'good' THEN 'minor_issue' WHEN clean AND said = 'major_issue' THEN 'minor_issue' ELSE said END AS physics FROM c""")
def physics_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = F.col("l_quantity") >= 50
    said = F.when(F.col("l_returnflag") == "A", "good").when(F.col("l_returnflag") == "N", "minor_issue").otherwise("major_issue")
    violation, clean = gates.physics_flags(F.col("l_discount") / 10, F.col("l_tax") / 100, F.col("l_quantity") / 50.0, outside)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gates.merge_physics(said, violation, outside, clean).alias("physics"))


@query("SELECT o_custkey, bool_and(o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT') AS success FROM orders GROUP BY 1")
def runtime_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(gates.all_or_not_blocking(F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "1-URGENT").alias("success"))


# --- statistics and geometry ---

_R = lambda x: f"floor(({x}) * 1e4 + 0.5) / 1e4"


@query(f"""SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, {_R("quantile_cont(l_extendedprice, 0.05)")} AS p05, {_R("quantile_cont(l_extendedprice, 0.5)")} AS p50, {_R("quantile_cont(l_extendedprice, 0.95)")} AS p95,
           max(l_extendedprice) AS hi, {_R("avg(l_extendedprice)")} AS mean, {_R("stddev_pop(l_extendedprice)")} AS sigma, {_R("stddev_pop(l_extendedprice) / avg(l_extendedprice)")} AS variation FROM lineitem GROUP BY 1""")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spread(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query(f"""SELECT event_id, user_id, CASE WHEN count(value) OVER w >= 10 THEN {_R("quantile_cont(value, 0.1) OVER w")} ELSE 40.0 END AS band_lo, CASE WHEN count(value) OVER w >= 10 THEN {_R("quantile_cont(value, 0.9) OVER w")} ELSE 180.0 END AS band_hi
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)""")
def rolling_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rolling_band(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "band_lo", "band_hi")


@query("""WITH b AS (SELECT l_returnflag, CAST(round_even(l_quantity / 8.0, 0) AS BIGINT) AS bin, sum(l_extendedprice) AS weight, sum(l_quantity * l_extendedprice) / sum(l_extendedprice) AS centre FROM lineitem GROUP BY 1, 2)
          SELECT l_returnflag, bin, floor(weight + 0.5) AS weight, floor(centre * 1e4 + 0.5) / 1e4 AS centre, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY round(weight, 2) DESC, bin) AS INTEGER) AS place FROM b""")
def weighted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.weighted_bins(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", 8.0)
    return out.withColumn("weight", F.floor(F.col("weight") + 0.5).cast("double")).withColumn("centre", rounded(F.col("centre")))


@query("""WITH e AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), k AS (SELECT DISTINCT p_brand, CAST(least(49, floor((p_retailprice - lo) / (hi - lo) * 50)) AS BIGINT) AS k FROM part JOIN e USING (p_brand) WHERE hi > lo),
          g AS (SELECT p_brand, coalesce(k - lag(k) OVER (PARTITION BY p_brand ORDER BY k) - 1, 0) AS g FROM k) SELECT p_brand, count(*) AS filled, max(g) AS gap FROM g GROUP BY 1""")
def z_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.widest_gap(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query(f"""SELECT label, {", ".join(f"{_R(f'quantile_cont(CAST(embedding[{i + 1}] AS DOUBLE), {q})')} AS e{i}_{n}" for i in range(3) for n, q in (("lo", 0.01), ("hi", 0.99)))} FROM embeddings GROUP BY 1""")
def percentile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)])
    return stats.percentile_box(e, "label", ["e0", "e1", "e2"])


@query("""WITH b AS (SELECT l_returnflag, avg(l_quantity) AS q, avg(l_discount * 100) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
          SELECT l_returnflag, count(*) AS n, count(*) FILTER ((l_quantity - q) * (l_quantity - q) + (l_discount * 100 - d) * (l_discount * 100 - d) > 576) AS far FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1""")
def foreground_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_discount") * 100)
    return stats.foreground(li, "l_returnflag", ["l_quantity", "d"], F.col("l_linenumber") == 1, 24.0)


@query(f"""SELECT p_partkey, {_R("1 - 0.6 * least(1.0, 2 * (p_size / 100.0)) - 0.4 * least(1.0, 1.5 * abs(p_retailprice / 2000.0 - 0.45))")} AS exposure FROM part""")
def exposure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rounded(stats.exposure(F.col("p_size") / 100.0, F.col("p_retailprice") / 2000.0)).alias("exposure"))


@query(f"""SELECT c_custkey, {_R("10 * cos(radians(c_nationkey)) * sin(radians(c_custkey % 360))")} AS x, {_R("0 - 10 * cos(radians(c_nationkey)) * cos(radians(c_custkey % 360))")} AS y, {_R("10 * sin(radians(c_nationkey))")} AS z FROM customer""")
def camera_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    x, y, z = geometry.camera_place((zero, zero, zero), F.lit(10.0), F.col("c_custkey") % 360, F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", rounded(x).alias("x"), rounded(y).alias("y"), rounded(z).alias("z"))


def _faces(li: DataFrame) -> DataFrame:
    """Lines as edges of meshes: flag, status and line number name the mesh."""
    return li.select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("mesh"), F.col("l_suppkey").alias("u"), (F.col("l_suppkey") + F.col("l_partkey") % 3).alias("v")).distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_returnflag || l_linestatus || l_linenumber AS mesh, l_suppkey AS u, l_suppkey + l_partkey % 3 AS v FROM lineitem),
          b AS (SELECT mesh, u, v FROM e UNION SELECT mesh, v, u FROM e), r(mesh, node, least) AS (SELECT mesh, u, u FROM b UNION SELECT b.mesh, b.v, r.least FROM r JOIN b ON b.mesh = r.mesh AND b.u = r.node AND r.least < b.v),
          c AS (SELECT mesh, node, min(least) AS component FROM r GROUP BY 1, 2) SELECT mesh, component, count(*) AS size FROM c GROUP BY 1, 2""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.component_sizes(_faces(table(spark, sf_dir, "lineitem")), "mesh", "u", "v")


@query()
def components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without SQL, which is slow on large tables; the tests compare it with brute force."""
    return geometry.component_sizes(_faces(table(spark, sf_dir, "lineitem")), "mesh", "u", "v")


@query()
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return geometry.hull_areas(e, "label", "x", "y").select("mesh", rounded(F.col("area")).alias("area"))


_OF = ", ".join(f"max(e{i}) FILTER (j = {j}) AS p{j}{i}" for j in range(3) for i in range(3))


@query(f"""WITH e AS (SELECT label AS mesh, vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS n FROM embeddings),
           t AS (SELECT mesh, n // 3 AS k, {_OF} FROM (SELECT *, n % 3 AS j FROM e WHERE n < 300) GROUP BY 1, 2 HAVING count(*) = 3),
           x AS (SELECT mesh, k, p00, p01, p02, p10 - p00 AS u0, p11 - p01 AS u1, p12 - p02 AS u2, p20 - p00 AS v0, p21 - p01 AS v1, p22 - p02 AS v2 FROM t), c AS (SELECT mesh, k, p00, p01, p02, u1 * v2 - u2 * v1 AS a, u2 * v0 - u0 * v2 AS b, u0 * v1 - u1 * v0 AS c FROM x),
           s AS (SELECT *, sqrt(a * a + b * b + c * c) AS z FROM c), m AS (SELECT mesh, k, a / z AS a, b / z AS b, c / z AS c, -(a / z * p00 + b / z * p01 + c / z * p02) AS d FROM s WHERE z >= 1e-12),
           i AS (SELECT mesh, k, count(*) FILTER (abs(a * e0 + b * e1 + c * e2 + d) <= 0.05) AS n FROM e JOIN m USING (mesh) GROUP BY 1, 2) SELECT mesh, max(n) AS inliers FROM i GROUP BY 1""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)])
    return geometry.planes(e, "label", "vec_id", ["e0", "e1", "e2"], 0.05).select("mesh", "inliers")


# --- scheduling ---


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 5 AS lo, s_suppkey % 5 + 3 AS hi FROM supplier), x AS (SELECT s_suppkey, list_sort(range(lo, hi + 1)) AS inc, [lo + 1] AS exc FROM s)
          SELECT s_suppkey, array_to_string(inc, ',') AS included, array_to_string(exc, ',') AS excluded, array_to_string(list_filter(inc, lambda d: NOT list_contains(exc, d)), ',') AS usable FROM x""")
def gpu_spec_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.col("s_suppkey") % 5).cast("int")
    spec = F.concat(low.cast("string"), F.lit("-"), (low + 3).cast("string"), F.lit(", !"), (low + 1).cast("string"))
    inc, exc = scheduling.expand_spec(spec, F.lit(8))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", inc.alias("i"), exc.alias("e"))
    return s.select("s_suppkey", F.array_join("i", ",").alias("included"), F.array_join("e", ",").alias("excluded"), F.array_join(F.array_except("i", "e"), ",").alias("usable"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 8 IN (5) THEN 'excluded' WHEN s_suppkey % 8 IN (3, 7) THEN 'reserved' WHEN s_acctbal * 10 >= 60000 THEN 'memory_busy' WHEN s_nationkey * 4 >= 90 THEN 'utilization_busy' ELSE 'free' END AS state FROM supplier""")
def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = scheduling.reservation((F.col("s_suppkey") % 8).cast("int"), F.array(F.lit(5)), F.array(F.lit(3), F.lit(7)), F.col("s_acctbal") * 10, F.col("s_nationkey") * 4)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(why, F.lit("free")).alias("state"))


_LOG = "CASE event_id % 6 WHEN 0 THEN 'CUDA out of memory in panogen' WHEN 1 THEN 'torch.OutOfMemoryError' WHEN 2 THEN 'blender: command not found' WHEN 3 THEN 'NCCL all_gather failed' WHEN 4 THEN 'nccl ok' ELSE props END"


@query(f"""WITH l AS (SELECT event_id, lower({_LOG}) AS t FROM events) SELECT event_id, CASE WHEN (contains(t, 'cuda out of memory') OR contains(t, 'torch.outofmemoryerror')) AND contains(t, 'panogen') THEN 'hyworld_pano_oom'
           WHEN contains(t, 'cuda out of memory') OR contains(t, 'torch.outofmemoryerror') THEN 'cuda_oom' WHEN contains(t, 'blender: command not found') THEN 'blender_missing'
           WHEN contains(t, 'nccl') AND (contains(t, 'all-gather') OR contains(t, 'all_gather') OR contains(t, 'invalid usage')) THEN 'nccl_collective_failure' ELSE 'unknown' END AS failure FROM l""")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scheduling.failure_class(F.expr(_LOG)).alias("failure"))


# --- text and lineage ---


@query("SELECT conv_id, turn, text FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY turn) = 1")
def ci_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.distinct_folded(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "text", ["turn"])


@query("""WITH u AS (SELECT page_id, regexp_extract(lower('https://arxiv.org/abs/24' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id % 97 AS VARCHAR), 5, '0') || 'v2'), 'arxiv\\.org/(?:abs|pdf)/([0-9]{4}\\.[0-9]{4,5})', 1) AS paper FROM pages)
          SELECT paper, min(page_id) AS page_id FROM u WHERE paper <> '' GROUP BY 1""")
def canonical_url_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    url = F.concat(F.lit("https://arxiv.org/abs/24"), F.lpad((p % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((p % 97).cast("string"), 5, "0"), F.lit("v2"))
    return table(spark, sf_dir, "pages").select("page_id", paper_id(url).alias("paper")).where("paper <> ''").groupBy("paper").agg(F.min("page_id").alias("page_id"))


@query("""SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'item') AS slug, CAST(('0x' || substr(sha256(p_name), 1, 10)) AS BIGINT) % 100000 AS seed FROM part""")
def slug_and_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"), derived_seed(F.col("p_name"), 100000).alias("seed"))


_TRACE = "text || chr(10) || 'Verdict: ' || CASE turn % 3 WHEN 0 THEN 'Keep' WHEN 1 THEN 'maybe' ELSE 'reject' END || chr(10) || '  Asset viability: ' || CASE turn % 2 WHEN 0 THEN 'abandon' ELSE 'so-so' END"


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'keep' WHEN 1 THEN CASE WHEN role = 'user' THEN 'keep' WHEN role = 'system' THEN 'reject' ELSE 'revise' END ELSE 'reject' END AS verdict, CASE turn % 2 WHEN 0 THEN 'abandon' ELSE 'unclear' END AS viability FROM conversations""")
def verdict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("trace", F.expr(_TRACE))
    route = F.when(F.col("role") == "user", "accepted").when(F.col("role") == "system", "rejected").otherwise("")
    return c.select("conv_id", "turn", text.verdict(F.col("trace"), route).alias("verdict"), text.viability(F.col("trace")).alias("viability"))


_NOTE = "text || CASE doc_id % 5 WHEN 0 THEN ' It is too large and FLOATING.' WHEN 1 THEN ' Acceptable, keep it.' WHEN 2 THEN ' Color shift, too dark: reject.' WHEN 3 THEN ' shadow missing' ELSE '' END"
_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query(f"""WITH n AS (SELECT doc_id, lower({_NOTE}) AS t FROM documents), g AS (SELECT doc_id, t, list_filter([{", ".join(f"CASE WHEN {_HAS(w)} THEN '{k}' END" for k, w in text.TAG_WORDS.items())}], lambda x: x IS NOT NULL)[1:3] AS tags FROM n)
           SELECT doc_id, array_to_string(tags, ',') AS tags, CASE WHEN {_HAS(text.REJECT_WORDS)} AND len(tags) >= 2 THEN 'reject' WHEN {_HAS(text.KEEP_WORDS)} AND len(tags) = 0 THEN 'pass' ELSE 'needs_fix' END AS route FROM g""")
def keyword_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("note", F.expr(_NOTE)).withColumn("tags", text.review_tags(F.col("note")))
    return d.select("doc_id", F.array_join("tags", ",").alias("tags"), text.review_route(F.col("note"), F.col("tags")).alias("route"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN trim(text) ELSE 'Only line ' || item_id END AS prompt FROM benchmark")
def llm_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    told = F.concat(F.lit("<think>no\nPROMPT: wrong</think>\nPROMPT: "), "text", F.lit('\nJSON: {"a": 1}'))
    answer = F.when(F.col("item_id") % 2 == 0, told).otherwise(F.concat(F.lit("\n  Only line "), F.col("item_id").cast("string")))
    return b.select("item_id", text.answer_prompt(answer).alias("prompt"))


@query()
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.extract_json(F.concat(F.lit("Sure! Here it is: {oops "), "props", F.lit(" Hope it helps."))).alias("props"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(range(5), lambda i: CAST(round_even(i * (n_chars % 97) / 4.0, 0) AS BIGINT)))), ',') AS frames FROM documents""")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pairs.keyframes(F.col("n_chars") % 97, 5), ",").alias("frames"))


@query("""WITH d AS (SELECT source, doc_id, lang FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM d)
          SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, string_agg('[' || doc_id || ']', ' ' ORDER BY doc_id) FILTER (n <= 8) AS summaries FROM r GROUP BY 1""")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.evidence(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id", "lang")


@query("""WITH b AS (SELECT doc_id, n_chars, source FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, n_chars + (doc_id % 5 = 0)::INT AS n_chars, source FROM documents WHERE doc_id % 11 <> 0)
          SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.n_chars = b.n_chars AND a.source = b.source THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    after = d.where("doc_id % 11 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return lineage.changed_files(d.where("doc_id % 7 <> 0"), after, "doc_id", ["n_chars", "source"])


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.manifest(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT conv_id, turn, CASE WHEN len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) > 6 THEN array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:6], ' ') || ' ...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS head FROM conversations")
def word_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", word_head(F.col("text"), 6).alias("head"))


@query()
def dryrun_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.format_string("bench_%04d", "item_id").alias("sample_id"), F.col("text").alias("prompt"))
    return dryrun.generate(b, dryrun.dry_run("t2i", frozenset({"bench_0003"})))


