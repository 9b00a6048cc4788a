"""Queries of registry and queue state, scheduling helpers and texts put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry_state, requests, scheduling, text
from ..streaming import assets
from .register import query, table

_q = lambda s: s.replace("'", "''")
_SQUASH = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("""WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'deprecated' ELSE 'active' END AS st, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 4 AS INTEGER) END AS used, CASE WHEN c_custkey % 4 > 0 THEN printf('attempt_%02d', c_custkey % 3) END AS av,
                 CASE WHEN c_custkey % 7 > 0 THEN [struct_pack(v := 'attempt_00', s := 'odd'), struct_pack(v := 'attempt_01', s := 'deprecated')] ELSE [] END AS vs FROM customer WHERE c_acctbal > 0), i AS (SELECT DISTINCT o_custkey AS id FROM orders),
               m AS (SELECT coalesce(e.id, i.id) AS id, st, used, coalesce(av, 'attempt_00') AS av, coalesce(vs, []) AS vs, e.id IS NULL AS created FROM i FULL JOIN e ON i.id = e.id),
               r AS (SELECT *, list_transform(vs, lambda x: struct_pack(v := x.v, s := CASE WHEN x.v = av AND x.s = 'odd' THEN 'active' ELSE x.s END)) AS vr, len(list_filter(vs, lambda x: x.v = av)) > 0 AS there FROM m)
          SELECT id AS canonical_id, created, CASE WHEN st IN ('deprecated', 'active') THEN st ELSE 'active' END AS status, coalesce(used, 0) AS attempts_used, av AS active_version,
          array_to_string(list_concat(list_transform(vr, lambda x: x.v || '=' || x.s), CASE WHEN there THEN [] ELSE [av || '=active'] END), ',') AS versions FROM r""")
def registry_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = lambda i, s: F.struct(F.lit(i).alias("version_id"), F.lit(s).alias("status"))
    entries = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        k.alias("canonical_id"), F.when(k % 5 == 0, "odd").when(k % 5 == 1, "deprecated").otherwise("active").alias("status"), F.when(k % 3 > 0, (k % 4).cast("int")).alias("attempts_used"), F.lit(None).cast("int").alias("restarts"),
        F.when(k % 4 > 0, requests.attempt_id(k % 3)).alias("active_version"), F.when(k % 7 > 0, F.array(v("attempt_00", "odd"), v("attempt_01", "deprecated"))).otherwise(F.array().cast("array<struct<version_id:string,status:string>>")).alias("versions"),
    )
    out = registry_state.repaired(entries, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("canonical_id")))
    shown = F.array_join(F.transform("versions", lambda x: F.concat(x["version_id"], F.lit("="), x["status"])), ",")
    return out.select("canonical_id", "created", "status", "attempts_used", "active_version", shown.alias("versions"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT c_custkey, a.o_custkey IS NOT NULL AS busy, CAST(c_custkey % 4 AS INTEGER) AS r, c_nationkey AS att FROM customer LEFT JOIN a ON c_custkey = o_custkey)
          SELECT c_custkey, CASE WHEN busy THEN NULL WHEN r >= 2 THEN 'manual_reprompt_required' ELSE 'deprecated_pending_replacement' END AS status, CASE WHEN NOT busy AND r < 2 THEN r + 1 ELSE r END AS restarts, CASE WHEN NOT busy AND r < 2 THEN att + 1 END AS job_attempt, NOT busy AND r < 2 AS enqueued FROM c""")
def stage_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("busy", F.lit(True))
    c = table(spark, sf_dir, "customer").join(busy, "c_custkey", "left")
    cols = registry_state.restart(F.coalesce("busy", F.lit(False)), (F.col("c_custkey") % 4).cast("int"), F.col("c_nationkey"))
    return c.select("c_custkey", *[v.alias(n) for n, v in cols.items()])


@query("""WITH q AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS attempt, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS n FROM orders), c AS (SELECT c_custkey, 0 AS attempt, CASE WHEN c_custkey % 3 = 0 THEN 'odd' ELSE 'completed' END AS ns FROM customer WHERE c_acctbal > 5000)
          SELECT o_custkey, o_orderkey, CASE WHEN n = 1 AND ns = 'completed' THEN ns ELSE status END AS status FROM q LEFT JOIN c ON o_custkey = c_custkey AND q.attempt = c.attempt""")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 2).alias("attempt"), F.col("o_orderstatus").alias("status"))
    k = F.col("c_custkey")
    changes = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(k.alias("o_custkey"), F.lit(0).cast("long").alias("attempt"), F.when(k % 3 == 0, "odd").otherwise("completed").alias("new_status"))
    return registry_state.set_status(queue, changes, "o_custkey", ["o_orderkey"]).drop("attempt")


@query(f"SELECT c_custkey, printf('attempt_%02d', c_nationkey) AS version_id, CASE WHEN c_nationkey % 2 = 0 THEN c_name || ', {requests.GEOMETRY_SUFFIX}' ELSE c_name END AS prompt FROM customer")
def version_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    entries = c.select("c_custkey", requests.attempt_id(F.col("c_nationkey")).alias("active_version"), "c_nationkey")
    return registry_state.snapshots(entries, c.select("c_custkey", F.col("c_name").alias("prompt")), "c_custkey", F.col("c_nationkey") % 2 == 0)


@query("""SELECT o_custkey, max_by(CASE WHEN o_orderkey % 10 = 0 THEN '-' ELSE 'run' END || o_orderkey, (o_orderdate, 'run' || o_orderkey)) AS run, max_by(o_orderstatus, (o_orderdate, 'run' || o_orderkey)) AS status FROM orders WHERE o_orderkey % 10 > 0 GROUP BY 1""")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "-").otherwise("run"), F.col("o_orderkey").cast("string"))
    runs = table(spark, sf_dir, "orders").select("o_custkey", name.alias("run"), "o_orderdate", F.col("o_orderstatus").alias("status"))
    return registry_state.latest_run(runs, "o_custkey", "run", "o_orderdate")


@query("""WITH h AS (SELECT conv_id, count(*) AS have FROM conversations WHERE turn % 2 = 0 GROUP BY 1) SELECT conv_id, turn, coalesce(have, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS citation_id FROM conversations LEFT JOIN h USING (conv_id) WHERE turn % 2 = 1""")
def session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return registry_state.appended(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", F.col("citation_id").cast("long").alias("citation_id"))


@query("""WITH d(param, dv) AS (VALUES ('click', 1.0), ('view', 2.0), ('zoom', 3.0)), s AS (SELECT user_id, event_type AS param, max(value) AS value FROM events GROUP BY 1, 2) SELECT k.user_id, d.param, coalesce(s.value, CAST(dv AS DOUBLE)) AS value FROM (SELECT DISTINCT user_id FROM events) k CROSS JOIN d LEFT JOIN s ON s.user_id = k.user_id AND s.param = d.param""")
def control_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("param")).agg(F.max("value").alias("value"))
    defaults = spark.createDataFrame([("click", 1.0), ("view", 2.0), ("zoom", 3.0)], "param string, value double")
    return registry_state.with_defaults(state, defaults, "user_id")


@query("""SELECT p_name AS action, min_by(p_brand, (p_type, p_partkey, p_brand)) AS grp, min_by(p_size, (p_type, p_partkey, p_brand)) AS delta FROM part GROUP BY 1""")
def action_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    space = p.select(F.col("p_brand").alias("grp"), F.col("p_type").alias("grp_pos"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("action"), F.col("p_brand").alias("target"), F.col("p_size").alias("delta"))
    return registry_state.legal_actions(space).drop("target")


@query("""WITH v AS (SELECT l_orderkey, l_returnflag AS target, max(l_quantity) AS b FROM lineitem GROUP BY 1, 2), m AS (SELECT v.*, greatest(0.0, least(50.0, greatest(0.0, least(45.0, b + 3.0)) * 0.9)) AS value, CASE target WHEN 'A' THEN 0 WHEN 'N' THEN 1 END AS pos FROM v WHERE target <> 'R')
          SELECT l_orderkey, target, value, value <> b AS applied, coalesce(value <> b AND pos = min(CASE WHEN value <> b THEN pos END) OVER (PARTITION BY l_orderkey), false) AS "primary" FROM m""")
def compound_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("target")).agg(F.max("l_quantity").alias("value"))
    rows = [(0, "A", "add", 3.0, 0.0, 45.0), (1, "N", "add", 3.0, 0.0, 45.0), (2, "A", "mul", 0.9, 0.0, 50.0), (3, "N", "mul", 0.9, 0.0, 50.0)]
    steps = spark.createDataFrame(rows, "pos int, target string, delta_type string, delta double, lo double, hi double")
    return registry_state.compound(values, values.select("l_orderkey", "target").join(steps, "target"), "l_orderkey")


@query("""WITH c(grp, action, compound, pos) AS (VALUES ('F', '1-URGENT', 'fix_all', 2), ('F', '1-URGENT', 'fix_fast', 1), ('O', '2-HIGH', 'open_all', 1))
          SELECT o_orderkey, coalesce(min_by(compound, pos) FILTER (compound <> 'fix_fast' OR o_custkey % 2 = 0), o_orderpriority) AS action FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN c.compound END AS compound, pos FROM orders LEFT JOIN c ON grp = o_orderstatus AND action = o_orderpriority) GROUP BY o_orderkey, o_orderpriority""")
def compound_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    compounds = spark.createDataFrame([("F", "1-URGENT", "fix_all", 2), ("F", "1-URGENT", "fix_fast", 1), ("O", "2-HIGH", "open_all", 1)], "grp string, action string, compound string, compound_pos int")
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("action"), "o_custkey")
    blocked = (F.col("compound") == "fix_fast") & (F.col("o_custkey") % 2 != 0)
    return registry_state.promoted(a, compounds, "o_orderkey", blocked, F.col("o_orderkey") % 3 > 0)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE ['light', 'object', 'scene', 'material', 'camera'][CAST(o_orderkey % 5 AS INTEGER) + 1] END AS grp FROM orders""")
def feedback_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    grp = registry_state.active_group(F.when(k % 7 == 0, F.col("o_orderstatus")).otherwise(" "), F.when(k % 5 == 0, F.col("o_orderpriority")), k, ("light", "object", "scene", "material", "camera"))
    return table(spark, sf_dir, "orders").select("o_orderkey", grp.alias("grp"))


@query("""SELECT c_custkey, c_custkey % 8 NOT IN (0, 3) AND c_custkey % 8 <> c_nationkey % 8 AND c_acctbal >= 100 AND c_nationkey <= 20 AS can_take FROM customer""")
def device_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (F.col("c_custkey") % 8).cast("int")
    ok = scheduling.available(index, F.col("c_acctbal"), F.col("c_nationkey"), F.lit(100), F.lit(20), F.array(F.lit(0), F.lit(3)), F.array((F.col("c_nationkey") % 8).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", ok.alias("can_take"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'p' || p_partkey END AS shard_id, p_type AS profile, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 100 END AS priority,
          CASE WHEN p_size % 5 > 0 THEN 'run ''' || p_name || '''' END AS command, CASE WHEN p_size % 5 = 0 THEN 'command' WHEN p_size % 7 = 0 THEN 'env' END AS error FROM part""")
def shard_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    key = F.when(size % 2 == 0, F.concat(F.lit('"id":"'), "p_brand", F.lit('"'))).otherwise(F.concat(F.lit('"shard_id":"p'), F.col("p_partkey").cast("string"), F.lit('"')))
    command = F.when(size % 5 > 0, F.concat(F.lit(',"command":["run","'), "p_name", F.lit('"]'))).otherwise(',"command":[]')
    priority = F.when(size % 3 == 0, F.concat(F.lit(',"priority":'), size.cast("string"))).otherwise("")
    env = F.when(size % 7 == 0, ',"env":"x"').otherwise(',"env":{"A":"1"}')
    spec = F.concat(F.lit("{"), key, F.lit(',"profile_name":"'), "p_type", F.lit('"'), command, priority, env, F.lit("}"))
    row = scheduling.shard_row(F.col("spec"))
    out = table(spark, sf_dir, "part").select("p_partkey", spec.alias("spec")).select("p_partkey", *[v.alias(n) for n, v in row.items()])
    return out.withColumn("command", F.when(F.size("command") > 0, scheduling.shell_quoted(F.col("command"))))


# --- texts ---


@query("""SELECT o_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND x <> ''), ',') AS items FROM (SELECT o_custkey, list(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]).alias("l"))  # the orders of one customer
    return listed.select("o_custkey", F.array_join(text.distinct_in_order(F.col("l")), ",").alias("items"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || ',doi' WHEN 1 THEN 'pdf,' || url ELSE url END AS links FROM pages""")
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    link = lambda url=None, link=None, pdf=None, i=None: F.struct(*[(F.lit(None).cast("string") if v is None else v).alias(n) for n, v in (("url", url), ("link", link), ("pdf_url", pdf), ("id", i))])
    url, blank = F.col("url"), F.lit(" ")
    links = F.when(k % 3 == 0, F.array(link(url=url), link(url=blank, i=F.lit("doi")), link(link=url))).when(k % 3 == 1, F.array(link(pdf=F.lit("pdf")), link(url=url))).otherwise(F.array(link(link=url), link(), link(url=url)))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.source_links(links), ",").alias("links"))


@query(f"""WITH d AS (SELECT doc_id, {_SQUASH("coalesce(text, '')")} AS t FROM documents), b AS (SELECT doc_id, CASE WHEN t <> '' THEN '- ' || t || chr(10) ELSE '' END || '- keep it plain' || chr(10) || 'Tags: calm, wide' AS b FROM d)
           SELECT doc_id, CASE WHEN length(b) > 1800 THEN rtrim(substr(b, 1, 1797)) || '...' ELSE b END AS block FROM b""")
def guidance_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.coalesce("text", F.lit("")), F.lit(" keep it  plain"), F.coalesce("text", F.lit("")), F.lit("keep it plain "))
    return table(spark, sf_dir, "documents").select("doc_id", text.guidance(parts, F.array(F.lit("calm"), F.lit("wide"), F.lit("calm"))).alias("block"))


@query(f"""WITH d AS (SELECT doc_id, {_SQUASH("text")} AS t FROM documents), h AS (SELECT *, substr(t, 1, 500) AS h FROM d), s AS (SELECT *, 500 - instr(reverse(h), '.') + 1 AS stop FROM h)
           SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN contains(h, '.') AND stop >= 160 THEN substr(h, 1, stop) ELSE rtrim(h) || '...' END AS summary FROM s""")
def compact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.compact_sentence(F.col("text")).alias("summary"))


@query("""SELECT event_id, 'Review sample ' || user_id || ', round ' || event_id % 4 || ', group ' || event_type || ', view v' || event_id % 8 || '.' || CASE WHEN event_id % 4 > 0 THEN ' Compare it with the previous round.' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' Use only these tags: none, dark.' ELSE '' END || ' Answer with one JSON object.' AS prompt FROM events""")
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    tags = F.when(k % 3 == 0, F.array(F.lit("none"), F.lit("dark"))).otherwise(F.array().cast("array<string>"))
    prompt = text.review_prompt(F.col("user_id").cast("string"), k % 4, F.col("event_type"), F.concat(F.lit("v"), (k % 8).cast("string")), k % 4 > 0, tags)
    return table(spark, sf_dir, "events").select("event_id", prompt.alias("prompt"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderkey % 4 = 2 THEN 7200 ELSE 0 END END AS seconds FROM orders""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k % 4 == 0, F.concat(at, F.lit("Z"))).when(k % 4 == 1, "soon").when(k % 4 == 2, F.concat(at, F.lit("+02:00"))).otherwise(F.concat(F.lit(" "), at, F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(text.iso_time(raw)).alias("seconds"))


@query("""WITH t(field, pos, question) AS (VALUES ('click', 1, 'What was clicked?'), ('view', 2, 'What was  seen?'), ('purchase', 3, 'What was bought?')), a AS (SELECT DISTINCT user_id, event_type AS field FROM events WHERE value > 100), q AS (SELECT DISTINCT user_id FROM events WHERE value < 20),
               g AS (SELECT k.user_id, t.* FROM (SELECT user_id FROM a UNION SELECT user_id FROM q) k CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = k.user_id AND a.field = t.field) AND NOT (t.field = 'view' AND k.user_id IN (SELECT user_id FROM q)))
          SELECT user_id, field, question FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos) <= 2""")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    templates = spark.createDataFrame([("click", 1, "What was clicked?"), ("view", 2, "What was  seen?"), ("purchase", 3, "What was bought?")], "field string, pos int, question string")
    answered = e.where("value > 100").select("user_id", F.col("event_type").alias("field")).distinct()
    asked = e.where("value < 20").select("user_id", F.lit(" what WAS seen? ").alias("question"))
    return text.open_questions(templates, answered, asked, "user_id", 2)


_KINDS = ("deprecate", "claim", "promote", "fail", "restart")


@query("""WITH RECURSIVE ev AS (SELECT user_id AS a, event_id AS seq, event_id % 5 AS k, event_id % 7 = 0 AS fin, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    st AS (
        SELECT a, 0::BIGINT AS n, 0::BIGINT AS seq, 'active' AS status, 0 AS used, 0 AS restarts, 0 AS active, MAP {0: 'active'} AS versions, MAP {-1: ''} AS jobs, NULL::INTEGER AS job, NULL::BIGINT AS started FROM (SELECT DISTINCT a FROM ev)
        UNION ALL
        SELECT a, n, seq,
            CASE k WHEN 0 THEN CASE WHEN job IS NULL AND used + 1 > 2 THEN 'manual_reprompt_required' ELSE 'deprecated_pending_replacement' END WHEN 2 THEN 'active' WHEN 3 THEN CASE WHEN fin THEN 'manual_reprompt_required' ELSE 'deprecated_pending_replacement' END
                   WHEN 4 THEN CASE WHEN job IS NOT NULL THEN status WHEN restarts >= 2 THEN 'manual_reprompt_required' ELSE 'deprecated_pending_replacement' END ELSE status END,
            CASE WHEN k IN (2, 3) THEN greatest(used, number) ELSE used END,
            CASE WHEN k = 2 THEN 0 WHEN k = 4 AND job IS NULL AND restarts < 2 THEN restarts + 1 ELSE restarts END,
            CASE WHEN k = 2 THEN number ELSE active END,
            CASE k WHEN 0 THEN map_concat(versions, MAP {active: CASE WHEN job IS NULL AND used + 1 > 2 THEN 'replacement_failed' ELSE 'deprecated_pending_replacement' END})
                   WHEN 2 THEN map_concat(map_concat(versions, MAP {active: 'deprecated'}), MAP {number: 'active'}) WHEN 3 THEN map_concat(versions, MAP {number: 'replacement_failed'}) ELSE versions END,
            CASE WHEN k = 0 AND job IS NULL AND used + 1 <= 2 THEN map_concat(jobs, MAP {used + 1: 'queued'}) WHEN k = 1 AND job IS NOT NULL AND jobs[job] = 'queued' THEN map_concat(jobs, MAP {job: 'running'})
                 WHEN k IN (2, 3) AND map_contains(jobs, number) THEN map_concat(jobs, MAP {number: CASE k WHEN 2 THEN 'completed' ELSE 'failed' END}) WHEN k = 4 AND job IS NULL AND restarts < 2 THEN map_concat(jobs, MAP {greatest(used, 1): 'queued'}) ELSE jobs END,
            CASE WHEN k = 0 AND job IS NULL AND used + 1 <= 2 THEN used + 1 WHEN k IN (2, 3) THEN NULL WHEN k = 4 AND job IS NULL AND restarts < 2 THEN greatest(used, 1) ELSE job END,
            CASE WHEN k = 1 AND job IS NOT NULL AND jobs[job] = 'queued' THEN ms ELSE started END
        FROM (SELECT st.a, ev.n, ev.seq, ev.k, ev.fin, ev.ms, status, used, restarts, active, versions, job, started, coalesce(job, used + 1) AS number,
                     CASE WHEN job IS NOT NULL AND jobs[job] = 'running' AND ev.ms - started >= 7200000 THEN map_concat(jobs, MAP {job: 'queued'}) ELSE jobs END AS jobs
              FROM st JOIN ev ON ev.a = st.a AND ev.n = st.n + 1) x)
    SELECT a AS asset_id, seq, status, used AS attempts_used, restarts, format('attempt_{:02d}', active) AS active_version, nullif(coalesce(job, list_max(map_keys(jobs))), -1) AS job_attempt,
           nullif(jobs[coalesce(job, list_max(map_keys(jobs)))], '') AS job_status, array_to_string(list_sort([format('attempt_{:02d}:', e.key) || e.value FOR e IN map_entries(versions)]), ',') AS versions
    FROM st QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC) = 1""")
def asset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as assets, their events as what happens to them: the registry's last entries with versions and jobs."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = e.select(
        F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.lit(None).cast("int").alias("attempt"), F.col("event_type").alias("reason"),
        (F.col("event_id") % 7 == 0).alias("final"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
    )
    return assets.folded_registry(rows).drop("note")


_BARE = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH a AS (SELECT doc_id, coalesce(CASE doc_id % 4 WHEN 0 THEN '<think>no' || chr(10) || 'PROMPT: wrong' || chr(10) || 'JSON: {{"color": "bad"}}</think>' || chr(10) || 'PROMPT: ' || text || chr(10) || 'JSON: {{"material": "m' || doc_id || '", "color": "red"}}'
                  WHEN 1 THEN 'PROMPT: ' || text || chr(10) || 'JSON: {{broken, "color": }}' WHEN 2 THEN chr(10) || '  ' || text ELSE '<think>' || text || '</think>  ' || chr(10) END, '') AS t FROM documents),
           r AS (SELECT doc_id, {_BARE("regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')")} AS t FROM a),
           j AS (SELECT *, nullif(regexp_extract(t, 'JSON:\\s*(\\{{[^}}]+\\}})', 1), '') AS j FROM r)
           SELECT doc_id, coalesce(nullif({_BARE("regexp_extract(t, '(?s)PROMPT:\\s*(.+?)(?:\\nJSON:|$)', 1)")}, ''), nullif({_BARE("regexp_extract(t, '^\\s*([^\\n]*)', 1)")}, ''), '{text.NO_ANSWER}') AS prompt,
                  CASE WHEN json_valid(j) THEN j->>'material' ELSE 'unknown' END AS material, CASE WHEN json_valid(j) THEN j->>'color' ELSE 'unknown' END AS color, CASE WHEN json_valid(j) THEN j->>'style' ELSE 'unknown' END AS style FROM j""")
def answer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a model's answers: with thoughts and an object, with a broken one, as plain lines, and of thoughts alone."""
    k, t = F.col("doc_id") % 4, F.col("text")
    answer = (
        F.when(k == 0, F.concat(F.lit('<think>no\nPROMPT: wrong\nJSON: {"color": "bad"}</think>\nPROMPT: '), t, F.lit('\nJSON: {"material": "m'), F.col("doc_id").cast("string"), F.lit('", "color": "red"}')))
        .when(k == 1, F.concat(F.lit("PROMPT: "), t, F.lit('\nJSON: {broken, "color": }'))).when(k == 2, F.concat(F.lit("\n  "), t)).otherwise(F.concat(F.lit("<think>"), t, F.lit("</think>  \n")))
    )
    d = table(spark, sf_dir, "documents").withColumn("_a", text.parsed_answer(answer))
    return d.select("doc_id", F.col("_a.prompt").alias("prompt"), *[F.try_element_at("_a.features", F.lit(c)).alias(c) for c in ("material", "color", "style")])
