"""The action cascade over all orders: their columns stand for reviews, their customers' lines for control state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control
from .register import query, table

_MAPS = [
    (1, "dim", 0, "BRIGHT"), (1, "dim", 1, "KEY_UP"), (1, "dim", 2, "FILL_UP"), (1, "harsh", 0, "KEY_DOWN"), (1, "good", 0, "NO_OP"), (2, "minor_shift", 0, "HUE_UP"), (2, "major_shift", 0, "SAT_UP"),
    (2, "major_shift", 1, "HUE_UP"), (3, "minor_issue", 0, "DROP"), (3, "floating", 0, "SCALE_UP"), (4, "dark", 0, "KEY_UP"), (4, "dark", 1, "BRIGHT"), (4, "broken", 0, "DROP"), (4, "broken", 1, "__MESH_REJECT__"), (4, "flat", 0, "FILL_UP"),
]
_ACTIONS = [
    ("KEY_UP", "lighting", "key", 0.0, 2.0), ("KEY_DOWN", "lighting", "key", 0.0, 2.0), ("FILL_UP", "lighting", "fill", 0.0, 1.5), ("HUE_UP", "material", "hue", -1.0, 1.0), ("SAT_UP", "material", "sat_scale", 0.5, 1.6),
    ("DROP", "object", "offset_z", -0.5, 0.5), ("SCALE_UP", "object", "scale", 0.5, 2.0),
]
_COMPOUNDS = [("BRIGHT", "KEY_UP"), ("BRIGHT", "FILL_UP")]
_GUARDS = [("BRIGHT", "key", 1.2)]
_STATE = [("key", "lighting", 17), ("fill", "lighting", 13), ("hue", "material", 11), ("scale", "object", 7)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def tables_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The operator's tables, by name."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(k / n) % len(xs) + 1).cast("int"))
    reviews = o.select(
        k.alias("id"), pick(1, "lighting", "object", "scene").alias("active_group"), pick(3, "good", "dim", "harsh", None, "dim").alias("lighting_diagnosis"), pick(5, "good", "minor_shift", "major_shift", None).alias("color_consistency"),
        pick(7, "good", "minor_issue", "floating", "odd", None).alias("physics_consistency"), F.when(k % 6 > 0, F.array(pick(2, "dark", "none", "flat"), pick(11, "broken", "flat", "dark"))).alias("issue_tags"),
        F.when(k % 4 == 0, F.array(F.lit("KEY_UP"), F.lit("HUE_UP"))).alias("denied"), F.when(k % 9 == 0, F.array(F.lit("FILL_UP"), F.lit("DROP"))).alias("allowed"),
    )
    state = o.select(k.alias("id"), F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(g).alias("grp"), ((c * n) % 21 / 10.0).alias("value")) for t, g, n in _STATE])))
    history = o.where(c % 3 == 0).select(k.alias("id"), F.inline(F.array(*[F.struct(F.lit(t).alias("target"), ((c + n) % 4 == 0).alias("frozen")) for t, _, n in _STATE])))
    return {
        "reviews": reviews, "maps": spark.createDataFrame(_MAPS, "phase int, said string, place int, action string"), "actions": spark.createDataFrame(_ACTIONS, "action string, grp string, target string, lo double, hi double"),
        "compounds": spark.createDataFrame(_COMPOUNDS, "action string, part string"), "guards": spark.createDataFrame(_GUARDS, "action string, param string, most double"), "state": state, "history": history,
    }


_pick = lambda n, *xs: f"([{', '.join('NULL' if x is None else repr(x) for x in xs)}])[(o_orderkey // {n}) % {len(xs)} + 1]"


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, {_pick(1, "lighting", "object", "scene")} AS grp0, coalesce({_pick(3, "good", "dim", "harsh", None, "dim")}, 'good') AS light, coalesce({_pick(5, "good", "minor_shift", "major_shift", None)}, 'good') AS color,
              coalesce({_pick(7, "good", "minor_issue", "floating", "odd", None)}, 'good') AS physics, CASE WHEN o_orderkey % 6 > 0 THEN [{_pick(2, "dark", "none", "flat")}, {_pick(11, "broken", "flat", "dark")}] ELSE [] END AS tags,
              CASE WHEN o_orderkey % 4 = 0 THEN ['KEY_UP', 'HUE_UP'] ELSE [] END AS denied, CASE WHEN o_orderkey % 9 = 0 THEN ['FILL_UP', 'DROP'] ELSE [] END AS allowed FROM orders),
           maps(phase, said, place, action) AS (VALUES {_values(_MAPS)}), actions(action, grp, target, lo, hi) AS (VALUES {_values(_ACTIONS)}), compounds(action, part) AS (VALUES {_values(_COMPOUNDS)}), st(target, grp, n) AS (VALUES {_values(_STATE)}),
           asked AS (SELECT id, 1 AS phase, 0 AS tag, light AS said FROM r WHERE grp0 IN ('lighting', 'scene') UNION ALL SELECT id, 2, 0, color FROM r WHERE color IN ('minor_shift', 'major_shift')
                     UNION ALL SELECT id, 3, 0, CASE physics WHEN 'odd' THEN 'minor_issue' ELSE physics END FROM r WHERE physics <> 'good' UNION ALL SELECT id, 4, i - 1, tags[i] FROM r, range(1, 3) t(i) WHERE len(tags) >= i),
           c AS (SELECT a.id, r.c, phase, tag, place, action, (len(allowed) = 0 OR list_contains(allowed, action)) AND NOT list_contains(denied, action) AS open FROM asked a JOIN r USING (id) JOIN maps USING (phase, said)),
           f AS (SELECT r.id, target, (c + n) % 4 = 0 AS frozen FROM r, st WHERE c % 3 = 0), v AS (SELECT r.id, grp, target, (c * n) % 21 / 10.0 AS value FROM r, st),
           one AS (SELECT c.id, phase, tag, place, action FROM c JOIN actions USING (action) LEFT JOIN f ON f.id = c.id AND f.target = actions.target LEFT JOIN v ON v.id = c.id AND v.grp = actions.grp AND v.target = actions.target
                   WHERE open AND NOT coalesce(frozen, false) AND NOT (coalesce(value, CASE WHEN actions.target LIKE '%scale' THEN 1.0 ELSE 0.0 END) <= lo + (hi - lo) * 0.05 OR coalesce(value, CASE WHEN actions.target LIKE '%scale' THEN 1.0 ELSE 0.0 END) >= hi - (hi - lo) * 0.05)),
           two AS (SELECT c.id, phase, tag, place, c.action FROM c JOIN compounds ON compounds.action = c.action JOIN actions ON actions.action = part LEFT JOIN f ON f.id = c.id AND f.target = actions.target LEFT JOIN v ON v.id = c.id AND v.target = 'key'
                   WHERE open AND phase IN (1, 4) AND NOT coalesce(frozen, false) AND coalesce(value, 1.0) <= 1.2),
           every AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT id, phase, tag, place, action FROM c WHERE phase = 1 AND action = 'NO_OP' UNION ALL SELECT id, phase, tag, -1, action FROM c WHERE phase = 4 AND action = '__MESH_REJECT__'),
           best AS (SELECT id, min_by(action, (phase, tag, place)) AS action, min_by(phase, (phase, tag, place)) AS phase FROM every GROUP BY id)
           SELECT r.id, coalesce(action, 'NO_OP') AS action, phase FROM r LEFT JOIN best USING (id)""")
def preset_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.preset_actions(key="id", **tables_of(spark, sf_dir))
