"""Feedback control: bounded steps, dead zones, oscillation, action choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Reversals after which a target is frozen.
FREEZE_AFTER = 3


def step_scale(round_idx: Column, score: Column) -> Column:
    """Smaller steps in later rounds, larger ones while the score is low, 1.2 at most."""
    base = F.when(round_idx == 0, 1.0).when(round_idx == 1, 0.7).when(round_idx == 2, 0.5).otherwise(0.4)
    return F.least(F.lit(1.2), F.when((score > 0) & (score < 0.65), base * 1.2).otherwise(base))


def apply_step(current: Column, kind: Column, delta: Column, scale: Column, lo: Column, hi: Column) -> Column:
    """A multiplicative or additive step, kept within bounds."""
    raw = F.when(kind == "mul", current * ((delta - 1) * scale + 1)).when(kind == "add", current + delta * scale).otherwise(current)
    return F.greatest(lo, F.least(hi, raw))


def in_dead_zone(value: Column, lo: Column, hi: Column, share: float = 0.05) -> Column:
    """Whether a value is within a share of the range from either bound."""
    edge = (hi - lo) * share
    return (value <= lo + edge) | (value >= hi - edge)


def flip_history(steps: DataFrame, key: str, order: list[str], sign: str) -> DataFrame:
    """(key, last_sign, flips, most_flips, frozen): reversals in a row, by windows over each key's signs.

    A reversal adds one, an equal sign starts anew; a target stays frozen once it was.
    """
    w = Window.partitionBy(key).orderBy(*order)
    s = steps.where(F.col(sign) != 0).select(key, F.struct(*order).alias("_at"), F.col(sign).cast("int").alias("_s"), (F.coalesce(F.lag(sign).over(w) != F.col(sign), F.lit(False))).cast("int").alias("_flip"))
    runs = s.withColumn("_run", F.sum(1 - F.col("_flip")).over(Window.partitionBy(key).orderBy("_at")))
    ended = runs.groupBy(key, "_run").agg(F.sum("_flip").alias("_n"), F.max(F.struct("_at", "_s")).alias("_last"))
    out = ended.groupBy(key).agg(F.max(F.struct("_last", "_n")).alias("_e"), F.max("_n").alias("most"))
    return out.select(key, F.col("_e._last._s").alias("last_sign"), F.col("_e._n").cast("int").alias("flips"), F.col("most").cast("int").alias("most_flips"), (F.col("most") >= FREEZE_AFTER).alias("frozen"))


def choose_action(rows: DataFrame, key: str, candidates: DataFrame, on: list[str], blocked: Column) -> DataFrame:
    """(key, action): the viable candidate of the first phase and place; NO_OP if there is none.

    ``candidates`` (keys, phase, place, action) is a short table.
    """
    met = rows.join(candidates, on, "left").withColumn("_ok", F.col("action").isNotNull() & ~F.coalesce(blocked, F.lit(False)))
    best = met.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.struct("phase", "place", "action"))).alias("b"))
    return best.select(key, F.coalesce("b.action", F.lit("NO_OP")).alias("action"))


def guard_blocks(values: dict[str, Column], limits: dict[str, float]) -> Column:
    """Whether one of the guarded values is over its limit."""
    out = F.lit(False)
    for name, limit in limits.items():
        out = out | (values[name] > limit)
    return out


# fixed values: what is chosen without a candidate, what rejects an asset, the groups whose light is diagnosed, and how a parameter starts
NO_OP, REJECT = "NO_OP", "__MESH_REJECT__"
LIT_GROUPS, SHIFTS, LESSER = ("lighting", "scene"), ("minor_shift", "major_shift"), "minor_issue"
GUARDED_GROUP, GUARDED_START = "lighting", 1.0


def start_value(target: Column) -> Column:
    """What a parameter is before it was ever set."""
    return F.when(F.endswith(target, F.lit("scale")), 1.0).otherwise(0.0)


def preset_actions(reviews: DataFrame, key: str, maps: DataFrame, actions: DataFrame, compounds: DataFrame, guards: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """(key, action, phase): each review's first viable action; NO_OP without one.

    The light's diagnosis comes first (1), then a shift of colour (2), physics (3), and the issue tags in
    their order (4). An action is viable if its lists allow it and its target is known, not frozen and
    not at a bound; a compound, which phases 1 and 4 know, if no guard stops it and one of its parts has a
    target that is not frozen. A tag that rejects wins before its other candidates.

    ``reviews``: key, active_group, lighting_diagnosis, color_consistency, physics_consistency, issue_tags,
    and denied and allowed (arrays; null or empty allow all). The action space in short tables: ``maps``
    (phase, said, place, action), ``actions`` (action, grp, target, lo, hi), unique by action,
    ``compounds`` (action, part), ``guards`` (action, param, most). ``state`` (key, grp, target, value) and
    ``history`` (key, target, frozen) are unique by their first columns. A null diagnosis is a good one.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("good"))
    step = lambda phase, cond, what: F.when(cond, F.struct(F.lit(phase).alias("phase"), F.lit(0).alias("tag"), what.alias("said")))
    tags = F.transform(F.coalesce("issue_tags", F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(4).alias("phase"), i.alias("tag"), t.alias("said")))
    firsts = F.array(
        step(1, F.col("active_group").isin(*LIT_GROUPS), said("lighting_diagnosis")),
        step(2, said("color_consistency").isin(*SHIFTS), said("color_consistency")),
        step(3, said("physics_consistency") != "good", said("physics_consistency")),
    )
    asked = reviews.select(F.col(key).alias("_k"), "denied", "allowed", F.inline(F.filter(F.concat(firsts, tags), lambda x: x.isNotNull())))
    # physics that the space does not know count as the lesser issue
    known = maps.where("phase = 3").select(F.col("said").alias("_known")).distinct()
    asked = asked.join(known, (F.col("phase") == 3) & (F.col("said") == F.col("_known")), "left")
    asked = asked.withColumn("said", F.when((F.col("phase") == 3) & F.col("_known").isNull(), LESSER).otherwise(F.col("said"))).drop("_known")
    met = asked.join(maps, ["phase", "said"])
    listed = (F.coalesce(F.size("allowed"), F.lit(0)) <= 0) | F.coalesce(F.array_contains("allowed", F.col("action")), F.lit(False))
    denied = F.coalesce(F.array_contains("denied", F.col("action")), F.lit(False))
    at = F.struct("phase", "tag", "place").alias("at")
    c = met.select("_k", "phase", at, "action", (listed & ~denied).alias("open"))

    frozen = history.select(F.col(key).alias("_k"), "target", F.coalesce("frozen", F.lit(False)).alias("frozen"))
    now = state.select(F.col(key).alias("_k"), "grp", "target", "value")
    single = c.where("open").join(actions, "action").join(frozen, ["_k", "target"], "left").join(now, ["_k", "grp", "target"], "left")
    bound = in_dead_zone(F.coalesce("value", start_value(F.col("target"))), F.col("lo"), F.col("hi"))
    single = single.where(~F.coalesce("frozen", F.lit(False)) & ~F.coalesce(bound, F.lit(False))).select("_k", "at", "action")

    both = c.where("open and phase in (1, 4)").join(compounds.select("action").distinct(), "action")
    parts = both.join(compounds, "action").join(actions.select(F.col("action").alias("part"), "target"), "part").join(frozen, ["_k", "target"], "left")
    viable = parts.where(~F.coalesce("frozen", F.lit(False))).select("_k", "at", "action").distinct()
    lit = now.where(F.col("grp") == GUARDED_GROUP).select("_k", F.col("target").alias("param"), "value")
    stopped = viable.join(guards, "action").join(lit, ["_k", "param"], "left").where(F.coalesce("value", F.lit(GUARDED_START)) > F.col("most")).select("_k", "at", "action").distinct()
    viable = viable.join(stopped, ["_k", "at", "action"], "left_anti")

    # that nothing is to be done is an answer of the first phase; a rejection stands before its tag's candidates
    idle = c.where((F.col("phase") == 1) & (F.col("action") == NO_OP)).select("_k", "at", "action")
    rejected = c.where((F.col("phase") == 4) & (F.col("action") == REJECT)).select("_k", F.struct(F.col("at.phase").alias("phase"), F.col("at.tag").alias("tag"), F.lit(-1).alias("place")).alias("at"), "action")
    best = single.unionByName(viable).unionByName(idle).unionByName(rejected).groupBy("_k").agg(F.min_by(F.struct("action", F.col("at.phase").alias("phase")), "at").alias("b"))
    return reviews.select(F.col(key).alias("_k")).join(best, "_k", "left").select(F.col("_k").alias(key), F.coalesce("b.action", F.lit(NO_OP)).alias("action"), F.col("b.phase").alias("phase"))
