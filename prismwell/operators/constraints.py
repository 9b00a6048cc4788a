"""Checklists of constraints: normalising, reconciling with reviews, rates, routes, improvement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import listed

# fixed values: words by which a prompt implies a constraint
IMPLIED = {
    "c_front_back": ("in front of", "behind", "front", "back"),
    "c_occlusion": ("occlude", "occludes", "occluded", "partially hidden", "partly inside"),
    "c_transparent_reflective": ("glass", "transparent", "reflective", "reflection", "mirror", "chrome", "metal"),
    "c_local_parts": ("handle", "ring", "cap", "button", "strap", "wheel", "edge", "rim", "teeth", "porthole"),
    "c_no_text": ("no text", "no readable", "no logos", "no logo", "watermark", "avoid text"),
}
COUNTED = r"\b(exactly|only)\s+(one|two|three|four|five|six|\d+)\b"


def normalize_constraints(rows: DataFrame, key: str, pos: str, cid: str, description: str, blank_first: bool = False) -> DataFrame:
    """The first row of each constraint id, those with blank descriptions left out.

    An id counts as used even by a blank row, unless ``blank_first`` drops those beforehand.
    """
    filled = F.length(F.trim(F.coalesce(F.col(description), F.lit("")))) > 0
    rows = rows.where(filled) if blank_first else rows
    first = F.row_number().over(Window.partitionBy(key, cid).orderBy(pos))
    return rows.withColumn("_n", first).where("_n = 1").where(filled).drop("_n")


def reconcile(declared: DataFrame, observed: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """All declared and observed constraints; what was not observed is uncertain."""
    d = declared.select(*keys).distinct().withColumn("declared", F.lit(True))
    o = observed.select(*keys, F.col(status).alias("status")).withColumn("observed", F.lit(True))
    met = d.join(o, keys, "full_outer")
    return met.select(*keys, F.coalesce("status", F.lit("uncertain")).alias("status"), F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("observed", F.lit(False)).alias("observed"))


def checklist_counts(rows: DataFrame, key: str) -> DataFrame:
    """Passed, failed, uncertain, total and the pass rate of each key."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy(key).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("uncertain").alias("uncertain"), F.count("*").alias("total"))
    return out.withColumn("pass_rate", F.col("passed") / F.greatest(F.lit(1), F.col("total")))


def route_image(said: Column, failed: Column, uncertain: Column) -> Column:
    """A failure overrides an explicit pass, an uncertain item does not."""
    clean = (failed == 0) & (uncertain == 0)
    route = F.when(said.isin("pass", "needs_fix", "reject"), said).otherwise(F.when(clean, "pass").otherwise("needs_fix"))
    return F.when((route == "pass") & (failed > 0), "needs_fix").otherwise(route)


def route_edit(said: Column, failed: Column, uncertain: Column, artifact_failed: Column) -> Column:
    """Failures and uncertain items override a pass; a failed artifact check among three rejects."""
    clean = (failed == 0) & (uncertain == 0)
    route = F.when(said.isin("pass", "needs_fix", "reject"), said).otherwise(F.when(clean, "pass").otherwise("needs_fix"))
    route = F.when((route == "pass") & ~clean, "needs_fix").otherwise(route)
    return F.when(artifact_failed & (failed >= 3), "reject").otherwise(route)


def overall_from_rate(rate: Column, failed: Column, uncertain: Column) -> Column:
    """1 to 5 by the rate, half to even; 3 at most with failures, 4 with uncertain items."""
    score = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(rate * 5, 0).cast("int")))
    return F.when(failed > 0, F.least(score, F.lit(3))).when(uncertain > 0, F.least(score, F.lit(4))).otherwise(score)


def improvements(rows: DataFrame, key: str, cid: str, round_col: str, status: str = "status") -> DataFrame:
    """Status changes between neighbouring rounds: improved from bad to pass, regressed the other way."""
    w = Window.partitionBy(key, cid).orderBy(round_col)
    prev = rows.withColumn("_s", F.lag(status).over(w)).withColumn("_r", F.lag(round_col).over(w))
    step = prev.where(F.col("_r") == F.col(round_col) - 1)
    good, was = F.col(status) == "pass", F.col("_s") == "pass"
    return step.groupBy(key, round_col).agg(F.count_if(good & ~was).alias("improved"), F.count_if(~good & was).alias("regressed"))


def first_improvement(changes: DataFrame, key: str, round_col: str) -> DataFrame:
    """The first round of each key in which something improved."""
    return changes.where("improved > 0").groupBy(key).agg(F.min(round_col).alias("to_round"), F.min_by("improved", round_col).alias("improved"))


def implied_constraints(prompt: Column) -> Column:
    """The ids of the constraints that a prompt implies, alignment first."""
    low = F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(F.coalesce(prompt, F.lit("")), r"\s+", " "))), F.lit(" "))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return listed(
        (F.lit(True), "c_prompt_alignment"), (low.rlike(COUNTED), "c_count"), (F.contains(low, F.lit(" left ")) | F.contains(low, F.lit(" right ")), "c_left_right"),
        *[(any_of(words), name) for name, words in IMPLIED.items()],
    )


def extend_constraints(base: Column, extra: list[str]) -> Column:
    """``base`` and those of ``extra`` that it lacks, in order."""
    return F.concat(base, F.filter(F.array(*map(F.lit, extra)), lambda x: ~F.array_contains(base, x)))


# fixed values: what videos are checked for besides, the checks of an edit, and the checks of each tier of the prompt bank
VIDEO = {"video_prompt_alignment": "prompt_alignment", "video_temporal_coherence": "temporal_coherence", "video_common_sense_motion": "physical_plausibility", "video_artifact_quality": "artifact_quality"}
EDIT = {
    "instruction_following": "The edited image visibly follows the requested edit: {}",
    "source_preservation": "Unmentioned source-image objects, scene layout, camera view, and overall identity remain recognizable.",
    "edit_locality": "The visual change is localized to the requested target or region instead of rewriting the whole image.",
    "identity_consistency": "The edited target remains the same object category/shape unless the instruction explicitly asks otherwise.",
    "background_preservation": "The background, lighting, and non-target composition are preserved unless explicitly requested.",
    "artifact_quality": "The edited result is coherent, not blank, not overpainted, and has no obvious artifacts, text, logos, or watermarks.",
}
TIER_KINDS = {
    "simple": ("object", "attribute", "composition"), "relation": ("object", "attribute", "relation", "text_ban"),
    "hard": ("object", "attribute", "count", "left_right", "front_back", "occlusion", "material", "local_parts", "text_ban"),
}


def default_edit(instruction: Column) -> Column:
    """The six checks of an edit, as an array of structs (constraint_id, type, description)."""
    text = lambda d: F.concat(F.lit(d[:-2]), instruction) if d.endswith("{}") else F.lit(d)
    return F.array(*[F.struct(F.lit(f"c_{k}").alias("constraint_id"), F.lit(k).alias("type"), text(d).alias("description")) for k, d in EDIT.items()])


def explicit_or(explicit: Column, inferred: Column) -> Column:
    """The explicit constraints if there are any, else the inferred ones."""
    return F.when(F.size(F.coalesce(explicit, F.array().cast("array<string>"))) > 0, explicit).otherwise(inferred)


def bank(seeds: DataFrame, tier: str, subject: Column) -> DataFrame:
    """(id, tier, prompt, constraints) of a tier's seed rows."""
    checks = F.array(*[F.struct(F.lit(f"c_{k}").alias("constraint_id"), F.lit(k).alias("type"), F.concat(F.lit(f"{k.replace('_', ' ')} of "), subject).alias("description")) for k in TIER_KINDS[tier]])
    return seeds.select("id", F.lit(tier).alias("tier"), F.concat(F.lit("A clean picture of "), subject).alias("prompt"), checks.alias("constraints"))
