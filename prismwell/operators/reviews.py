"""Reviews as rows: coercion of what models say, keyword reviews, measured scores, fusion of views, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, has_any, last_match, rounded

# fixed values: the fields of a review and what they may hold
SCORES = ("lighting", "object_integrity", "composition", "render_quality_semantic", "overall")
CONFIDENCES = ("low", "medium", "high")
NONE_LIKE = ("none", "null", "n/a", "na")
VIABILITY = ("continue", "abandon", "unclear")
ABANDON_HINTS = (
    "should be regenerated", "needs regeneration", "regenerate this asset", "regenerate the asset", "unusable asset", "not salvageable", "cannot be salvaged", "wrong object geometry",
    "fundamentally wrong geometry", "render effect not salvageable", "不可补救", "建议重生", "建议重新生成", "需要重新生成", "渲染效果不可补救", "几何完全不对",
)
# fixed values: word families of free reviews: words, tag, actions, the score they cap at 2
FAMILIES = {
    "large": (("too large", "too big", "oversized", "过大", "太大", "偏大"), "scale_implausible", ("O_SCALE_DOWN_10",), "composition"),
    "small": (("too small", "undersized", "过小", "太小", "偏小"), "scale_implausible", ("O_SCALE_UP_10",), "composition"),
    "dark": (("too dark", "too black", "underexposed", "darker than reference", "太暗", "太黑", "偏黑"), "underexposed", ("ENV_STRENGTH_UP", "M_VALUE_UP"), "lighting"),
    "color": (("color difference", "color mismatch", "color shift", "色差", "偏色", "颜色不一致", "颜色太假"), "color_shift", ("M_VALUE_UP", "M_SATURATION_DOWN"), "render_quality_semantic"),
    "light": (("lighting mismatch", "light mismatch", "fake lighting", "光影不一致", "光照不一致", "阴影方向不一致"), "scene_light_mismatch", ("ENV_ROTATE_30",), "lighting"),
    "shadow": (("shadow missing", "missing shadow", "grounding weak", "接触阴影", "阴影缺失", "缺少阴影"), "shadow_missing", ("S_CONTACT_SHADOW_UP",), "lighting"),
    "material": (("material fake", "material looks fake", "too glossy", "plastic", "材质假", "塑料感", "反光假"), None, ("M_ROUGHNESS_UP",), "render_quality_semantic"),
    "floating": (("floating", "hovering", "漂浮", "浮空"), "floating_visible", ("O_LOWER_SMALL",), "composition"),
    "sunk": (("intersecting ground", "embedded in ground", "穿地", "穿插地面"), "ground_intersection_visible", ("O_LIFT_SMALL",), "composition"),
    "wrong": (("different object", "wrong object", "不是同一个", "结构不一致"), None, (), "object_integrity"),
}
MAJOR_WORDS = ("major", "severe", "明显", "很大")
KEEP_WORDS = ("keep", "acceptable", "good enough", "可以接受", "可接受", "能接受")
REJECT_WORDS = ("reject", "unusable", "不可用", "不行")
# fixed values: weights of the measured scores with a mask, without one, and in scenes
CV_MASK = {"mask": 0.30, "exposure": 0.25, "sharpness": 0.20, "framing": 0.25}
CV_PLAIN = {"exposure": 0.556, "sharpness": 0.444}
CV_SCENE = {"exposure": 0.45, "sharpness": 0.35, "framing": 0.20}
# fixed values: tags of failed checks by their kinds
EDIT_TAGS = {
    "instruction_not_followed": ("instruction_following",), "source_not_preserved": ("source_preservation", "background_preservation"), "edit_not_local": ("edit_locality",),
    "edit_artifact": ("artifact_quality",), "identity_drift": ("identity_consistency",),
}
EDIT_KINDS = ("instruction_following", "source_preservation", "edit_locality", "identity_consistency", "artifact_quality")


def coerced_score(x: Column, default: int = 3) -> Column:
    """A score of 1 to 5: fractions are cut, what is no whole number as text or nothing is the default."""
    return clamp(F.coalesce(x.try_cast("int"), F.lit(default)), 1, 5)


def one_of(x: Column, known: tuple[str, ...], default: str | None) -> Column:
    return F.when(x.isin(*known), x).otherwise(F.lit(default))


def none_to_null(x: Column) -> Column:
    """Trimmed; null for blank and for words that say none."""
    t = F.nullif(F.trim(x), F.lit(""))
    return F.when(~F.lower(t).isin(*NONE_LIKE), t)


def kept_tags(tags: Column, known: tuple[str, ...], most: int = 3) -> Column:
    """The first known tags, or none."""
    found = F.slice(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(*known)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def kept_actions(actions: Column, legal: Column, most: int = 2) -> Column:
    """Of the first actions those that are legal, or NO_OP."""
    head = F.slice(F.filter(F.coalesce(actions, F.array(F.lit("NO_OP"))), lambda a: a.isNotNull()), 1, most)
    found = F.filter(head, lambda a: F.array_contains(legal, a) | (a == "NO_OP"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NO_OP")))


def asset_viability(text: Column, said: Column | None = None) -> tuple[Column, Column, Column]:
    """(viability, reason, confidence): from the review's lines, else as ``said`` elsewhere, else from hints in its words."""
    line = F.lower(last_match(text, r"(?im)^\s*Asset viability:\s*(continue|abandon|unclear)\b"))
    reason = none_to_null(last_match(text, r"(?im)^\s*Abandon reason:\s*(.+?)\s*$"))
    sure = one_of(F.lower(last_match(text, r"(?im)^\s*Abandon confidence:\s*(low|medium|high|none)\b")), CONFIDENCES, None)
    low = F.lower(text)
    hint = F.coalesce(*[F.when(F.contains(low, F.lit(h.lower())), F.lit(h)) for h in ABANDON_HINTS])
    known = F.lit(None).cast("string") if said is None else one_of(F.lower(said), VIABILITY, None)
    state = F.coalesce(line, known, F.when(hint.isNotNull(), "abandon"), F.lit("unclear"))
    hinted = line.isNull() & known.isNull()
    return state, F.when(line.isNotNull(), reason).when(hinted, hint), F.when(line.isNotNull(), sure).when(hinted & hint.isNotNull(), "high")


def keyword_review(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a whole review from a free text's words: route, scores, tags, actions, diagnoses and viability."""
    state, reason, sure = asset_viability(F.col(text))
    found = {name: has_any(F.col(text), words) for name, (words, _, _, _) in FAMILIES.items()} | {"major": has_any(F.col(text), MAJOR_WORDS), "keep": has_any(F.col(text), KEEP_WORDS), "reject": has_any(F.col(text), REJECT_WORDS)}
    found |= {"state": state, "reason": reason, "sure": sure}
    seen = rows.select("*", *[c.alias(f"_is_{n}") for n, c in found.items()])  # columns of their own, so that none is worked out twice
    told = {n: F.col(f"_is_{n}") for n in found}
    raw_tags = F.array_compact(F.array(*[F.when(told[n], F.lit(tag)) for n, (_, tag, _, _) in FAMILIES.items() if tag]))
    acts = F.array_compact(F.array(*[F.when(told[n], F.lit(a)) for n, (_, _, actions, _) in FAMILIES.items() for a in actions]))
    seen = seen.withColumns({"_tags": raw_tags, "_acts": F.slice(F.array_distinct(acts), 1, 2)})
    capped = lambda score: sum((told[n].cast("int") for n, f in FAMILIES.items() if f[3] == score), F.lit(0)) > 0
    forced = told["wrong"] & (told["state"] != "abandon")
    seen = seen.withColumns({"_passes": told["keep"] & (F.size("_tags") == 0), "_rejects": told["reject"] & (F.size("_tags") >= 2)})
    gone = ((told["wrong"] | (told["state"] == "abandon")) & ~F.col("_passes")) | F.col("_rejects")
    tags = F.slice(F.array_distinct("_tags"), 1, 3)
    color = F.when(told["color"], F.when(told["major"], "major_shift").otherwise("minor_shift")).when(told["dark"], "minor_shift").otherwise("good")
    light = F.when(told["light"], "scene_light_mismatch").when(told["dark"], "underexposed_global").when(told["shadow"], "shadow_missing").otherwise("good")
    cols = {
        "route": F.when(gone, "reject").when(F.col("_passes"), "pass").otherwise("needs_fix"), **{s: F.when(capped(s), 2).otherwise(3) for s in SCORES[:4]},
        "overall": F.when(gone, 2).when(F.col("_passes"), 4).otherwise(3),
        "issue_tags": F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("none"))), "suggested_actions": F.when(F.size("_acts") > 0, F.col("_acts")).otherwise(F.array(F.lit("NO_OP"))),
        "lighting_diagnosis": light, "structure_consistency": F.when(told["wrong"], "major_mismatch").otherwise("good"), "color_consistency": color,
        "physics_consistency": F.when(told["floating"] | told["sunk"], "minor_issue").otherwise("good"), "asset_viability": F.when(told["wrong"], "abandon").otherwise(told["state"]),
        "abandon_reason": F.when(forced, F.coalesce(told["reason"], F.lit("wrong object geometry"))).otherwise(told["reason"]),
        "abandon_confidence": F.when(forced, F.coalesce(told["sure"], F.lit("high"))).otherwise(told["sure"]),
    }
    return seen.select(*rows.columns, *[v.alias(n) for n, v in cols.items()])


def tags_of_kinds(kinds: Column) -> Column:
    """The tags of an image's failed or uncertain checks, from the set of their kinds."""
    ban = F.array_contains(kinds, "text_ban")
    other = F.size(F.array_remove(kinds, "text_ban")) > 0
    return F.when(F.size(kinds) == 0, F.array(F.lit("none"))).otherwise(F.array_compact(F.array(F.when(ban, "text_artifact"), F.when(other, "prompt_constraint_miss"))))


def edit_tags_of_kinds(kinds: Column) -> Column:
    """The same of an edit's checks, four at most."""
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, ks))), F.lit(t)) for t, ks in EDIT_TAGS.items()]))
    return F.when(F.size(kinds) == 0, F.array(F.lit("none"))).when(F.size(found) == 0, F.array(F.lit("edit_constraint_miss"))).otherwise(F.slice(found, 1, 4))


def edit_scores(rows: DataFrame, key: str, pos: str, overall: Column, kind: str = "kind", status: str = "status") -> DataFrame:
    """A score of 2 for each kind whose last check that did not pass failed, else the overall one; an uncertain check hides a failure before it.

    Failed checks are told before uncertain ones.
    """
    bad = rows.where(F.col(status) != "pass")
    told = lambda k: F.max_by(F.when(F.col(kind) == k, F.col(status)), F.when(F.col(kind) == k, F.struct((F.col(status) == "uncertain"), F.col(pos))))
    last = bad.groupBy(key).agg(*[told(k).alias(k) for k in EDIT_KINDS])
    return last.select(key, *[F.when(F.col(k) == "fail", 2).otherwise(overall).alias(k) for k in EDIT_KINDS])


def cv_score(mask: Column, exposure: Column, sharpness: Column, framing: Column, scene: bool = False) -> Column:
    """The measured scores as one: by the mask's weights where there is a mask, in scenes never."""
    named = {"mask": mask, "exposure": exposure, "sharpness": sharpness, "framing": framing}
    mixed = lambda weights: rounded(sum((named[k] * w for k, w in list(weights.items())[1:]), named[next(iter(weights))] * next(iter(weights.values()))), 4)
    return mixed(CV_SCENE) if scene else F.when(mask.isNotNull(), mixed(CV_MASK)).otherwise(mixed(CV_PLAIN))


def framing_score(box: tuple[Column, Column, Column, Column], pixels: Column, width: Column, height: Column, weak: bool = False, border: int = 5) -> Column:
    """How well a foreground (its inclusive box and number of pixels) stands in the frame; a half for none."""
    x0, y0, x1, y1 = box
    off = F.hypot((x0 + x1) / 2.0 - width / 2.0, (y0 + y1) / 2.0 - height / 2.0)
    diagonal = F.hypot(width.cast("double"), height.cast("double"))
    low, high = (0.08, 0.80) if weak else (0.15, 0.65)
    area = pixels / (width * height)
    centre = 1.0 - off / (diagonal + 1e-8) if weak else 1.0 - off / (diagonal / 2.0 + 1e-8)
    size = F.when(area < low, area / low).when(area > high, 1.0 - (area - high) / (1.0 - high)).otherwise(1.0)
    cut = 0.25 * sum((c.cast("int") for c in (y1 > height - border, x0 < border, x1 > width - border)), (y0 < border).cast("int"))
    a, b, c = (0.20, 0.45, 0.35) if weak else (0.45, 0.35, 0.20)
    return F.when(pixels > 0, clamp(a * centre + b * F.greatest(F.lit(0.0), size) + c * (1.0 - cut), 0.0, 1.0)).otherwise(0.5)


def view_means(views: DataFrame, key: str, scores: tuple[str, ...], optional: tuple[str, ...], flag: str) -> DataFrame:
    """Each object's mean scores at two decimals, means of the optional ones where there are any, and whether any view has the flag."""
    return views.groupBy(key).agg(*[rounded(F.avg(s), 2).alias(s) for s in scores], *[rounded(F.avg(s), 4).alias(s) for s in optional], F.bool_or(flag).alias(flag))


def blended_rounded(value: str) -> Column:
    """Seven tenths of the mean, rounded before, and three of the worst."""
    return rounded(0.7 * rounded(F.avg(value), 4) + 0.3 * F.min(value), 4)


def video_rate(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Counts and the pass rate as it is, 0 without any check."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = rows.groupBy(key).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("uncertain").alias("uncertain"), F.count(status).alias("total"))
    return out.withColumn("pass_rate", F.coalesce(F.col("passed") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def image_statistics(pixels: DataFrame, key: str, channels: tuple[str, ...], luma: str) -> DataFrame:
    """Mean, deviation, luma deviation, shares that are not black and not white, and whether the picture is not flat."""
    k = len(channels)
    mean = sum((F.avg(c) for c in channels[1:]), F.avg(channels[0])) / k
    sigma = sum((F.stddev_pop(c) for c in channels[1:]), F.stddev_pop(channels[0])) / k
    m = pixels.groupBy(key).agg(mean.alias("mean"), sigma.alias("std"), F.stddev_pop(luma).alias("luma_std"), F.count_if(F.col(luma) >= 9).alias("b"), F.count_if(F.col(luma) < 247).alias("w"), F.count("*").alias("n"))
    return m.select(key, "mean", "std", "luma_std", (F.col("b") / F.col("n")).alias("nonblack"), (F.col("w") / F.col("n")).alias("nonwhite"), ((F.col("std") > 8.0) & (F.col("luma_std") > 6.0)).alias("nonflat"))


def mask_statistics(pixels: DataFrame, key: str, x: str, y: str, value: str) -> DataFrame:
    """The foreground's share and its inclusive box, null for an empty mask."""
    on = F.col(value) > 8
    at = lambda f, c: f(F.when(on, F.col(c)))
    m = pixels.groupBy(key).agg(F.count_if(on).alias("on"), F.count("*").alias("n"), at(F.min, x).alias("x0"), at(F.min, y).alias("y0"), at(F.max, x).alias("x1"), at(F.max, y).alias("y1"))
    return m.select(key, (F.col("on") > 0).alias("nonempty"), (F.col("on") / F.col("n")).alias("area_fraction"), "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) / F.col("n")).alias("bbox_fraction"))
