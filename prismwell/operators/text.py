"""Reading reviews and model answers: verdicts, viability, JSON in noise, keyword reviews, roll-ups."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import has_any, last_match, squash_spaces

# fixed values: keywords of free reviews, each with its tag
TAG_WORDS = {
    "scale_implausible": ("too large", "too big", "oversized", "too small", "undersized", "过大", "太大", "偏大", "过小", "太小", "偏小"),
    "underexposed": ("too dark", "too black", "underexposed", "darker than reference", "太暗", "太黑", "偏黑"),
    "color_shift": ("color difference", "color mismatch", "color shift", "色差", "偏色", "颜色不一致", "颜色太假"),
    "scene_light_mismatch": ("lighting mismatch", "light mismatch", "fake lighting", "光影不一致", "光照不一致", "阴影方向不一致"),
    "shadow_missing": ("shadow missing", "missing shadow", "grounding weak", "接触阴影", "阴影缺失", "缺少阴影"),
    "floating_visible": ("floating", "hovering", "漂浮", "浮空"),
    "ground_intersection_visible": ("intersecting ground", "embedded in ground", "穿地", "穿插地面"),
}
KEEP_WORDS = ("keep", "acceptable", "good enough", "可以接受", "可接受", "能接受")
REJECT_WORDS = ("reject", "unusable", "不可用", "不行")


def verdict(review: Column, route: Column) -> Column:
    """The last verdict line of a review, else by the route."""
    said = F.lower(last_match(review, r"(?im)^\s*Verdict:\s*(keep|revise|reject)\b"))
    low = F.lower(route)
    return F.coalesce(said, F.when(low.isin("accept", "accepted", "keep"), "keep").when(low.isin("reject", "rejected"), "reject").otherwise("revise"))


def viability(review: Column) -> Column:
    """The last viability line of a review, else unclear."""
    return F.coalesce(F.lower(last_match(review, r"(?im)^\s*Asset viability:\s*(continue|abandon|unclear)\b")), F.lit("unclear"))


def review_tags(text: Column) -> Column:
    """The first three tags that a free review's words give."""
    tags = F.array_compact(F.array(*[F.when(has_any(text, words), F.lit(tag)) for tag, words in TAG_WORDS.items()]))
    return F.slice(tags, 1, 3)


def review_route(text: Column, tags: Column) -> Column:
    """Pass if it is to be kept and nothing is wrong, reject with two tags, else a fix."""
    return F.when(has_any(text, REJECT_WORDS) & (F.size(tags) >= 2), "reject").when(has_any(text, KEEP_WORDS) & (F.size(tags) == 0), "pass").otherwise("needs_fix")


def answer_prompt(answer: Column) -> Column:
    """The prompt of a model's answer: what follows PROMPT: up to JSON:, else the first filled line."""
    rest = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    told = F.nullif(F.trim(F.regexp_extract(rest, r"(?s)PROMPT:(.*?)(?:\nJSON:|$)", 1)), F.lit(""))
    return F.coalesce(told, F.trim(F.regexp_extract(rest, r"(?m)^\s*(\S.*)$", 1)))


# fixed values: what an answer without a line, and one without readable features, stands for
NO_ANSWER, UNKNOWN = "photorealistic studio photo, white background, 8K", {"material": "unknown", "color": "unknown", "style": "unknown"}


def parsed_answer(answer: Column) -> Column:
    """(prompt, features) of a model's answer: the prompt told or the first filled line, and the flat JSON object after JSON:.

    Thoughts between ``<think>`` marks count for nothing. Features are a map of texts; an answer without
    any, or with an object that cannot be read, has unknown ones. White space is that of ASCII.
    """
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rest = bare(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", ""))
    told = F.nullif(bare(F.regexp_extract(rest, r"(?s)PROMPT:\s*(.+?)(?:\nJSON:|$)", 1)), F.lit(""))
    line = F.nullif(bare(F.regexp_extract(rest, r"^\s*([^\n]*)", 1)), F.lit(""))
    found = F.try_parse_json(F.nullif(F.regexp_extract(rest, r"JSON:\s*(\{[^}]+\})", 1), F.lit("")))
    unknown = F.create_map(*[F.lit(x) for pair in UNKNOWN.items() for x in pair])
    return F.struct(F.coalesce(told, line, F.lit(NO_ANSWER)).alias("prompt"), F.coalesce(F.try_variant_get(found, "$", "map<string,string>"), unknown).alias("features"))


def first_json(text: str | None) -> str | None:
    """The first JSON document in a text: the text itself, a fenced block, or balanced braces."""
    text = text or ""
    decoder = json.JSONDecoder()
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for t in (text.strip(), *map(str.strip, fenced)):
        try:
            return json.dumps(json.loads(t), sort_keys=True)
        except ValueError:
            continue
    for m in re.finditer(r"\{", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], sort_keys=True)
        except ValueError:
            continue
    return None


def extract_json(col: Column) -> Column:
    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(first_json)

    return found(col)


def distinct_folded(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The first of each key's values that differ by more than case and white space."""
    folded = F.lower(squash_spaces(F.col(value)))
    kept = rows.withColumn("_k", folded).where(F.length("_k") > 0)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_k").orderBy(*order))).where("_n = 1").drop("_n", "_k")


def distinct_in_order(items: Column) -> Column:
    """The different items that are not empty, in order."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def source_links(links: Column) -> Column:
    """The different addresses of structs with url, link, pdf_url or id, the first of these that is filled."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return distinct_in_order(F.transform(links, lambda s: F.coalesce(*[filled(s[k]) for k in ("url", "link", "pdf_url", "id")], F.lit(""))))


def guidance(parts: Column, tags: Column, items: int = 8, chars: int = 1800) -> Column:
    """A block of the first different items, and a line of tags, cut with an ellipsis; '' for nothing."""
    said = F.slice(distinct_in_order(F.transform(parts, squash_spaces)), 1, items)
    lines = F.array_join(F.transform(said, lambda x: F.concat(F.lit("- "), x)), "\n")
    tag_line = F.array_join(F.slice(distinct_in_order(tags), 1, items), ", ")
    block = F.concat_ws("\n", F.nullif(lines, F.lit("")), F.when(tag_line != "", F.concat(F.lit("Tags: "), tag_line)))
    return F.when(F.length(block) > chars, F.concat(F.rtrim(F.substring(block, 1, chars - 3)), F.lit("..."))).otherwise(block)


def compact_sentence(x: Column, most: int = 500, least: int = 160) -> Column:
    """A text of at most ``most`` characters: cut after its last full stop from ``least`` on, else with an ellipsis."""
    flat = squash_spaces(x)
    head = F.substring(flat, 1, most)
    stop = most - F.instr(F.reverse(head), ".") + 1
    return F.when(F.length(flat) <= most, flat).when((F.instr(head, ".") > 0) & (stop >= least), F.substr(head, F.lit(1), stop)).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def review_prompt(sample: Column, round_idx: Column, group: Column, view: Column, has_previous: Column, tags: Column) -> Column:
    """What a reviewer is asked, from a row's fields."""
    parts = [
        F.format_string("Review sample %s, round %d, group %s, view %s.", sample, round_idx.cast("int"), group, view),
        F.when(has_previous, "Compare it with the previous round."), F.when(F.size(tags) > 0, F.concat(F.lit("Use only these tags: "), F.array_join(tags, ", "), F.lit("."))), F.lit("Answer with one JSON object."),
    ]
    return F.concat_ws(" ", *parts)


def iso_time(x: Column) -> Column:
    """The time of an ISO text, null for any other."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(x), "Z$", "+00:00"))


def open_questions(templates: DataFrame, answered: DataFrame, asked: DataFrame, key: str, most: int) -> DataFrame:
    """(key, field, question): for fields without an answer, those not asked before, at most so many of each key.

    ``templates``: field, pos, question (a short table); ``answered``: key, field; ``asked``: key, question.
    Questions that differ by case and white space alone are the same.
    """
    folded = lambda c: F.lower(squash_spaces(F.col(c)))
    keys = answered.select(key).union(asked.select(key)).distinct()
    gaps = keys.crossJoin(templates).join(answered, [key, "field"], "left_anti").withColumn("_q", folded("question"))
    fresh = gaps.join(asked.select(key, folded("question").alias("_q")).distinct(), [key, "_q"], "left_anti")
    n = F.row_number().over(Window.partitionBy(key).orderBy("pos", "field"))
    return fresh.withColumn("_n", n).where(F.col("_n") <= max(1, most)).select(key, "field", "question")
