"""Dataset requests: routes, models, prompts for each sample, and what a prompt's row carries along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import has_any, squash_spaces

# fixed values: routes, their other names, texts of prompts without a file, clauses, metadata keys
ROUTES = ("t2i", "edit", "blender", "t2v")
ALIASES = {
    "text_to_image": "t2i", "text2image": "t2i", "image_edit": "edit", "i2i_edit": "edit", "t_i_to_i": "edit",
    "3d": "blender", "blender_3d": "blender", "text_to_video": "t2v", "text2video": "t2v",
}
NO_REQUEST = "Create a high-quality multimodal dataset sample"
T2I_PROMPT = ". Produce one clean, inspectable image for dataset sample {n}. Use stable composition, clear subject identity, and no text watermark."
EDIT_PROMPT = ". Edit only the requested visual attributes for sample {n}; preserve unrelated content, layout, and image identity."
BLENDER_PROMPT = ". Route this request to the existing Blender dataset pipeline. Keep scene assets, render metadata, and loop trace outputs reproducible."
T2V_PROMPT = (
    ". Generate a short, coherent text-to-video dataset sample. Use physically plausible motion, stable camera behavior, consistent subject identity, natural lighting, "
    "and a clear beginning-middle-end action. Avoid text, logos, watermarks, flicker, warped anatomy, impossible object motion, and unrelated scene changes."
)
T2V_NEGATIVE = "text, subtitles, logos, watermark, flicker, jitter, distorted anatomy, warped geometry, impossible physics, abrupt scene cuts, low quality"
PRESERVE_WORDS = ("preserve", "保持", "保留", "unchanged")
PRESERVATION = (
    "Apply only this requested edit. Preserve the source image's camera view, layout, background, lighting, non-target objects, object identity, and overall composition. "
    "Do not repaint the whole image. Avoid text, logos, watermarks, blur, or new unrelated objects."
)
METADATA_KEYS = ("original_prompt", "rewritten_prompt", "original_edit_instruction", "tier", "source_prompt_id", "rewrite_reason", "negative_prompt")
GEOMETRY_SUFFIX = "high quality 3D geometry, detailed surface, clear edges, non-flat"
PROMPT_COLUMNS = {"t2i": ("prompt", "text", "user_request"), "edit": ("edit_instruction", "instruction", "prompt", "text"), "t2v": ("prompt", "text", "user_request")}


def route(x: Column, strict: bool = False) -> Column:
    """The route of this name; others fail, or are null unless ``strict``."""
    plain = F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("-"), F.lit("_"))
    known = F.create_map(*[F.lit(v) for pair in (ALIASES | {r: r for r in ROUTES}).items() for v in pair])
    found = F.try_element_at(known, plain)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported route: "), plain)).cast("string")) if strict else found


def resolve_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``requests`` (route, model_name, model_path) with the model: what is asked for, else the registry's default.

    ``models`` has model_name, model_route, default_path, is_default, one default for each route. A name
    that is not registered stands, with ``registry_hit`` false; one of another route gives ``mismatch``.
    """
    default = models.where("is_default").select(F.col("model_route").alias("route"), F.col("model_name").alias("_default"))
    named = requests.join(default, "route", "left").withColumn("model_name", F.coalesce(F.nullif(F.trim("model_name"), F.lit("")), "_default")).drop("_default")
    met = named.join(models.drop("is_default"), "model_name", "left")
    path = F.coalesce(F.nullif(F.trim("model_path"), F.lit("")), "default_path")
    hit = F.col("model_route").isNotNull()
    return met.withColumns({"model_path": path, "registry_hit": hit, "mismatch": hit & (F.col("model_route") != F.col("route"))}).drop("default_path", "model_route")


def build_requests(rows: DataFrame) -> DataFrame:
    """Requests with their numbers in range and texts trimmed; ``error`` names what forbids one."""
    least = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c).cast("int"), F.lit(1)))
    named = route(F.col("route"))
    blank = F.length(F.trim(F.coalesce("input_image_dir", F.lit("")))) == 0
    error = F.when(named.isNull(), "unsupported_route").when((named == "edit") & blank, "input_image_dir_required")
    return rows.withColumns({"route": named, "user_request": F.trim("user_request"), "negative_prompt": F.trim(F.coalesce("negative_prompt", F.lit(""))), "num_samples": least("num_samples"), "vlm_max_retries": least("vlm_max_retries"), "error": error})


def edit_instruction(x: Column) -> Column:
    """The instruction with the clause that all else is to be kept, unless it says so itself."""
    clean = squash_spaces(x)
    return F.when(has_any(clean, PRESERVE_WORDS), clean).otherwise(F.concat(clean, F.lit(". " + PRESERVATION)))


def row_metadata(row: dict[str, Column]) -> Column:
    """A map of the whitelisted values that are not blank."""
    pairs = F.create_map(*[v for k in METADATA_KEYS if k in row for v in (F.lit(k), row[k].cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (F.length(F.trim(v)) > 0))


def build_prompts(requests: DataFrame, file_rows: DataFrame) -> DataFrame:
    """A row for each sample of each request: request_id, idx, sample_id, prompt, original_prompt, negative_prompt.

    ``requests``: request_id, route, user_request, num_samples, sample_prefix, negative_prompt;
    ``file_rows``: request_id, idx and any of sample_id, id and the columns of PROMPT_COLUMNS. A sample
    takes its file's row, else its route's template.
    """
    wide = requests.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("num_samples") - 1)))
    told = [c for c in file_rows.columns if c not in ("request_id", "idx")]
    met = wide.join(file_rows.select("request_id", "idx", *[F.col(c).alias(f"file_{c}") for c in told]), ["request_id", "idx"], "left")
    # each text is squashed, chosen and decorated once, as a column of its own: written out wherever it is used, the code outgrows what the JVM compiles
    keys = [k for k in dict.fromkeys([*(k for ks in PROMPT_COLUMNS.values() for k in ks), "negative_prompt", "sample_id", "id", "original_prompt"]) if k in told]
    met = met.withColumns({f"_{k}": F.nullif(squash_spaces(F.col(f"file_{k}")), F.lit("")) for k in keys} | {"_base": F.nullif(squash_spaces(F.col("user_request")), F.lit(""))})
    of_file = lambda *ks: F.coalesce(*[F.col(f"_{k}") for k in ks if k in told], F.lit(None).cast("string"))
    base = F.coalesce("_base", F.lit(NO_REQUEST))
    number = (F.col("idx") + 1).cast("string")

    def templated(text: str) -> Column:
        head, _, tail = text.partition("{n}")
        return F.concat(base, F.lit(head), number, F.lit(tail)) if tail else F.concat(base, F.lit(head))

    route = F.col("route")
    said = (
        F.when(route == "t2i", F.coalesce(of_file(*PROMPT_COLUMNS["t2i"]), templated(T2I_PROMPT)))
        .when(route == "edit", F.coalesce(of_file(*PROMPT_COLUMNS["edit"]), templated(EDIT_PROMPT)))
        .when(route == "t2v", F.coalesce(of_file(*PROMPT_COLUMNS["t2v"]), templated(T2V_PROMPT)))
        .otherwise(templated(BLENDER_PROMPT))
    )
    met = met.withColumn("_said", said)
    negative = F.when(route == "t2v", F.coalesce(of_file("negative_prompt"), F.nullif("negative_prompt", F.lit("")), F.lit(T2V_NEGATIVE))).otherwise(of_file("negative_prompt"))
    met = met.withColumn("_edit", F.when(route == "edit", edit_instruction(F.col("_said"))))
    return met.select(
        "request_id", "idx", "route",
        F.coalesce(of_file("sample_id", "id"), F.format_string("%s_%04d", "sample_prefix", F.col("idx") + 1)).alias("sample_id"),
        F.coalesce("_edit", "_said").alias("prompt"), F.coalesce(of_file("original_prompt"), F.col("_said")).alias("original_prompt"), negative.alias("negative_prompt"),
    )


def with_geometry_suffix(prompt: Column) -> Column:
    """The prompt with the geometry clause at its end, once."""
    filled = F.coalesce(prompt, F.lit(""))
    return F.when(filled == "", GEOMETRY_SUFFIX).when(F.contains(F.lower(filled), F.lit(GEOMETRY_SUFFIX.lower())), filled).otherwise(F.concat(filled, F.lit(", " + GEOMETRY_SUFFIX)))


def attempt_id(n: Column) -> Column:
    return F.format_string("attempt_%02d", n.cast("int"))


def templated_prompt(concepts: DataFrame, templates: DataFrame, generic: dict[str, str]) -> DataFrame:
    """``concepts`` (name, features) with the prompt of the template of that name, else of the ``generic`` words.

    ``templates``: name, material, color, style, geometry; ``features`` stands for the geometry where it is filled.
    """
    met = concepts.join(templates, "name", "left")
    word = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(generic[c]))
    geometry = F.coalesce(F.nullif(F.trim("features"), F.lit("")), word("geometry"))
    return met.select(*concepts.columns, F.concat(F.lit("a "), F.concat_ws(" ", word("color"), word("material"), "name"), F.lit(", "), geometry, F.lit(", "), word("style")).alias("prompt"))


def panorama_prompt(instruction: str, explicit: Column, description: Column, scene_type: Column, tags: Column, hints: Column) -> Column:
    """An explicit prompt, led by the instruction once; else one put together from what is told of the scene."""
    told = F.trim(F.coalesce(explicit, F.lit("")))
    filled = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    part = lambda lead, x, end: F.when(F.length(x) > 0, F.concat(F.lit(lead), x, F.lit(end)))
    made = F.concat_ws(
        " ", F.concat(F.lit(instruction), F.lit(" Preserve the generated "), F.coalesce(F.nullif(F.trim(scene_type), F.lit("")), F.lit("outdoor")), F.lit(" scene.")),
        part("Scene description: ", F.trim(F.coalesce(description, F.lit(""))), ""), part("Visual style: ", F.array_join(filled(tags), ", "), "."), part("Layout constraints: ", F.array_join(filled(hints), "; "), "."),
    )
    return F.when((told != "") & F.contains(told, F.lit(instruction)), told).when(told != "", F.concat_ws(" ", F.lit(instruction), told)).otherwise(made)


def repair_clauses(spec: Column, families: dict[str, tuple[tuple[str, ...], str]], most: int = 3) -> Column:
    """The first clauses whose words a repair note holds, joined by commas; '' without any."""
    told = F.array_compact(F.array(*[F.when(has_any(spec, words), F.lit(clause)) for words, clause in families.values()]))
    return F.array_join(F.slice(told, 1, most), ", ")


def coerced_text(x: Column) -> Column:
    """A list's items that are not blank, trimmed: from text, split at semicolons and lines, without bullets."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), "[;\n]"), lambda p: F.regexp_replace(p, r"^[\s\-*]+|[\s\-*]+$", ""))
    return F.filter(parts, lambda p: F.length(p) > 0)


def selected(rows: DataFrame, tier: str = "all", ids: list[str] | None = None) -> DataFrame:
    """The rows of a tier, of all by that name, and of the ids asked for, if any are."""
    rows = rows if tier == "all" else rows.where(F.col("tier") == tier)
    return rows if ids is None else rows.where(F.trim(F.col("id").cast("string")).isin(*ids))
