"""Quality gates: conditions in a fixed order that give a status and its reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import first_of, listed

# fixed values: thresholds of the image, video, alpha, physics and material gates
IMAGE = {"least_bytes": 1024, "sigma": 1.0, "black": 3.0, "white": 252.0, "washed_luma": 245.0, "washed_sigma": 18.0, "none": 0.005, "small": 0.035, "weak": 0.08, "weak_luma": 235.0}
ALPHA_RANGE = (0.05, 0.95)


def image_issues(size: Column, width: Column, height: Column, want: tuple[int, int], max_sigma: Column, max_mean: Column, min_mean: Column, luma: Column, luma_sigma: Column, foreground: Column) -> Column:
    t = IMAGE
    return listed(
        (size < t["least_bytes"], "output_too_small"), (width != want[0], "width_mismatch"), (height != want[1], "height_mismatch"),
        (max_sigma < t["sigma"], "low_information"), (max_mean < t["black"], "near_black"), (min_mean > t["white"], "near_white"),
        ((luma > t["washed_luma"]) & (luma_sigma < t["washed_sigma"]), "washed_out"),
        (foreground < t["none"], "foreground_missing"), ((foreground >= t["none"]) & (foreground < t["small"]), "foreground_too_small"),
        ((foreground < t["weak"]) & (luma > t["weak_luma"]), "weak_separation"),
    )


def image_status(issues: Column) -> Column:
    """Warn if a small output is the only issue."""
    return F.when(F.size(issues) == 0, "pass").when(F.array_join(issues, ",") == "output_too_small", "warn").otherwise("fail")


def video_status(issues: Column) -> Column:
    """Missing metadata alone does no harm."""
    return F.when(F.size(F.array_except(issues, F.array(F.lit("video_metadata_unavailable")))) == 0, "pass").otherwise("fail")


def alpha_reason(readable: Column, has_alpha: Column, low: Column, high: Column, foreground: Column) -> Column:
    """The first failure of the alpha gate, or ok."""
    return first_of(
        (~readable, "unreadable"), (~has_alpha, "not_rgba"), (low >= 255, "alpha_all_white"), (high <= 0, "alpha_all_black"),
        ((foreground < ALPHA_RANGE[0]) | (foreground > ALPHA_RANGE[1]), "fg_ratio_out_of_range"), otherwise="ok",
    )


def physics_flags(gap: Column, penetration: Column, height: Column, outside: Column) -> tuple[Column, Column]:
    """(worst violation, whether all is clean), with tolerances that grow with the object's height."""
    gap_room = F.greatest(F.lit(0.0012), F.least(F.lit(0.004), height * 0.005))
    depth_room = F.greatest(F.lit(0.0008), F.least(F.lit(0.003), height * 0.004))
    clean = (gap <= gap_room) & (penetration <= depth_room) & ~outside
    return F.greatest(gap, penetration), clean


def merge_physics(said: Column, violation: Column, outside: Column, clean: Column) -> Column:
    """What was said of the physics, corrected by what was measured."""
    return (
        F.when((violation > 0.05) | outside, "major_issue")
        .when((violation > 0.01) & (said == "good"), "minor_issue")
        .when(clean & (said == "major_issue"), "minor_issue")
        .otherwise(said)
    )


def material_reason(faces: Column, flatness: Column, textured: Column, colorful: Column) -> Column:
    return first_of((faces < 200, "geometry_too_sparse"), (flatness < 0.02, "bbox_too_flat"), (~textured, "missing_image_texture"), (colorful < 0.05, "low_colorfulness"), otherwise="ok")


def all_or_not_blocking(success: Column, blocking: Column) -> Column:
    """An aggregate: no blocking check failed."""
    return F.bool_and(success | ~blocking)


# fixed values: thresholds of the alpha check before reconstruction, and fields of a render that must be so
CUTOUT = {"small": 0.01, "large": 0.92, "side": 0.08, "fragments": 0.25, "parts": 12}
RENDER_FLAGS = {"ground_hit_success": True, "contract_support_plane_used": False, "joint_3d_render": True, "is_floating": False, "is_intersecting_support": False}
RENDER_WORDS = {"camera_mode": "scene_camera_match", "ground_hit_source": "mesh_raycast"}
VIDEO_SUFFIXES = ("mp4", "gif", "webm", "mov")
BLOCKING = ("deprecated_pending_replacement", "manual_reprompt_required")


def video_issues(path: Column, size: Column, width: Column, height: Column, frames: Column, want: tuple[int, int, int]) -> Column:
    """Issues of a video file; width and height are null where no probe could read it."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    least = max(2, min(want[2], 8))
    return listed(
        (size < F.when(suffix == "gif", 1024).otherwise(4096), "output_too_small"), (~suffix.isin(*VIDEO_SUFFIXES), "unexpected_video_extension"),
        (width.isNull() | height.isNull(), "video_metadata_unavailable"), (width != want[0], "width_mismatch"), (height != want[1], "height_mismatch"), (frames < least, "too_few_frames"),
    )


def cutout_issues(foreground: Column, side_w: Column, side_h: Column, fragments: Column, parts: Column) -> Column:
    """Why a cut-out cannot be reconstructed; shares of fragments and parts may be unknown."""
    t = CUTOUT
    return listed(
        (foreground < t["small"], "foreground_too_small"), (foreground > t["large"], "foreground_too_large"), (side_w < t["side"], "bbox_too_narrow"), (side_h < t["side"], "bbox_too_short"),
        (fragments > t["fragments"], "foreground_fragmented"), (parts > t["parts"], "too_many_components"),
    )


def render_passes(fields: dict[str, Column]) -> Column:
    """Whether all seven fields of a render are as they must be; what is absent is not."""
    checks = [F.coalesce(fields[k] == v, F.lit(False)) for k, v in (RENDER_FLAGS | RENDER_WORDS).items()]
    return F.forall(F.array(*checks), lambda x: x)


def shell_reason(variation: Column, spread: Column, depth_variation: Column, depth_spread: Column, least: float = 0.01) -> Column:
    """Why a geometry is no scene: all at one radius, or one depth; ok otherwise. Depth may be unknown."""
    return first_of(((variation < least) | (spread < least), "constant_radius_shell"), ((depth_variation < least) | (depth_spread < least), "constant_depth"), otherwise="ok")


def contract_reason(schema_ok: Column, ready: Column, artificial_allowed: Column, surfaces: Column, selected: Column) -> Column:
    """The first reason against a scene's contract; ``surfaces`` is an array of structs (id, artificial)."""
    there = F.exists(surfaces, lambda s: s["id"] == selected)
    real = F.exists(surfaces, lambda s: (s["id"] == selected) & ~s["artificial"])
    return first_of((~schema_ok, "schema"), (~ready, "status"), (F.coalesce(artificial_allowed, F.lit(True)), "artificial_support_allowed"), (~there, "support_missing"), (~real, "support_artificial"), otherwise="ok")


def support_of(surfaces: Column, selected: Column) -> Column:
    """The selected surface of a contract, null if it is not there."""
    return F.try_element_at(F.filter(surfaces, lambda s: s["id"] == selected), F.lit(1))


def scene_reason(required: Column, path_exists: Column, units: Column, up: Column, artificial: Column, origin: Column) -> Column:
    """The first reason against rendering by a contract; none is needed where it is not required."""
    return first_of(
        (~required & ~path_exists, "not_required"), (~path_exists, "contract_missing"), (units != "meters", "units"), (up != "z", "up_axis"), (artificial, "artificial_support"),
        (origin != "reconstruction", "support_origin"), otherwise="ok",
    )


def output_issue(size: Column, least: int, textured: Column | None = None) -> Column:
    """What is wrong with an output: missing, too small, without a texture where one is needed."""
    bare = F.lit(False) if textured is None else ~F.coalesce(textured, F.lit(False))
    return first_of((size.isNull(), "missing"), (size < least, "too_small"), (bare, "no_texture"), otherwise="ok")


def prior_findings(present: dict[str, Column], sizes: dict[str, Column]) -> tuple[Column, Column]:
    """(errors, warnings): required keys that lack, lists that are empty."""
    return listed(*[(~v, f"missing:{k}") for k, v in present.items()]), listed(*[(F.coalesce(n, F.lit(0)) == 0, f"empty:{k}") for k, n in sizes.items()])


def blocks_loop(status: Column) -> Column:
    """Whether an asset of this status keeps its scene waiting."""
    return F.coalesce(status.isin(*BLOCKING), F.lit(False))


def page_video_issues(size: Column, url: Column) -> Column:
    """Issues of a video that is known by its size and address alone."""
    return listed((size < 4096, "output_too_small"), (~F.contains(url, F.lit("https")), "bad_extension"), (size % 2 == 0, "video_metadata_unavailable"))
