"""Cameras, boxes and ground contact as column arithmetic; sizes and positions are metres, z is up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, first_of, rounded

# fixed values: bounds of the ground-contact tolerance, and what camera distances follow from
CONTACT_LEAST, CONTACT_MOST, CONTACT_BASE_SHARE, CONTACT_HEIGHT_SHARE = 0.0005, 0.0025, 0.55, 0.0018
DIAGONAL, SPAN, NEAREST, FARTHEST, TARGET_HEIGHT = 2.2, 2.8, 2.0, 8.0, 0.45
FAR, FLAT_DEPTH = 1e9, 32768
# fixed values: how far a control value may be off before the reference material is forced
MATERIAL_DEVIATIONS = {"value_scale": (1.0, 0.12), "saturation_scale": (1.0, 0.12), "hue_offset": (0.0, 0.02), "roughness_add": (0.0, 0.08), "specular_add": (0.0, 0.08)}


def intrinsics(width: Column, height: Column, lens: Column, sensor_w: Column, sensor_h: Column, fit: Column, shift_x: Column, shift_y: Column, aspect: Column, perspective: Column) -> dict[str, Column]:
    """fx, fy, cx, cy of a pinhole camera; fx and fy are null for any other."""
    fit = F.when(fit == "AUTO", F.when(width >= height, "HORIZONTAL").otherwise("VERTICAL")).otherwise(fit)
    vertical = fit == "VERTICAL"
    su = F.when(vertical, width / sensor_w / aspect).otherwise(width / sensor_w)
    sv = F.when(vertical, height / sensor_h).otherwise(height * aspect / sensor_h)
    seen = lambda x: F.when(perspective, rounded(x, 6))
    return {
        "fx": seen(lens * su), "fy": seen(lens * sv),
        "cx": F.when(perspective, rounded(width / 2.0 - shift_x * width, 6)).otherwise(width / 2.0), "cy": F.when(perspective, rounded(height / 2.0 + shift_y * height, 6)).otherwise(height / 2.0),
    }


def box_corners(low: list[Column], high: list[Column]) -> Column:
    """The eight corners of a box, as an array of structs x, y, z."""
    pick = lambda axis, k: (high if k else low)[axis]
    return F.array(*[F.struct(pick(0, i).alias("x"), pick(1, j).alias("y"), pick(2, k).alias("z")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])


def box_on_image(corners: DataFrame, key: str, u: Column, v: Column, depth: Column, width: float, height: float) -> DataFrame:
    """(key, x0, y0, x1, y1): what the corners before the camera span, within the image; no row if none is.

    ``u`` and ``v`` are shares of the image from its lower left.
    """
    seen = corners.where(depth > 0).select(key, (u * width).alias("x"), ((1.0 - v) * height).alias("y"))
    return seen.groupBy(key).agg(
        rounded(F.greatest(F.lit(0.0), F.min("x")), 6).alias("x0"), rounded(F.greatest(F.lit(0.0), F.min("y")), 6).alias("y0"),
        rounded(F.least(F.lit(width), F.max("x")), 6).alias("x1"), rounded(F.least(F.lit(height), F.max("y")), 6).alias("y1"),
    )


def exact_bbox(points: DataFrame, key: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Least, greatest, centre and size on each axis."""
    box = points.groupBy(key).agg(*[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumns({f"{a}_center": (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in axes} | {f"{a}_size": F.col(f"{a}_max") - F.col(f"{a}_min") for a in axes})


def unit_box(points: DataFrame, key: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``points`` moved and scaled so that each key's box has its middle at 0 and a greatest extent of 2."""
    box = exact_bbox(points, key, axes)
    extent = F.greatest(*[F.col(f"{a}_size") for a in axes])
    box = box.select(key, *[f"{a}_center" for a in axes], F.when(extent > 1e-8, 2.0 / extent).otherwise(1.0).alias("_scale"))
    placed = {a: (F.col(a) - F.col(f"{a}_center")) * F.col("_scale") for a in axes}
    return points.join(box, key).withColumns(placed).select(points.columns)


def fit_factor(current: Column, low: float, high: float) -> Column:
    """1 within the range and for nothing at all, else what brings the height to its middle."""
    return F.when((current <= 1e-6) | current.between(low, high), 1.0).otherwise((low + high) / 2.0 / current)


def scene_factor(sizes: list[Column], current: Column, share: float = 0.1) -> Column:
    """What brings an object to a tenth of the scene's mean extent; null where there is none to speak of."""
    mean = sum(sizes[1:], sizes[0]) / float(len(sizes))
    return F.when((mean >= 1e-6) & (current >= 1e-6), mean * share / current)


def contact_tolerance(height: Column, base: float = 0.0014) -> Column:
    """The ground-contact tolerance of an object so high; of the base alone without a height."""
    tall = F.greatest(height, F.lit(1e-3)) * CONTACT_HEIGHT_SHARE
    return clamp(F.when(height.isNull(), F.lit(base)).otherwise(F.greatest(F.lit(base * CONTACT_BASE_SHARE), tall)), CONTACT_LEAST, CONTACT_MOST)


def contact_correction(min_z: Column, height: Column, support_z: Column, tolerance: Column) -> Column:
    """How far to lift or lower an object so that its foot lies in the range allowed above its support."""
    h = F.greatest(height, F.lit(1e-3))
    low = support_z - F.least(F.lit(0.0008), h * 0.0015)
    high = support_z + F.greatest(tolerance * 1.15, F.least(F.lit(0.0028), h * 0.0028))
    move = F.when(min_z < low, low - min_z).when(min_z > high, high - min_z).otherwise(0.0)
    return F.when(F.abs(move) > 1e-6, rounded(move, 6)).otherwise(0.0)


def camera_distance(size_x: Column, size_y: Column, size_z: Column, min_z: Column) -> tuple[Column, Column]:
    """(distance, height of the target) of a camera that looks at a box."""
    diagonal = F.greatest(F.sqrt(size_x * size_x + size_y * size_y + size_z * size_z), F.lit(1e-3))
    span = F.greatest(size_x, size_y, size_z, F.lit(1e-3))
    return F.least(F.greatest(diagonal * DIAGONAL, span * SPAN, F.lit(NEAREST)), F.lit(FARTHEST)), min_z + size_z * TARGET_HEIGHT


def ground_anchor(origin: list[Column], through: list[Column], ground_z: Column) -> list[Column]:
    """Where a ray from ``origin`` through a point meets the ground; null if it is level or points away."""
    d = [b - a for a, b in zip(origin, through, strict=True)]
    norm = F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))
    t = (ground_z - origin[2]) / (d[2] / norm)
    meets = (F.abs(d[2] / norm) >= 1e-6) & (t > 0)
    return [F.when(meets, o + x / norm * t) for o, x in zip(origin, d, strict=True)]


def depth_levels(pixels: DataFrame, key: str, depth: str) -> DataFrame:
    """``pixels`` with ``level``: near is 65535, far 0; no depth is 0, and one depth for all 32768."""
    seen = F.when(F.col(depth) < FAR, F.col(depth))
    span = pixels.groupBy(key).agg(F.min(seen).alias("_low"), F.max(seen).alias("_high"))
    share = 1.0 - (F.col(depth) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    level = F.when(F.col(depth).isNull() | (F.col(depth) >= FAR), 0).when(F.col("_high") > F.col("_low"), F.floor(share * 65535).cast("int")).otherwise(FLAT_DEPTH)
    return pixels.join(span, key, "left").withColumn("level", level).drop("_low", "_high")


def brightness_gain(target: Column, actual: Column, damping: float, least: float, most: float) -> Column:
    """The factor that brings a picture nearer to the brightness aimed at."""
    return clamp(1.0 + (target / F.greatest(actual, F.lit(1e-6)) - 1.0) * damping, least, most)


def force_reference(flag: Column, controls: dict[str, Column]) -> Column:
    """Why the reference material is to be forced: the flag, the first control that is too far off, or 'keep'."""
    off = [(F.abs(F.coalesce(controls[k], F.lit(at)) - at) > room, k) for k, (at, room) in MATERIAL_DEVIATIONS.items() if k in controls]
    return first_of((F.coalesce(flag, F.lit(False)), "explicit"), *off, otherwise="keep")


def rounded_vector(v: Column, places: int = 6) -> Column:
    return F.transform(v, lambda x: rounded(x, places))


def evenly_spaced(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key at even distances, the first and the last among them; all if there are fewer."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # row i is taken if one of the places floor(k (n - 1) / (m - 1)) falls on it
    place = F.ceil(F.col("_i") * F.lit(most - 1) / (F.col("_n") - 1))
    hit = (place <= most - 1) & (F.floor(place * (F.col("_n") - 1) / F.lit(most - 1)) == F.col("_i"))
    return numbered.where((F.col("_n") <= most) | hit).drop("_i", "_n")


def ray_height(hits: Column) -> Column:
    """Of the sorted heights that rays met, the one at three quarters."""
    return F.try_element_at(F.array_sort(hits), F.greatest(F.lit(1), F.ceil(F.size(hits) * 0.75).cast("int")))


def choose_support(planes: DataFrame, key: str, area: str = "area", z: str = "z") -> DataFrame:
    """The largest plane of each key, of equals the lowest."""
    return planes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(area), z))).where("_n = 1").drop("_n")


def ground_object(objects: DataFrame, key: str, hint: Column) -> DataFrame:
    """Each key's ground: an object of that name, else the lowest flat one, else the lowest (columns name, min_z, size_x, size_y, size_z)."""
    flat = F.col("size_z") <= 0.5 * F.greatest("size_x", "size_y")
    rank = F.when(F.contains(F.lower("name"), F.lower(hint)), 0).when(flat, 1).otherwise(2)
    return objects.withColumn("rank", rank).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("rank", "min_z", "name"))).where("_n = 1").drop("_n")


def floor_confidence(area: Column, footprint: Column, overhang: Column, inliers: Column, thickness: Column, least: dict[str, float]) -> Column:
    """How sure a part is a floor, by five shares that saturate; null where one is out of its range."""
    one = lambda x: F.least(x, F.lit(1.0))
    passes = (area >= least["area"]) & (footprint >= least["footprint"]) & (thickness <= least["thickness"]) & (overhang >= least["overhang"]) & (inliers >= least["inliers"])
    score = (
        0.30 * one(area / 0.40) + 0.20 * one(footprint / 0.90) + 0.15 * one((overhang - least["overhang"]) / 0.60)
        + 0.20 * one((inliers - least["inliers"]) / (1.0 - least["inliers"])) + 0.15 * one((least["thickness"] - thickness) / least["thickness"])
    )
    return F.when(passes, score)


def floor_signal(sweep: DataFrame, key: str, gap: Column, detached: Column) -> DataFrame:
    """Of a parameter sweep's rows (area, thickness, footprint, passes): the best by area, and how many signs tell of a floor."""
    best = sweep.groupBy(key).agg(F.max(F.struct("area", (-F.col("pos")).alias("at"), "thickness", "footprint")).alias("b"), F.min("thickness").alias("thinnest"), F.bool_or("passes").alias("any_passes"), F.max(gap).alias("gap"), F.bool_or(detached).alias("detached"))
    signs = [F.col("b.area") > 0.05, F.col("b.thickness") < 0.10, F.col("b.footprint") > 0.30, F.col("gap") > 0.05, F.col("detached")]
    return best.select(key, F.col("b.area").alias("max_area"), "thinnest", "any_passes", sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs[1:]), F.coalesce(signs[0], F.lit(False)).cast("int")).alias("signal"))


def swept(rows: DataFrame, grid: dict[str, tuple[float, ...]]) -> DataFrame:
    """``rows`` once for each combination of the parameters' values, which are few and given."""
    for name, values in grid.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def without_faces(faces: DataFrame, gone: DataFrame, key: str, face: str, z: str = "z", least: int = 200, loss: float = 0.08) -> DataFrame:
    """(key, kept, height_loss, done): whether floor faces may go; not if too few are left or too much height is lost."""
    both = faces.join(gone.select(key, face).distinct().withColumn("_gone", F.lit(True)), [key, face], "left").withColumn("_left", F.col("_gone").isNull())
    span = lambda c: F.max(F.when(c, F.col(z))) - F.min(F.when(c, F.col(z)))
    m = both.groupBy(key).agg(F.count_if("_left").alias("kept"), span(F.lit(True)).alias("whole"), span(F.col("_left")).alias("rest"))
    lost = F.when(F.col("whole") > 0, (F.col("whole") - F.coalesce("rest", F.lit(0.0))) / F.col("whole")).otherwise(0.0)
    return m.select(key, "kept", lost.alias("height_loss"), ((F.col("kept") >= least) & (lost <= loss)).alias("done"))
