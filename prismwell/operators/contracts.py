"""Scene and object contracts of triangle meshes: statistics, gates, supporting surface, bounds, as nested rows.

``triangles`` are those of the mesh reader, with a column ``mesh``. Everything is an aggregate by mesh or
by (mesh, height bin). Where something is not as it must be, the contract is rejected and says why.

Edge cases: a mesh without horizontal faces, or with none large enough, has no support; equal bins are
taken from the higher one down; faces without area count as faces only; a null hint is none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..graph import spread_join
from . import stats
from .topology import measured

# fixed values: what a support may be, the least spread of a scene, names that stand for no reconstructed surface
SLOPE_DEGREES, CEILING, LEAST_AREA, LEAST_SPAN = 20.0, 0.45, 0.5, 0.5
LEAST_VARIATION = 0.01
GENERIC_NAMES = ("plane", "ground", "supportplane")


def vertices(triangles: DataFrame) -> DataFrame:
    """(mesh, v, x, y, z): each vertex once."""
    corner = F.inline(F.array(*[F.struct(F.col(f"v{i}").alias("v"), *[F.col(f"{a}{i}").alias(a) for a in "xyz"]) for i in range(3)]))
    return triangles.select("mesh", corner).distinct()


def bounds(triangles: DataFrame) -> DataFrame:
    """Per mesh: the least and greatest coordinates, vertex_count and face_count."""
    low = lambda a: F.min(F.least(*[f"{a}{i}" for i in range(3)])).alias(f"{a}_min")
    high = lambda a: F.max(F.greatest(*[f"{a}{i}" for i in range(3)])).alias(f"{a}_max")
    ends = triangles.groupBy("mesh").agg(*[f(a) for a in "xyz" for f in (low, high)], F.count("*").alias("face_count"))
    return ends.join(vertices(triangles).groupBy("mesh").agg(F.count("*").alias("vertex_count")), "mesh")


def support_surfaces(triangles: DataFrame, hint: Column | None = None) -> DataFrame:
    """Per mesh with one: the surface that objects may stand on (height, area, face_count, anchor_x, anchor_y, x_min, x_max, y_min, y_max).

    Nearly horizontal faces are binned by the height of their centres; of the bins in the lower part that
    are large and wide enough, the one with most area is taken, or the nearest to ``hint``.
    """
    flat = measured(triangles).where((F.col("up") >= math.cos(math.radians(SLOPE_DEGREES))) & (F.col("area") > 0))
    ends = triangles.groupBy("mesh").agg(F.min(F.least("z0", "z1", "z2")).alias("_low"), F.max(F.greatest("z0", "z1", "z2")).alias("_high"))
    ends = ends.withColumn("_tol", F.greatest(F.lit(0.02), (F.col("_high") - F.col("_low")) * 0.005))
    binned = spread_join(flat, ends, ["mesh"], ["face"]).withColumn("bin", F.bround(F.col("z") / F.col("_tol"), 0).cast("long"))
    weighted = lambda a: F.sum(F.col("area") * (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2"))) / (3 * F.sum("area"))
    low = lambda a: F.min(F.least(*[f"{a}{i}" for i in range(3)]))
    high = lambda a: F.max(F.greatest(*[f"{a}{i}" for i in range(3)]))
    bins = binned.groupBy("mesh", "bin", "_low", "_high", "_tol").agg(
        F.sum("area").alias("area"), F.count("*").alias("face_count"), (F.sum(F.col("area") * F.col("z")) / F.sum("area")).alias("height"),
        weighted("x").alias("anchor_x"), weighted("y").alias("anchor_y"), *[f(a).alias(f"{a}_{n}") for a in "xy" for f, n in ((low, "min"), (high, "max"))],
    )
    at = F.col("bin") * F.col("_tol")
    fit = bins.where(at <= F.col("_low") + CEILING * F.greatest(F.col("_high") - F.col("_low"), F.col("_tol")))
    fit = fit.where((F.col("area") >= LEAST_AREA) & (F.least(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) >= LEAST_SPAN))
    nearest = F.lit(0.0) if hint is None else F.coalesce(-F.abs(at - hint), F.lit(0.0))
    told = ["height", "area", "face_count", "anchor_x", "anchor_y", "x_min", "x_max", "y_min", "y_max"]
    best = fit.groupBy("mesh").agg(F.max_by(F.struct(*told), F.struct(nearest, F.round("area", 9), "bin")).alias("s"))
    return best.select("mesh", *[F.col(f"s.{c}") if c == "face_count" else rounded(F.col(f"s.{c}"), 6).alias(c) for c in told])


def shell_problem(statistics: Column) -> Column:
    """Whether the distances of a struct of statistics are all but the same."""
    return (statistics["coefficient_of_variation"] < LEAST_VARIATION) | (statistics["relative_range"] < LEAST_VARIATION)


def scene_contracts(triangles: DataFrame, support_name: Column, depths: DataFrame | None = None) -> DataFrame:
    """Per mesh: status, reason, scene_asset (counts, bounds, statistics), support_surface.

    ``support_name`` is of columns of ``mesh`` alone; ``depths`` (mesh, depth) may give a scene's depths.
    """
    radial = stats.radial_statistics(vertices(triangles), "mesh", ["x", "y", "z"])
    radial = radial.select("mesh", F.struct(*[c for c in radial.columns if c != "mesh"]).alias("radial_statistics"))
    t = bounds(triangles).join(radial, "mesh", "left")
    if depths is not None:
        depth = stats.depth_statistics(depths, "mesh", "depth")
        t = t.join(depth.select("mesh", F.struct(*[c for c in depth.columns if c != "mesh"]).alias("depth_statistics")), "mesh", "left")
    else:
        t = t.withColumn("depth_statistics", F.lit(None).cast(t.schema["radial_statistics"].dataType))
    found = support_surfaces(triangles)
    t = t.join(found.select("mesh", F.struct(*[c for c in found.columns if c != "mesh"]).alias("support_surface")), "mesh", "left")
    name = F.lower(F.trim(F.coalesce(support_name, F.lit(""))))
    reason = (
        F.when((name == "") | name.isin(*GENERIC_NAMES), "generic_support_name")
        .when(shell_problem(F.col("radial_statistics")), "constant_radius_shell")
        .when(F.coalesce(shell_problem(F.col("depth_statistics")), F.lit(False)), "constant_depth")
        .when(F.col("support_surface").isNull(), "no_support_surface")
    )
    box = F.struct(*[rounded(F.col(f"{a}_{n}"), 6).alias(f"{a}_{n}") for a in "xyz" for n in ("min", "max")]).alias("bounds")
    asset = F.struct("vertex_count", "face_count", box, "radial_statistics", "depth_statistics").alias("scene_asset")
    return t.select("mesh", F.when(reason.isNull(), "ready").otherwise("rejected").alias("status"), reason.alias("reason"), asset, F.when(reason.isNull(), F.col("support_surface")).alias("support_surface"))


def object_contracts(triangles: DataFrame) -> DataFrame:
    """Per mesh: bounds, dimensions_m, and contact_plane (height, footprint)."""
    t = bounds(triangles)
    r = {c: rounded(F.col(c), 6) for c in (f"{a}_{n}" for a in "xyz" for n in ("min", "max"))}
    box = F.struct(*[c.alias(n) for n, c in r.items()]).alias("bounds")
    size = F.array(*[rounded(F.col(f"{a}_max") - F.col(f"{a}_min"), 6) for a in "xyz"]).alias("dimensions_m")
    plane = F.struct(r["z_min"].alias("height"), F.array(r["x_min"], r["x_max"], r["y_min"], r["y_max"]).alias("footprint")).alias("contact_plane")
    return t.select("mesh", "vertex_count", "face_count", box, size, plane)
