"""Scene and object contracts of small meshes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from prismwell.operators import contracts, stats
from prismwell.sources import meshes

SCHEMA = "mesh string, " + meshes.TRIANGLES.split("string, ")[2]


def soup(spark, plans: dict[str, tuple[list, list]]):
    rows = [(m, f, *v, *(float(x) for i in v for x in points[i])) for m, (points, faces) in plans.items() for f, v in enumerate(faces)]
    return spark.createDataFrame(rows, SCHEMA)


GROUND = ([(-2, -2, 0), (2, -2, 0), (2, 2, 0), (-2, 2, 0), (0, 0, 3), (1, 0, 3), (0, 1, 4)], [(0, 1, 2), (0, 2, 3), (4, 5, 6)])


def sphere() -> tuple[list, list]:
    rng = random.Random(1)
    points = []
    for _ in range(60):
        x, y, z = (rng.gauss(0, 1) for _ in range(3))
        r = math.sqrt(x * x + y * y + z * z)
        points.append((8 * x / r, 8 * y / r, 8 * z / r))
    return points, [(i, (i + 1) % 60, (i + 2) % 60) for i in range(60)]


def test_the_ground_supports_and_what_does_not_is_told(spark):
    wall = ([(0, 0, 0), (0, 4, 0), (0, 4, 4), (0, 0, 4)], [(0, 1, 2), (0, 2, 3)])
    tiny = ([(1, 1, 0), (1.2, 1, 0), (1, 1.2, 0), (5, 5, 9)], [(0, 1, 2), (0, 1, 3)])
    t = soup(spark, {"ground": GROUND, "shell": sphere(), "wall": wall, "tiny": tiny, "named": GROUND})
    rows = {r["mesh"]: r for r in contracts.scene_contracts(t, F.when(F.col("mesh") == "named", " Plane ").otherwise("floor_3")).collect()}
    assert {m: (r["status"], r["reason"]) for m, r in rows.items()} == {"ground": ("ready", None), "shell": ("rejected", "constant_radius_shell"), "wall": ("rejected", "no_support_surface"), "tiny": ("rejected", "no_support_surface"), "named": ("rejected", "generic_support_name")}
    s = rows["ground"]["support_surface"]
    assert (s["height"], s["area"], s["face_count"], s["x_min"], s["x_max"]) == (0.0, 16.0, 2, -2.0, 2.0)
    asset = rows["ground"]["scene_asset"]
    assert (asset["vertex_count"], asset["face_count"], asset["bounds"]["z_max"], asset["depth_statistics"]) == (7, 3, 4.0, None)


def test_constant_depths_reject(spark):
    t = soup(spark, {"a": GROUND, "b": GROUND})
    depths = spark.createDataFrame([("a", 8.0), ("a", 8.0), ("b", 1.0), ("b", 4.0), ("b", -1.0)], "mesh string, depth double")
    got = {r["mesh"]: r["reason"] for r in contracts.scene_contracts(t, F.lit("floor"), depths).collect()}
    assert got == {"a": "constant_depth", "b": None}


def test_the_largest_surface_or_the_nearest_to_a_hint(spark):
    """Two terraces in the lower part; the ceiling keeps a third and larger one out."""
    square = lambda z, n, at: [(at, 0, z), (at + n, 0, z), (at + n, n, z), (at, n, z)]
    points = square(0, 2, 0) + square(3, 3, 10) + square(10, 6, 20)
    t = soup(spark, {"m": (points, [f for k in (0, 4, 8) for f in ((k, k + 1, k + 2), (k, k + 2, k + 3))])})
    assert [(r["height"], r["area"]) for r in contracts.support_surfaces(t).collect()] == [(3.0, 9.0)]
    assert [(r["height"], r["area"]) for r in contracts.support_surfaces(t, F.lit(0.4)).collect()] == [(0.0, 4.0)]
    assert contracts.support_surfaces(t.limit(0)).count() == 0


def test_an_object_stands_on_its_lowest_point(spark):
    r = contracts.object_contracts(soup(spark, {"m": GROUND})).first()
    assert (r["dimensions_m"], r["contact_plane"]["height"], r["contact_plane"]["footprint"]) == ([4.0, 4.0, 4.0], 0.0, [-2.0, 2.0, -2.0, 2.0])


@pytest.mark.parametrize(("value", "lo", "hi", "want"), [(40.0, 40.0, 180.0, 0.0), (180.0, 40.0, 180.0, 1.0), (5000.0, 40.0, 180.0, 1.0), (None, 40.0, 180.0, 0.5), (90.0, 40.0, 180.0, (math.log1p(90) - math.log1p(40)) / (math.log1p(180) - math.log1p(40) + 1e-6))])
def test_sharpness(spark, value, lo, hi, want):
    row = spark.createDataFrame([(value, lo, hi)], "v double, lo double, hi double")
    assert row.select(stats.sharpness(F.col("v"), F.col("lo"), F.col("hi")).alias("s")).first()["s"] == pytest.approx(want, abs=1e-5)
