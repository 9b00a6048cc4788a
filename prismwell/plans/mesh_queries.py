"""Queries of triangle meshes. Each supplier is a terrain of 20 by 20 cells; its lines tell which half cells are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..graph import dealt
from ..operators import contracts, topology
from ..session import kept, scratch
from ..sources import meshes
from .register import query, table

_SIDE = 20
#: A floor's thresholds, less strict than the library's own, so that the terrains hold some.
_FLOOR = topology.FLOOR | {"area": 0.01, "footprint": 0.01, "overhang": 0.01, "inliers": 0.5}

_HEIGHT = "CASE WHEN (v * 37 + mesh * 11) % 100 < 70 THEN 0.0::DOUBLE ELSE ((v * 37 + mesh * 11) % 100 - 70) / 4.0::DOUBLE END"
_TRI = f"""h AS (SELECT DISTINCT l_suppkey AS mesh, l_partkey % {_SIDE * _SIDE} AS cell, l_linenumber % 2 AS half FROM lineitem),
    c AS (SELECT mesh, cell * 2 + half AS face, (cell // {_SIDE}) * {_SIDE + 1} + cell % {_SIDE} AS v, half FROM h),
    k AS (SELECT mesh, face, unnest(CASE half WHEN 0 THEN [v, v + 1, v + {_SIDE + 1}] ELSE [v + 1, v + {_SIDE + 2}, v + {_SIDE + 1}] END) AS v, unnest([0, 1, 2]) AS i FROM c),
    p AS (SELECT mesh, face, i, v, CAST(v % {_SIDE + 1} AS DOUBLE) AS x, CAST(v // {_SIDE + 1} AS DOUBLE) AS y, {_HEIGHT} AS z FROM k),
    tri AS (SELECT mesh, face, {", ".join(f"max({n}) FILTER (i = {i}) AS {n}{i}" for i in range(3) for n in "vxyz")} FROM p GROUP BY mesh, face),
    m AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM tri),
    f AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area, abs(nz) / sqrt(nx * nx + ny * ny + nz * nz) AS up, (z0 + z1 + z2) / 3 AS z FROM m),
    s AS (SELECT mesh, face, unnest([{", ".join(f"struct_pack(a := least({p}, {q}), b := greatest({p}, {q}))" for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))}]) AS e FROM tri),
    e AS (SELECT mesh, e.a AS a, e.b AS b, count(*) AS n, min(face) AS low, max(face) AS high FROM s GROUP BY ALL),
    w AS (SELECT mesh, min(least(z0, z1, z2)) AS z_min, max(greatest(z0, z1, z2)) AS z_max, sum(area) AS total, count(*) AS n_faces FROM f GROUP BY 1)"""


def _components(nodes: str, edges: str) -> str:
    """A recursive query ``cc`` (graph, node, comp) over ``nodes`` (graph, node) and ``edges`` (graph, u, v)."""
    return f"""either AS (SELECT graph, u, v FROM {edges} UNION SELECT graph, v, u FROM {edges}),
        cc(graph, node, comp) USING KEY (graph, node) AS (SELECT graph, node, node FROM {nodes} UNION
           SELECT b.graph, b.u, min(c.comp) FROM cc c JOIN either b ON b.graph = c.graph AND b.v = c.node JOIN recurring.cc p ON p.graph = b.graph AND p.node = b.u WHERE c.comp < p.comp GROUP BY b.graph, b.u)"""


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' triangles."""
    line = table(spark, sf_dir, "lineitem")
    half = line.select(F.col("l_suppkey").alias("mesh"), (F.col("l_partkey") % (_SIDE * _SIDE)).alias("cell"), (F.col("l_linenumber") % 2).alias("half"))
    half = dealt(half, line.count(), "mesh", "cell", "half").distinct()
    v = (F.floor(F.col("cell") / _SIDE) * (_SIDE + 1) + F.col("cell") % _SIDE).cast("long")
    t = half.select("mesh", (F.col("cell") * 2 + F.col("half")).cast("long").alias("face"), v.alias("_v"), (F.col("half") == 0).alias("_first"))
    steps = ((0, 1), (1, _SIDE + 2), (_SIDE + 1, _SIDE + 1))
    each = {}
    for i in range(3):
        n = F.col("_v") + F.when(F.col("_first"), steps[i][0]).otherwise(steps[i][1])
        h = (n * 37 + F.col("mesh") * 11) % 100
        each |= {f"v{i}": n, f"x{i}": (n % (_SIDE + 1)).cast("double"), f"y{i}": F.floor(n / (_SIDE + 1)).cast("double"), f"z{i}": F.when(h < 70, 0.0).otherwise((h - 70) / 4.0)}
    return t.select("mesh", "face", *[c.alias(n) for n, c in each.items()])


@query(f"""WITH {_TRI}, faces AS (SELECT mesh, count(*) AS n_faces FROM tri GROUP BY 1), corners AS (SELECT mesh, count(DISTINCT v) AS n_vertices FROM p GROUP BY 1),
           k2 AS (SELECT mesh, count(*) AS n_edges, count(*) FILTER (n = 1) AS boundary_edges, count(*) FILTER (n = 2) AS manifold_edges, count(*) FILTER (n > 2) AS other_edges FROM e GROUP BY 1)
           SELECT *, n_vertices - n_edges + n_faces AS euler, boundary_edges = 0 AND other_edges = 0 AS closed FROM faces JOIN corners USING (mesh) JOIN k2 USING (mesh)""")
def mesh_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.incidence(terrain(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


_PART = f"""WITH RECURSIVE {_TRI}, nodes AS (SELECT mesh AS graph, face AS node FROM tri), pairs AS (SELECT mesh AS graph, low AS u, high AS v FROM e WHERE n = 2), {_components("nodes", "pairs")},
    parts AS (SELECT f.mesh, cc.comp AS part, count(*) AS n_faces, sum(area) AS area, min(least(z0, z1, z2)) AS low, max(greatest(z0, z1, z2)) AS high FROM f JOIN cc ON cc.graph = f.mesh AND cc.node = f.face GROUP BY ALL),
    split AS (SELECT parts.mesh, part, parts.n_faces, area / (total + 1e-8) AS area_frac, (low - z_min) / (z_max - z_min + 1e-8) AS z_bottom, (high - z_min) / (z_max - z_min + 1e-8) AS z_top, high - low AS z_height,
              (high - z_min) / (z_max - z_min + 1e-8) < 0.15 AS is_bottom_only, (high - low) / (z_max - z_min + 1e-8) < 0.05 AS is_thin FROM parts JOIN w USING (mesh))"""
_R = lambda x: f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"
_R6 = lambda c: f"{_R(c)} AS {c}"


@query(f"{_PART} SELECT mesh, part, n_faces, {_R6('area_frac')}, {_R6('z_bottom')}, {_R6('z_top')}, {_R6('z_height')}, is_bottom_only, is_thin, row_number() OVER (PARTITION BY mesh ORDER BY floor(split.area_frac * 1000000000.0 + 0.5) DESC, part) AS place FROM split")
def mesh_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topology.topology(terrain(spark, sf_dir))
    return t.withColumns({c: rounded(F.col(c), 6) for c in ("area_frac", "z_bottom", "z_top", "z_height")})


@query(f"{_PART} SELECT mesh, count(*) AS n_components, bool_or(is_bottom_only AND is_thin AND area_frac > 0.02) AS has_detached_bottom FROM split GROUP BY 1")
def mesh_detached_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.detached_bottom(topology.topology(terrain(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_TRI}, grid AS (SELECT band, dot FROM (VALUES (0.05::DOUBLE), (0.10), (0.15), (0.20)) b(band), (VALUES (0.90::DOUBLE), (0.95), (0.97)) d(dot)),
           seed AS (SELECT f.mesh, band, dot, face, concat_ws('|', f.mesh, band, dot) AS graph, area, least(z0, z1, z2) AS zl, greatest(z0, z1, z2) AS zh FROM f JOIN w USING (mesh), grid WHERE z_max - z_min >= 1e-6 AND z <= z_min + (z_max - z_min) * band AND up >= dot),
           nodes AS (SELECT graph, face AS node FROM seed), pairs AS (SELECT s.graph, e.low AS u, e.high AS v FROM e JOIN seed s ON s.mesh = e.mesh AND s.face = e.low JOIN seed t ON t.graph = s.graph AND t.face = e.high WHERE e.n = 2), {_components("nodes", "pairs")}
           SELECT s.mesh, band, dot, comp AS component, count(*) AS n_faces, {_R('sum(area) / (any_value(total) + 1e-8)')} AS area_frac, {_R('(max(zh) - min(zl)) / (any_value(z_max - z_min) + 1e-8)')} AS thickness, min(zl) AS z_min, max(zh) AS z_max
           FROM seed s JOIN cc ON cc.graph = s.graph AND cc.node = s.face JOIN w ON w.mesh = s.mesh GROUP BY 1, 2, 3, 4""")
def mesh_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = topology.sweep_metrics(terrain(spark, sf_dir)).drop("area")
    return m.withColumns({c: rounded(F.col(c), 6) for c in ("area_frac", "thickness")})


def _floors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = kept(terrain(spark, sf_dir))
    label = topology.bottom_components(t)
    return t, label, topology.floor_candidates(t, label, _FLOOR)


@query()
def mesh_floor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls and planes are beyond SQL; the tests compare with a mesh at a time in NumPy."""
    return _floors(spark, sf_dir)[2].withColumns({c: rounded(F.col(c), 6) for c in ("area_frac", "fp_ratio", "thickness", "confidence")})


@query()
def mesh_floor_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, label, found = _floors(spark, sf_dir)
    return topology.floor_decisions(t, kept(found), label, auto=0.4, review=0.3).withColumns({c: rounded(F.col(c), 6) for c in ("z_extent_frac", "floor_confidence")})


@query(f"WITH {_TRI} SELECT CAST(mesh AS VARCHAR) AS part, count(*) AS n_faces, {_R('sum(area)')} AS area, min(least(z0, z1, z2)) AS z_min, max(greatest(z0, z1, z2)) AS z_max FROM f GROUP BY 1")
def mesh_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the terrains as files and reads their triangles back."""
    path = scratch(spark, "meshes")
    meshes.write_meshes(terrain(spark, sf_dir), path, faces_per_file=200)
    t = topology.measured(meshes.triangles(spark, path))
    return t.groupBy("part").agg(F.count("*").alias("n_faces"), rounded(F.sum("area"), 6).alias("area"), F.min(F.least("z0", "z1", "z2")).alias("z_min"), F.max(F.greatest("z0", "z1", "z2")).alias("z_max"))


_BOUNDS = f"""{_TRI}, vs AS (SELECT DISTINCT mesh, v, x, y, z FROM p), bx AS (SELECT mesh, {", ".join(f"min(least({a}0, {a}1, {a}2)) AS {a}_min, max(greatest({a}0, {a}1, {a}2)) AS {a}_max" for a in "xyz")}, count(*) AS face_count FROM tri GROUP BY 1),
    bv AS (SELECT mesh, count(*) AS vertex_count FROM vs GROUP BY 1), b AS (SELECT * FROM bx JOIN bv USING (mesh))"""
_SUPPORT = ("height", "area", "face_count", "anchor_x", "anchor_y", "x_min", "x_max", "y_min", "y_max")


@query(f"""WITH {_BOUNDS}, rad AS (SELECT mesh, stddev_pop(sqrt(x * x + y * y + z * z)) / avg(sqrt(x * x + y * y + z * z)) AS cv FROM vs GROUP BY 1),
           ex AS (SELECT mesh, z_min AS low, z_max AS high, greatest(0.02::DOUBLE, (z_max - z_min) * 0.005::DOUBLE) AS tol FROM b),
           n AS (SELECT f.*, low, high, tol, CAST(round_even(z / tol, 0) AS BIGINT) AS bin FROM f JOIN ex USING (mesh) WHERE up >= cos(radians(20.0)) AND area > 0),
           g AS (SELECT mesh, bin, any_value(low) AS low, any_value(high) AS high, any_value(tol) AS tol, sum(area) AS area, count(*) AS face_count, sum(area * z) / sum(area) AS height, sum(area * (x0 + x1 + x2)) / (3 * sum(area)) AS anchor_x, sum(area * (y0 + y1 + y2)) / (3 * sum(area)) AS anchor_y,
                 min(least(x0, x1, x2)) AS x_min, max(greatest(x0, x1, x2)) AS x_max, min(least(y0, y1, y2)) AS y_min, max(greatest(y0, y1, y2)) AS y_max FROM n GROUP BY 1, 2),
           sup AS (SELECT * FROM g WHERE bin * tol <= low + 0.45 * greatest(high - low, tol) AND area >= 0.5 AND least(x_max - x_min, y_max - y_min) >= 0.5 QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY round(area, 9) DESC, bin DESC) = 1),
           o AS (SELECT b.mesh, vertex_count, b.face_count AS n_faces, {_R("cv")} AS variation, CASE WHEN b.mesh % 10 = 3 THEN 'generic_support_name' WHEN cv < 0.01 THEN 'constant_radius_shell' WHEN sup.mesh IS NULL THEN 'no_support_surface' END AS reason,
                 {", ".join(f"sup.{c} AS {c}" if c == "face_count" else f"{_R('sup.' + c)} AS {c}" for c in _SUPPORT)} FROM b JOIN rad USING (mesh) LEFT JOIN sup USING (mesh))
           SELECT mesh, vertex_count, n_faces, variation, CASE WHEN reason IS NULL THEN 'ready' ELSE 'rejected' END AS status, reason, {", ".join(f"CASE WHEN reason IS NULL THEN {c} END AS {c}" for c in _SUPPORT)} FROM o""")
def scene_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("mesh") % 10 == 3, " Ground").otherwise("terrace")
    t = contracts.scene_contracts(kept(terrain(spark, sf_dir)), name)
    a = F.col("scene_asset")
    return t.select("mesh", a["vertex_count"].alias("vertex_count"), a["face_count"].alias("n_faces"), rounded(a["radial_statistics"]["coefficient_of_variation"], 6).alias("variation"), "status", "reason", *[F.col(f"support_surface.{c}") for c in _SUPPORT])


@query(f"""WITH {_BOUNDS} SELECT mesh, vertex_count, face_count, {_R("z_min")} AS contact_height, [{", ".join(_R(f"{a}_max - {a}_min") for a in "xyz")}] AS dimensions_m, [{", ".join(_R(c) for c in ("x_min", "x_max", "y_min", "y_max"))}] AS footprint FROM b""")
def object_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = contracts.object_contracts(kept(terrain(spark, sf_dir)))
    return t.select("mesh", "vertex_count", "face_count", F.col("contact_plane.height").alias("contact_height"), "dimensions_m", F.col("contact_plane.footprint").alias("footprint"))
