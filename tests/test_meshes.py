"""Mesh files, published files and mesh topology against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import json
import random
import struct
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prismwell import graph
from prismwell.operators import geometry, topology
from prismwell.plans import mesh_queries
from prismwell.plans.register import QUERIES
from prismwell.sources import meshes, publish

SF = "/root/testdata/sf0.001"
SQUARE = np.array([[0, 0, 0], [4, 0, 0], [4, 4, 0], [0, 4, 0]], float)
TWO = np.array([[0, 1, 2], [0, 2, 3]])


def glb(doc: dict, body: bytes) -> bytes:
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body
    return struct.pack("<III", 0x46546C67, 2, 12 + len(chunks)) + chunks


def scene() -> bytes:
    """Two parts below a turned and moved node: one of interleaved vertices and 16-bit indices, one without indices; and a part of lines."""
    wide = np.zeros((4, 6), "<f4")
    wide[:, :3] = SQUARE
    index, soup = TWO.astype("<u2"), np.array([[0, 0, 1], [1, 0, 1], [0, 1, 1]], "<f4")
    body = wide.tobytes() + index.tobytes() + soup.tobytes()
    half = 2**-0.5
    return glb({
        "asset": {"version": "2.0"}, "scenes": [{"nodes": [0]}], "scene": 0,
        "nodes": [{"children": [1, 2], "translation": [10, 0, 0], "rotation": [0, 0, half, half]}, {"mesh": 0, "name": "ground", "scale": [2, 2, 1]},
                  {"mesh": 1, "matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 5, 1]}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 1}]}, {"primitives": [{"attributes": {"POSITION": 2}}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 4}, {"bufferView": 1, "componentType": 5123, "count": 6}, {"bufferView": 2, "componentType": 5126, "count": 3}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 96, "byteStride": 24}, {"buffer": 0, "byteOffset": 96, "byteLength": 12}, {"buffer": 0, "byteOffset": 108, "byteLength": 36}],
        "buffers": [{"byteLength": len(body)}],
    }, body)


def ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffB", *v, 7) for v in vertices) + b"".join(struct.pack("<Biii", 3, *f) for f in faces)
    return head.encode() + body


def corners(row) -> list[tuple]:
    return [tuple(round(row[f"{a}{i}"], 5) for a in "xyz") for i in range(3)]


def test_a_scene_is_read_with_its_transforms(spark, tmp_path):
    (tmp_path / "a.glb").write_bytes(scene())
    rows = sorted(meshes.triangles(spark, str(tmp_path)).collect(), key=lambda r: r["face"])
    assert [(r["part"], r["face"], r["v0"], r["v1"], r["v2"]) for r in rows] == [("ground", 0, 0, 1, 2), ("ground", 1, 0, 2, 3), ("1", 2, 4, 5, 6)]
    turned = lambda x, y, z: (round(10 - y, 5), round(float(x), 5), round(float(z), 5))
    assert corners(rows[0]) == [turned(0, 0, 0), turned(8, 0, 0), turned(8, 8, 0)]
    assert corners(rows[2]) == [turned(0, 0, 6), turned(1, 0, 6), turned(0, 1, 6)]


@pytest.mark.parametrize("kind", ["glb", "ply"])
def test_slices_of_a_file_give_every_face_once(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    xyz, index = rng.integers(-50, 50, (300, 3)).astype(float), rng.integers(0, 300, (1000, 3))
    (tmp_path / f"m.{kind}").write_bytes(meshes.glb_bytes(xyz, index) if kind == "glb" else ply(xyz, index))
    df = meshes.triangles(spark, str(tmp_path / f"m.{kind}"), slice_bytes=1500)
    assert df.rdd.getNumPartitions() > 5
    rows = sorted(df.collect(), key=lambda r: r["face"])
    assert [(r["v0"], r["v1"], r["v2"]) for r in rows] == [tuple(f) for f in index.tolist()]
    assert all(corners(r) == [tuple(xyz[v].tolist()) for v in f] for r, f in zip(rows, index, strict=True))


BAD = {
    "no faces.glb": meshes.glb_bytes(SQUARE, np.zeros((0, 3))), "no mesh.glb": b"no mesh", "cut short.glb": meshes.glb_bytes(SQUARE, TWO)[:-8], "far.glb": meshes.glb_bytes(SQUARE, np.array([[0, 1, 9]])),
    "quads.ply": ply(SQUARE, TWO).replace(struct.pack("<Biii", 3, 0, 1, 2), struct.pack("<Biiii", 4, 0, 1, 2, 3)), "text.ply": b"ply\nformat ascii 1.0\nend_header\n",
}


@pytest.mark.parametrize("name", BAD)
def test_files_without_a_readable_mesh_fail(spark, tmp_path, name):
    (tmp_path / name).write_bytes(BAD[name])
    with pytest.raises(PySparkException, match="MeshError"):
        meshes.triangles(spark, str(tmp_path)).count()


def test_a_folder_without_meshes_fails(spark, tmp_path):
    with pytest.raises(PySparkException, match="no mesh file"):
        meshes.triangles(spark, str(tmp_path)).count()


def test_written_meshes_come_back(spark, tmp_path):
    t = mesh_queries.terrain(spark, SF)
    meshes.write_meshes(t, str(tmp_path / "out"), faces_per_file=50)
    back = meshes.triangles(spark, str(tmp_path / "out"))
    flat = lambda df, part: sorted((str(r[part]), *corners(r)) for r in df.collect())
    assert flat(back, "part") == flat(t, "mesh")


# --- publishing ---


def test_copies_have_the_digests_of_their_sources(spark, tmp_path):
    rows, want = [], {}
    for i, size in enumerate([0, 1, 1000, (8 << 20) + 5, 3 << 20]):
        data = random.Random(i).randbytes(size)
        (tmp_path / f"s{i}").write_bytes(data)
        rows.append((f"deep/{i}.bin", str(tmp_path / f"s{i}"), None))
        want[f"deep/{i}.bin"] = data
    rows.append(("given", None, bytearray(b"content")))
    want["given"] = b"content"
    found = publish.publish(spark.createDataFrame(rows, "name string, source string, content binary").repartition(3), str(tmp_path / "out")).collect()
    assert {r["name"]: (r["length"], r["sha256"]) for r in found} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in want.items()}
    assert all((tmp_path / "out" / r["part"] / r["name"]).read_bytes() == want[r["name"]] for r in found)
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


BROKEN = {"a missing source": ("x", "/none/there", None), "no content": ("x", None, None), "a way out": ("../x", None, bytearray(b"x")), "no name": (None, None, bytearray(b"x")), "a name told twice": ("ok0", None, bytearray(b"x"))}


@pytest.mark.parametrize("row", BROKEN.values(), ids=BROKEN)
def test_a_failed_task_leaves_nothing(spark, tmp_path, row):
    good = [(f"ok{i}", None, bytearray(b"y" * 100)) for i in range(20)]
    rows = spark.createDataFrame([*good, row], "name string, source string, content binary").coalesce(1 if row[0] == "ok0" else 4)
    with pytest.raises(PySparkException):
        publish.publish(rows, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_what_is_published_is_not_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"1"))], "name string, content binary")
    publish.publish(rows, str(tmp_path / "out"))
    with pytest.raises(PySparkException, match="stays as it is"):
        publish.publish(rows, str(tmp_path / "out"))
    assert [r["length"] for r in publish.manifest(spark, str(tmp_path / "out")).collect()] == [1]


def test_attempts_that_failed_are_dropped_at_the_commit(tmp_path):
    writer = publish._Writer(str(tmp_path / "out"))
    for folder in ("part-00000-1", "part-00000-2"):
        for path in (Path(writer.staging) / folder, Path(writer.staging) / "_manifest"):
            path.mkdir(parents=True, exist_ok=True)
        (Path(writer.staging) / folder / "a").write_bytes(b"x")
        (Path(writer.staging) / "_manifest" / f"{folder}.jsonl").write_text("{}")
    writer.commit([publish.Written("part-00000-2"), publish.Written(None)])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/_manifest/part-00000-2.jsonl", "out/part-00000-2/a"]


def test_an_empty_table_publishes_an_empty_folder(spark, tmp_path):
    assert publish.publish(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "out")).count() == 0


# --- topology ---


def random_mesh(seed: int, n_vertices: int, n_faces: int) -> tuple[np.ndarray, np.ndarray]:
    """Few vertices, so that edges of one, two and more faces occur; some faces name a vertex twice."""
    rng = np.random.default_rng(seed)
    xyz = np.stack([rng.integers(0, 10, n_vertices), rng.integers(0, 10, n_vertices), rng.choice([0, 0, 0, 0.25, 1, 5], n_vertices)], 1).astype(float)
    return xyz, rng.integers(0, n_vertices, (n_faces, 3))


MESHES = {1: random_mesh(1, 60, 90), 2: random_mesh(2, 25, 60), 3: (SQUARE, TWO), 4: (SQUARE + [[0, 0, 0], [0, 0, 0], [0, 0, 3], [0, 0, 3]], TWO)}


@pytest.fixture(scope="module")
def soup(spark):
    rows = [(m, f, *map(int, v), *map(float, xyz[v].ravel())) for m, (xyz, index) in MESHES.items() for f, v in enumerate(index)]
    return spark.createDataFrame(rows, "mesh int, " + meshes.TRIANGLES.split("string, ")[2]).repartition(3).cache()


def shared(index: np.ndarray) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for f, v in enumerate(index.tolist()):
        if len(set(v)) == 3:
            for e in combinations(sorted(v), 2):
                out.setdefault(e, []).append(f)
    return out


def grouped(faces: set[int], index: np.ndarray) -> dict[int, set[int]]:
    """Components of the faces, by their least."""
    near: dict[int, set[int]] = {f: set() for f in faces}
    for fs in shared(index).values():
        if len(fs) == 2 and set(fs) <= faces:
            near[fs[0]].add(fs[1])
            near[fs[1]].add(fs[0])
    out, seen = {}, set()
    for start in sorted(faces):
        if start not in seen:
            todo, found = [start], set()
            while todo:
                if (x := todo.pop()) not in found:
                    found.add(x)
                    todo += near[x]
            out[start] = found
            seen |= found
    return out


def measures(xyz: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = xyz[index]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1)
    return size / 2, np.divide(np.abs(n[:, 2]), size, out=np.zeros(len(size)), where=size > 0), p[:, :, 2].mean(axis=1)


def test_incidence(soup):
    got = {r["mesh"]: r.asDict() for r in topology.incidence(soup).collect()}
    for m, (_, index) in MESHES.items():
        counts = [len(f) for f in shared(index).values()]
        n_vertices = len(set(index.ravel().tolist()))
        assert (got[m]["n_vertices"], got[m]["n_edges"], got[m]["n_faces"]) == (n_vertices, len(counts), len(index))
        assert (got[m]["boundary_edges"], got[m]["manifold_edges"], got[m]["other_edges"]) == (counts.count(1), counts.count(2), sum(c > 2 for c in counts))
        assert got[m]["euler"] == n_vertices - len(counts) + len(index)
    tetra = [(9, f, *v, *([0.0] * 9)) for f, v in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)])]
    closed = topology.incidence(soup.sparkSession.createDataFrame(tetra, soup.schema)).first()
    assert (closed["euler"], closed["closed"]) == (2, True)


def test_incidence_is_dealt_out_by_the_number_of_triangles(soup, spark, monkeypatch, capsys):
    before = {tuple(r) for r in topology.incidence(soup).collect()}
    twice = soup.unionByName(soup).withColumn("mesh", F.col("mesh").cast("long"))
    monkeypatch.setattr(graph, "TASK_ROWS", 3)
    dealt = topology.incidence(twice)
    dealt.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert {tuple(r) for r in dealt.collect()} == before
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    assert mesh_queries.terrain(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 100)


def test_parts(soup):
    got: dict[tuple, set] = {}
    for r in topology.parts(soup).collect():
        got.setdefault((r["mesh"], r["part"]), set()).add(r["face"])
    assert got == {(m, k): f for m, (_, index) in MESHES.items() for k, f in grouped(set(range(len(index))), index).items()}


@pytest.fixture
def small_tasks_stay(spark):
    """Ranges of few rows are not put together, so that a giant's parts lie in several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_topology_with_places_by_area(soup, monkeypatch, small_tasks_stay):
    """Of meshes that a task can hold and of giants, whose parts no task orders alone."""
    want = {}
    for m, (xyz, index) in MESHES.items():
        area, _, _ = measures(xyz, index)
        z = xyz[index][:, :, 2]
        low, height = z.min(), np.ptp(z) + 1e-8
        parts = {k: sorted(f) for k, f in grouped(set(range(len(index))), index).items()}
        share = {k: area[f].sum() / (area.sum() + 1e-8) for k, f in parts.items()}
        for place, k in enumerate(sorted(parts, key=lambda k: (-round(share[k], 9), k)), 1):
            own = z[parts[k]]
            bottom, top, tall = (own.min() - low) / height, (own.max() - low) / height, np.ptp(own)
            want[m, k] = (place, len(parts[k]), share[k], bottom, top, tall, top < 0.15, tall / height < 0.05)
    assert len(want) > len(MESHES) + 20
    for most in (graph.CONTRACTED, 100):
        monkeypatch.setattr(graph, "CONTRACTED", most)
        assert topology.giants(soup)[1] == (most == 100)
        rows = topology.topology(soup).collect()
        assert len(rows) == len(want)
        for r in rows:
            got = (r["place"], r["n_faces"], r["area_frac"], r["z_bottom"], r["z_top"], r["z_height"], r["is_bottom_only"], r["is_thin"])
            assert got == pytest.approx(want[r["mesh"], r["part"]])


def test_equal_parts_have_their_places_by_their_least_face(spark, monkeypatch, small_tasks_stay):
    """Twelve strips of the same triangles, whose areas are summed in other orders, and a smaller one."""
    rng, rows, n = np.random.default_rng(5), [], 60
    xyz = np.stack([np.arange(n + 2) // 2 * 3, np.arange(n + 2) % 2 * 2, rng.integers(0, 40, n + 2)], 1).astype(float)
    for strip in range(13):
        count = n if strip else n - 1  # the first is the smaller one
        for i, k in zip(rng.permutation(count), range(count), strict=True):
            v = [int(i) + j for j in range(3)]
            rows.append((1, strip * 100 + k, *(x + 1000 * strip for x in v), *map(float, (xyz[v] + [200 * strip, 0, 0]).ravel())))
    t = spark.createDataFrame(rows, "mesh int, " + meshes.TRIANGLES.split("string, ")[2]).repartition(7).cache()
    for most in (graph.CONTRACTED, 100):
        monkeypatch.setattr(graph, "CONTRACTED", most)
        got = topology.topology(t).orderBy("place").select("place", "part").collect()
        assert [tuple(r) for r in got] == [*((k, 100 * k) for k in range(1, 13)), (13, 0)]


def test_the_sweep_equals_a_run_for_each_pair_of_thresholds(soup):
    got: dict[tuple, set] = {}
    for r in topology.swept_components(soup).collect():
        got.setdefault((r["mesh"], r["band"], r["dot"], r["component"]), set()).add(r["face"])
    want = {}
    for m, (xyz, index) in MESHES.items():
        _, up, z = measures(xyz, index)
        used = xyz[index.ravel()][:, 2]
        low, height = used.min(), used.max() - used.min()
        for band in topology.BANDS:
            for dot in topology.DOTS:
                if height >= 1e-6:
                    want |= {(m, band, dot, k): f for k, f in grouped(set(np.flatnonzero((z <= low + height * band) & (up >= dot)).tolist()), index).items()}
    assert got == want


def hull_by_hand(points: np.ndarray) -> float:
    """A pair of points is an edge of the hull if all others lie on one side; its area by the shoelace rule."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return 0.0
    total = 0.0
    for i, p in enumerate(pts):
        for j, q in enumerate(pts):
            if i == j:
                continue
            side = (q[0] - p[0]) * (pts[:, 1] - p[1]) - (q[1] - p[1]) * (pts[:, 0] - p[0])
            on = pts[np.abs(side) < 1e-12]
            along = (on - p) @ (q - p) / ((q - p) @ (q - p))
            if (side >= -1e-12).all() and along.min() >= -1e-9 and along.max() <= 1 + 1e-9:
                total += p[0] * q[1] - q[0] * p[1]
    return total / 2


def test_metrics_with_hulls(soup):
    label = topology.swept_components(soup, (0.2,), (0.9,)).select("mesh", "face", "component").cache()
    faces: dict[tuple, list] = {}
    for r in label.collect():
        faces.setdefault((r["mesh"], r["component"]), []).append(r["face"])
    got = {(r["mesh"], r["component"]): r for r in topology.component_metrics(soup, label, []).collect()}
    assert set(got) == set(faces) and len(faces) > 5
    for (m, k), fs in faces.items():
        xyz, index = MESHES[m]
        area, _, _ = measures(xyz, index)
        own = xyz[index[fs].ravel()]
        height = np.ptp(xyz[index.ravel()][:, 2])
        want = (len(fs), area[fs].sum() / (area.sum() + 1e-8), np.ptp(own[:, 2]) / (height + 1e-8), hull_by_hand(own[:, :2]), hull_by_hand(own[:, :2]) / (hull_by_hand(xyz[index.ravel()][:, :2]) + 1e-8))
        r = got[m, k]
        assert (r["n_faces"], r["area_frac"], r["thickness"], r["fp_area"], r["fp_ratio"]) == pytest.approx(want)


@pytest.mark.parametrize("shares", [1, 3, 64])
def test_hulls_equal_brute_force(spark, shares):
    rng = np.random.default_rng(4)
    points = {k: rng.integers(0, 30, (n, 2)).astype(float) for k, n in enumerate([1, 2, 3, 40, 200])} | {9: np.array([[i, i] for i in range(9)], float)}
    angle = np.arange(500) * 2 * np.pi / 500
    points[10] = np.stack([np.cos(angle), np.sin(angle)], 1)
    df = spark.createDataFrame([(k, *map(float, p)) for k, ps in points.items() for p in ps], "mesh long, x double, y double").repartition(4)
    got = {r["mesh"]: r["area"] for r in geometry.hull_areas(df, "mesh", "x", "y", shares).collect()}
    assert got == pytest.approx({k: hull_by_hand(p) for k, p in points.items()})


def test_floor_candidates_and_decisions(spark):
    """A wide flat ground under a tower is found, removed if enough is left, and not if too little is."""
    def ground(n: int, z: float) -> list:
        at = lambda x, y: (x * (n + 1) + y, float(x), float(y), z)
        return [t for x in range(n) for y in range(n) for t in ([at(x, y), at(x + 1, y), at(x, y + 1)], [at(x + 1, y), at(x + 1, y + 1), at(x, y + 1)])]

    def tower(levels: int) -> list:
        at = lambda k, i: (10_000 + 4 * k + i % 4, 4.0 + (i % 4 in (1, 2)), 4.0 + (i % 4 in (2, 3)), 20.0 * k / levels)
        return [t for k in range(levels) for i in range(4) for t in ([at(k, i), at(k, i + 1), at(k + 1, i)], [at(k, i + 1), at(k + 1, i + 1), at(k + 1, i)])]

    plans = {1: ground(10, 0.0) + tower(40), 2: ground(10, 0.0) + tower(5), 3: ground(10, 0.0), 4: tower(40)}
    rows = [(m, f, *(c[0] for c in t), *(x for c in t for x in c[1:])) for m, ts in plans.items() for f, t in enumerate(ts)]
    t = spark.createDataFrame(rows, "mesh int, " + meshes.TRIANGLES.split("string, ")[2]).cache()
    label = topology.bottom_components(t)
    assert topology.floor_candidates(t, label).count() == 0  # a footprint is never wider than the whole, which the strict overhang asks for
    found = topology.floor_candidates(t, label, topology.FLOOR | {"overhang": 0.2}).cache()
    assert {(r["mesh"], r["n_faces"], r["place"]) for r in found.collect()} == {(1, 200, 1), (2, 200, 1)}
    assert all(r["confidence"] == pytest.approx(0.30 * min(r["area_frac"] / 0.4, 1) + 0.20 + 0.15 + 0.20 + 0.15, abs=1e-6) for r in found.collect())
    got = {r["mesh"]: (r["decision"], r["n_faces_cleaned"], r["error"]) for r in topology.floor_decisions(t, found, label).collect()}
    assert got == {1: ("removed", 320, None), 2: ("keep", 240, "abort_min_faces"), 3: ("skip_flat", 200, None), 4: ("keep", 320, None)}
    sure = topology.floor_decisions(t, found.withColumn("confidence", F.lit(0.6)), label).where("mesh < 3")
    assert {r["decision"] for r in sure.collect()} == {"review"}


@pytest.mark.parametrize("name", ["mesh_floor_candidates", "mesh_floor_decisions"])
def test_queries_without_sql(spark, name):
    """Of all terrains: candidates are numbered by confidence, decisions are one for each."""
    rows = QUERIES[name](spark, SF).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["mesh"], []).append(r)
    suppliers = {r["l_suppkey"] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    if name == "mesh_floor_candidates":
        assert by and set(by) <= suppliers
        assert all([r["confidence"] for r in sorted(rs, key=lambda r: r["place"])] == sorted((r["confidence"] for r in rs), reverse=True) for rs in by.values())
    else:
        assert set(by) == suppliers and all(len(rs) == 1 for rs in by.values())


def test_giants_give_what_other_meshes_give(spark, monkeypatch):
    """Components of meshes too large for a task come by rounds; those of others take no join by face."""
    t = mesh_queries.terrain(spark, "/root/testdata/sf0.001").where("mesh < 3").localCheckpoint()
    found = lambda: [sorted(map(tuple, df.collect())) for df in (topology.parts(t), topology.sweep_metrics(t).select("mesh", "band", "dot", "component", "n_faces", "z_min", "z_max"))]
    whole = found()
    monkeypatch.setattr(graph, "CONTRACTED", 300)
    assert topology.giants(t)[1]
    assert found() == whole and all(whole)


def test_few_faces_in_a_task_need_no_rounds(spark):
    """Before, the sweep of four bands was four loops of eager rounds."""
    t = mesh_queries.terrain(spark, "/root/testdata/sf0.001").where("mesh < 3")
    spark.sparkContext.setJobGroup("sweep", "few meshes")
    try:
        assert topology.sweep_metrics(t).count() and topology.topology(t).count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sweep")) <= 45
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_files_are_read_many_to_a_task():
    small = [(f"{i}.glb", 9000) for i in range(1000)]
    got = meshes.slices([*small[:500], ("large.glb", 3 * meshes.SLICE_BYTES), *small[500:]], meshes.SLICE_BYTES)
    assert len(got) <= 3 + 5
    assert sorted(x for s in got for x in s.shares) == sorted([(p, 0, 1) for p, _ in small] + [("large.glb", k, 3) for k in range(3)])


def test_hulls_of_many_small_meshes_and_a_large_one(spark):
    """Hulls grow from sorted points: no group of points is gathered for each mesh and share, which took a second a thousand."""
    rng = np.random.default_rng(3)
    sets = {f"m{i}": np.round(rng.normal(size=(int(rng.integers(1, 12)), 2)), 1) for i in range(300)}
    sets |= {"large": rng.normal(size=(20_000, 2)), "line": np.array([[k, 2.0 * k] for k in range(500)]), "point": np.ones((300, 2))}
    rows = [(m, float(x), float(y)) for m, p in sets.items() for x, y in p]
    random.Random(5).shuffle(rows)
    df = geometry.hull_areas(spark.createDataFrame(rows, "mesh string, x double, y double").repartition(3), "mesh", "x", "y")
    got = {r["mesh"]: r["area"] for r in df.collect()}
    assert got.keys() == sets.keys()
    for m, p in sets.items():
        assert got[m] == pytest.approx(geometry.hull_area(p), abs=1e-9)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
