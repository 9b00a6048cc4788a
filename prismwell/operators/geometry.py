"""Mesh geometry: face components, hulls, planes, projection. A mesh may be as large as the table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import components

def component_sizes(edges: DataFrame, mesh: str, u: str, v: str) -> DataFrame:
    """(mesh, component, size) of each mesh's graph; a component's name is its least node.

    No mesh is gathered anywhere.
    """
    plain = edges.select(F.col(mesh).alias("mesh"), F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    nodes = plain.select("mesh", F.explode(F.array("u", "v")).alias("node")).distinct()
    found = components(plain, "mesh").withColumnRenamed("graph", "mesh")
    named = nodes.join(found, ["mesh", "node"], "left")
    return named.groupBy("mesh", F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("size"))


def hull_points(xy: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points in the plane, in order; all of them if fewer than three differ."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(points: np.ndarray) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array([*half(pts), *half(pts[::-1])])


def hull_area(xy: np.ndarray) -> float:
    """The area of the convex hull; 0 for fewer than three different points."""
    ring = hull_points(xy)
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


#: Points of one mesh in a batch from which on their hull is worth taking before they move.
WORTH_A_HULL = 64


class _Chain:
    """The lower and the upper half of a hull of points that come sorted."""

    def __init__(self) -> None:
        self.halves: tuple[list, list] = ([], [])

    def add(self, x: float, y: float) -> None:
        for out, sign in zip(self.halves, (1, -1), strict=True):
            if out and out[-1] == (x, y):
                continue
            while len(out) > 1 and sign * ((out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0])) <= 0:
                out.pop()
            out.append((x, y))

    def ring(self) -> list[tuple[float, float]]:
        lower, upper = self.halves
        return [*lower[:-1], *upper[:0:-1]] if len(lower) > 1 else lower

    def area(self) -> float:
        ring = self.ring()
        if len(ring) < 3:
            return 0.0
        return abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def _chains(batches, by: list[str]):
    """(key, chain) of each key's points, which come sorted by key and place; and None at the end of a batch."""
    now, chain = None, None
    for pdf in batches:
        for *key, px, py in zip(*[pdf[c].tolist() for c in (*by, "x", "y")], strict=True):
            if chain is None or key != now:
                if chain is not None:
                    yield now, chain
                now, chain = key, _Chain()
            chain.add(px, py)
        yield None
    if chain is not None:
        yield now, chain
    yield None


def hull_areas(points: DataFrame, mesh: str, x: str, y: str, shares: int = 64) -> DataFrame:
    """(mesh, area): batches with many points of a mesh keep their hulls' corners only, shares of a mesh those of their batches, and the mesh those of its shares.

    Points come sorted by mesh and place, and a task grows one hull at a time. Corners are few whatever the
    points, as long as these lie on no circle; a share bounds what one task holds even then.
    """
    kind = points.schema[mesh].dataType.simpleString()
    schema = f"mesh {kind}, x double, y double, share int"

    def corners(batches):
        for pdf in batches:
            pdf = pdf.drop_duplicates()
            size = pdf.groupby("mesh", sort=False, dropna=False)["x"].transform("size")
            yield pdf[size < WORTH_A_HULL].assign(share=0)
            for key, part in pdf[size >= WORTH_A_HULL].groupby("mesh", sort=False, dropna=False):
                ring = hull_points(part[["x", "y"]].to_numpy(float))
                out = pd.DataFrame({"mesh": [key] * len(ring), "x": ring[:, 0], "y": ring[:, 1]}, columns=["mesh", "x", "y"])
                yield out.assign(share=np.arange(len(ring)) % shares)

    def of_shares(batches):
        rows: list = []
        for got in _chains(batches, ["mesh", "share"]):
            if got:
                rows += [(got[0][0], px, py, got[0][1]) for px, py in got[1].ring()]
            else:
                yield pd.DataFrame(rows, columns=["mesh", "x", "y", "share"])
                rows = []

    def of_meshes(batches):
        rows: list = []
        for got in _chains(batches, ["mesh"]):
            if got:
                rows.append((got[0][0], got[1].area()))
            else:
                yield pd.DataFrame(rows, columns=["mesh", "area"])
                rows = []

    plain = points.select(F.col(mesh).alias("mesh"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    few = plain.mapInPandas(corners, schema).repartition("mesh", "share").sortWithinPartitions("mesh", "share", "x", "y").mapInPandas(of_shares, schema)
    return few.repartition("mesh").sortWithinPartitions("mesh", "x", "y").mapInPandas(of_meshes, f"mesh {kind}, area double")


def planes(points: DataFrame, mesh: str, row: str, axes: list[str], tolerance: float, tries: int = 100) -> DataFrame:
    """(mesh, a, b, c, d, inliers): of the planes through ``tries`` triples the one with most points near it, of equals the first.

    The triples of a mesh are its points in the order of a hash of their ids, three by three, so results
    repeat. Points are counted by a join with the mesh's planes and an aggregate.
    """
    x = [f"_{i}" for i in range(3)]
    plain = points.select(F.col(mesh).alias("mesh"), F.col(row).alias("row"), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, x, strict=True)])
    order = F.row_number().over(Window.partitionBy("mesh").orderBy(F.sha2(F.col("row").cast("string"), 256), "row"))
    drawn = plain.withColumn("n", order).where(F.col("n") <= 3 * tries).withColumns({"k": F.floor((F.col("n") - 1) / 3).cast("int"), "j": (F.col("n") - 1) % 3})
    of = lambda j, n: F.max(F.when(F.col("j") == j, F.col(n)))
    triples = drawn.groupBy("mesh", "k").agg(F.count("*").alias("c"), *[of(j, n).alias(f"p{j}{n}") for j in range(3) for n in x]).where("c = 3")
    u, v = ([F.col(f"p{j}{n}") - F.col(f"p0{n}") for n in x] for j in (1, 2))
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    triples = triples.select("mesh", "k", *[c.alias(n) for c, n in zip(normal, "abc", strict=True)], *[f"p0{n}" for n in x])
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    triples = triples.where(size >= 1e-12).select("mesh", "k", *[(F.col(n) / size).alias(n) for n in "abc"], *[f"p0{n}" for n in x])
    told = triples.withColumn("d", -(F.col("a") * F.col("p0_0") + F.col("b") * F.col("p0_1") + F.col("c") * F.col("p0_2"))).select("mesh", "k", "a", "b", "c", "d")
    near = F.abs(F.col("a") * F.col("_0") + F.col("b") * F.col("_1") + F.col("c") * F.col("_2") + F.col("d")) <= tolerance
    counted = plain.join(told, "mesh").groupBy("mesh", "k", "a", "b", "c", "d").agg(F.count_if(near).alias("inliers"))
    return counted.groupBy("mesh").agg(F.max(F.struct("inliers", (-F.col("k")).alias("k"), "a", "b", "c", "d")).alias("b")).select("mesh", "b.a", "b.b", "b.c", "b.d", "b.inliers")


def camera_place(target: tuple[Column, Column, Column], distance: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Where a camera stands that looks at the target."""
    az, el = F.radians(azimuth), F.radians(elevation)
    x, y, z = target
    return x + distance * F.cos(el) * F.sin(az), y - distance * F.cos(el) * F.cos(az), z + distance * F.sin(el)
