"""Triangle meshes as a data source: binary glTF files and binary PLY files.

``spark.read.format("prismwell_mesh").load(folder or file)`` gives a row per triangle. A file of several
slices' size is read by as many tasks: each reads the header, its share of the faces of every part, and
the vertices between the least and the greatest that these faces name. Small files are read many to a
task. A part is a mesh primitive under a
node; the node's transform and those of the nodes above it are applied. Parts follow one another in the
order of a walk through the scene, and so do the numbers of vertices and faces.

Edge cases: a file without any triangle is an error, as is one that is cut short, compressed, or of
another kind; primitives of points and lines are left out; a part without indices has a face for each
three vertices; names are kept as they are, a part without one is called by its number.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .publish import filesystem, publish

#: Bytes of a file that one task reads, and faces in a batch.
SLICE_BYTES, BATCH_FACES = 64 << 20, 50_000
#: Bytes that opening a file counts for when small files are put together.
OPENING = 256 << 10
TRIANGLES = "file string, part string, face long, v0 long, v1 long, v2 long, " + ", ".join(f"{a}{i} double" for i in range(3) for a in "xyz")
# fixed values: glTF's codes of number types, the mode of triangle lists, and its chunk names
_TYPES = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_TRIANGLE_MODE, _MAGIC, _JSON, _BIN = 4, 0x46546C67, 0x4E4F534A, 0x004E4942
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}


class MeshError(ValueError):
    """A file that holds no readable triangle mesh."""


@dataclass
class Strided:
    """Rows of ``width`` numbers at a place in a file, ``stride`` bytes apart."""

    file: pa.NativeFile
    at: int
    count: int
    dtype: np.dtype
    width: int
    stride: int

    def rows(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(self.at + start * self.stride)
        size = self.width * self.dtype.itemsize
        want = (stop - start - 1) * self.stride + size if stop > start else 0
        data = self.file.read(want)
        if len(data) < want:
            raise MeshError("the file is cut short")
        shape, strides = (stop - start, self.width), (self.stride, self.dtype.itemsize)
        return np.ndarray(shape, self.dtype, data, 0, strides)


@dataclass
class Part:
    """A primitive in its place: where its vertices and indices are, and the transform into the scene."""

    name: str
    vertices: Strided
    indices: Strided | None
    world: np.ndarray
    lead: Strided | None = None

    @property
    def n_faces(self) -> int:
        if self.indices is None:
            return self.vertices.count // 3
        return self.indices.count * self.indices.width // 3

    def faces(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(vertex numbers, coordinates) of the faces from start to stop."""
        if self.indices is None:
            v = np.arange(3 * start, 3 * stop).reshape(-1, 3)
        elif self.indices.width == 3:
            if (self.lead.rows(start, stop) != 3).any():
                raise MeshError("a face is no triangle")
            v = self.indices.rows(start, stop).astype(np.int64)
        else:
            v = self.indices.rows(3 * start, 3 * stop).astype(np.int64).reshape(-1, 3)
        if not len(v):
            return v, np.zeros((0, 3, 3))
        low, high = int(v.min()), int(v.max())
        if low < 0 or high >= self.vertices.count:
            raise MeshError("a face names a vertex that is not there")
        xyz = self.vertices.rows(low, high + 1).astype(np.float64)
        xyz = xyz @ self.world[:3, :3].T + self.world[:3, 3]
        return v, xyz[v - low]


def local_transform(node: dict) -> np.ndarray:
    """A node's own matrix: given whole, or as translation, rotation (a unit quaternion x, y, z, w) and scale."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def _accessor(doc: dict, file: pa.NativeFile, body: int, number: int, width: int) -> Strided:
    a = doc["accessors"][number]
    if "bufferView" not in a or "sparse" in a or doc["buffers"][doc["bufferViews"][a["bufferView"]]["buffer"]].get("uri"):
        raise MeshError("vertices and indices must lie in the file itself, neither sparse nor compressed")
    view, dtype = doc["bufferViews"][a["bufferView"]], np.dtype(_TYPES[a["componentType"]])
    stride = view.get("byteStride") or width * dtype.itemsize
    return Strided(file, body + view.get("byteOffset", 0) + a.get("byteOffset", 0), a["count"], dtype, width, stride)


def glb_parts(file: pa.NativeFile) -> list[Part]:
    """The triangle primitives of a binary glTF file's scene."""
    head = file.read(20)
    if len(head) < 20 or struct.unpack("<I", head[:4])[0] != _MAGIC or struct.unpack("<I", head[16:20])[0] != _JSON:
        raise MeshError("no binary glTF file")
    size = struct.unpack("<I", head[12:16])[0]
    doc = json.loads(file.read(size))
    chunk = file.read(8)
    if len(chunk) == 8 and struct.unpack("<I", chunk[4:])[0] != _BIN:
        raise MeshError("no binary glTF file")
    body, nodes, out = 28 + size, doc.get("nodes", []), []
    scenes = doc.get("scenes") or [{"nodes": list(range(len(nodes)))}]
    todo = [(n, np.eye(4)) for n in reversed(scenes[doc.get("scene", 0)].get("nodes", []))]
    while todo:
        number, above = todo.pop()
        node = nodes[number]
        world = above @ local_transform(node)
        todo += [(n, world) for n in reversed(node.get("children", []))]
        mesh = doc["meshes"][node["mesh"]] if "mesh" in node else {"primitives": []}
        for p in mesh["primitives"]:
            if p.get("mode", _TRIANGLE_MODE) != _TRIANGLE_MODE:
                continue
            vertices = _accessor(doc, file, body, p["attributes"]["POSITION"], 3)
            indices = _accessor(doc, file, body, p["indices"], 1) if "indices" in p else None
            out.append(Part(node.get("name") or mesh.get("name") or str(len(out)), vertices, indices, world))
    return out


def ply_parts(file: pa.NativeFile) -> list[Part]:
    """The one part of a binary little-endian PLY file whose faces are triangles and have no other property."""
    head = b""
    while not head.endswith(b"end_header\n"):
        more = file.read(1)
        if not more or len(head) > 1 << 16:
            raise MeshError("no PLY file")
        head += more
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    if lines[0] != ["ply"] or ["format", "binary_little_endian", "1.0"] not in lines:
        raise MeshError("only binary little-endian PLY files are read")
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    if [e[0] for e in elements[:2]] != ["vertex", "face"] or len(elements[1][2]) != 1 or elements[1][2][0][0] != "list":
        raise MeshError("a PLY file must hold vertices, then faces of a list only")
    (_, n, fields), (_, faces, [(_, few, index, _)]) = elements[:2]
    sizes = [np.dtype(_PLY_TYPES[f[0]]).itemsize for f in fields]
    names = [f[1] for f in fields]
    at = names.index("x")
    if names[at : at + 3] != ["x", "y", "z"] or len({f[0] for f in fields[at : at + 3]}) != 1:
        raise MeshError("x, y and z must follow one another")
    start, stride = len(head), sum(sizes)
    vertices = Strided(file, start + sum(sizes[:at]), n, np.dtype(_PLY_TYPES[fields[at][0]]), 3, stride)
    lead, index = np.dtype(_PLY_TYPES[few]), np.dtype(_PLY_TYPES[index])
    record = lead.itemsize + 3 * index.itemsize
    counts = Strided(file, start + n * stride, faces, lead, 1, record)
    if len(elements) == 2 and file.size() != start + n * stride + faces * record:
        raise MeshError("a face is no triangle, or the file is cut short")
    return [Part("0", vertices, Strided(file, start + n * stride + lead.itemsize, faces, index, 3, record), np.eye(4), counts)]


def parts_of(path: str, file: pa.NativeFile) -> list[Part]:
    parts = ply_parts(file) if path.lower().endswith(".ply") else glb_parts(file)
    if not sum(p.n_faces for p in parts):
        raise MeshError(f"no triangle faces in {path}")
    return parts


@dataclass
class Slice(InputPartition):
    """Shares of files: (path, number, of how many)."""

    shares: list[tuple[str, int, int]]


def slices(files: list[tuple[str, int]], slice_bytes: int) -> list[Slice]:
    """What each task reads of these files (path, bytes): a share of a large one, or some small ones."""
    out, few, held = [], [], 0
    for path, size in files:
        n = max(1, -(-size // slice_bytes))
        if n > 1:
            out += [Slice([(path, k, n)]) for k in range(n)]
            continue
        if few and held + size + OPENING > slice_bytes:
            out.append(Slice(few))
            few, held = [], 0
        few.append((path, 0, 1))
        held += size + OPENING
    return [*out, Slice(few)] if few else out


class _Reader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int):
        self.path, self.slice_bytes = path, slice_bytes

    def partitions(self) -> list[Slice]:
        """Files by their sizes; no file is opened here."""
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        found = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.path.lower().endswith((".glb", ".ply")))
        if not found:
            raise MeshError(f"no mesh file at {self.path}")
        return slices(found, self.slice_bytes)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for share in partition.shares:
            for batch in self.faces_of(*share):
                if held and count + len(batch) > BATCH_FACES:
                    yield pa.concat_batches(held)
                    held, count = [], 0
                held.append(batch)
                count += len(batch)
        if held:
            yield pa.concat_batches(held)

    def faces_of(self, path: str, number: int, of: int) -> Iterator[pa.RecordBatch]:
        fs = filesystem(self.path)[0]
        with fs.open_input_file(path) as file:
            first_vertex = first_face = 0
            for part in parts_of(path, file):
                start, stop = (k * part.n_faces // of for k in (number, number + 1))
                for at in range(start, stop, BATCH_FACES):
                    v, xyz = part.faces(at, min(stop, at + BATCH_FACES))
                    n = len(v)
                    columns = [pa.repeat(pa.scalar(path), n), pa.repeat(pa.scalar(part.name), n), pa.array(np.arange(first_face + at, first_face + at + n))]
                    columns += [pa.array(v[:, i] + first_vertex) for i in range(3)]
                    columns += [pa.array(xyz[:, i, a]) for i in range(3) for a in range(3)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TRIANGLES.split(", ")])
                first_vertex += part.vertices.count
                first_face += part.n_faces


class MeshSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prismwell_mesh"

    def schema(self) -> str:
        return TRIANGLES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("sliceBytes", SLICE_BYTES)))


def triangles(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The triangles of all mesh files below ``path``."""
    spark.dataSource.register(MeshSource)
    return spark.read.format("prismwell_mesh").option("sliceBytes", slice_bytes).load(path)


def glb_bytes(vertices: np.ndarray, faces: np.ndarray, node: dict | None = None) -> bytes:
    """A binary glTF file of one part, with 32-bit floats and indices; ``node`` may name it and hold its transform."""
    xyz, index = np.ascontiguousarray(vertices, "<f4"), np.ascontiguousarray(faces, "<u4")
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, **(node or {})}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(xyz), "type": "VEC3", "min": xyz.min(axis=0).tolist() if len(xyz) else [0] * 3, "max": xyz.max(axis=0).tolist() if len(xyz) else [0] * 3},
            {"bufferView": 1, "componentType": 5125, "count": index.size, "type": "SCALAR"},
        ],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": xyz.nbytes}, {"buffer": 0, "byteOffset": xyz.nbytes, "byteLength": index.nbytes}],
        "buffers": [{"byteLength": xyz.nbytes + index.nbytes}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = xyz.tobytes() + index.tobytes()
    chunks = struct.pack("<II", len(text), _JSON) + text + struct.pack("<II", len(body), _BIN) + body
    return struct.pack("<III", _MAGIC, 2, 12 + len(chunks)) + chunks


def write_meshes(rows: DataFrame, path: str, faces_per_file: int = 20_000) -> DataFrame:
    """Publish the triangles (mesh, face, corners) as binary glTF files of bounded size; returns their manifest.

    A mesh's faces are dealt to files by their numbers, so that a mesh of any size is written by many tasks.
    """
    def encode(key: tuple[str, int], pdf: pd.DataFrame) -> pd.DataFrame:
        """One file of one mesh's faces."""
        v = pdf[["v0", "v1", "v2"]].to_numpy(np.int64)
        xyz = pdf[[f"{a}{i}" for i in range(3) for a in "xyz"]].to_numpy(float).reshape(-1, 3)
        names, first, place = np.unique(v.ravel(), return_index=True, return_inverse=True)
        content = glb_bytes(xyz[first], place.reshape(-1, 3), {"name": str(key[0])})
        return pd.DataFrame({"name": [f"{key[0]}-{key[1]}.glb"], "content": [content]})

    chunk = F.floor(F.col("face") / faces_per_file).alias("chunk")
    files = rows.groupBy(F.col("mesh").cast("string").alias("mesh"), chunk).applyInPandas(encode, "name string, content binary")
    return publish(files, path)
