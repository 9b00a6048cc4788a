"""Publishing files with their digests in two phases.

``publish`` writes one file for each row (name, and either its content or the path of a source) below a
folder that must not exist yet. Tasks write to a staging folder beside it, chunk by chunk, and list what
they wrote with length and SHA-256; the commit on the driver drops what failed attempts left and renames
the staging folder, so that either all files are there or none. A failed job's staging folder is removed.

Edge cases: a row without name, with a name that leaves the folder, or with neither content nor source
fails the job; of two rows of one name in a task the job fails; an empty table publishes an empty folder.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CHUNK = 8 << 20
MANIFEST = "part string, name string, length long, sha256 string"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def copy_with_digest(source: str | bytes, fs: pafs.FileSystem, target: str) -> tuple[int, str]:
    """Write a file's, or the given, bytes to ``target``: (length, SHA-256)."""
    digest, length = hashlib.sha256(), 0
    with fs.open_output_stream(target) as out:

        def put(chunk) -> None:
            nonlocal length
            out.write(chunk)
            digest.update(chunk)
            length += len(chunk)

        if isinstance(source, str):
            from_fs, at = filesystem(source)
            with from_fs.open_input_stream(at) as file:
                while chunk := file.read(CHUNK):
                    put(chunk)
        else:
            put(source)
    return length, digest.hexdigest()


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        fs, at = filesystem(self.path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{path} exists; what is published stays as it is")
        self.staging = f"{posixpath.dirname(self.path)}/.{posixpath.basename(self.path)}.staging-{uuid4().hex}"
        fs, root = filesystem(self.staging)
        fs.create_dir(f"{root}/_manifest", recursive=True)  # tasks make no folder above their own: after an abort they fail

    def write(self, iterator: Iterator) -> Written:
        fs, root = filesystem(self.staging)
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        seen: set[str] = set()
        made: set[str] = {root}
        lines = []

        def make(path: str) -> None:
            if path not in made:
                make(posixpath.dirname(path))
                fs.create_dir(path, recursive=False)
                made.add(path)

        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/") or name in seen:
                raise ValueError(f"not a name to publish under: {name!r}")
            seen.add(name)
            content = row["content"]
            source = bytes(content) if content is not None else row["source"]
            if source is None:
                raise ValueError(f"{name} has neither content nor source")
            target = f"{root}/{folder}/{name}"
            make(posixpath.dirname(target))
            length, digest = copy_with_digest(source, fs, target)
            lines.append(json.dumps({"part": folder, "name": name, "length": length, "sha256": digest}))
        if not lines:
            return Written(None)
        with fs.open_output_stream(f"{root}/_manifest/{folder}.jsonl") as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.staging)
        _, final = filesystem(self.path)
        good = {m.folder for m in messages if m is not None and m.folder}
        for info in fs.get_file_info(pafs.FileSelector(root)):  # a folder for each task
            if info.base_name.startswith("part-") and info.base_name not in good:
                fs.delete_dir(info.path)
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/_manifest")):
            if info.base_name.removesuffix(".jsonl") not in good:
                fs.delete_file(info.path)
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.path} has been published meanwhile")
        fs.move(root, final)

    def abort(self, messages: list[Written | None]) -> None:
        """Take the folder away under the tasks that still run, then delete it."""
        fs, root = filesystem(self.staging)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.move(root, f"{root}-aborted")
            fs.delete_dir(f"{root}-aborted")


class PublishSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prismwell_publish"

    def schema(self) -> str:
        return "name string, source string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def publish(rows: DataFrame, path: str) -> DataFrame:
    """Write the rows (name, and content or source) as files below ``path``; returns their manifest."""
    spark = rows.sparkSession
    spark.dataSource.register(PublishSink)
    columns = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("source", "string"), ("content", "binary"))]
    rows.select(*columns).write.format("prismwell_publish").mode("append").save(path)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, name, length, sha256) of what was published; a file lies at part/name."""
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest")
