"""Runs as an append-only log in shared storage: created once, changed in steps, with a pointer to the last success.

Each step is a file of its own, named by its number and created only if it is not there yet, which the
file system decides: of two writers of one step one fails. The pointer is a log of its own kind, to which
only a finished run adds. Reading is a DataFrame over all steps.

Edge cases: an id that is no plain name, an unknown run, and a step that the run's state does not admit
fail and write nothing; a run that failed leaves the pointer where it was; an empty log gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "run_id string, scene_id string, step int, status string, at string, note string"
POINTER = "step int, run_id string, scene_id string, at string"
# fixed values: names of runs, and which states follow one another
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
FOLLOWING = {"running": ("running", "incomplete", "complete", "failed"), "incomplete": ("running", "incomplete", "failed")}
SUCCESS = "complete"


class RunConflict(RuntimeError):
    """Another writer was first, or the run's state does not admit the step."""


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _create(self, name: str, row: dict) -> None:
        """Write a file that must not be there; the file system creates it for one writer only.

        HDFS and its like decide that when a file is created. Local and mounted folders do not through
        Hadoop's interface, so there the whole file is linked to its name, which fails if the name is taken.
        """
        data, path = (json.dumps(row) + "\n").encode(), self._path(name)
        if self._fs.getUri().getScheme() == "file":
            local = Path(path.toUri().getPath())
            local.parent.mkdir(parents=True, exist_ok=True)
            whole = local.with_name(f".{uuid4().hex}")
            whole.write_bytes(data)
            try:
                os.link(whole, local)
            except FileExistsError:
                raise RunConflict(f"{name} exists") from None
            finally:
                whole.unlink()
            return
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or self._fs.exists(path):
                raise RunConflict(f"{name} exists") from None
            raise
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def _last(self, folder: str) -> int:
        """The number of a folder's last step, -1 without any."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return -1
        return max((int(s.getPath().getName()[:8]) for s in self._fs.listStatus(path) if re.fullmatch(r"\d{8}\.json", s.getPath().getName())), default=-1)

    def _now(self) -> str:
        return self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\") AS t").first()["t"]

    def create(self, run_id: str, scene_id: str) -> None:
        """Begin a run; fails if there is one of that id, whatever became of it."""
        if not _NAME.fullmatch(run_id or ""):
            raise ValueError(f"no name of a run: {run_id!r}")
        self._create(f"{self.root}/runs/{run_id}/{0:08d}.json", {"run_id": run_id, "scene_id": scene_id, "step": 0, "status": "running", "at": self._now(), "note": None})

    def state(self, run_id: str) -> dict:
        """The run's last step."""
        last = self._last(f"{self.root}/runs/{run_id}") if _NAME.fullmatch(run_id or "") else -1
        if last < 0:
            raise KeyError(run_id)
        return self.spark.read.schema(STEP).json(f"{self.root}/runs/{run_id}/{last:08d}.json").first().asDict()

    def step(self, run_id: str, status: str, note: str | None = None, seen: int | None = None) -> int:
        """Add a step after the last one, or after the one ``seen``; a success moves the pointer."""
        now = self.state(run_id)
        if status not in FOLLOWING.get(now["status"], ()):
            raise RunConflict(f"{run_id} is {now['status']}; {status} cannot follow")
        number = (now["step"] if seen is None else seen) + 1
        self._create(f"{self.root}/runs/{run_id}/{number:08d}.json", now | {"step": number, "status": status, "at": self._now(), "note": note})
        while status == SUCCESS:
            at = self._last(f"{self.root}/latest") + 1
            try:
                self._create(f"{self.root}/latest/{at:08d}.json", {"step": at, "run_id": run_id, "scene_id": now["scene_id"], "at": self._now()})
                break
            except RunConflict:  # another run finished at the same time: after it, then
                continue
        return number

    def steps(self) -> DataFrame:
        """STEP: every step of every run."""
        there = self._fs.exists(self._path(f"{self.root}/runs"))
        return self.spark.read.schema(STEP).json(f"{self.root}/runs/*") if there else self.spark.createDataFrame([], STEP)

    def runs(self) -> DataFrame:
        """(run_id, scene_id, status, steps, created_at, updated_at) of every run."""
        last = F.max_by(F.struct("scene_id", "status", "at"), "step")
        found = self.steps().groupBy("run_id").agg(last.alias("m"), F.count("*").alias("steps"), F.min_by("at", "step").alias("created_at"))
        return found.select("run_id", "m.scene_id", "m.status", "steps", "created_at", F.col("m.at").alias("updated_at"))

    def latest(self, scene_id: str | None = None) -> str | None:
        """The run that succeeded last, of one scene or of all."""
        if not self._fs.exists(self._path(f"{self.root}/latest")):
            return None
        told = self.spark.read.schema(POINTER).json(f"{self.root}/latest")
        return told.where(F.col("scene_id") == scene_id if scene_id is not None else F.lit(True)).agg(F.max_by("run_id", "step")).first()[0]
