"""Session helpers: one factory for local work, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch: a Python worker holds some batches at a time, whatever the texts' length.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def build_session(master: str = "local[*]", app: str = "prismwell", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and a small shuffle width for local runs."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; a local session gets a temporary one where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prismwell-ckpt-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/prismwell-{label}-{uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Set ARROW_LIMITS where the session has larger ones."""
    for key, limit in ARROW_LIMITS.items():
        now = spark.conf.get(key)
        if not (now or "").isdigit() or not 0 < int(now) <= int(limit):
            spark.conf.set(key, limit)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers import operators by name, so the modules must be importable
    there; ``addPyFile`` serves the archive from the driver.
    """
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, archive = tempfile.mkstemp(prefix="prismwell-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
