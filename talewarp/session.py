"""Session helpers: a default local session, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for one machine with the settings that the engine expects."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("talewarp")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="talewarp-ship-")
        archive = os.path.join(folder, "talewarp.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    A session on one machine without that setting gets a temporary folder; on a cluster
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="talewarp-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{str(root).rstrip('/')}/{name}-{uuid.uuid4().hex}"
