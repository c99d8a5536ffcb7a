"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def on_executors(spark: SparkSession) -> None:
    """Make this package importable in Python workers: by PYTHONPATH where it names us, else as a shipped file."""
    here = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(ROOT) in here or getattr(spark, "_ferrolens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, "ferrolens_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "ferrolens").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    spark._ferrolens_shipped = True


def shared_path(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/ferrolens-{uuid.uuid4().hex}"
