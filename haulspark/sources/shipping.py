"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the job's Python files, once a session and only if the workers would not find it."""
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if _ROOT in known or app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="spark-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{_ROOT.name}-code", "zip", _ROOT, "haulspark"))
    _SHIPPED.add(app)
