"""Sends this package to the Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    """Once for each Spark context; workers that could import the package anyway get the same code."""
    context = spark.sparkContext
    if getattr(context, "_srcatlas_shipped", False):
        return
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="srcatlas-"), "srcatlas.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._srcatlas_shipped = True
