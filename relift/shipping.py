"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once a SparkContext, by ``addPyFile``."""
    sc = spark.sparkContext
    if getattr(sc, "_relift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="relift-"), "relift.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(at)
    sc._relift_shipped = True
