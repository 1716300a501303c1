"""Brings the package to the executors: the functions of Python steps are pickled by name and imported there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to an application once, whatever folder or path it was started from."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestrata-src-"), "lodestrata.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestrata", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _done.add(app)
