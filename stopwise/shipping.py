"""Sends this package to the executors, whose Python workers may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Once for each Spark application; every later executor fetches the same archive from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_stopwise_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="stopwise-"), "stopwise.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
    sc._stopwise_shipped = True
