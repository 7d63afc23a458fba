"""Media dataflow on Spark: files as tables of streams, packets, frames, samples and pixels."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, whatever their PYTHONPATH holds."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(here, f"{folder}/tree/reelframe", ignore=shutil.ignore_patterns("__pycache__"))
        name = tempfile.mkdtemp(prefix="reelframe-zip-")
        sc.addPyFile(shutil.make_archive(f"{name}/reelframe", "zip", f"{folder}/tree"))
    _shipped.add(sc.applicationId)
