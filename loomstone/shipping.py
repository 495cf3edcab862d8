"""Sends this library to the Python workers, which may be on machines or in folders without it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: list[str] = []


def ship(spark: SparkSession) -> None:
    """Once an application. To be called before a function of this library goes into Python workers."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.append(app)
        at = Path(__file__).resolve().parents[1]
        # A stateful stream also starts a worker beside the driver, which takes no added files, but this path.
        env = spark.sparkContext.environment
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), str(at)) if x)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/loomstone-base", "zip", at, "loomstone"))
