"""Make the package importable on the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers, once a Spark application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="corpusloom-src-"), "corpusloom.zip")
        with zipfile.ZipFile(name, "w") as archive:
            for folder, _, files in os.walk(here):
                for file in files:
                    if not file.endswith(".pyc"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(name)
        _SHIPPED.add(context.applicationId)
    return spark
