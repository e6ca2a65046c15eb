"""Makes sure that executors can import the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package's source to the executors, once an application. Spark itself serves the archive."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as at:
        copied = Path(at, "source")
        shutil.copytree(root, copied / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        served = tempfile.mkdtemp()  # the driver serves it until it ends
        atexit.register(shutil.rmtree, served, ignore_errors=True)
        context.addPyFile(shutil.make_archive(str(Path(served, f"{root.name}_source")), "zip", copied))
    _shipped.add(context.applicationId)
