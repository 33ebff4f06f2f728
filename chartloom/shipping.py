"""Makes the package importable in the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along with the application, once, unless PYTHONPATH already leads to it (as with --py-files)."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or not package.is_dir():
        return
    path = f"{tempfile.mkdtemp(prefix='chartloom-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
