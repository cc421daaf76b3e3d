"""The package for Python workers that can't import it from where they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as file:
        for f in sorted(top.rglob("*.py")):
            file.write(f, f.relative_to(top.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)
