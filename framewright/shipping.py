"""The package itself, for executors that don't share the driver's files."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="framewright-"), "framewright.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
