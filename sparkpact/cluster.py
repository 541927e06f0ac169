"""Makes the package known to Python workers that cannot import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkpact_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkpact-"), "sparkpact.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("sparkpact", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._sparkpact_shipped = True
