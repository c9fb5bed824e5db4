"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a session: they may not have the folder that the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_strandex_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandex-"), "strandex.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("strandex", os.path.relpath(full, home)))
    sc.addPyFile(path)
    sc._strandex_shipped = True
