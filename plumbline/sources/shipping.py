"""Getting this package to the executors' Python workers, whatever their working directory and path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    sc = spark.sparkContext
    if _shipped.get(sc.applicationId):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(top, "plumbline")):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path


def mapped(df: DataFrame, run: Callable, kinds: str) -> DataFrame:
    """df.mapInArrow for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, kinds)
