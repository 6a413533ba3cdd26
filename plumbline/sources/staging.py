"""Intermediate results in the folder that the cluster shares.

`stored` cuts a plan's lineage: later readers neither recompute it nor depend on any executor's disk. `scratch` deletes what was
stored inside it, once nothing reads it any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that the open scopes of `scratch` have stored, the innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    A temporary one only where the session names none and everything runs in this process, as in tests: the executors of a
    cluster wouldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once_a_value(df: DataFrame, column: str, name: str, made: Column) -> DataFrame:
    """df with `name`, an expression of one column that is worked out once for each of its values, not once a row.

    The values are stored, so the join knows their size: few are broadcast by Spark's own limit, many are shuffled.
    """
    values = stored(df.select(column).distinct().withColumn(name, made)).withColumnRenamed(column, "_value")
    return df.join(values, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that `stored` wrote inside. What is to last must have been written elsewhere by then.

    Results that are read later, such as those of a lazy DataFrame that an operator returns, mustn't leave the block unwritten.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """As `stored`, but for the scope around the innermost `scratch`: it outlasts the latter."""
    inner = _scopes.pop() if _scopes else None
    try:
        return stored(df)
    finally:
        if inner is not None:
            _scopes.append(inner)
