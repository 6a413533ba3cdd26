"""Conforming a stream: rows that fit go to one folder, the others to a quarantine folder.

Both come from one micro-batch, written by its number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.conform import Contract, conform_split


def conform_stream(stream: DataFrame, contract: Contract, fit_path: str, rest_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream. trigger: as for DataStreamWriter.trigger (default: all that is there, then stop)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        fit, rest = conform_split(batch, contract)
        for df, path in ((fit, fit_path), (rest, rest_path)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
