"""Keys of a stream: the second row of a key is quarantined, in whatever batch it comes.

What has been seen is a table of keys in the shared folder, a folder for each batch. A batch is judged against the keys of the
batches before it, and writes by its number: one that is repeated after a failure or a restart replaces itself and gives the
same rows. Everything is joins and aggregates, combined before they are shuffled, so a frequent key is no large task. Whole rows
are shuffled once, by their number, and stored with the verdict, which both outputs read; else only keys and order are shuffled.
Joins are merges at any size: tables as long as a batch aren't gathered in the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.sources.staging import scratch, stored


def unique_stream(stream: DataFrame, key: list[str], order: list[str], kept_path: str, rest_path: str, seen_path: str, checkpoint: str, primary: bool = False, at: str | None = None, expiry: str | None = None, **trigger) -> StreamingQuery:
    """Starts the stream. The first row of each key, the least by `order` within its batch, goes to kept_path; others go to rest_path
    with `reason` (repeated key, or null key for a primary one; rows of another key with a NULL part are kept).

    at, expiry: a time column and an interval, such as 7 days: a key that was seen longer than that before the newest row of a
    batch is forgotten. trigger: as for DataStreamWriter.trigger (default: all that is there, then stop).
    """
    fields = [stream.schema[c] for c in key] + ([StructField("_at", stream.schema[at].dataType)] if at else [])
    seen_schema = StructType([*fields, StructField("batch", IntegerType())])
    whole = reduce(lambda x, y: x & y, [F.col(f"`{c}`").isNotNull() for c in key])

    def put(df: DataFrame, path: str, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            put(batch.limit(0).select(*key, *([F.col(at).alias("_at")] if at else [])), seen_path, number)
        with scratch(spark):
            rows = stored(batch.withColumn("_row", F.monotonically_increasing_id()))
            seen = spark.read.schema(seen_schema).parquet(seen_path).where(F.col("batch") < number)
            if at and expiry:
                newest = rows.agg(F.max(at).alias("newest"))
                seen = seen.crossJoin(F.broadcast(newest)).where(F.col("_at") >= F.col("newest") - F.expr(f"INTERVAL {expiry}")).drop("newest")
            first = rows.where(whole).groupBy(*key).agg(F.min(F.struct(*order, "_row"))["_row"].alias("_row"), *([F.max(at).alias("_at")] if at else []))
            new = stored(first.join(seen.select(*key).hint("merge"), key, "left_anti"))
            judged = rows.join(new.select("_row", F.lit(True).alias("_new")).hint("merge"), "_row", "left")
            judged = stored(judged.withColumn("_fine", F.when(whole, F.col("_new").isNotNull()).otherwise(not primary)).drop("_row", "_new"))
            put(judged.where("_fine").drop("_fine"), kept_path, number)
            reason = F.when(whole, "repeated key").otherwise("null key")
            put(judged.where("not _fine").drop("_fine").withColumn("reason", reason), rest_path, number)
            put(new.select(*key, *(["_at"] if at else [])), seen_path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
