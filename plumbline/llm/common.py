"""What the corpus operators share: tables, row keys, stored intermediate results and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shipping import mapped
from plumbline.sources.staging import kept, scratch, stored

#: The white space of all word definitions here: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside the operators, so that keys can be compared with plain equality.
NO_ID = -(2**63)


__all__ = ["NO_ID", "WORD", "arrow", "free", "held_out", "kept", "key", "mapped", "scratch", "small_batches", "stored", "table", "texts", "unkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NO_ID))


def unkey(col: str) -> Column:
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


def free(names: list[str], *wanted: str) -> list[str]:
    """A column name for each of `wanted` that none of `names` is, whatever their case."""
    taken = {n.lower() for n in names}
    mark = next(m for m in ("_" * i for i in range(1, len(names) + 2)) if not any(f"{m}{w}".lower() in taken for w in wanted))
    return [f"{mark}{w}" for w in wanted]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: those whose CRC-32 of the id has the remainder 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that memory doesn't follow the session's batch size."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
