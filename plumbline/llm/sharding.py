"""Operator 10: sharding by extendible hashing.

A document's hash is 60 bits. The directory is addressed by hash prefixes; a bucket over the byte limit splits on its next
bit, and only such buckets do, until every shard fits. All splits of a round are found at once: bytes are summed by
prefix at a depth a few bits below the expected one, the sums are added up towards the root, and a bucket is a shard if it
fits and the bucket above it doesn't. Buckets that are still too large down there go on alone, deeper, in the next round.

Hashes can't tell rows of one id apart. When the bits are used up, such rows are dealt into numbered parts by count, and a
document that is itself over the limit is a shard of its own, marked `oversize`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

BITS = 60
#: Bits below the expected depth that a round looks at.
AHEAD = 5
#: Copies of a row that one task writes out at a time.
COPIES = 1000


def hashed(id_col: str = "doc_id") -> Column:
    """The first 60 bits of the id's MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(depth, prefix, bytes) of the shards between two depths. cells: prefix at depth `high` and bytes.

    At depth `low` the buckets are known to be too large (or it is the root).
    """
    up = cells.select("bytes", "prefix", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    sums = common.stored(up.groupBy("depth", F.call_function("shiftright", F.col("prefix"), (F.lit(high) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("bytes")))
    above = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    fits = sums.where(F.col("bytes") <= limit).withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    inner = fits.join(above, ["depth", "above"], "left_semi").select("depth", "prefix", "bytes")
    root = fits.where(F.col("depth") == 0).select("depth", "prefix", "bytes") if low == 0 else inner.limit(0)
    return inner.unionByName(root)


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(depth, prefix, bytes) of all shards that prefixes can make, and the hashes (h) that no prefix can part, if any.

    rows: h and n_bytes.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + AHEAD)
    cells = common.stored(rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes")))
    shards = None
    while True:
        at = cells.groupBy(_prefix("h", high).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        found = common.stored(_leaves(at, low, high, limit))
        shards = found if shards is None else shards.unionByName(found)
        large = common.stored(at.where(F.col("bytes") > limit).select("prefix"))
        if large.isEmpty():
            return shards, None
        cells = common.stored(cells.withColumn("prefix", _prefix("h", high)).join(large, "prefix", "left_semi").select("h", "bytes"))
        if high == BITS:
            return shards, cells.select("h")
        low, high = high, min(BITS, high + 2 * AHEAD)


def _addresses(shards: DataFrame, depth: int) -> DataFrame:
    """Directory entries at one depth: every prefix of `depth` bits with its shard. Shards are at most `depth` bits deep."""
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(depth) - F.col("depth")).cast("int"))
    first = F.call_function("shiftleft", F.col("prefix"), (F.lit(depth) - F.col("depth")).cast("int"))
    return shards.select("depth", "prefix", "bytes", F.explode(F.sequence(first, first + width - 1)).alias("address"))


def sharded(df: DataFrame, limit: int, size: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes and oversize for each row.

    limit: bytes of a shard. size: bytes of a row (default: of its text in UTF-8; null counts as 0). shard: the bits of its
    prefix (empty: everything fits into one), for parts of inseparable rows then a point and the part's number. Null ids
    are hashed like any other id. Other columns are ignored; see `written` for files.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    size = F.octet_length("text") if size is None else size
    rows = common.stored(df.select(F.col(id_col).cast("bigint").alias("doc_id"), hashed(id_col).alias("h"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n_bytes")))
    shards, stuck = directory(rows, limit)
    shards = common.stored(shards)
    deep = shards.agg(F.max("depth")).first()[0] or 0
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    named = shards.withColumn("shard", bits)
    # Few shards are much deeper than the rest: those are looked up at their own depths.
    common_depth = min(deep, int(shards.agg(F.percentile_approx("depth", 0.95)).first()[0] or 0) + 1)
    shallow = _addresses(named.where(F.col("depth") <= common_depth).select("depth", "prefix", "bytes"), common_depth)
    shallow = shallow.select("address", "depth", "bytes", bits.alias("shard"))
    open_rows = rows if stuck is None else rows.join(stuck, "h", "left_anti")
    found = open_rows.withColumn("address", _prefix("h", common_depth)).join(shallow, "address", "left")
    placed = [found.where("shard is not null").select("doc_id", "n_bytes", "shard", "depth", F.col("bytes").alias("shard_bytes"))]
    rest = found.where("shard is null").select("doc_id", "h", "n_bytes")
    for d in [r[0] for r in shards.where(F.col("depth") > common_depth).select("depth").distinct().collect()]:
        own = named.where(F.col("depth") == d).select("prefix", "shard", "depth", F.col("bytes").alias("shard_bytes"))
        placed.append(rest.withColumn("prefix", _prefix("h", d)).join(own, "prefix").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes"))
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    if stuck is not None:
        out = out.unionByName(_parts(rows.join(stuck, "h", "left_semi"), limit))
    return out.select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that share all bits, dealt into parts by size and count: alike rows are folded, then written out in chunks."""
    alike = rows.groupBy("h", "doc_id", "n_bytes").count()
    alike = alike.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / COPIES))))
    first = F.col("chunk") * COPIES
    spread = alike.repartition("h", "n_bytes", "chunk").withColumn("i", F.explode(F.sequence(first, F.least(first + COPIES, F.col("count")) - 1)))
    part = F.floor(F.col("i") / _fit(limit))
    held = F.least(_fit(limit), F.col("count") - part * _fit(limit)) * F.col("n_bytes")
    return spread.select("doc_id", "n_bytes", _part_name("h", "n_bytes", part).alias("shard"), F.lit(BITS).cast("bigint").alias("depth"), held.alias("shard_bytes"))


def _fit(limit: int) -> Column:
    """Rows of n_bytes that a part holds."""
    return F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("bigint")


def _part_name(h: str, n_bytes: str, part: Column) -> Column:
    return F.concat(F.lpad(F.bin(h), BITS, "0"), F.lit("."), F.col(n_bytes).cast("string"), F.lit("."), part.cast("string"))


def written(df: DataFrame, path: str, limit: int, id_col: str = "doc_id") -> None:
    """Writes df as Parquet, a folder for each shard (`shard=<bits>`), each row once.

    Ids may repeat or be null. Rows of one id go to its shard; where these alone are over the limit, each row has a number
    among those of its id and size, and the number says which part it goes to. A column named shard is replaced.
    """
    names = [c for c in df.columns if c.lower() != "shard"]
    text = F.col("text") if "text" in df.columns else F.lit("")
    facts = {"i": F.monotonically_increasing_id(), "id": F.col(f"`{id_col}`").cast("bigint"), "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), "h": hashed(id_col)}
    # Stored, so that a row has the same number whenever it is read.
    rows = common.stored(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *[v.alias(k) for k, v in facts.items()]))
    homes = common.stored(sharded(rows.select(F.col("id").alias("doc_id"), "n_bytes"), limit, F.col("n_bytes")).select("doc_id", "shard").distinct())
    whole = homes.where(~F.col("shard").contains("."))
    in_parts = homes.where(F.col("shard").contains(".")).select("doc_id").distinct()
    placed = rows.join(whole, rows["id"].eqNullSafe(whole["doc_id"])).drop("doc_id")
    over = rows.join(in_parts, rows["id"].eqNullSafe(in_parts["doc_id"]), "left_semi").withColumn("task", F.shiftrightunsigned("i", 33))
    # Numbers within a task of the stored table, then each task's offset: no group is gathered whole.
    alike = ["id", "n_bytes"]
    offset = F.sum("n").over(Window.partitionBy(*alike).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = over.groupBy(*alike, "task").agg(F.count("*").alias("n")).select(F.col("id").alias("id_"), F.col("n_bytes").alias("n_"), F.col("task").alias("task_"), F.coalesce(offset, F.lit(0)).alias("before"))
    numbered = over.withColumn("rank", F.row_number().over(Window.partitionBy(*alike, "task").orderBy("i")) - 1)
    numbered = numbered.join(tasks, numbered["id"].eqNullSafe(tasks["id_"]) & (numbered["n_bytes"] == tasks["n_"]) & (numbered["task"] == tasks["task_"]))
    dealt = numbered.withColumn("shard", _part_name("h", "n_bytes", F.floor((F.col("before") + F.col("rank")) / _fit(limit))))
    columns = [*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.concat(F.lit("s"), "shard").alias("shard")]
    both = placed.select(*columns).unionByName(dealt.select(*columns))
    both.repartition("shard").write.partitionBy("shard").parquet(path)


#: Bytes of a shard in the registered query.
SHARD_BYTES = 1 << 20


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(common.table(spark, sf_dir, "documents"), SHARD_BYTES)


#: DuckDB SQL for op10_sharding, for tables with unique ids and no document over the limit.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS bytes FROM d, range(0, 31) g(depth) GROUP BY ALL),
f AS (SELECT d.doc_id, d.n_bytes, d.h, s.depth, s.bytes, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) AS i
      FROM d JOIN s ON s.prefix = d.h >> ({BITS} - s.depth) WHERE s.bytes <= {SHARD_BYTES})
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(bin(h >> ({BITS} - depth) | (1::BIGINT << CAST(depth AS INTEGER))), CAST(depth AS INTEGER)) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, false AS oversize
FROM f WHERE i = 1
"""
