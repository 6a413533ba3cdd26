"""Cardinalities by mergeable sketches: one row for each shard and set of columns, merged without reading the data again.

A shard's sketch is made in the scan that counts its rows, with one aggregate for all sets: nothing is expanded or shuffled but
sketches. Sketches of shards are stored; when a shard changes only its own are made anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch has 2 ** LG_K registers; its relative error is about 1.04 / sqrt(2 ** LG_K), 0.8 %.
LG_K = 14


def sketched(df: DataFrame, shard: list[str], sets: dict[str, list[str | Column]], lg_k: int = LG_K) -> DataFrame:
    """shard columns, set_name, n_rows (all parts present), nulls (a part is NULL) and sketch of each set of columns or expressions."""
    parts = {n: [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols] for n, cols in sets.items()}
    made = []
    for i, cols in enumerate(parts.values()):
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        made += [F.count_if(whole).alias(f"_n{i}"), F.count_if(~whole).alias(f"_z{i}"), F.hll_sketch_agg(F.when(whole, F.xxhash64(*cols)), F.lit(lg_k)).alias(f"_s{i}")]
    rows = df.groupBy(*shard).agg(*made)
    sets_ = [F.struct(F.lit(n).alias("set_name"), F.col(f"_n{i}").alias("n_rows"), F.col(f"_z{i}").alias("nulls"), F.col(f"_s{i}").alias("sketch")) for i, n in enumerate(parts)]
    return rows.select(*shard, F.explode(F.array(*sets_)).alias("r")).select(*shard, "r.*")


def refreshed(known: DataFrame, made: DataFrame, shard: list[str]) -> DataFrame:
    """Stored sketches with those of the shards in `made` in place of their old ones."""
    return known.join(made.select(*shard).distinct(), shard, "left_anti").unionByName(made)


def cardinalities(sketches: DataFrame, by: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """set_name (and `by`), n_shards, n_rows, nulls, distinct_values and the bounds low and high, which the true number leaves about
    once in 300 times (three standard errors)."""
    error = 3 * 1.04 / (1 << lg_k) ** 0.5
    rows = sketches.groupBy("set_name", *(by or [])).agg(F.count("*").alias("n_shards"), F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
    low, high = F.floor(F.col("distinct_values") * (1 - error)), F.ceil(F.col("distinct_values") * (1 + error))
    return rows.withColumns({"low": low, "high": high})


def selectivities(found: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """set_name, full_set and the share of its distinct values that each prefix tells apart. found: see cardinalities."""
    names = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    full = found.select(F.col("set_name").alias("full_set"), F.col("distinct_values").alias("_full"))
    return found.withColumn("full_set", F.try_element_at(names, F.col("set_name"))).join(full, "full_set").select("set_name", "full_set", (F.col("distinct_values") / F.col("_full")).alias("share"))
