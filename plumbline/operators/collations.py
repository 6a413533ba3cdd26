"""Collations of catalogs as Spark's collated strings: what is equal under a collation, as a group or a join key.

A name tells its rules: ai or as (accents), ci or cs (case), bin, and whether trailing spaces count (those of the 0900
family do, the older ones don't). ICU's root rules stand for the language's own: ß equals ss where accents don't count (and only there), and
letters that a language sorts apart (å in Swedish) aren't told from their base. Values are compared by collation keys, so a
group or a join is a plain shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spark_collation(name: str) -> str:
    """Spark's collation for a catalog's name."""
    parts = name.lower().split("_")
    if name.lower() == "binary":
        return "UTF8_BINARY"
    padded = "" if "0900" in parts else "_RTRIM"
    if parts[-1] == "bin":
        return f"UTF8_BINARY{padded}"
    if "cs" in parts:
        return f"UNICODE{'_AI' if 'ai' in parts else ''}{padded}"
    # Older names say ci alone; accents don't count for them either.
    return f"UNICODE_CI{'' if 'as' in parts else '_AI'}{padded}"


def collated(column: str, collation: str) -> Column:
    return F.collate(F.col(f"`{column}`"), spark_collation(collation))


def collisions(df: DataFrame, column: str, collation: str) -> DataFrame:
    """least, variants and n_rows of values that differ but are equal under a collation: a unique key could keep one of each.

    Values fold to one row before they are compared, so a frequent one costs no more than a rare one. NULL never collides.
    """
    values = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("_v")).agg(F.count("*").alias("_n"))
    groups = values.groupBy(collated("_v", collation).alias("_c")).agg(F.min("_v").alias("least"), F.count("*").alias("variants"), F.sum("_n").alias("n_rows"))
    return groups.where("variants > 1").select("least", "variants", "n_rows")


def key_violations(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """duplicate_groups and surplus_rows of a unique key whose text parts have collations (None: a part without one).

    Rows with a NULL part never violate.
    """
    present = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    exact = present.groupBy(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("_n"))
    parts = [collated(f"_{i}", c).alias(f"_k{i}") if c else F.col(f"_{i}").alias(f"_k{i}") for i, c in enumerate(columns.values())]
    groups = exact.groupBy(*parts).agg(F.sum("_n").alias("_n"))
    return groups.agg(F.count_if(F.col("_n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, collation: str) -> DataFrame:
    """Child rows with a value that no parent has under the collation of the key."""
    known = parent.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_p")).distinct()
    on = collated(column, collation) == collated("_p", collation)
    return child.where(F.col(f"`{column}`").isNotNull()).join(known, on, "left_anti")
