"""Checks across rows and tables: keys, prefixes of keys and foreign keys.

Rows with a NULL key part are filtered before joins, so they don't pile up in one task. No side is broadcast by hint; Spark does
that below its size threshold, and large sides go by sorted joins that adaptive execution splits where a key is frequent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _duplicates(groups: DataFrame) -> list[Column]:
    return [F.count_if(F.col("_n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows")]


def key_violations(df: DataFrame, columns: list[str], primary: bool = True) -> DataFrame:
    """duplicate_groups, surplus_rows (beyond the first of each) and null_rows of a key.

    In a unique key that isn't primary, rows with a NULL part never collide and never violate (null_rows is 0).
    """
    return key_violations_multi(df, {"key": (columns, primary)}).drop("key_name")


def key_violations_multi(df: DataFrame, keys: dict[str, tuple[list[str], bool]]) -> DataFrame:
    """The same for several keys (name -> columns, primary) in one pass by grouping sets.

    The grouping's id tells the keys apart: a NULL part of a key isn't mistaken for a column that was rolled up.
    """
    columns = sorted({c for cols, _ in keys.values() for c in cols})
    if len(keys) == 1:
        (name, (cols, primary)), = keys.items()
        grouped = df.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_key", F.lit(name))
    else:
        grouped = df.groupingSets([[F.col(c) for c in cols] for cols, _ in keys.values()], *[F.col(c) for c in columns]).agg(F.count("*").alias("_n"), F.grouping_id().alias("_gid"))
        gid = lambda cols: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in cols)
        grouped = grouped.withColumn("_key", F.coalesce(*[F.when(F.col("_gid") == gid(cols), F.lit(name)) for name, (cols, _) in keys.items()]))
    whole = F.coalesce(*[F.when(F.col("_key") == name, _present(cols)) for name, (cols, _) in keys.items()])
    primary = F.coalesce(*[F.when(F.col("_key") == name, F.lit(p)) for name, (_, p) in keys.items()])
    rows = grouped.select("_key", "_n", whole.alias("_whole"), primary.alias("_primary"))
    repeated = F.col("_whole") & (F.col("_n") > 1)
    return rows.groupBy(F.col("_key").alias("key_name")).agg(
        F.count_if(repeated).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"),
        F.coalesce(F.sum(F.when(~F.col("_whole") & F.col("_primary"), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_rows"),
    )


def prefix_key_violations(df: DataFrame, parts: dict[str, int]) -> DataFrame:
    """Violations of a unique key on the first characters of its parts (0: the whole value)."""
    cut = df.select(*[(F.substring(c, 1, n) if n else F.col(c)).alias(c) for c, n in parts.items()])
    return key_violations(cut, list(parts), primary=False)


def fk_orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose key parts are all present and that have no parent."""
    named = parent.select(*[F.col(k).alias(f"_parent_{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_parent_{i}") for i, c in enumerate(columns)])
    return child.where(_present(columns)).join(named, on, "left_anti")


def fk_ambiguous(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Parent keys that occur more than once and have children, with parents, the number of their rows."""
    repeated = parent.where(_present(keys)).groupBy(*keys).agg(F.count("*").alias("parents")).where("parents > 1")
    named = child.select(*[F.col(c).alias(f"_child_{i}") for i, c in enumerate(columns)])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_child_{i}") for i, k in enumerate(keys)])
    return repeated.join(named, on, "left_semi")


def fk_missing_parent(foreign_keys: DataFrame, tables: DataFrame) -> DataFrame:
    """Declared foreign keys whose parent table isn't in the catalog. A null parent schema means the child's own."""
    there = tables.select(F.col("schema_name").alias("_s"), F.col("table_name").alias("_t"))
    return foreign_keys.join(there, (F.coalesce("parent_schema", "schema_name") == F.col("_s")) & (F.col("parent_table") == F.col("_t")), "left_anti")


def fk_delete_impact(child: DataFrame, columns: list[str], gone: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    """delete_rule and child_rows that deleting the parent rows `gone` would cascade to, set to NULL or be blocked by.

    rule: the rule of a child row (a literal, or an expression where children of several tables are together).
    """
    named = gone.select(*[F.col(k).alias(f"_gone_{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_gone_{i}") for i, c in enumerate(columns)])
    hit = child.where(_present(columns)).join(named, on, "left_semi")
    effect = F.when(rule == "CASCADE", "cascade").when(rule == "SET NULL", "set null").otherwise("blocked")
    return hit.groupBy(effect.alias("effect")).agg(F.count("*").alias("child_rows"))
