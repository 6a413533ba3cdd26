"""Places of rows in their groups by one distributed sort: no group, however large, passes through one task.

Rows are range-partitioned and sorted by group and order, and stored with a running number. A partition's stretch of a group
is a row of a small table; places follow from the stretches before it. That table has a row for each group and at most one
more for each partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common


def _part() -> Column:
    return F.shiftright("_seq", 33)


@dataclass
class Ranked:
    """rows: the sorted rows, stored, with _seq. stretches: part, the group, first (least _seq), before (rows of the group in
    earlier parts). groups: the group, n (its rows), number (its place among the groups, nulls first), stored."""

    rows: DataFrame
    stretches: DataFrame
    groups: DataFrame
    group: str

    def placed(self, facts: DataFrame) -> DataFrame:
        """The rows with `place` in their group (from 0) and the columns of facts, which has a row for each group."""
        named = facts.withColumnRenamed(self.group, "_facts")
        known = self.stretches.join(named, F.col(self.group).eqNullSafe(F.col("_facts"))).drop("_facts").withColumnRenamed(self.group, "_group")
        known = common.stored(known)
        rows = self.rows.join(known, (_part() == F.col("part")) & F.col(self.group).eqNullSafe(F.col("_group")))
        return rows.withColumn("place", F.col("_seq") - F.col("first") + F.col("before")).drop("_seq", "part", "_group", "first", "before")


def ranked(df: DataFrame, group: str, order: list[str]) -> Ranked:
    """Sorts by the group and `order`, nulls first. Rows that are equal in these are dealt over partitions by where they were
    read, so a row that repeats without end is no partition of its own."""
    by: list[Column] = [F.col(c).asc_nulls_first() for c in (group, *order)]
    rows = common.stored(df.withColumn("_read", F.monotonically_increasing_id()).orderBy(*by, "_read").drop("_read").withColumn("_seq", F.monotonically_increasing_id()))
    parts = common.stored(rows.groupBy(_part().alias("part"), group).agg(F.min("_seq").alias("first"), F.count("*").alias("_n")))
    # At most a row for each partition: small in each group.
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = parts.withColumn("before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # A group's number: those that begin in earlier parts (one row a part), then those before it in the part where it begins.
    groups = parts.groupBy(group).agg(F.sum("_n").alias("n"), F.min("part").alias("_start"))
    starts = groups.groupBy("_start").agg(F.count("*").alias("_groups"))
    starts = starts.select(F.col("_start").alias("_part"), F.coalesce(F.sum("_groups").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    within = F.row_number().over(Window.partitionBy("_start").orderBy(F.col(group).asc_nulls_first())) - 1
    numbered = groups.withColumn("_within", within).join(starts, F.col("_start") == F.col("_part"))
    return Ranked(rows, stretches, common.stored(numbered.select(group, "n", (F.col("_earlier") + F.col("_within")).alias("number"))), group)
