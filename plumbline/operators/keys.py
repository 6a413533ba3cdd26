"""Minimal candidate keys of any width, by a level-wise search of the lattice of column sets.

Most sets are never looked at: a set that holds a key isn't minimal; a set of which some rows agree in all columns can't be a
key, and groups that repeat a value show such rows for many sets at once; and a set whose columns have too few values to tell all
rows apart can't be one either. Single columns are checked in one scan by grouping sets. Wider sets are first checked on the rows
of a slice of the values of one of their columns, where their groups are whole: a group of several rows there rules a set out. Only
sets that this leaves are grouped over all rows, one at a time and by their own columns alone. What reaches the driver are facts
of column sets, never values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sets that one scan checks at most: a scan multiplies its rows by the sets before they are combined.
SETS_A_SCAN = 24
#: One of how many slices of a column's values is looked at first.
SLICES = 64


def _bit(columns: list[str], name: str) -> int:
    return 1 << columns.index(name)


def _mask(columns: list[str], names: tuple[str, ...]) -> int:
    return sum(_bit(columns, n) for n in names)


def _checked(df: DataFrame, columns: list[str], sets: list[tuple[str, ...]]) -> tuple[dict[int, int], list[int]]:
    """Of sets of columns: the groups that each makes; and masks of columns that all rows of a group with several agree in."""
    # The grouped columns are copies: the facts below need the values of all columns, also of those that a set leaves out.
    rows = df.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(columns)], *[F.xxhash64(f"`{c}`").alias(f"_h{i}") for i, c in enumerate(columns)])
    used = sorted({columns.index(c) for s in sets for c in s})
    same = lambda i: F.when(F.min(f"_h{i}") == F.max(f"_h{i}"), F.lit(1 << i)).otherwise(F.lit(0))
    agree: Column = F.lit(0)
    for i in range(len(columns)):
        agree = agree.bitwiseOR(same(i))
    groups = rows.groupingSets([[F.col(f"_g{columns.index(c)}") for c in s] for s in sets], *[F.col(f"_g{i}") for i in used]).agg(F.grouping_id().alias("_set"), F.count("*").alias("_n"), agree.cast("bigint").alias("_agree"))
    found = groups.groupBy("_set", F.when(F.col("_n") > 1, F.col("_agree")).alias("_agree")).agg(F.count("*").alias("_groups")).collect()
    number = {sum(1 << (len(used) - 1 - used.index(i)) for i in used if columns[i] not in s): _mask(columns, s) for s in sets}
    sizes = {number[g]: 0 for g in number}
    for r in found:
        sizes[number[r["_set"]]] += r["_groups"]
    return sizes, [r["_agree"] for r in found if r["_agree"] is not None]


def _largest(masks: set[int]) -> set[int]:
    """Masks that are inside no other one."""
    out: list[int] = []
    for m in sorted(masks, key=lambda m: -m.bit_count()):
        if not any(m & o == m for o in out):
            out.append(m)
    return set(out)


def minimal_keys(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """key_columns (comma-joined, in the order of `columns`) and width of each minimal set of at most k columns that is unique and
    never NULL. An empty table has every column as a key.

    Needs a scan of a slice for each level and column that has the most values in a set, and a scan for each set that is left. Columns with a NULL are in no key. Rows that agree
    in a set are found by values; what else they agree in by 64-bit hashes, where two different values that hash alike could
    hide a key with a chance of about 2**-64 a pair.
    """
    if not 0 < len(columns) < 63:
        raise ValueError("need one to 62 columns")
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    total = first["n"]
    columns = [c for i, c in enumerate(columns) if first[f"_{i}"] == 0]
    keys: list[int] = []
    dead: set[int] = set()
    values: dict[int, int] = {}
    for level in range(1, min(k, len(columns)) + 1):
        todo = []
        for s in combinations(columns, level):
            m = _mask(columns, s)
            if not any(m & o == o for o in keys) and not any(m & o == m for o in dead) and _enough(values, columns, s, total):
                todo.append(s)
        open_ = lambda: [s for s in todo if not any(_mask(columns, s) & o == _mask(columns, s) for o in dead)]
        if level == 1:
            while todo:
                sizes, agree = _checked(df, columns, todo[:SETS_A_SCAN])
                values.update(sizes)
                keys += [m for m, groups in sizes.items() if groups == total]
                dead = _largest(dead | set(agree) | {m for m, groups in sizes.items() if groups < total})
                todo = todo[SETS_A_SCAN:]
            continue
        most = lambda s: max(s, key=lambda c: (values[_bit(columns, c)], c))
        for c in sorted({most(s) for s in todo}):
            some = df.where(F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(SLICES)) == 0)
            sets = [s for s in open_() if most(s) == c]
            while sets:
                dead = _largest(dead | set(_checked(some, columns, sets[:SETS_A_SCAN])[1]))
                left = open_()
                sets = [s for s in sets[SETS_A_SCAN:] if s in left]
        while todo := open_():
            s = todo.pop(0)
            m = _mask(columns, s)
            values[m] = df.groupBy(*[F.col(f"`{c}`") for c in s]).agg(F.count(F.lit(1)).alias("_n")).count()
            if values[m] == total:
                keys.append(m)
            else:
                dead = _largest(dead | {m})
    return _listed(df.sparkSession, columns, keys)


def _enough(values: dict[int, int], columns: list[str], s: tuple[str, ...], total: int) -> bool:
    """Whether the values of a set's columns, or of one less and that column, could tell all rows apart."""
    if len(s) == 1:
        return True
    m = _mask(columns, s)
    for c in s:
        rest, one = values.get(m & ~_bit(columns, c)), values.get(_bit(columns, c))
        if rest is not None and one is not None and rest * one < total:
            return False
    return True


def _listed(spark: SparkSession, columns: list[str], keys: list[int]) -> DataFrame:
    rows = [(",".join(c for c in columns if m & _bit(columns, c)), m.bit_count()) for m in keys]
    return spark.createDataFrame(rows, "key_columns string, width int")
