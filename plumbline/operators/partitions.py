"""Partition schemes applied to rows: routing, statistics and the effect of changing a scheme."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An upper bound above every value.
MAXVALUE = object()


@dataclass(frozen=True)
class Scheme:
    """method: RANGE, RANGE COLUMNS, LIST, LIST COLUMNS, HASH or KEY. expressions: Spark SQL, one for each part.

    partitions: name -> bound. For RANGE a tuple of upper bounds (excluded; MAXVALUE for none), in ascending order; for LIST the
    list of tuples that belong to it (None for NULL); for HASH and KEY it is ignored, only the order counts.
    """

    method: str
    expressions: list[str]
    partitions: dict[str, object] = field(default_factory=dict)

    def names(self) -> list[str]:
        return list(self.partitions)


def _below(values: list[Column], bound: tuple) -> Column:
    """Whether a tuple is below a bound, part by part; NULL is lower than everything."""
    out = F.lit(False)
    for v, b in reversed(list(zip(values, bound, strict=True))):
        if b is MAXVALUE:
            out = F.lit(True)
        else:
            out = F.coalesce(v < F.lit(b), F.lit(True)) | (F.coalesce(v == F.lit(b), F.lit(False)) & out)
    return out


def _listed(values: list[Column], partitions: dict) -> Column:
    out = F.lit(None).cast("string")
    for name, members in reversed(list(partitions.items())):
        inside = F.lit(False)
        for member in members:
            same = F.lit(True)
            for v, x in zip(values, member if isinstance(member, tuple) else (member,), strict=True):
                same = same & v.eqNullSafe(F.lit(x))
            inside = inside | same
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


#: Bounds or members from which a scheme is an array that is searched, not an expression of its own size.
MANY = 64


def _found(n: int, reached: Callable[[Column], Column]) -> Column:
    """How many of n sorted items a row has reached, by halving: reached(i) tells it of item i (from 1)."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & reached(F.least(at + step, F.lit(n))), at + step).otherwise(at))


def _constant(values: list) -> Column:
    """A constant array of values of one kind, as one text that is split and cast when the plan is made.

    A literal for each value would take longer to build than the table takes to route.
    """
    kinds = {type(v) for v in values}
    if len(kinds) != 1 or not kinds <= _KINDS.keys():
        return F.array(*map(F.lit, values))
    kind = _KINDS[kinds.pop()]
    if kind == "decimal":
        kind = f"decimal(38,{max(0, *(-v.as_tuple().exponent for v in values))})"
    texts = [str(v) for v in values]
    mark = next(c for c in map(chr, range(1, 0x100)) if c not in _SPECIAL and not any(c in t for t in texts))
    return F.split(F.lit(mark.join(texts)), mark, -1).cast(f"array<{kind}>")


#: Spark's type for values of a kind; others become literals one by one.
_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string", Decimal: "decimal", date: "date", datetime: "timestamp"}
_SPECIAL = set(r"\^$.|?*+()[]{}#-&") | set(map(chr, (9, 10, 11, 12, 13, 32)))


def _searched_range(values: list[Column], bounds: list[tuple], names: list[str]) -> Column:
    parts = []
    for k in range(len(values)):
        filler = next((b[k] for b in bounds if b[k] is not MAXVALUE), 0)
        parts.append((_constant([filler if b[k] is MAXVALUE else b[k] for b in bounds]), _constant([b[k] is MAXVALUE for b in bounds])))

    def reached(i: Column) -> Column:
        """Whether the row isn't below bound i: part by part, NULL lowest."""
        below = F.lit(False)
        for v, (items, highest) in reversed(list(zip(values, parts, strict=True))):
            b = F.element_at(items, i)
            below = F.element_at(highest, i) | F.coalesce(v < b, F.lit(True)) | (F.coalesce(v == b, F.lit(False)) & below)
        return ~below

    return F.try_element_at(_constant(names), _found(len(names), reached) + 1)


def _searched_list(values: list[Column], members: list[tuple[tuple, str]]) -> Column:
    """members: (tuple without None, partition), no tuple twice."""
    members = sorted(members)
    parts = [_constant([m[k] for m, _ in members]) for k in range(len(values))]

    def reached(i: Column) -> Column:
        above = F.lit(True)
        for v, items in reversed(list(zip(values, parts, strict=True))):
            x = F.element_at(items, i)
            above = (v > x) | ((v == x) & above)
        return F.coalesce(above, F.lit(False))

    at = _found(len(members), reached)
    same, there = at > 0, F.greatest(at, F.lit(1))
    for v, items in zip(values, parts, strict=True):
        same = same & (v == F.element_at(items, there))
    return F.when(same, F.element_at(_constant([n for _, n in members]), there))


def route(scheme: Scheme) -> Column:
    """Name of the partition of a row, NULL where there is none. KEY depends on a server's hash and isn't routed.

    RANGE is a balanced tree of comparisons, so a row is compared with about log2(partitions) bounds and no join is needed.
    Schemes of over MANY bounds or members are constant arrays that are searched by halving, which compile at any size.
    """
    values = [F.expr(e) for e in scheme.expressions]
    names = scheme.names()
    null = F.lit(None).cast("string")
    if scheme.method.startswith("RANGE") and len(names) > MANY:
        return _searched_range(values, [b if isinstance(b, tuple) else (b,) for b in scheme.partitions.values()], names)
    if scheme.method.startswith("LIST") and sum(map(len, scheme.partitions.values())) > MANY:
        listed = {m if isinstance(m, tuple) else (m,): name for name, members in reversed(list(scheme.partitions.items())) for m in members}
        some = {m: n for m, n in listed.items() if None in m}
        rest: dict[str, list[tuple]] = {}
        for m, n in some.items():
            rest.setdefault(n, []).append(m)
        whole = _searched_list(values, [(m, n) for m, n in listed.items() if None not in m])
        # Members with a NULL part are told apart one by one.
        return F.coalesce(whole, _listed(values, rest)) if rest else whole
    if scheme.method.startswith("RANGE"):
        bounds = [b if isinstance(b, tuple) else (b,) for b in scheme.partitions.values()]

        def tree(low: int, high: int) -> Column:
            """The first partition of low .. high whose bound is above the row (high: none of them)."""
            if low == high:
                return F.lit(names[low]) if low < len(names) else null
            middle = (low + high) // 2
            return F.when(_below(values, bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

        return tree(0, len(names))
    if scheme.method.startswith("LIST"):
        return _listed(values, scheme.partitions)
    if scheme.method == "HASH":
        at = F.pmod(F.coalesce(values[0].cast("bigint"), F.lit(0)), F.lit(len(names)))
        return F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    return null


def routed(df: DataFrame, scheme: Scheme, name: str = "partition_name") -> DataFrame:
    return df.withColumn(name, route(scheme))


def partition_stats(df: DataFrame, scheme: Scheme) -> DataFrame:
    """partition_name, n_rows, empty and skew (n_rows over the mean of all partitions); unroutable rows have a NULL name."""
    names = scheme.names()
    counts = df.groupBy(route(scheme).alias("partition_name")).agg(F.count("*").alias("n_rows"))
    rows = F.explode(F.array(*map(F.lit, names))).alias("_name")
    listed = df.sparkSession.range(1).select(rows)
    every = counts.join(listed, F.col("partition_name") == F.col("_name"), "full_outer").select(F.coalesce("partition_name", "_name").alias("partition_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    total = every.agg(F.sum(F.when(F.col("partition_name").isNotNull(), F.col("n_rows"))).alias("_total"))
    mean = F.col("_total") / len(names)
    return every.crossJoin(F.broadcast(total)).select("partition_name", "n_rows", (F.col("n_rows") == 0).alias("empty"), F.when(F.col("partition_name").isNotNull() & (mean > 0), F.round(F.col("n_rows") / mean, 6)).alias("skew"))


def repartition_impact(df: DataFrame, old: Scheme, new: Scheme) -> DataFrame:
    """old_partition, new_partition, n_rows, moves and lost (no partition in the new scheme)."""
    pairs = df.groupBy(route(old).alias("old_partition"), route(new).alias("new_partition")).agg(F.count("*").alias("n_rows"))
    return pairs.withColumns({"moves": ~F.col("old_partition").eqNullSafe(F.col("new_partition")), "lost": F.col("new_partition").isNull()})


def drop_partition_impact(df: DataFrame, scheme: Scheme, dropped: list[str]) -> DataFrame:
    """partition_name and n_rows that dropping these partitions would delete."""
    return df.groupBy(route(scheme).alias("partition_name")).agg(F.count("*").alias("n_rows")).where(F.col("partition_name").isin(*dropped))
