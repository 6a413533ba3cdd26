"""Row checks: what a change of a column's definition would do to the rows there are.

A check is a boolean Column that is true for a row that would be lost, altered or rejected. NULL never violates unless a check
says so. Checks of one table are fused: `run_checks` makes one aggregate of all of them, one scan whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.plans import safety

#: Numbers are compared in this type, not as binary floating point.
EXACT = "decimal(38,10)"

_CHECKS: dict[str, Callable[..., Column]] = {}


def check(name: str) -> Callable:
    """Registers a row check: a function of a Column and further arguments that returns a boolean Column."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in _CHECKS:
            raise ValueError(f"a check named {name} is already registered")
        _CHECKS[name] = f
        return f

    return add


def registered() -> dict[str, Callable[..., Column]]:
    return dict(_CHECKS)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Type:
    """A type's parts, from its text."""

    text: str
    base: str
    size: int = 0
    scale: int = 0
    unsigned: bool = False
    values: tuple[str, ...] = ()

    @staticmethod
    def of(text: str) -> Type:
        plain = re.sub(r"'(?:[^']|'')*'", "''", text).lower()
        m = re.match(r"\s*(\w+)(?:\((\d+)(?:,\s*(\d+))?\))?", plain)
        values = tuple(v.replace("''", "'") for v in re.findall(r"'((?:[^']|'')*)'", text)) if m[1] in ("enum", "set") else ()
        return Type(text, m[1], int(m[2] or 0), int(m[3] or 0), " unsigned" in plain, values)

    def range(self) -> tuple[int, int]:
        low, high = T.INTEGERS[self.base]
        return (0, high - low) if self.unsigned else (low, high)


@check("int_fit")
def int_fit(c: Column, type: str) -> Column:
    """Out of an integer type's range, or with a fraction."""
    low, high = Type.of(type).range()
    x = c.try_cast(EXACT)
    return _true(c.isNotNull() & (x.isNull() | (x != F.round(x, 0)) | (x < F.lit(str(low)).cast(EXACT)) | (x > F.lit(str(high)).cast(EXACT))))


@check("decimal_fit")
def decimal_fit(c: Column, type: str) -> Column:
    """More decimals than the scale, more whole digits than precision less scale, or negative where that is forbidden."""
    t = Type.of(type)
    x = c.try_cast(EXACT)
    bad = x.isNull() | (F.round(x, t.scale) != x) | (F.abs(x) >= F.lit(str(10 ** (t.size - t.scale))).cast(EXACT))
    return _true(c.isNotNull() & (bad | (x < 0) if t.unsigned else c.isNotNull() & bad))


@check("scale_loss")
def scale_loss(c: Column, scale: int) -> Column:
    x = c.try_cast(EXACT)
    return _true(F.round(x, scale) != x)


@check("float_exact")
def float_exact(c: Column, precision: int, scale: int) -> Column:
    """A double that isn't itself after a stay in decimal(precision, scale)."""
    return _true(c.isNotNull() & ~F.coalesce(c.cast(EXACT).try_cast(f"decimal({precision},{scale})").cast("double") == c, F.lit(False)))


@check("string_fit")
def string_fit(c: Column, type: str) -> Column:
    """Over the characters of char and varchar, over the bytes of a text type."""
    t = Type.of(type)
    return _true(F.char_length(c) > t.size if t.base in ("char", "varchar") else F.octet_length(c) > F.lit(T.TEXT_BYTES[t.base]))


#: Characters outside a set, by set (fixed values). latin1 is taken as U+0000 to U+00FF.
OUTSIDE = {"ascii": r"[^\x{00}-\x{7F}]", "latin1": r"[^\x{00}-\x{FF}]", "utf8": r"[^\x{00}-\x{FFFF}]", "utf8mb3": r"[^\x{00}-\x{FFFF}]"}


@check("charset_fit")
def charset_fit(c: Column, charset: str) -> Column:
    """With a character that the set lacks. Sets that aren't listed are taken to hold everything."""
    return _true(c.rlike(OUTSIDE[charset])) if charset in OUTSIDE else F.lit(False)


@check("binary_fit")
def binary_fit(c: Column, size: int) -> Column:
    return _true(F.octet_length(c) > size)


@check("binary_padded")
def binary_padded(c: Column, size: int) -> Column:
    """Shorter than a fixed-length binary type, which would pad it with zeros."""
    return _true(F.octet_length(c) < size)


@check("enum_fit")
def enum_fit(c: Column, values: tuple[str, ...]) -> Column:
    return _true(~c.isin(*values))


@check("enum_shift")
def enum_shift(c: Column, old: tuple[str, ...], new: tuple[str, ...]) -> Column:
    """A value whose number in the list changes."""
    at = lambda v: F.array_position(F.array(*map(F.lit, v)), c)
    return _true(at(old) != at(new))


@check("temporal_fit")
def temporal_fit(c: Column, digits: int) -> Column:
    """Changed by cutting it to so many fractional digits of a second."""
    return _true(F.unix_micros(c.cast("timestamp")) % F.lit(10 ** (6 - digits)) != 0)


@check("null_fit")
def null_fit(c: Column) -> Column:
    """NULL (the one check that NULL violates)."""
    return c.isNull()


@check("clause")
def clause(expression: Column) -> Column:
    """A check clause that is FALSE; NULL passes."""
    return _true(~expression)


@check("generated_mismatch")
def generated_mismatch(c: Column, expression: Column) -> Column:
    """A stored generated value other than its expression's."""
    return ~c.eqNullSafe(expression)


@check("ts_range")
def ts_range(c: Column) -> Column:
    """Outside what a 32-bit timestamp holds: 1970-01-01 00:00:01 to 2038-01-19 03:14:07 UTC."""
    s = F.unix_seconds(c.cast("timestamp"))
    return _true((s < 1) | (s > 2147483647))


@check("zero_dates")
def zero_dates(c: Column) -> Column:
    """Dates in text with a zero year, month or day."""
    return _true(c.rlike(r"^(0000-\d\d-\d\d|\d{4}-00-\d\d|\d{4}-\d\d-00)"))


@check("vector_fit")
def vector_fit(c: Column, size: int) -> Column:
    """Arrays of another length, or with a null or NaN item."""
    return _true(c.isNotNull() & ((F.size(c) != size) | F.exists(c, lambda x: x.isNull() | F.isnan(x))))


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check_name, rows_total and rows_affected of each check, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(checks.values())])
    rows = [F.struct(F.lit(n).alias("check_name"), F.col("_total").alias("rows_total"), F.col(f"_{i}").alias("rows_affected")) for i, n in enumerate(checks)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class ColumnChange:
    """A column and its type before and after. Character sets count for text types."""

    column: str
    old: str
    new: str
    charset: str = "utf8mb4"
    new_charset: str | None = None
    old_nullable: bool = True
    new_nullable: bool = True

    def affected(self) -> Column:
        """The row check that fits the new type (and its character set and nullability)."""
        c, t, old = F.col(self.column), Type.of(self.new), Type.of(self.old)
        if t.base in T.INTEGERS:
            out = int_fit(c, self.new)
        elif t.base == "decimal":
            out = decimal_fit(c, self.new)
        elif t.base in ("float", "double") and t.size:
            out = decimal_fit(c, self.new)
        elif t.base in ("char", "varchar") or t.base in T.TEXT_BYTES:
            out = string_fit(c.cast("string"), self.new)
        elif t.base == "enum":
            out = enum_fit(c, t.values)
            if old.base == "enum" and t.values[: len(old.values)] != old.values:
                out = out | enum_shift(c, old.values, t.values)
        elif t.base in ("datetime", "timestamp", "time"):
            out = temporal_fit(c, t.size) | (ts_range(c) if t.base == "timestamp" else F.lit(False))
        elif t.base == "date":
            out = _true(c.cast("timestamp") != F.date_trunc("day", c.cast("timestamp")))
        elif t.base in ("binary", "varbinary"):
            out = binary_fit(c, t.size) | (binary_padded(c, t.size) if t.base == "binary" else F.lit(False))
        elif t.base in T.BLOB_BYTES:
            out = binary_fit(c, T.BLOB_BYTES[t.base])
        elif t.base == "bit":
            out = _true((c < 0) | (c.try_cast(EXACT) >= F.lit(str(2 ** max(1, t.size))).cast(EXACT)))
        elif t.base == "vector":
            out = vector_fit(c, t.size)
        else:
            out = F.lit(False)
        if self.new_charset and self.new_charset != self.charset:
            out = out | charset_fit(c, self.new_charset)
        if self.old_nullable and not self.new_nullable:
            out = out | null_fit(c)
        return out


def change_impact(df: DataFrame, changes: list[ColumnChange], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """clause, unsafe, rows_total, rows_affected and truly_lossy of each change.

    unsafe is what the type rule says; rows_affected counts the rows that would really change or be rejected, and truly_lossy
    is whether there are any. All column changes share one scan. keys: key name -> columns that are to become a primary key;
    there rows_affected counts the groups of rows that share a key, and a key is unsafe by rule. Each key is one aggregate.
    """
    scanned = run_checks(df, {f"modify {x.column}": x.affected() for x in changes}).withColumnRenamed("check_name", "clause")
    rule = [F.when(F.col("clause") == f"modify {x.column}", safety.unsafe_type_change(x.old, x.new, x.charset, x.new_charset or x.charset)) for x in changes]
    out = scanned.withColumn("unsafe", F.coalesce(*rule)) if rule else None
    for name, columns in (keys or {}).items():
        groups = df.groupBy(*columns).agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("rows_total"), F.count_if((F.col("_n") > 1) | _any_null(columns)).alias("rows_affected"))
        part = groups.select(F.lit(f"add key {name}").alias("clause"), F.coalesce("rows_total", F.lit(0)).cast("bigint").alias("rows_total"), "rows_affected", F.lit(True).alias("unsafe"))
        out = part if out is None else out.unionByName(part)
    return out.select("clause", "unsafe", "rows_total", "rows_affected", (F.col("rows_affected") > 0).alias("truly_lossy"))


def _any_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, nulls and never_null of each column, in one scan."""
    return run_checks(df, {c: null_fit(F.col(c)) for c in columns}).select(F.col("check_name").alias("column_name"), F.col("rows_affected").alias("nulls"), (F.col("rows_affected") == 0).alias("never_null"))


def check_violations(df: DataFrame, clauses: dict[str, tuple[str, bool]]) -> DataFrame:
    """check_name, rows_total, rows_affected, enforced and gates of each clause, in one scan.

    clauses: name -> (Spark SQL, whether it is enforced). All are counted, but only an enforced one with violations gates.
    """
    found = run_checks(df, {n: clause(F.expr(e)) for n, (e, _) in clauses.items()})
    enforced = F.col("check_name").isin([n for n, (_, on) in clauses.items() if on])
    return found.withColumn("enforced", enforced).withColumn("gates", F.col("enforced") & (F.col("rows_affected") > 0))


def drop_impact(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """column_name, rows_with_value and distinct_values that dropping a column would lose.

    distinct_values is about right (by HyperLogLog, in one scan without a shuffle of values) unless it is to be exact.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    row = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}__n"), distinct(c).alias(f"{c}__d"))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("rows_with_value"), F.col(f"{c}__d").alias("distinct_values")) for c in columns]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def collation_collisions(df: DataFrame, column: str) -> DataFrame:
    """folded and variants: values that differ now but are equal without case and trailing spaces (an approximation of
    case-insensitive collations), of which a unique key could keep only one."""
    folded = F.lower(F.rtrim(column)).alias("folded")
    distinct = df.where(F.col(column).isNotNull()).groupBy(folded, F.col(column).alias("_v")).agg(F.lit(1))
    return distinct.groupBy("folded").agg(F.count("*").alias("variants")).where("variants > 1")


def id_headroom(df: DataFrame, column: str, types: list[str]) -> DataFrame:
    """type, largest id, limit, share used and whether that is over 80 %, for each candidate type."""
    row = df.agg(F.max(F.col(column).cast(T.BIG)).alias("largest"))
    limit = lambda t: F.lit(str(Type.of(t).range()[1])).cast(T.BIG)
    rows = [F.struct(F.lit(t).alias("type"), F.col("largest"), limit(t).alias("limit_value"), (F.col("largest").cast("double") / limit(t).cast("double")).alias("used"), (F.col("largest").cast("double") / limit(t).cast("double") > 0.8).alias("exhausted")) for t in types]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def next_id(df: DataFrame, column: str, counter: int) -> DataFrame:
    """next_id that the data asks for, the stored counter, and whether the counter lags behind."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("bigint").alias("next_id")).select("next_id", F.lit(counter).cast("bigint").alias("counter"), (F.lit(counter) < F.col("next_id")).alias("lags"))


def violation_sample(df: DataFrame, checks: dict[str, Column], key: list[str], n: int = 3) -> DataFrame:
    """check_name, sample_rank and the key of up to n rows of each failed check, the least keys first."""
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    rows = df.select(*key, failed.alias("_failed")).where(F.size("_failed") > 0).select(*key, F.explode("_failed").alias("check_name"))
    order = Window.partitionBy("check_name").orderBy(*key)
    return rows.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= n)


def prefix_selectivity(df: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """prefix_length, prefixes and full values (distinct): how much of a column's selectivity an index on its start keeps."""
    row = df.agg(F.count_distinct(column).alias("full_values"), *[F.count_distinct(F.substring(column, 1, n)).alias(f"_{n}") for n in lengths])
    rows = [F.struct(F.lit(n).alias("prefix_length"), F.col(f"_{n}").alias("prefixes"), F.col("full_values")) for n in lengths]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def index_cardinality(df: DataFrame, indexes: dict[str, list[str]]) -> DataFrame:
    """index_name and distinct values (rows with a NULL part left out) of each candidate index."""
    row = df.agg(*[F.count_distinct(*[F.col(c) for c in cols]).alias(f"_{i}") for i, cols in enumerate(indexes.values())])
    rows = [F.struct(F.lit(n).alias("index_name"), F.col(f"_{i}").alias("distinct_values")) for i, n in enumerate(indexes)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def candidate_keys(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """key_columns, minimal: sets of at most k columns that are unique and never NULL.

    A HyperLogLog pass over all sets rules most out; only the rest is counted exactly, again in one pass. A set that holds a
    smaller key isn't minimal.
    """
    sets = [list(s) for n in range(1, k + 1) for s in combinations(columns, n)]
    about = [F.approx_count_distinct(F.xxhash64(*s), 0.02).alias(f"_{i}") for i, s in enumerate(sets)]
    seen = df.agg(F.count(F.lit(1)).alias("_n"), *about, *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns]).first()
    likely = [s for i, s in enumerate(sets) if seen[f"_{i}"] >= 0.85 * seen["_n"] and not any(seen[f"_null_{c}"] for c in s)]
    if not likely:
        return df.sparkSession.createDataFrame([], "key_columns string, minimal boolean")
    exact = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(*s).alias(f"_{i}") for i, s in enumerate(likely)]).first()
    keys = [s for i, s in enumerate(likely) if exact[f"_{i}"] == exact["_n"]]
    rows = [(",".join(s), not any(set(o) < set(s) for o in keys)) for s in keys]
    return df.sparkSession.createDataFrame(rows, "key_columns string, minimal boolean")


#: Bytes of an item of an array of numbers.
ITEM_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def row_width(df: DataFrame) -> Column:
    """Bytes of a row: values as text, arrays of numbers by their items, other nested values as JSON; NULL is 0."""
    out = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind.startswith("array<") and kind[6:-1] in ITEM_BYTES:
            width = F.when(c.isNotNull(), F.size(c)) * ITEM_BYTES[kind[6:-1]]
        elif kind.startswith(("array<", "map<", "struct<")):
            width = F.octet_length(F.to_json(c))
        else:
            width = F.octet_length(c.cast("string"))
        out = out + F.coalesce(width, F.lit(0))
    return out


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows and bytes (see row_width; 0 when empty)."""
    parts = []
    for name, df in tables.items():
        width = row_width(df)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("n_bytes")).select(F.lit(name).alias("table_name"), "n_rows", "n_bytes"))
    return _union(parts)


def non_empty(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name of each table with a row; a table is read up to its first row."""
    return _union([df.limit(1).select(F.lit(name).alias("table_name")) for name, df in tables.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
