"""Conforming a DataFrame to a contract: cast, add, drop, reorder and generate columns; quarantine what doesn't fit.

Everything is a projection or a filter of Columns, so it works on streams as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.operators import checks
from plumbline.operators.checks import ColumnChange, Type
from plumbline.operators.partitions import Scheme, route
from plumbline.sources.staging import stored


@dataclass(frozen=True)
class Target:
    """A column of a contract. default and generated are Spark SQL; source: the column it comes from (default: its name)."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    generated: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class Contract:
    """columns in their order and named check clauses in Spark SQL. zero_fill: whether a NOT NULL column that is added without
    a default gets its type's zero value in existing rows (else such rows are rejected). unenforced: names of clauses that
    are declared only and reject no row.
    """

    columns: list[Target]
    clauses: dict[str, str] = field(default_factory=dict)
    zero_fill: bool = True
    unenforced: frozenset[str] = frozenset()


def spark_type(text: str) -> str:
    """Spark type of a contract's type: unsigned integers go to the next wider signed type."""
    t = Type.of(text)
    whole = ["tinyint", "smallint", "mediumint", "int", "bigint"]
    if t.base in whole:
        wide = {"tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "bigint": "bigint"}
        wider = {"tinyint": "smallint", "smallint": "int", "mediumint": "int", "int": "bigint", "bigint": T.BIG}
        return (wider if t.unsigned else wide)[t.base]
    if t.base == "decimal":
        if t.size > 38:
            raise ValueError(f"{text}: over 38 digits")
        return f"decimal({t.size or 10},{t.scale})"
    if t.base in ("float", "double", "date"):
        return t.base
    if t.base == "datetime":
        return "timestamp_ntz"
    if t.base == "timestamp":
        return "timestamp"
    if t.base == "year":
        return "int"
    if t.base == "bit":
        return "bigint"
    if t.base in ("binary", "varbinary") or t.base in T.BLOB_BYTES:
        return "binary"
    if t.base == "vector":
        return "array<float>"
    return "string"


def zero(text: str) -> Column:
    kind = spark_type(text)
    if kind == "string":
        t = Type.of(text)
        return F.lit(t.values[0] if t.values else "")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.lit("1970-01-01").cast(kind)
    if kind == "binary":
        return F.lit("").cast("binary")
    return F.array().cast(kind) if kind.startswith("array") else F.lit(0).cast(kind)


def _value(t: Target, there: list[str], zero_fill: bool) -> Column:
    kind = spark_type(t.type)
    if t.generated is not None:
        return F.expr(t.generated).try_cast(kind)
    source = t.source or t.name
    if source in there:
        value = F.col(source) if kind.startswith("array") else F.col(source).try_cast(kind)
        return F.coalesce(value, F.when(F.col(source).isNull(), F.expr(t.default).try_cast(kind))) if t.default is not None and not t.nullable else value
    if t.default is not None:
        return F.expr(t.default).try_cast(kind)
    return zero(t.type) if not t.nullable and zero_fill else F.lit(None).cast(kind)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """df in the contract's columns, order and types. What can't be cast is NULL: see conform_split for those rows."""
    return df.select(*[_value(t, df.columns, contract.zero_fill).alias(t.name) for t in contract.columns])


def reasons(df: DataFrame, contract: Contract) -> Column:
    """The checks that a row fails, as an array of names: `<column>: type`, `<column>: null`, `check <name>`."""
    kinds = dict(df.dtypes)
    out = []
    for t in contract.columns:
        source = t.source or t.name
        if t.generated is None and source in df.columns:
            bad = ColumnChange(source, t.type, t.type).affected()
            if not spark_type(t.type).startswith("array") and kinds[source] != "binary":
                bad = bad | (F.col(source).isNotNull() & F.col(source).try_cast(spark_type(t.type)).isNull())
            out.append(F.when(bad, F.lit(f"{t.name}: type")))
        if not t.nullable:
            out.append(F.when(_value(t, df.columns, contract.zero_fill).isNull() & (F.col(source).isNull() if source in df.columns else F.lit(True)), F.lit(f"{t.name}: null")))
    out += [F.when(checks.clause(F.expr(e)), F.lit(f"check {n}")) for n, e in contract.clauses.items() if n not in contract.unenforced]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def conform_split(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, conformed; rows that don't, as they were, with their `reasons`)."""
    marked = df.withColumn("reasons", reasons(df, contract))
    return conform(marked.where(F.size("reasons") == 0), contract), marked.where(F.size("reasons") > 0)


def fill_defaults(df: DataFrame, contract: Contract) -> DataFrame:
    """df with the NULLs of NOT NULL columns replaced by their default, or by the zero value if the contract says so."""
    made = {}
    for t in contract.columns:
        if t.name in df.columns and not t.nullable:
            default = F.expr(t.default) if t.default is not None else zero(t.type) if contract.zero_fill else None
            if default is not None:
                made[t.name] = F.coalesce(F.col(t.name), default.try_cast(df.schema[t.name].dataType.simpleString()))
    return df.withColumns(made)


def conform_dry_run(df: DataFrame, contract: Contract) -> DataFrame:
    """rows_total, rows_fit and rows_rejected, and a row for each reason (reason NULL: the totals). Nothing is written."""
    found = df.select(reasons(df, contract).alias("_reasons"))
    marked = found.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "_reasons")).alias("reason"), (F.size("_reasons") > 0).alias("_bad"))
    return marked.groupBy("reason").agg(F.count("*").alias("n_rows"), F.count_if("_bad").alias("n_rejected"))


def write_conformed(df: DataFrame, contract: Contract, path: str, scheme: Scheme | None = None) -> DataFrame:
    """Writes the rows that fit as Parquet, in a folder for each partition of the scheme; returns the others.

    A partition's rows are dealt to all shuffle partitions by a hash of the row, so that one large partition makes no large task
    and a row goes the same way if it is computed again. Files then number partitions times tasks at most; adaptive execution
    joins small tasks.
    """
    fit, rest = conform_split(df, contract)
    if scheme is None:
        fit.write.parquet(path)
    else:
        placed = fit.withColumn("partition_name", route(scheme))
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in fit.columns]), F.lit(n))
        placed.repartition("partition_name", deal).write.partitionBy("partition_name").parquet(path)
    return rest


def fleet_plan(df: DataFrame, shard: str, changes: list[ColumnChange], limit: int = 0) -> DataFrame:
    """shard, clause, unsafe, rows_total, rows_affected, n_bytes and skipped: what the changes would do to each shard.

    All shards are one DataFrame with the shard as a column. A shard is skipped if an unsafe change affects rows in it and its
    table has `limit` bytes or more.
    """
    from plumbline.plans import safety

    row = df.groupBy(shard).agg(F.count("*").alias("rows_total"), F.sum(checks.row_width(df)).cast("bigint").alias("n_bytes"), *[F.count_if(x.affected()).alias(f"_{i}") for i, x in enumerate(changes)])
    unsafe = [safety.unsafe_type_change(x.old, x.new, x.charset, x.new_charset) for x in changes]
    skipped = F.lit(False)
    for i in range(len(changes)):
        skipped = skipped | (unsafe[i] & (F.col(f"_{i}") > 0))
    skipped = skipped & (F.col("n_bytes") >= limit)
    parts = [F.struct(F.lit(f"modify {x.column}").alias("clause"), unsafe[i].alias("unsafe"), F.col(f"_{i}").alias("rows_affected")) for i, x in enumerate(changes)]
    return row.select(shard, "rows_total", "n_bytes", skipped.alias("skipped"), F.explode(F.array(*parts)).alias("r")).select(shard, "r.*", "rows_total", "n_bytes", "skipped")


def shard_fingerprints(df: DataFrame, shard: str) -> DataFrame:
    """shard and fingerprint: the paths, sizes and times of the files that have its rows. Reads the shard's column alone."""
    files = df.select(shard, F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string")).alias("_file")).distinct()
    return files.groupBy(shard).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_file")), ","), 256).alias("fingerprint"))


def resumed_plan(df: DataFrame, shard: str, changes: list[ColumnChange], limit: int = 0, previous: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """As fleet_plan, with fingerprint, signature and scanned, for a table that is read from files.

    previous: a stored result of this function. Shards whose files and changes are as they were there aren't scanned again but
    taken from it; shards that are gone have no rows. errors: shard and n_errors of a lint; a shard with any is skipped too.
    What a scan found is kept apart from this gate, so errors may come and go between runs.
    """
    signature = F.sha2(F.lit(repr((sorted(map(repr, changes)), limit))), 256)
    prints = stored(shard_fingerprints(df, shard).withColumn("signature", signature))
    key = [shard, "fingerprint", "signature"]
    out = [*key, "clause", "unsafe", "rows_total", "rows_affected", "n_bytes", "skipped_by_data"]
    if previous is None:
        todo, old = prints, None
    else:
        known = previous.select(*key).distinct()
        todo, old = stored(prints.join(known, key, "left_anti")), previous.join(prints, key, "left_semi").select(*out)
    # The shards to scan are a stored table of a row each: where they are few, Spark prunes the files of the others by it.
    scanned = fleet_plan(df.join(todo.select(shard), shard, "left_semi"), shard, changes, limit).withColumnRenamed("skipped", "skipped_by_data").join(prints, shard).select(*out)
    both = scanned.withColumn("scanned", F.lit(True))
    if old is not None:
        both = both.unionByName(old.withColumn("scanned", F.lit(False)))
    n_errors = F.lit(0)
    if errors is not None:
        both = both.join(errors.select(shard, "n_errors"), shard, "left")
        n_errors = F.coalesce("n_errors", F.lit(0))
    return both.select(*out, "scanned", n_errors.cast("bigint").alias("n_errors"), (F.col("skipped_by_data") | (n_errors > 0)).alias("skipped"))
