"""Safety of changes by rule (types alone), and the gates that follow from it.

Reason codes rather than sentences: they group and join. The order of the decisions matters, so it is one chain of `when`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.sources.staging import once_a_value

#: Texts that convert without loss to and from types for addresses and identifiers (fixed values).
CONVENIENCE = {
    "inet6": ("binary(16)", "char(39)", "varchar(39)"),
    "inet4": ("binary(4)", "char(15)", "varchar(15)"),
    "uuid": ("binary(16)", "char(32)", "varchar(32)", "char(36)", "varchar(36)"),
}


def unsafe_reason(old: Column, new: Column, old_charset: Column, new_charset: Column, old_collation: Column | None = None, new_collation: Column | None = None, virtual: Column | None = None, in_unique: Column | None = None, old_srid: Column | None = None, new_srid: Column | None = None, inet4_widens: bool = False) -> Column:
    """Why a change of a column is unsafe, NULL if it is safe. old and new are type structs (see types.type_struct).

    Reasons: charset, collation, srid, value list, zero padding, lossy. inet4_widens: whether the server turns inet4 into inet6.
    """
    no, null = F.lit(False), F.lit(None).cast("string")
    safe = F.lit(None).cast("string")
    lossy = lambda c: F.when(F.coalesce(c, no), F.lit("lossy"))
    base_is = lambda *b: old["base"].isin(*b)
    same_family = (old["base"] == new["base"]) | ((old["base"] == "float") & (new["base"] == "double"))
    gains_sign_limit = new["unsigned"] & ~old["unsigned"]
    smaller = (new["size"] < old["size"]) | (new["scale"] < old["scale"])
    extended = F.slice(new["vals"], 1, F.size(old["vals"])) == old["vals"]
    by_float = F.when(gains_sign_limit, F.lit("lossy")).when(new["size"] == 0, safe).when((old["size"] == 0) | smaller, F.lit("lossy"))
    within_base = (
        F.when(base_is("decimal"), lossy(smaller | gains_sign_limit))
        .when(base_is("bit", "time", "timestamp", "datetime"), lossy(new["size"] < old["size"]))
        .when(base_is("enum", "set"), F.when(~F.coalesce(extended, no), F.lit("value list")))
        .otherwise(by_float)
    )
    old_range, new_range = T.int_range(old), T.int_range(new)
    old_bytes, new_bytes = T.string_max_bytes(old, old_charset), T.string_max_bytes(new, new_charset)
    old_binary, new_binary = T.binary_max_bytes(old), T.binary_max_bytes(new)
    convenient = no
    for base, texts in CONVENIENCE.items():
        convenient = convenient | ((old["base"] == base) & F.lower(new["text"]).isin(*texts)) | ((old["base"] != base) & (new["base"] == base) & F.lower(old["text"]).isin(*texts))
    if inet4_widens:
        convenient = convenient | ((old["base"] == "inet4") & (new["base"] == "inet6"))
    padded = ((old["base"] == "binary") & (new["base"] != "vector")) | ((new["base"] == "binary") & (old["base"] != "vector"))
    out = F.when(T.type_equiv(old, new), safe)
    out = out.when(same_family & base_is("decimal", "bit", "time", "timestamp", "datetime", "enum", "set", "float", "double"), within_base)
    out = out.when(T.is_integer(old) & T.is_integer(new), lossy((old_range["low"] < new_range["low"]) | (old_range["high"] > new_range["high"])))
    out = out.when(old_bytes.isNotNull() & new_bytes.isNotNull(), lossy(new_bytes < old_bytes))
    out = out.when(convenient, safe)
    out = out.when(old_binary.isNotNull() & new_binary.isNotNull(), F.when(new_binary < old_binary, F.lit("lossy")).when(padded, F.lit("zero padding")))
    by_type = out.otherwise(F.lit("lossy"))
    first = F.when(F.coalesce(virtual if virtual is not None else no, no), null)
    first = first.when(~T.plain_charset(F.coalesce(old_charset, F.lit(""))).eqNullSafe(T.plain_charset(F.coalesce(new_charset, F.lit("")))), F.lit("charset"))
    if old_collation is not None:
        first = first.when(~T.plain_charset(F.coalesce(old_collation, F.lit(""))).eqNullSafe(T.plain_charset(F.coalesce(new_collation, F.lit("")))) & F.coalesce(in_unique if in_unique is not None else no, no), F.lit("collation"))
    if old_srid is not None:
        first = first.when(~old_srid.eqNullSafe(new_srid), F.lit("srid"))
    return first.otherwise(by_type)


def unsafe_type_change(old: str, new: str, charset: str = "utf8mb4", new_charset: str | None = None) -> Column:
    """Whether changing one type to another is unsafe by rule, for types known beforehand."""
    a, b = T.type_struct(F.lit(old)), T.type_struct(F.lit(new))
    return unsafe_reason(a, b, F.lit(charset), F.lit(new_charset or charset)).isNotNull()


def unsafe_modify(changes: DataFrame) -> DataFrame:
    """changes with unsafe and reason_code. Needs clause, old and new (column definitions) and in_unique.

    Dropped columns are unsafe unless virtual; added and moved ones are safe; modified ones follow the type rules, which are worked
    out once for each pair of definitions: a fleet has millions of changes and few pairs.
    """
    fields = ["column_type", "charset", "collation", "is_virtual", "srid"]
    pair = F.struct("in_unique", *[F.struct(*[F.col(f"{s}.{f}").alias(f) for f in fields]).alias(s) for s in ("old", "new")])
    rows = changes.withColumn("_pair", F.when(F.col("clause") == "modify column", pair))
    of = lambda side, f: F.col(f"_pair.{side}.{f}")
    old, new = (T.type_struct(of(s, "column_type")) for s in ("old", "new"))
    modified = unsafe_reason(old, new, *(of(s, f) for f in ("charset", "collation") for s in ("old", "new")), of("old", "is_virtual"), F.col("_pair.in_unique"), of("old", "srid"), of("new", "srid"))
    rows = once_a_value(rows, "_pair", "_modified", modified)
    code = (
        F.when(F.col("clause") == "drop column", F.when(~F.coalesce(F.col("old.is_virtual"), F.lit(False)), F.lit("column dropped")))
        .when(F.col("clause") == "modify column", F.col("_modified"))
        .otherwise(F.lit(None).cast("string"))
    )
    return rows.withColumn("reason_code", code).drop("_pair", "_modified").withColumn("unsafe", F.col("reason_code").isNotNull())


def unsafe_objects(changes: DataFrame) -> DataFrame:
    """reason_code and unsafe of table, schema, engine, partition and routine changes by their clause.

    Needs clause and n_objects (of a dropped schema), n_dropped (partitions), signature_changed (routines).
    """
    code = (
        F.when(F.col("clause") == "drop table", F.lit("table dropped"))
        .when((F.col("clause") == "drop schema") & (F.col("n_objects") > 0), F.lit("schema with objects dropped"))
        .when(F.col("clause") == "engine", F.lit("engine changed"))
        .when((F.col("clause") == "modify partitions") & (F.col("n_dropped") > 0), F.lit("partitions dropped"))
        .when(F.col("clause") == "drop routine", F.lit("routine dropped"))
        .when((F.col("clause") == "replace routine") & F.col("signature_changed"), F.lit("routine signature changed"))
        .when(F.col("clause") == "replace routine", F.lit("routine replaced"))
        .otherwise(F.lit(None).cast("string"))
    )
    return changes.withColumn("reason_code", code).withColumn("unsafe", F.col("reason_code").isNotNull())


def schema_drops(schemas: DataFrame, tables: DataFrame, routines: DataFrame) -> DataFrame:
    """Differences of schemas (see diff_schemas) with clause and n_objects: the tables and routines that a dropped schema holds."""
    held = tables.select("schema_name").unionByName(routines.select("schema_name")).groupBy("schema_name").agg(F.count("*").alias("n_objects"))
    gone = schemas.where("change = 'drop'").select("schema_name", F.lit("drop schema").alias("clause"))
    return gone.join(held, "schema_name", "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))


def unsafe_reasons(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_unsafe and the sorted reasons of each object with an unsafe change."""
    return changes.where("unsafe").groupBy(*keys).agg(F.count("*").alias("n_unsafe"), F.array_join(F.sort_array(F.collect_set("reason_code")), ",").alias("reasons"))


def safe_below_size(changes: DataFrame, sizes: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """changes with `unsafe` lifted where the table's n_bytes are under the limit (tables without a size count as empty)."""
    joined = changes.join(sizes.select(*keys, "n_bytes"), keys, "left")
    return joined.withColumn("unsafe", F.col("unsafe") & (F.coalesce("n_bytes", F.lit(0)) >= limit)).drop("n_bytes")


def gate(plan: DataFrame, annotations: DataFrame, target: list[str]) -> DataFrame:
    """target, n_changes, n_unsafe, n_errors and skipped: a target with an unsafe change or a lint error is skipped whole."""
    changes = plan.groupBy(*target).agg(F.count("*").alias("n_changes"), F.count_if("unsafe").alias("n_unsafe"))
    errors = annotations.groupBy(*target).agg(F.count_if(F.col("severity") == "error").alias("n_errors"))
    both = changes.join(errors, target, "full_outer")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_changes", "n_unsafe", "n_errors")}
    return both.select(*target, *[v.alias(c) for c, v in counts.items()]).withColumn("skipped", (F.col("n_unsafe") > 0) | (F.col("n_errors") > 0))
