"""Catalog DataFrames: loading them from the tables that database servers describe themselves with, and selecting from them.

Raw tables have a row for each object of each server (columns schema_name, table_name and so on). A fleet is one DataFrame;
nothing here depends on the number of servers but the amount of data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from plumbline.functions import types as T

#: Schemas that belong to the server (fixed values).
SYSTEM_SCHEMAS = ["information_schema", "performance_schema", "mysql", "sys", "test"]
TABLE_KEY = ["schema_name", "table_name"]


def read_catalog(spark: SparkSession, source: str | dict, name: str) -> DataFrame:
    """A raw catalog table from a folder of Parquet files or, given JDBC options, from a server."""
    return spark.read.parquet(f"{source}/{name}.parquet") if isinstance(source, str) else spark.read.format("jdbc").options(**source, dbtable=name).load()


def all_of(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def load_schemata(raw: DataFrame) -> DataFrame:
    return raw.where(~F.lower("schema_name").isin(*SYSTEM_SCHEMAS))


def load_tables(raw: DataFrame) -> DataFrame:
    """Base tables alone; the charset is the collation's part before the first underscore; options become a map."""
    base = raw.where(F.col("table_type") == "BASE TABLE")
    return base.withColumns({"charset": F.substring_index("table_collation", "_", 1), "options": T.options_map(F.coalesce("create_options", F.lit("")))})


def load_columns(raw: DataFrame) -> DataFrame:
    """Definitions from rows with is_nullable, extra, column_default, generation_expression and the like."""
    extra = F.lower(F.coalesce("extra", F.lit("")))
    return raw.select(
        *TABLE_KEY, "column_name", F.col("ordinal_position").cast("int").alias("ordinal"), F.col("column_type"), (F.upper("is_nullable") == "YES").alias("nullable"),
        extra.contains("auto_increment").alias("auto_inc"), extra.contains("invisible").alias("invisible"), extra.contains("virtual generated").alias("is_virtual"),
        F.when(extra.contains("generated"), F.col("generation_expression")).alias("generation_expr"),
        F.when(~extra.contains("generated"), F.col("column_default")).alias("default_expr"),
        F.when(extra.contains("on update"), F.upper(F.regexp_extract("extra", r"(?i)on update (\S+)", 1))).alias("on_update"),
        F.col("character_set_name").alias("charset"), F.col("collation_name").alias("collation"), F.coalesce("column_comment", F.lit("")).alias("comment"), F.col("srs_id").cast("int").alias("srid"),
    )


def definitions(columns: DataFrame) -> DataFrame:
    """columns with every field of a definition: those that are missing are added as unset."""
    unset = {"nullable": "boolean", "auto_inc": "boolean", "default_expr": "string", "on_update": "string", "generation_expr": "string", "is_virtual": "boolean", "comment": "string", "invisible": "boolean", "compression": "string", "check_clause": "string", "srid": "int", "charset": "string", "collation": "string", "show_charset": "boolean", "show_collation": "boolean"}
    return columns.withColumns({c: F.lit(None).cast(k) for c, k in unset.items() if c not in columns.columns})


def load_indexes(parts: DataFrame) -> DataFrame:
    """An index a row, its parts in order. parts: a row each, with index_name, seq, column_name, non_unique, prefix_length, ordinal
    and, where servers have them, expression, descending, index_type, comment, invisible, parser, attributes."""
    given = {"expression": F.lit(""), "descending": F.lit(False), "index_type": F.lit("BTREE"), "comment": F.lit(""), "invisible": F.lit(False), "parser": F.lit(""), "attributes": F.lit("")}
    full = parts.withColumns({c: v for c, v in given.items() if c not in parts.columns})
    part = F.struct("seq", F.coalesce("column_name", F.lit("")).alias("column_name"), "expression", "prefix_length", "descending")
    facts = [F.min(c).alias(c) for c in ("index_type", "comment", "invisible", "ordinal", "parser", "attributes")]
    found = full.groupBy(*TABLE_KEY, "index_name").agg(F.sort_array(F.collect_list(part)).alias("parts"), (~F.bool_or("non_unique")).alias("is_unique"), *facts)
    return found.withColumn("is_primary", F.col("index_name") == "PRIMARY")


def load_foreign_keys(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Constraints joined with their columns in order; the parent schema only where it isn't the child's."""
    key = [*TABLE_KEY, "fk_name"]
    cols = key_columns.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("seq", "column_name", "parent_column"))).alias("_c"))
    named = F.when(F.col("parent_schema") != F.col("schema_name"), F.col("parent_schema"))
    return constraints.join(cols, key).select(*key, F.col("_c.column_name").alias("columns"), named.alias("parent_schema"), "parent_table", F.col("_c.parent_column").alias("parent_columns"), "update_rule", "delete_rule")


def load_checks(raw: DataFrame) -> DataFrame:
    return raw.select(*TABLE_KEY, "check_name", F.col("check_clause").alias("clause"), (F.upper(F.coalesce("enforced", F.lit("YES"))) == "YES").alias("enforced"), F.row_number().over(Window.partitionBy(*TABLE_KEY).orderBy("check_name")).alias("ordinal"))


def load_partitions(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """A partitioned table a row, its partitions in order; their engine is the table's."""
    part = F.struct("ordinal", "partition_name", "bound", F.coalesce("comment", F.lit("")).alias("comment"))
    found = raw.groupBy(*TABLE_KEY).agg(F.sort_array(F.collect_list(part)).alias("partitions"), F.first("method", True).alias("method"), F.first("expression", True).alias("expression"))
    return found.join(tables.select(*TABLE_KEY, "engine"), TABLE_KEY)


def load_routines(raw: DataFrame) -> DataFrame:
    keep = ["schema_name", "routine_name", "routine_type", "params", "returns", "body", "definer", "deterministic", "data_access", "security", "sql_mode", "collation", "comment"]
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in keep])


_MYSQL = {"tinyint": "tinyint(4)", "smallint": "smallint(6)", "int": "int(11)", "bigint": "bigint(20)", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp(6)", "timestamp_ntz": "datetime(6)", "boolean": "tinyint(1)", "binary": "longblob", "string": "longtext"}


def catalog_of(df: DataFrame, name: str, schema_name: str = "dataset") -> DataFrame:
    """The columns catalog of a DataFrame, so that datasets can be compared and linted like tables. Strings become longtext;
    narrowest_type says what would do. Types without a counterpart become json."""

    def kind(t: ST.DataType) -> str:
        text = t.simpleString()
        if text.startswith("decimal"):
            return text
        if isinstance(t, ST.ArrayType) and isinstance(t.elementType, ST.FloatType):
            return "vector(0)"
        return _MYSQL.get(text, "json")

    rows = [(schema_name, name, f.name, i, kind(f.dataType), f.nullable) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean")


def strip_matches(objects: DataFrame, patterns: DataFrame) -> DataFrame:
    """Objects (object_type, object_name) that match no pattern (object_type, pattern: a regular expression). Patterns are a
    policy of a few rows; an empty object_type is any type."""
    p = F.broadcast(patterns.select(F.col("object_type").alias("_type"), F.col("pattern").alias("_p")))
    return objects.join(p, ((F.col("_type") == "") | (F.col("_type") == F.col("object_type"))) & F.expr("object_name rlike _p"), "left_anti")


def select_schemas(schemata: DataFrame, spec: str) -> DataFrame:
    """`*`, `/regular expression/` or a list with commas; system schemas are never selected."""
    user = load_schemata(schemata)
    if spec == "*":
        return user
    if len(spec) > 1 and spec[0] == spec[-1] == "/":
        return user.where(F.col("schema_name").rlike(spec[1:-1]))
    return user.where(F.col("schema_name").isin(*[s.strip() for s in spec.split(",")]))


def targets(instances: DataFrame, schemata: DataFrame) -> DataFrame:
    """Every schema name of a directory on every instance of that directory: an equi join on the directory, which both have."""
    return instances.join(schemata, "directory").select("directory", "instance", "schema_name")


def first_only(found: DataFrame) -> DataFrame:
    """The alphabetically first schema of each directory and instance."""
    return found.groupBy("directory", "instance").agg(F.min("schema_name").alias("schema_name"))


def case_mode_conflicts(instances: DataFrame) -> DataFrame:
    """Directories whose instances disagree on how names are cased; unknown modes (negative) don't count."""
    return instances.where("name_case >= 0").groupBy("directory").agg(F.count_distinct("name_case").alias("modes")).where("modes > 1")


def cased(name: Column, mode: int) -> Column:
    """Object names as a server of that mode stores them: 0 as they are, 1 in lower case (2 compares so, but stores as they are)."""
    return F.lower(name) if mode == 1 else name


def duplicate_definitions(objects: DataFrame, mode: int) -> DataFrame:
    """schema_name, object_type, name, definitions: names that are defined more than once under a mode of name casing."""
    name = F.lower("object_name") if mode in (1, 2) else F.col("object_name")
    return objects.groupBy("schema_name", "object_type", name.alias("name")).agg(F.count("*").alias("definitions"), F.min("object_name").alias("first_name")).where("definitions > 1")


def sync_snapshot(live: DataFrame, stored: DataFrame, key: list[str], only: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """key and action (create, rewrite, remove) that bring a stored snapshot up to date. Both have `definition`, a text or hash."""
    a, b = live.select(*key, F.col("definition").alias("_live")), stored.select(*key, F.col("definition").alias("_stored"))
    both = a.join(b, key, "full_outer")
    if only is not None:
        both = both.join(only.select(*key).distinct(), key, "left_semi")
    if ignore is not None:
        both = both.join(ignore.select(*key).distinct(), key, "left_anti")
    action = F.when(F.col("_stored").isNull(), "create").when(F.col("_live").isNull(), "remove").when(F.col("_live") != F.col("_stored"), "rewrite")
    return both.select(*key, action.alias("action")).where("action is not null")


def sync_count(live: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """action and its number of definitions; nothing is written."""
    return sync_snapshot(live, stored, key).groupBy("action").agg(F.count("*").alias("n"))


def write_snapshot(catalog: DataFrame, path: str) -> None:
    """Writes a catalog snapshot by its column `snapshot`; snapshots that aren't in `catalog` stay as they are."""
    catalog.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def canonicalise(live: DataFrame, stored: DataFrame, keep_partitioning: bool = True) -> DataFrame:
    """Tables as a snapshot stores them: no counter unless the stored one is over 1, partitioning kept or removed."""
    known = stored.select(*TABLE_KEY, F.col("next_auto_inc").alias("_stored"))
    out = live.join(known, TABLE_KEY, "left").withColumn("next_auto_inc", F.when(F.col("_stored") > 1, F.col("next_auto_inc"))).drop("_stored")
    return out if keep_partitioning else strip_partitioning(out)


def strip_partitioning(tables: DataFrame) -> DataFrame:
    return tables.withColumns({c: F.lit("") for c in ("partition_method", "partition_expression") if c in tables.columns})


def schema_membership(live: DataFrame, stored: DataFrame) -> DataFrame:
    """schema_name and change (new, vanished)."""
    a, b = (x.select("schema_name").distinct() for x in (live, stored))
    return a.join(b, "schema_name", "left_anti").withColumn("change", F.lit("new")).unionByName(b.join(a, "schema_name", "left_anti").withColumn("change", F.lit("vanished")))


def server_support(instances: DataFrame, oldest: tuple[int, int], deprecated_below: tuple[int, int], newest: tuple[int, int]) -> DataFrame:
    """instance, status (too old, deprecated, supported, too new) and mismatch with the configured major version."""
    version = F.struct(F.col("major").cast("int").alias("a"), F.col("minor").cast("int").alias("b"))
    at = lambda v: F.struct(F.lit(v[0]).alias("a"), F.lit(v[1]).alias("b"))
    status = F.when(version < at(oldest), "too old").when(version < at(deprecated_below), "deprecated").when(version > at(newest), "too new").otherwise("supported")
    return instances.select("instance", status.alias("status"), (F.col("major") != F.col("wanted_major")).alias("mismatch"))
