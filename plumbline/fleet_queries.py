"""Registered queries over the fleet catalog that is derived from the supplied tables, with their DuckDB SQL.

The desired catalog is side `a`, what the shards have is side `b`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.plans import diff as D
from plumbline.plans import lint as L
from plumbline.plans import safety as U
from plumbline.queries import ORACLES as TABLE_ORACLES
from plumbline.sources import catalog as S
from plumbline.sources import fleet as X
from plumbline.sources.staging import stored

PART_NARROW = TABLE_ORACLES["narrowest_type"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"a query named {name} is already registered")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _with(**parts: str) -> str:
    """The WITH clause of an oracle: each part a statement of the fleet."""
    return "WITH " + ", ".join(f"{n} AS ({X.portable(s)})" for n, s in parts.items())


_COLS = _with(a=X.DESIRED_COLUMNS, b=X.ACTUAL_COLUMNS)
_TABS = _with(a=X.DESIRED_TABLES, b=X.ACTUAL_TABLES)
_KEY = "schema_name, table_name, column_name"


def columns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.derived(spark, d, X.DESIRED_COLUMNS), X.derived(spark, d, X.ACTUAL_COLUMNS)


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.derived(spark, d, X.DESIRED_TABLES), X.derived(spark, d, X.ACTUAL_TABLES)


def indexes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return S.load_indexes(X.derived(spark, d, X.DESIRED_INDEXES)), S.load_indexes(X.derived(spark, d, X.ACTUAL_INDEXES))


def parts(spark: SparkSession, d: str) -> tuple[D.Parts, D.Parts]:
    """What the tables of each side are and have besides columns."""
    keys, checks = ([X.derived(spark, d, s) for s in sides] for sides in ((X.DESIRED_KEYS, X.ACTUAL_KEYS), (X.DESIRED_CHECKS, X.ACTUAL_CHECKS)))
    a, b = (D.Parts(*side) for side in zip(tables(spark, d), indexes(spark, d), keys, checks, strict=True))
    return a, b


# Types

_INTS = "base IN ('tinyint', 'smallint', 'mediumint', 'int', 'bigint')"
_BITS = "CASE base WHEN 'tinyint' THEN 8 WHEN 'smallint' THEN 16 WHEN 'mediumint' THEN 24 WHEN 'int' THEN 32 WHEN 'bigint' THEN 64 END"


@query(
    "fleet_types",
    _with(b=X.ACTUAL_COLUMNS)
    + rf""", t AS (SELECT column_type, charset, count(*) AS n, regexp_extract(column_type, '^[a-z0-9_]+') AS base, coalesce(try_cast(regexp_extract(column_type, '^[a-z0-9_]+\((\d+)', 1) AS INTEGER), 0) AS size,
      coalesce(try_cast(regexp_extract(column_type, ',(\d+)\)', 1) AS INTEGER), 0) AS scale, column_type LIKE '% unsigned' AS unsigned FROM b GROUP BY ALL),
w AS (SELECT *, CASE WHEN charset = 'utf8mb4' THEN 4 ELSE 1 END AS cb, {_BITS} AS bits FROM t)
SELECT column_type, charset, n, base, size, scale, unsigned,
  CASE WHEN {_INTS} THEN CAST(CASE WHEN unsigned THEN 0 ELSE -(CAST(2 AS HUGEINT) ** (bits - 1)) END AS DECIMAL(20,0)) END AS low,
  CASE WHEN {_INTS} THEN CASE WHEN unsigned AND bits = 64 THEN CAST('18446744073709551615' AS DECIMAL(20,0)) WHEN bits = 64 THEN CAST('9223372036854775807' AS DECIMAL(20,0)) WHEN unsigned THEN CAST((1::BIGINT << bits) - 1 AS DECIMAL(20,0)) ELSE CAST((1::BIGINT << (bits - 1)) - 1 AS DECIMAL(20,0)) END END AS high,
  CAST(CASE WHEN base IN ('char', 'varchar') THEN size * cb WHEN base = 'tinytext' THEN 255 WHEN base = 'text' THEN 65535 WHEN base = 'mediumtext' THEN 16777215 WHEN base = 'longtext' THEN 4294967295 END AS BIGINT) AS string_bytes,
  CAST(CASE WHEN base IN ('binary', 'varbinary') THEN size WHEN base = 'vector' THEN size * 4 WHEN base = 'blob' THEN 65535 END AS BIGINT) AS binary_bytes,
  CASE WHEN base = 'enum' THEN array_to_string(regexp_extract_all(column_type, '''([^'']*)''', 1), '/') END AS listed,
  CASE WHEN size > 0 AND ({_INTS} OR base = 'year') AND column_type <> 'tinyint(1)' THEN regexp_replace(column_type, '\(\d+\)', '') ELSE column_type END AS stripped
FROM w""",
)
def fleet_types(spark, d):
    cols = columns(spark, d)[1].groupBy("column_type", "charset").agg(F.count("*").alias("n")).withColumn("t", T.type_struct("column_type"))
    t = F.col("t")
    return cols.select(
        "column_type", "charset", "n", "t.base", "t.size", "t.scale", "t.unsigned", T.int_range(t)["low"].alias("low"), T.int_range(t)["high"].alias("high"),
        T.string_max_bytes(t, F.col("charset")).alias("string_bytes"), T.binary_max_bytes(t).alias("binary_bytes"), F.array_join(t["vals"], "/").alias("listed"), T.strip_width(t).alias("stripped"),
    )


_LISTED = ", ".join(f"('{k}', {v})" for k, v in T.CHARSET_BYTES.items())


@query("charset_sizes", _with(b=X.ACTUAL_COLUMNS) + f", c(charset, max_bytes) AS (VALUES {_LISTED}) SELECT b.charset, max_bytes, CAST(count(*) AS BIGINT) AS n FROM b JOIN c USING (charset) GROUP BY ALL")
def charset_sizes(spark, d):
    cols = columns(spark, d)[1].groupBy("charset").agg(F.count("*").alias("n"))
    return cols.join(F.broadcast(T.charset_dim(spark)), "charset").select("charset", F.col("max_bytes").cast("int").alias("max_bytes"), "n")


@query("default_collations", _with(b=X.ACTUAL_COLUMNS) + " SELECT charset, CASE charset WHEN 'utf8mb4' THEN 'utf8mb4_0900_ai_ci' WHEN 'latin1' THEN 'latin1_swedish_ci' END AS default_collation, count(*) AS n, count(*) FILTER (WHERE b.collation = CASE charset WHEN 'utf8mb4' THEN 'utf8mb4_0900_ai_ci' WHEN 'latin1' THEN 'latin1_swedish_ci' END) AS at_default FROM b WHERE charset IS NOT NULL GROUP BY ALL")
def default_collations(spark, d):
    defaults = spark.createDataFrame([("utf8mb4", "utf8mb4_0900_ai_ci"), ("latin1", "latin1_swedish_ci")], "charset string, default_collation string")
    cols = T.default_collation(columns(spark, d)[1].where("charset is not null"), defaults)
    return cols.groupBy("charset", "default_collation").agg(F.count("*").alias("n"), F.count_if(F.col("collation") == F.col("default_collation")).alias("at_default"))


# Loading and selecting


@query("load_tables", _with(b=X.ACTUAL_TABLES) + " SELECT schema_name, table_name, split_part(table_collation, '_', 1) AS charset, CASE WHEN create_options LIKE '%key_block%' THEN 'COMPRESSED' WHEN create_options LIKE '%DYNAMIC%' THEN 'DYNAMIC' END AS row_format FROM b WHERE table_type = 'BASE TABLE'")
def load_tables(spark, d):
    return S.load_tables(tables(spark, d)[1]).select("schema_name", "table_name", "charset", T.row_format(F.col("options")).alias("row_format"))


_RAW = """
SELECT schema_name, table_name, column_name, ordinal AS ordinal_position, column_type, CASE WHEN nullable THEN 'YES' ELSE 'NO' END AS is_nullable,
 CASE WHEN auto_inc THEN 'auto_increment' WHEN column_type = 'datetime' THEN 'DEFAULT_GENERATED on update CURRENT_TIMESTAMP' WHEN column_type = 'double' THEN 'VIRTUAL GENERATED' WHEN column_type = 'text' THEN 'INVISIBLE' ELSE '' END AS extra,
 default_expr AS column_default, CASE WHEN column_type = 'double' THEN 'a * b' END AS generation_expression, charset AS character_set_name, collation AS collation_name, comment AS column_comment, CAST(NULL AS INTEGER) AS srs_id FROM {b}
"""


@query(
    "load_columns",
    _with(b=X.ACTUAL_COLUMNS)
    + """ SELECT column_type, count(*) AS n, count(*) FILTER (WHERE nullable) AS nullable, count(*) FILTER (WHERE auto_inc) AS auto_inc, CAST(0 AS BIGINT) + count(*) FILTER (WHERE column_type = 'text' AND NOT auto_inc) AS invisible, count(*) FILTER (WHERE column_type = 'double') AS is_virtual,
 max(CASE WHEN column_type = 'double' THEN 'a * b' END) AS generation_expr, max(CASE WHEN column_type = 'datetime' THEN 'CURRENT_TIMESTAMP' END) AS on_update, max(CASE WHEN column_type NOT IN ('double', 'datetime') THEN default_expr END) AS default_expr FROM b GROUP BY column_type""",
)
def load_columns(spark, d):
    raw = spark.sql(_RAW, b=columns(spark, d)[1])
    flags = [F.count_if(c).alias(c) for c in ("nullable", "auto_inc", "invisible", "is_virtual")]
    return S.load_columns(raw).groupBy("column_type").agg(F.count("*").alias("n"), *flags, F.max("generation_expr").alias("generation_expr"), F.max("on_update").alias("on_update"), F.max("default_expr").alias("default_expr"))


@query("load_indexes", _with(b=X.ACTUAL_INDEXES) + " SELECT schema_name, table_name, index_name, string_agg(column_name || ':' || prefix_length, ',' ORDER BY seq) AS parts, NOT bool_or(non_unique) AS is_unique, index_name = 'PRIMARY' AS is_primary FROM b GROUP BY schema_name, table_name, index_name")
def load_indexes(spark, d):
    parts = F.array_join(F.transform("parts", lambda p: F.concat(p["column_name"], F.lit(":"), p["prefix_length"].cast("string"))), ",")
    return indexes(spark, d)[1].select("schema_name", "table_name", "index_name", parts.alias("parts"), "is_unique", "is_primary")


@query("load_foreign_keys", _with(b=X.ACTUAL_KEYS) + " SELECT schema_name, table_name, fk_name, columns || ',' || columns || '_2' AS columns, CASE WHEN fk_name LIKE '%supplier%' THEN 'shared' END AS parent_schema, parent_table, parent_columns || ',' || parent_columns || '_2' AS parent_columns, delete_rule FROM b")
def load_foreign_keys(spark, d):
    keys = X.derived(spark, d, X.ACTUAL_KEYS)
    constraints = keys.select("schema_name", "table_name", "fk_name", F.when(F.col("fk_name").contains("supplier"), "shared").otherwise(F.col("schema_name")).alias("parent_schema"), "parent_table", "update_rule", "delete_rule")
    parts = keys.select("schema_name", "table_name", "fk_name", F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.concat("columns", F.lit("_2")).alias("column_name"), F.concat("parent_columns", F.lit("_2")).alias("parent_column")), F.struct(F.lit(1).alias("seq"), F.col("columns").alias("column_name"), F.col("parent_columns").alias("parent_column")))).alias("p")).select("schema_name", "table_name", "fk_name", "p.*")
    return S.load_foreign_keys(constraints, parts).select("schema_name", "table_name", "fk_name", F.array_join("columns", ",").alias("columns"), "parent_schema", "parent_table", F.array_join("parent_columns", ",").alias("parent_columns"), "delete_rule")


@query("load_checks", _with(b=X.ACTUAL_CHECKS) + " SELECT schema_name, table_name, check_name, clause, enforced, CAST(row_number() OVER (PARTITION BY schema_name, table_name ORDER BY check_name) AS INTEGER) AS ordinal FROM b")
def load_checks(spark, d):
    raw = X.derived(spark, d, X.ACTUAL_CHECKS).select("schema_name", "table_name", "check_name", F.col("clause").alias("check_clause"), F.when(F.col("enforced"), "YES").otherwise("NO").alias("enforced"))
    return S.load_checks(raw)


@query("load_partitions", _with(b=X.ACTUAL_TABLES) + " SELECT schema_name, table_name, 'p0:,p1:,p2:' AS partitions, partition_method AS method, partition_expression AS expression, engine FROM b WHERE partition_method <> ''")
def load_partitions(spark, d):
    t = tables(spark, d)[1]
    raw = t.where("partition_method <> ''").select("schema_name", "table_name", F.col("partition_method").alias("method"), F.col("partition_expression").alias("expression"), F.explode(F.sequence(F.lit(2), F.lit(0), F.lit(-1))).alias("ordinal"))
    raw = raw.withColumns({"partition_name": F.concat(F.lit("p"), F.col("ordinal").cast("string")), "bound": F.lit(""), "comment": F.lit(None).cast("string")})
    listed = F.array_join(F.transform("partitions", lambda p: F.concat(p["partition_name"], F.lit(":"), p["bound"])), ",")
    return S.load_partitions(raw, t).select("schema_name", "table_name", listed.alias("partitions"), "method", "expression", "engine")


@query("load_routines", _with(b=X.ACTUAL_ROUTINES) + " SELECT schema_name, routine_name, routine_type, params, body, definer, security FROM b")
def load_routines(spark, d):
    return S.load_routines(X.derived(spark, d, X.ACTUAL_ROUTINES)).select("schema_name", "routine_name", "routine_type", "params", "body", "definer", "security")


@query("load_schemata", _with(b=X.ACTUAL_TABLES) + " SELECT DISTINCT schema_name FROM b WHERE schema_name SIMILAR TO '1[0-9]*' AND schema_name <> '1'")
def load_schemata(spark, d):
    b = tables(spark, d)[1].select("schema_name").distinct()
    return S.select_schemas(b.unionByName(spark.createDataFrame([("mysql",), ("SYS",)], "schema_name string")), "/^1[0-9]+$/")


@query(
    "contract_of_part",
    "SELECT 'dataset' AS schema_name, 'part' AS table_name, v.*, true AS nullable, f.fits FROM (VALUES ('p_partkey', 1, 'bigint(20)'), ('p_name', 2, 'longtext'), ('p_brand', 3, 'longtext'), ('p_type', 4, 'longtext'), ('p_size', 5, 'int(11)'), ('p_retailprice', 6, 'double')) v(column_name, ordinal, column_type) LEFT JOIN ("
    + PART_NARROW
    + ") f USING (column_name)",
)
def contract_of_part(spark, d):
    """A dataset's own catalog, with the narrowest types that its data would fit."""
    part = spark.read.parquet(f"{d}/part.parquet")
    fits = T.narrowest_type(part, ["p_partkey", "p_size", "p_name", "p_brand", "p_type"]).select("column_name", "fits")
    return S.catalog_of(part, "part").join(fits, "column_name", "left")


@query("strip_matches", _with(b=X.ACTUAL_TABLES) + " SELECT schema_name, 'table' AS object_type, table_name AS object_name FROM b WHERE NOT regexp_matches(table_name, '^tmp_') AND NOT regexp_matches(table_name, 's$')")
def strip_matches(spark, d):
    objects = tables(spark, d)[1].select("schema_name", F.lit("table").alias("object_type"), F.col("table_name").alias("object_name"))
    return S.strip_matches(objects, spark.createDataFrame([("table", "^tmp_"), ("", "s$"), ("routine", "^r")], "object_type string, pattern string"))


def _instances(spark, d):
    found = X.derived(spark, d, X.INSTANCES)
    names = tables(spark, d)[1].select("schema_name").distinct().select(F.concat(F.lit("dir"), F.pmod(F.col("schema_name").cast("int"), F.lit(5)).cast("string")).alias("directory"), "schema_name")
    return found, names


_INST = _with(i=X.INSTANCES, b=X.ACTUAL_TABLES) + ", s AS (SELECT DISTINCT 'dir' || (CAST(schema_name AS INTEGER) % 5) AS directory, schema_name FROM b), t AS (SELECT i.directory, instance, schema_name FROM i JOIN s ON i.directory = s.directory)"


@query("targets", _INST + " SELECT * FROM t")
def targets(spark, d):
    return S.targets(*_instances(spark, d))


@query("first_only", _INST + " SELECT directory, instance, min(schema_name) AS schema_name FROM t GROUP BY ALL")
def first_only(spark, d):
    return S.first_only(S.targets(*_instances(spark, d)))


@query("case_mode_conflicts", _INST + " SELECT directory, count(DISTINCT name_case) AS modes FROM i WHERE name_case >= 0 GROUP BY 1 HAVING count(DISTINCT name_case) > 1")
def case_mode_conflicts(spark, d):
    return S.case_mode_conflicts(_instances(spark, d)[0])


@query("server_support", _INST + " SELECT instance, CASE WHEN (major, minor) < (5, 2) THEN 'too old' WHEN (major, minor) < (8, 0) THEN 'deprecated' WHEN (major, minor) > (10, 1) THEN 'too new' ELSE 'supported' END AS status, major <> wanted_major AS mismatch FROM i")
def server_support(spark, d):
    return S.server_support(_instances(spark, d)[0], (5, 2), (8, 0), (10, 1))


@query("duplicate_names", _with(b=X.ACTUAL_TABLES) + " SELECT schema_name, 'table' AS object_type, lower(table_name) AS name, count(*) AS definitions, min(table_name) AS first_name FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_names(spark, d):
    objects = tables(spark, d)[1].select("schema_name", F.lit("table").alias("object_type"), F.col("table_name").alias("object_name"))
    return S.duplicate_definitions(objects, 1)


_SYNC = _TABS + ", l AS (SELECT schema_name, table_name, engine || create_options AS x FROM b), s AS (SELECT schema_name, table_name, engine || create_options AS x FROM a), j AS (SELECT coalesce(l.schema_name, s.schema_name) AS schema_name, coalesce(l.table_name, s.table_name) AS table_name, CASE WHEN s.x IS NULL THEN 'create' WHEN l.x IS NULL THEN 'remove' WHEN l.x <> s.x THEN 'rewrite' END AS action FROM l FULL JOIN s ON l.schema_name = s.schema_name AND l.table_name = s.table_name)"


def _defined(df: DataFrame) -> DataFrame:
    return df.select("schema_name", "table_name", F.concat("engine", "create_options").alias("definition"))


@query("sync_snapshot", _SYNC + " SELECT * FROM j WHERE action IS NOT NULL AND table_name <> 'labels'")
def sync_snapshot(spark, d):
    a, b = tables(spark, d)
    return S.sync_snapshot(_defined(b), _defined(a), S.TABLE_KEY, ignore=a.where("table_name = 'labels'"))


@query("sync_count", _SYNC + " SELECT action, count(*) AS n FROM j WHERE action IS NOT NULL GROUP BY action")
def sync_count(spark, d):
    a, b = tables(spark, d)
    return S.sync_count(_defined(b), _defined(a), S.TABLE_KEY)


@query("canonicalise", _TABS + " SELECT b.schema_name, b.table_name, CASE WHEN a.next_auto_inc > 1 THEN b.next_auto_inc END AS next_auto_inc, '' AS partition_method FROM b LEFT JOIN (SELECT schema_name, table_name, next_auto_inc + CAST(schema_name AS BIGINT) % 2 AS next_auto_inc FROM a) a USING (schema_name, table_name)")
def canonicalise(spark, d):
    a, b = tables(spark, d)
    kept = a.withColumn("next_auto_inc", F.col("next_auto_inc") + F.pmod(F.col("schema_name").cast("bigint"), F.lit(2)))
    return S.canonicalise(b, kept, keep_partitioning=False).select("schema_name", "table_name", "next_auto_inc", "partition_method")


@query("new_schemas", _TABS + " SELECT schema_name, 'new' AS change FROM (SELECT DISTINCT schema_name FROM b WHERE CAST(schema_name AS INTEGER) % 3 <> 0) x ANTI JOIN (SELECT DISTINCT schema_name FROM a WHERE CAST(schema_name AS INTEGER) % 4 <> 0) y USING (schema_name) UNION ALL SELECT schema_name, 'vanished' FROM (SELECT DISTINCT schema_name FROM a WHERE CAST(schema_name AS INTEGER) % 4 <> 0) x ANTI JOIN (SELECT DISTINCT schema_name FROM b WHERE CAST(schema_name AS INTEGER) % 3 <> 0) y USING (schema_name)")
def new_schemas(spark, d):
    a, b = tables(spark, d)
    return S.schema_membership(b.where("cast(schema_name as int) % 3 <> 0"), a.where("cast(schema_name as int) % 4 <> 0"))


# Differences


@query("fleet_schema_diff", _TABS + ", x AS (SELECT schema_name, min(table_collation) AS c FROM a WHERE CAST(schema_name AS INTEGER) % 10 <> 1 GROUP BY 1), y AS (SELECT schema_name, min(table_collation) AS c FROM b WHERE CAST(schema_name AS INTEGER) % 10 <> 2 GROUP BY 1) SELECT coalesce(x.schema_name, y.schema_name) AS schema_name, CASE WHEN x.c IS NULL THEN 'create' WHEN y.c IS NULL THEN 'drop' ELSE 'alter' END AS change FROM x FULL JOIN y ON x.schema_name = y.schema_name WHERE x.c IS DISTINCT FROM y.c")
def fleet_schema_diff(spark, d):
    made = [t.where(f"cast(schema_name as int) % 10 <> {i}").groupBy("schema_name").agg(F.min("table_collation").alias("collation")).withColumn("charset", F.substring_index("collation", "_", 1)) for i, t in enumerate(tables(spark, d), 1)]
    return D.diff_schemas(*made)


@query("fleet_table_diff", _TABS + " SELECT coalesce(a.schema_name, b.schema_name) AS schema_name, coalesce(a.table_name, b.table_name) AS table_name, CASE WHEN a.table_name IS NULL THEN 'create' ELSE 'drop' END AS change FROM a FULL JOIN b ON a.schema_name = b.schema_name AND a.table_name = b.table_name WHERE a.table_name IS NULL OR b.table_name IS NULL")
def fleet_table_diff(spark, d):
    return D.diff_tables(*tables(spark, d)).where("change <> 'both'")


#: A table is compared if both sides have it; its missing columns are dropped, its new ones added.
_BOTH = ", t AS (SELECT DISTINCT schema_name, table_name FROM b)"


@query("fleet_column_drops", _COLS + _BOTH + f" SELECT {_KEY} FROM a SEMI JOIN t USING (schema_name, table_name) ANTI JOIN b USING ({_KEY})")
def fleet_column_drops(spark, d):
    a, b = columns(spark, d)
    return D.column_drops(a, b).select(*D.COLUMN_KEY)


@query(
    "fleet_column_adds",
    _COLS
    + f""", m AS (SELECT b.*, a.column_name IS NOT NULL AS there FROM b LEFT JOIN a ON a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.column_name = b.column_name),
w AS (SELECT *, max(ordinal) FILTER (WHERE there) OVER (PARTITION BY schema_name, table_name) AS last, lag(column_name) OVER (PARTITION BY schema_name, table_name ORDER BY ordinal) AS before FROM m)
SELECT {_KEY}, coalesce(ordinal < last AND before IS NULL, false) AS first, CASE WHEN ordinal < last THEN before END AS after FROM w WHERE NOT there""",
)
def fleet_column_adds(spark, d):
    a, b = columns(spark, d)
    return D.column_adds(a, b).select(*D.COLUMN_KEY, "first", "after")


_PLAIN = "regexp_replace({}, '^utf8mb3', 'utf8')"
_DIFFERS = "(a.column_type <> b.column_type OR a.nullable <> b.nullable OR a.charset IS DISTINCT FROM b.charset OR a.collation IS DISTINCT FROM b.collation OR a.comment <> b.comment)"
_COSMETIC_BUT_COMMENT = "((a.column_type = b.column_type OR (a.column_type, b.column_type) IN (('int', 'int(11)'), ('year', 'year(4)'))) AND a.nullable = b.nullable AND a.charset IS NOT DISTINCT FROM b.charset AND a.collation IS NOT DISTINCT FROM b.collation)"
_COSMETIC = f"({_COSMETIC_BUT_COMMENT} AND a.comment = b.comment)"


@query("fleet_column_diff", _COLS + f" SELECT {_KEY}, a.column_type AS old_type, b.column_type AS new_type, {_COSMETIC} AS cosmetic FROM a JOIN b USING ({_KEY}) WHERE {_DIFFERS}")
def fleet_column_diff(spark, d):
    a, b = columns(spark, d)
    return D.column_mods(a, b).select(*D.COLUMN_KEY, F.col("old.column_type").alias("old_type"), F.col("new.column_type").alias("new_type"), "cosmetic")


@query(
    "fleet_supported",
    _with(a=X.DESIRED_COLUMNS, b=X.ACTUAL_COLUMNS, w=X.ACTUAL_TABLES)
    + f" SELECT b.schema_name, b.table_name, b.column_name, w.partition_method = '' AS supported FROM a JOIN b USING ({_KEY}) JOIN w ON w.schema_name = b.schema_name AND w.table_name = b.table_name WHERE {_DIFFERS}",
)
def fleet_supported(spark, d):
    a, b = columns(spark, d)
    changes = D.column_mods(a, b).select(*D.COLUMN_KEY, F.lit(True).alias("supported"))
    return D.mark_supported(changes, tables(spark, d)[1].withColumn("unsupported", F.col("partition_method") != ""))


@query("fleet_moves")
def fleet_moves(spark, d):
    a, b = columns(spark, d)
    return D.column_moves(a, b).select(*D.COLUMN_KEY, "first", "after")


@query(
    "fleet_move_counts",
    _COLS
    + f""", r AS (SELECT schema_name, table_name, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY a.ordinal) AS x, b.ordinal > 1000 AS late FROM a JOIN b USING ({_KEY})),
/* A shard's order is two rising runs, columns in place and columns at the end: what stays is the first run up to a column and
   the second run from there. */
k AS (SELECT r.schema_name, r.table_name, v.x AS v, count(*) FILTER (WHERE CASE WHEN r.late THEN r.x > v.x ELSE r.x <= v.x END) AS stay, count(*) AS n
  FROM r JOIN (SELECT schema_name, table_name, x FROM r UNION ALL SELECT DISTINCT schema_name, table_name, 0 FROM r) v ON r.schema_name = v.schema_name AND r.table_name = v.table_name GROUP BY 1, 2, 3)
SELECT schema_name, table_name, max(n) - max(stay) AS n_moved FROM k GROUP BY 1, 2 HAVING max(n) > max(stay)""",
)
def fleet_move_counts(spark, d):
    a, b = columns(spark, d)
    return D.column_moves(a, b).groupBy("schema_name", "table_name").agg(F.count("*").alias("n_moved"))


@query("fleet_moved_tables", _COLS + f", r AS (SELECT schema_name, table_name, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY a.ordinal) AS x, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY b.ordinal) AS y FROM a JOIN b USING ({_KEY})) SELECT DISTINCT schema_name, table_name FROM r WHERE x <> y")
def fleet_moved_tables(spark, d):
    return D.moved_tables(*columns(spark, d))


@query("fleet_verify", "SELECT CAST(0 AS BIGINT) AS left_over")
def fleet_verify(spark, d):
    """Whole tables are verified: their columns, then what they are and have besides."""
    a, b = columns(spark, d)
    left = D.verify(a, b, D.column_changes(a, b), X.partitions(spark, d)).select(*S.TABLE_KEY)
    x, y = parts(spark, d)
    rest = D.verify_tables(x, y, D.table_changes(x, y), X.partitions(spark, d)).select(*S.TABLE_KEY)
    return left.unionByName(rest).agg(F.count("*").alias("left_over"))


_SAFE = "('r_regionkey', 'n_nationkey', 'n_name', 'c_acctbal', 's_name', 'p_name', 'p_type', 'o_orderstatus', 'o_orderdate', 'l_linenumber', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linestatus', 'l_shipdate', 'event_type', 'props', 'lang', 'n_chars', 'label', 'html', 'item_id', 'quality', 'toxic', 'turn')"
#: What the type rules say of each drifted column, written down by hand.
_REASON = f"CASE WHEN a.charset IS DISTINCT FROM b.charset THEN 'charset' WHEN a.column_type = b.column_type OR column_name IN {_SAFE} THEN NULL WHEN column_name = 'l_returnflag' THEN 'value list' ELSE 'lossy' END"
_UNSAFE = _COLS + _BOTH + f""", u AS (
SELECT {_KEY}, 'modify column' AS clause, {_REASON} AS reason_code FROM a JOIN b USING ({_KEY}) WHERE {_DIFFERS}
UNION ALL SELECT {_KEY}, 'drop column', 'column dropped' FROM a SEMI JOIN t USING (schema_name, table_name) ANTI JOIN b USING ({_KEY})
UNION ALL SELECT {_KEY}, 'add column', NULL FROM b ANTI JOIN a USING ({_KEY}))"""


def _changes(spark, d, cols=None):
    """Changes of columns with their safety. Whether a column is in a unique constraint matters where its collation changes: indexes
    of such tables alone are put together, found within their shards."""
    changes = D.column_changes(*(cols or columns(spark, d)))
    asked = (F.col("clause") == "modify column") & ~F.col("old.collation").eqNullSafe(F.col("new.collation"))
    near = changes.where(asked).select(*S.TABLE_KEY).repartition(X.partitions(spark, d), "schema_name").groupBy("schema_name").agg(F.collect_set("table_name").alias("_tables"))
    parts = [X.derived(spark, d, s).join(near.hint("shuffle_hash"), "schema_name").where(F.array_contains("_tables", F.col("table_name"))).drop("_tables") for s in (X.DESIRED_INDEXES, X.ACTUAL_INDEXES)]
    unique = stored(D.in_unique_constraint(*map(S.load_indexes, parts)))
    marked = D.marked_unique(changes.where(asked).drop("in_unique"), unique)
    return U.unsafe_modify(changes.where(~asked).unionByName(marked))


@query("fleet_unsafe", _UNSAFE + " SELECT schema_name, table_name, column_name AS member, clause, reason_code, reason_code IS NOT NULL AS unsafe FROM u")
def fleet_unsafe(spark, d):
    return _changes(spark, d).where("clause <> 'move column'").select("schema_name", "table_name", "member", "clause", "reason_code", "unsafe")


@query("fleet_unsafe_reasons", _UNSAFE + " SELECT schema_name, table_name, count(*) AS n_unsafe, string_agg(DISTINCT reason_code, ',' ORDER BY reason_code) AS reasons FROM u WHERE reason_code IS NOT NULL GROUP BY schema_name, table_name")
def fleet_unsafe_reasons(spark, d):
    return U.unsafe_reasons(_changes(spark, d), S.TABLE_KEY)


@query("fleet_safe_below_size", _UNSAFE + " SELECT clause, CAST(schema_name AS BIGINT) % 10 < 6 AS small, count(*) AS n, count(*) FILTER (WHERE reason_code IS NOT NULL AND CAST(schema_name AS BIGINT) % 10 >= 6) AS n_unsafe FROM u GROUP BY ALL")
def fleet_safe_below_size(spark, d):
    changes = _changes(spark, d).where("clause <> 'move column'")
    sizes = tables(spark, d)[1].select("schema_name", "table_name", (F.pmod(F.col("schema_name").cast("bigint"), F.lit(10)) * 1000).alias("n_bytes"))
    lifted = U.safe_below_size(changes, sizes, 6000, S.TABLE_KEY)
    return lifted.groupBy("clause", (F.pmod(F.col("schema_name").cast("bigint"), F.lit(10)) < 6).alias("small")).agg(F.count("*").alias("n"), F.count_if("unsafe").alias("n_unsafe"))


@query("fleet_changed_keys", _COLS + _BOTH + f", k AS (SELECT schema_name, table_name FROM a JOIN b USING ({_KEY}) WHERE {_DIFFERS} AND NOT {_COSMETIC} UNION SELECT schema_name, table_name FROM (SELECT {_KEY} FROM a SEMI JOIN t USING (schema_name, table_name) ANTI JOIN b USING ({_KEY})) UNION SELECT schema_name, table_name FROM (SELECT {_KEY} FROM b ANTI JOIN a USING ({_KEY}))) SELECT schema_name, table_name FROM k UNION SELECT schema_name, table_name FROM (SELECT schema_name, table_name, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY a.ordinal) AS x, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY b.ordinal) AS y FROM a JOIN b USING ({_KEY})) WHERE x <> y")
def fleet_changed_keys(spark, d):
    return D.changed_keys(D.column_changes(*columns(spark, d)))


@query("fleet_differing_instances", ORACLES["fleet_changed_keys"].replace(" SELECT schema_name, table_name FROM k UNION SELECT schema_name, table_name FROM (", " SELECT schema_name FROM k UNION SELECT schema_name FROM ("))
def fleet_differing_instances(spark, d):
    return D.differing_instances(D.column_changes(*columns(spark, d)))


@query("fleet_summary", _UNSAFE + " SELECT schema_name, count(*) AS n_changes, count(*) FILTER (WHERE reason_code IS NOT NULL) AS n_unsafe, CAST(0 AS BIGINT) AS n_unsupported FROM u GROUP BY ROLLUP (schema_name)")
def fleet_summary(spark, d):
    return D.summarise(_changes(spark, d).where("clause <> 'move column'")).select("schema_name", "n_changes", "n_unsafe", "n_unsupported")


@query("fleet_modifiers", _COLS + f" SELECT CASE WHEN a.comment <> b.comment THEN 'comment too' ELSE 'other' END AS kind, count(*) AS n FROM a JOIN b USING ({_KEY}) WHERE {_DIFFERS} AND NOT {_COSMETIC_BUT_COMMENT} GROUP BY 1")
def fleet_modifiers(spark, d):
    left = D.apply_modifiers(D.column_changes(*columns(spark, d)), D.Modifiers(lax_column_order=True, lax_comments=True)).where("clause = 'modify column'")
    return left.groupBy(F.when(F.col("old.comment") != F.col("new.comment"), "comment too").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


_IX = _with(pa=X.DESIRED_INDEXES, pb=X.ACTUAL_INDEXES) + """,
a AS (SELECT schema_name, table_name, index_name, min(ordinal) AS ord, string_agg(column_name || ':' || prefix_length, ',' ORDER BY seq) || bool_or(non_unique) AS sig FROM pa GROUP BY 1, 2, 3),
b AS (SELECT schema_name, table_name, index_name, min(ordinal) AS ord, string_agg(column_name || ':' || prefix_length, ',' ORDER BY seq) || bool_or(non_unique) AS sig FROM pb GROUP BY 1, 2, 3)"""


@query("fleet_pk_diff", _IX + ", j AS (SELECT coalesce(a.schema_name, b.schema_name) AS schema_name, coalesce(a.table_name, b.table_name) AS table_name, a.sig AS x, b.sig AS y FROM (SELECT * FROM a WHERE index_name = 'PRIMARY') a FULL JOIN (SELECT * FROM b WHERE index_name = 'PRIMARY') b ON a.schema_name = b.schema_name AND a.table_name = b.table_name) SELECT schema_name, table_name, 'drop primary key' AS clause FROM j WHERE x IS NOT NULL AND x IS DISTINCT FROM y UNION ALL SELECT schema_name, table_name, 'add primary key' FROM j WHERE y IS NOT NULL AND x IS DISTINCT FROM y")
def fleet_pk_diff(spark, d):
    return D.diff_pk(*indexes(spark, d))


@query(
    "fleet_index_diff",
    _IX
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name, sig ORDER BY ord, index_name) AS r FROM a ANTI JOIN b USING (schema_name, table_name, index_name) WHERE index_name <> 'PRIMARY'),
n AS (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name, sig ORDER BY ord, index_name) AS r FROM b ANTI JOIN a USING (schema_name, table_name, index_name) WHERE index_name <> 'PRIMARY')
SELECT coalesce(g.schema_name, n.schema_name) AS schema_name, coalesce(g.table_name, n.table_name) AS table_name, CASE WHEN n.sig IS NULL THEN 'drop index' WHEN g.sig IS NULL THEN 'add index' ELSE 'rename index' END AS clause,
       coalesce(g.index_name, n.index_name) AS member, CASE WHEN g.sig IS NOT NULL THEN n.index_name END AS new_member
FROM g FULL JOIN n ON g.schema_name = n.schema_name AND g.table_name = n.table_name AND g.sig = n.sig AND g.r = n.r
UNION ALL SELECT schema_name, table_name, 'modify index', index_name, NULL FROM a JOIN b USING (schema_name, table_name, index_name) WHERE index_name <> 'PRIMARY' AND a.sig <> b.sig""",
)
def fleet_index_diff(spark, d):
    return D.diff_indexes(*indexes(spark, d))


@query("fleet_index_columns", _IX + " SELECT schema_name, table_name, column_name, string_agg(index_name, ',' ORDER BY index_name) AS indexes FROM (SELECT DISTINCT schema_name, table_name, column_name, index_name FROM pb) GROUP BY 1, 2, 3")
def fleet_index_columns(spark, d):
    return D.indexes_with_column(indexes(spark, d)[1]).groupBy(*D.COLUMN_KEY).agg(F.array_join(F.sort_array(F.collect_set("index_name")), ",").alias("indexes"))


@query("fleet_clustered_key", _with(p=X.ACTUAL_INDEXES, c=X.ACTUAL_COLUMNS) + ", g AS (SELECT p.schema_name, p.table_name, index_name, min(p.ordinal) AS o, bool_and(coalesce(NOT c.nullable, false)) AS ok FROM p LEFT JOIN c ON p.schema_name = c.schema_name AND p.table_name = c.table_name AND p.column_name = c.column_name WHERE NOT non_unique GROUP BY 1, 2, 3) SELECT schema_name, table_name, arg_min(index_name, (CASE WHEN index_name = 'PRIMARY' THEN 0 ELSE 1000 END) + o) AS index_name FROM g WHERE ok OR index_name = 'PRIMARY' GROUP BY 1, 2")
def fleet_clustered_key(spark, d):
    return D.clustered_key(indexes(spark, d)[1], columns(spark, d)[1])


@query("fleet_table_flags", _with(c=X.ACTUAL_COLUMNS) + " SELECT schema_name, table_name, false AS has_virtual, bool_or(auto_inc) AS has_auto_inc, false AS has_fulltext FROM c GROUP BY 1, 2")
def fleet_table_flags(spark, d):
    return D.table_flags(columns(spark, d)[1], indexes(spark, d)[1])


_FK = _with(a=X.DESIRED_KEYS, b=X.ACTUAL_KEYS) + """,
x AS (SELECT *, columns || parent_table || parent_columns AS m, CASE WHEN delete_rule IN ('RESTRICT', 'NO ACTION') THEN '' ELSE delete_rule END AS dr FROM a), y AS (SELECT *, columns || parent_table || parent_columns AS m, CASE WHEN delete_rule IN ('RESTRICT', 'NO ACTION') THEN '' ELSE delete_rule END AS dr FROM b)"""


@query(
    "fleet_fk_diff",
    _FK
    + """ SELECT schema_name, table_name, 'drop foreign key' AS clause, fk_name AS member, EXISTS (SELECT 1 FROM y WHERE y.schema_name = x.schema_name AND y.table_name = x.table_name AND y.m = x.m AND y.dr = x.dr) AS cosmetic FROM x ANTI JOIN y USING (schema_name, table_name, fk_name)
UNION ALL SELECT schema_name, table_name, 'add foreign key', fk_name, EXISTS (SELECT 1 FROM x WHERE y.schema_name = x.schema_name AND y.table_name = x.table_name AND y.m = x.m AND y.dr = x.dr) FROM y ANTI JOIN x USING (schema_name, table_name, fk_name)
UNION ALL SELECT schema_name, table_name, c, fk_name, x.dr = y.dr FROM x JOIN y USING (schema_name, table_name, fk_name), (VALUES ('drop foreign key'), ('add foreign key')) v(c) WHERE x.delete_rule <> y.delete_rule""",
)
def fleet_fk_diff(spark, d):
    return D.diff_fks(X.derived(spark, d, X.DESIRED_KEYS), X.derived(spark, d, X.ACTUAL_KEYS))


@query("fleet_missing_parents", _with(k=X.ACTUAL_KEYS, t=X.ACTUAL_TABLES) + " SELECT k.schema_name, k.table_name, k.fk_name, k.parent_table FROM k ANTI JOIN t ON k.schema_name = t.schema_name AND k.parent_table = t.table_name")
def fleet_missing_parents(spark, d):
    from plumbline.operators.relational import fk_missing_parent

    return fk_missing_parent(X.derived(spark, d, X.ACTUAL_KEYS), tables(spark, d)[1]).select("schema_name", "table_name", "fk_name", "parent_table")


@query(
    "fleet_check_diff",
    _with(a=X.DESIRED_CHECKS, b=X.ACTUAL_CHECKS)
    + """, e AS (SELECT schema_name, table_name, check_name FROM a JOIN b USING (schema_name, table_name, check_name) WHERE a.clause = b.clause AND a.enforced <> b.enforced),
x AS (SELECT * FROM a ANTI JOIN e USING (schema_name, table_name, check_name)), y AS (SELECT * FROM b ANTI JOIN e USING (schema_name, table_name, check_name))
SELECT schema_name, table_name, 'alter check' AS clause, check_name AS member, false AS cosmetic FROM e
UNION ALL SELECT schema_name, table_name, 'drop check', check_name, EXISTS (SELECT 1 FROM y WHERE y.schema_name = x.schema_name AND y.table_name = x.table_name AND y.clause = x.clause AND y.enforced = x.enforced) FROM x ANTI JOIN y USING (schema_name, table_name, check_name)
UNION ALL SELECT schema_name, table_name, 'add check', check_name, EXISTS (SELECT 1 FROM x WHERE y.schema_name = x.schema_name AND y.table_name = x.table_name AND y.clause = x.clause AND y.enforced = x.enforced) FROM y ANTI JOIN x USING (schema_name, table_name, check_name)
UNION ALL SELECT schema_name, table_name, c, check_name, false FROM x JOIN y USING (schema_name, table_name, check_name), (VALUES ('drop check'), ('add check')) v(c) WHERE x.clause <> y.clause""",
)
def fleet_check_diff(spark, d):
    return D.diff_checks(X.derived(spark, d, X.DESIRED_CHECKS), X.derived(spark, d, X.ACTUAL_CHECKS))


@query("fleet_attr_diff", _TABS + " SELECT schema_name, table_name, 'engine' AS clause, a.engine AS old_value, b.engine AS new_value FROM a JOIN b USING (schema_name, table_name) WHERE a.engine <> b.engine UNION ALL SELECT schema_name, table_name, 'comment', a.table_comment, b.table_comment FROM a JOIN b USING (schema_name, table_name) WHERE a.table_comment <> b.table_comment")
def fleet_attr_diff(spark, d):
    return D.diff_attrs(*tables(spark, d))


@query("fleet_charset_diff", _TABS + " SELECT schema_name, table_name, a.table_collation AS old_value, b.table_collation AS new_value FROM a JOIN b USING (schema_name, table_name) WHERE regexp_replace(a.table_collation, '^utf8mb3_', 'utf8_') <> regexp_replace(b.table_collation, '^utf8mb3_', 'utf8_')")
def fleet_charset_diff(spark, d):
    return D.diff_charset(*tables(spark, d))


@query("fleet_autoinc_diff", _TABS + ", j AS (SELECT schema_name, table_name, a.next_auto_inc AS old_value, b.next_auto_inc AS new_value FROM a JOIN b USING (schema_name, table_name) WHERE a.next_auto_inc <> b.next_auto_inc) SELECT 'if-increased' AS mode, * FROM j WHERE new_value > old_value UNION ALL SELECT 'if-already', * FROM j WHERE old_value > 1 UNION ALL SELECT 'always', * FROM j")
def fleet_autoinc_diff(spark, d):
    a, b = tables(spark, d)
    parts = [D.diff_autoinc(a, b, m).select(F.lit(m).alias("mode"), "*") for m in ("ignore", "if-increased", "if-already", "always")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "fleet_option_diff",
    _TABS
    + """, j AS (SELECT schema_name, table_name, b.create_options AS o FROM a JOIN b USING (schema_name, table_name) WHERE a.create_options <> b.create_options)
SELECT schema_name, table_name, 'ROW_FORMAT' AS option, 'DYNAMIC' AS old_value, CASE WHEN o LIKE '%COMPRESSED%' THEN 'COMPRESSED' ELSE 'DEFAULT' END AS new_value FROM j
UNION ALL SELECT schema_name, table_name, 'KEY_BLOCK_SIZE', NULL, '4' FROM j WHERE o LIKE '%key_block%' UNION ALL SELECT schema_name, table_name, 'STATS_PERSISTENT', '1', 'DEFAULT' FROM j WHERE o NOT LIKE '%stats%'""",
)
def fleet_option_diff(spark, d):
    return D.diff_options(*tables(spark, d))


@query("fleet_partition_diff", _TABS + " SELECT schema_name, table_name, 'partition by' AS clause, true AS supported FROM b SEMI JOIN a USING (schema_name, table_name) WHERE partition_method <> ''")
def fleet_partition_diff(spark, d):
    return D.diff_partitioning(*tables(spark, d))


_RT = _with(a=X.DESIRED_ROUTINES, b=X.ACTUAL_ROUTINES) + """, r AS (SELECT schema_name, routine_type, routine_name, CASE WHEN b.body IS NULL THEN 'drop routine' WHEN a.params <> b.params OR a.body <> b.body OR a.definer <> b.definer THEN 'replace routine' WHEN a.security <> b.security OR a.comment <> b.comment THEN 'alter routine' END AS clause, coalesce(a.params <> b.params, false) AS signature_changed FROM a LEFT JOIN b USING (schema_name, routine_type, routine_name))"""


@query("fleet_routine_diff", _RT + " SELECT * FROM r WHERE clause IS NOT NULL")
def fleet_routine_diff(spark, d):
    return D.diff_routines(X.derived(spark, d, X.DESIRED_ROUTINES), X.derived(spark, d, X.ACTUAL_ROUTINES))


@query("fleet_unsafe_objects", _with(ra=X.DESIRED_ROUTINES, rb=X.ACTUAL_ROUTINES, a=X.DESIRED_TABLES, b=X.ACTUAL_TABLES) + """, r AS (SELECT ra.schema_name, ra.routine_name AS object_name, CASE WHEN rb.body IS NULL THEN 'routine dropped' WHEN ra.params <> rb.params THEN 'routine signature changed' WHEN ra.body <> rb.body OR ra.definer <> rb.definer THEN 'routine replaced' END AS reason_code FROM ra LEFT JOIN rb USING (schema_name, routine_type, routine_name))
SELECT * FROM r WHERE reason_code IS NOT NULL UNION ALL SELECT schema_name, table_name, 'engine changed' FROM a JOIN b USING (schema_name, table_name) WHERE a.engine <> b.engine UNION ALL SELECT schema_name, table_name, 'table dropped' FROM a ANTI JOIN b USING (schema_name, table_name)""")
def fleet_unsafe_objects(spark, d):
    a, b = tables(spark, d)
    plain = {"n_objects": F.lit(0), "n_dropped": F.lit(0), "signature_changed": F.lit(False)}
    routines = D.diff_routines(X.derived(spark, d, X.DESIRED_ROUTINES), X.derived(spark, d, X.ACTUAL_ROUTINES)).withColumns({k: v for k, v in plain.items() if k != "signature_changed"})
    attrs = D.diff_attrs(a, b).withColumns(plain)
    gone = D.diff_tables(a, b).where("change = 'drop'").withColumn("clause", F.lit("drop table")).withColumns(plain)
    parts = [x.select("schema_name", F.col(n).alias("object_name"), "clause", *plain) for x, n in ((routines, "routine_name"), (attrs, "table_name"), (gone, "table_name"))]
    return U.unsafe_objects(parts[0].unionByName(parts[1]).unionByName(parts[2])).where("unsafe").select("schema_name", "object_name", "reason_code")


_PRINT = "sha256(string_agg(column_name || '|' || column_type || '|' || nullable || '|' || coalesce(charset, '~') || '|' || coalesce(b.collation, '~') || '|' || coalesce(default_expr, '~') || '|' || coalesce(comment, '~'), chr(10) ORDER BY ordinal))"


@query("fleet_drift", _with(b=X.ACTUAL_COLUMNS) + f""", p AS (SELECT schema_name, table_name, {_PRINT} AS fingerprint FROM b GROUP BY 1, 2), c AS (SELECT table_name, fingerprint, count(*) AS shards FROM p GROUP BY 1, 2),
u AS (SELECT table_name, fingerprint AS majority FROM c QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY shards DESC, fingerprint) = 1) SELECT p.schema_name, p.table_name, p.fingerprint, shards, majority FROM p JOIN u USING (table_name) JOIN c USING (table_name, fingerprint) WHERE p.fingerprint <> majority""")
def fleet_drift(spark, d):
    return D.drift(columns(spark, d)[1])


_SNAP = "SELECT 1 AS snapshot, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM a WHERE ordinal % 5 <> 3"


@query("fleet_history", _COLS + f""", s AS ({_SNAP}), g AS (SELECT schema_name, table_name, column_name, snapshot FROM (SELECT DISTINCT {_KEY} FROM s) JOIN (SELECT DISTINCT schema_name, table_name, snapshot FROM s) USING (schema_name, table_name)),
l AS (SELECT {_KEY}, snapshot, column_type AS new_type, lag(column_type) OVER (PARTITION BY {_KEY} ORDER BY snapshot) AS old_type FROM g LEFT JOIN s USING ({_KEY}, snapshot))
SELECT snapshot, {_KEY}, CASE WHEN old_type IS NULL THEN 'appeared' WHEN new_type IS NULL THEN 'vanished' ELSE 'type changed' END AS event, old_type, new_type FROM l WHERE old_type IS DISTINCT FROM new_type""")
def fleet_history(spark, d):
    a, b = columns(spark, d)
    at = lambda s, i: s.withColumn("snapshot", F.lit(i))
    return D.history(at(a, 1).unionByName(at(b, 2)).unionByName(at(a.where("ordinal % 5 <> 3"), 3)))


# Lint

_WORDS = ["value", "text", "label", "role", "source"]


def _catalog(spark, d, cols=None) -> tuple[L.Catalog, L.Options]:
    keys = X.derived(spark, d, X.ACTUAL_KEYS).withColumns({"columns": F.array("columns"), "parent_columns": F.array("parent_columns")})
    cat = L.Catalog(tables(spark, d)[1], columns(spark, d)[1] if cols is None else cols, indexes(spark, d)[1], keys, X.derived(spark, d, X.ACTUAL_ROUTINES))
    severities = {n: "warning" for n in L.rules()} | {"definer": "error", "pk": "error", "nullable": "off"}
    return cat, L.Options(severities, {"charset": ["utf8mb4"], "definer": ["app@%"], "compression": ["none"]}, spark.createDataFrame([(w,) for w in _WORDS], "word string"))


_LINT_WITH = _with(t=X.ACTUAL_TABLES, c=X.ACTUAL_COLUMNS, p=X.ACTUAL_INDEXES, k=X.ACTUAL_KEYS, r=X.ACTUAL_ROUTINES) + r""", y AS (SELECT *, regexp_extract(column_type, '^[a-z0-9_]+') AS base, coalesce(try_cast(regexp_extract(column_type, '^[a-z0-9_]+\((\d+)', 1) AS INTEGER), 0) AS size, column_type LIKE '% unsigned' AS uns FROM c),
x AS (SELECT schema_name, table_name, index_name, min(ordinal) AS o, bool_or(non_unique) AS nu, list(column_name ORDER BY seq) AS cols, list(prefix_length ORDER BY seq) AS pre FROM p GROUP BY 1, 2, 3)"""
_OK_TABLE = "(schema_name, table_name) IN (SELECT (schema_name, table_name) FROM t)"
_LINT_PARTS = {
    "auto-inc": "SELECT schema_name, table_name, column_name FROM y JOIN t USING (schema_name, table_name) WHERE auto_inc AND (column_type NOT IN ('int(10) unsigned', 'bigint(20) unsigned') OR next_auto_inc > 0.8 * CASE WHEN column_type LIKE 'int%unsigned' THEN 4294967295.0 WHEN uns THEN 18446744073709551615.0 ELSE 9223372036854775807.0 END)",
    "charset": f"SELECT schema_name, table_name, '' FROM t WHERE split_part(table_collation, '_', 1) <> 'utf8mb4' UNION ALL SELECT schema_name, table_name, column_name FROM c WHERE charset <> 'utf8mb4' AND (schema_name, table_name) IN (SELECT (schema_name, table_name) FROM t WHERE split_part(table_collation, '_', 1) = 'utf8mb4')",
    "compression": "SELECT schema_name, table_name, '' FROM t WHERE engine = 'InnoDB' AND create_options LIKE '%COMPRESSED%'",
    "display-width": "SELECT schema_name, table_name, column_name FROM y WHERE size > 0 AND column_type <> 'tinyint(1)' AND base IN ('tinyint', 'smallint', 'mediumint', 'int', 'bigint') AND size <> CASE base WHEN 'tinyint' THEN 4 WHEN 'smallint' THEN 6 WHEN 'mediumint' THEN 9 WHEN 'int' THEN 11 ELSE 20 END - CASE WHEN uns AND base <> 'bigint' THEN 1 ELSE 0 END",
    "dupe-index": """SELECT DISTINCT a.schema_name, a.table_name, a.index_name FROM x a JOIN x b ON a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.index_name <> b.index_name
      WHERE a.index_name <> 'PRIMARY' AND (a.nu OR NOT b.nu) AND CASE WHEN NOT a.nu AND NOT b.nu THEN a.cols = b.cols AND a.pre = b.pre ELSE len(a.cols) <= len(b.cols) AND a.cols = b.cols[1:len(a.cols)] AND len(list_filter(range(1, len(a.cols) + 1), lambda i: b.pre[i] > 0 AND (a.pre[i] = 0 OR a.pre[i] > b.pre[i]))) = 0 END
      AND (NOT (a.cols = b.cols AND a.pre = b.pre AND a.nu = b.nu AND b.index_name <> 'PRIMARY') OR a.o > b.o)""",
    "engine": "SELECT schema_name, table_name, '' FROM t WHERE engine <> 'InnoDB'",
    "fk-parent": "SELECT schema_name, table_name, fk_name FROM k WHERE (schema_name, parent_table) NOT IN (SELECT (schema_name, table_name) FROM t) OR (schema_name, parent_table, parent_columns) NOT IN (SELECT (schema_name, table_name, cols[1]) FROM x WHERE NOT nu AND len(cols) = 1 AND pre[1] = 0)",
    "has-enum": "SELECT schema_name, table_name, column_name FROM y WHERE base IN ('enum', 'set')",
    "has-fk": "SELECT schema_name, table_name, CAST(count(*) AS VARCHAR) FROM k GROUP BY 1, 2",
    "has-float": "SELECT schema_name, table_name, column_name FROM y WHERE base IN ('float', 'double')",
    "has-time": "SELECT schema_name, table_name, column_name FROM y WHERE base IN ('timestamp', 'datetime', 'time')",
    "ids": "SELECT schema_name, table_name, column_name FROM y WHERE (column_name = 'id' OR column_name LIKE '%\\_id' ESCAPE '\\') AND column_type NOT LIKE 'bigint%unsigned'",
    "name-case": "SELECT schema_name, table_name, '' FROM t WHERE lower(table_name) <> table_name",
    "pk": "SELECT schema_name, table_name, '' FROM t WHERE (schema_name, table_name) NOT IN (SELECT (schema_name, table_name) FROM x WHERE index_name = 'PRIMARY')",
    "pk-type": "SELECT x.schema_name, x.table_name, cols[1] FROM x JOIN y ON x.schema_name = y.schema_name AND x.table_name = y.table_name AND cols[1] = column_name WHERE index_name = 'PRIMARY' AND base NOT IN ('tinyint', 'smallint', 'mediumint', 'int', 'bigint', 'binary', 'varbinary')",
    "reserved-word": f"SELECT schema_name, table_name, '' FROM t WHERE lower(table_name) IN {tuple(_WORDS)} UNION ALL SELECT schema_name, table_name, column_name FROM c WHERE lower(column_name) IN {tuple(_WORDS)}",
    "zero-date": "SELECT schema_name, table_name, column_name FROM y WHERE base IN ('timestamp', 'datetime', 'date') AND default_expr LIKE '0000-%'",
}
_LINT = _LINT_WITH + ", l AS (" + " UNION ALL ".join(f"SELECT schema_name, 'table' AS object_type, table_name AS object_name, '{n}' AS rule, m AS member FROM ({s}) z(schema_name, table_name, m)" for n, s in _LINT_PARTS.items()) + """
 UNION ALL SELECT schema_name, lower(routine_type), routine_name, 'has-routine', '' FROM r UNION ALL SELECT schema_name, lower(routine_type), routine_name, 'definer', '' FROM r WHERE definer <> 'app@%'),
n AS (SELECT *, CASE WHEN rule IN ('definer', 'pk') THEN 'error' ELSE 'warning' END AS severity FROM l)"""


@query("lint_all", _LINT + " SELECT * FROM n")
def lint_all(spark, d):
    return L.lint(*_catalog(spark, d))


@query("lint_counts", _LINT + " SELECT severity, count(*) AS n FROM n GROUP BY 1")
def lint_counts(spark, d):
    return L.counts(L.lint(*_catalog(spark, d)))


@query("lint_changed", _LINT + f", a AS ({X.portable(X.DESIRED_TABLES)}) SELECT * FROM n WHERE (schema_name, object_name) IN (SELECT (schema_name, table_name) FROM a JOIN t USING (schema_name, table_name) WHERE a.engine <> t.engine)")
def lint_changed(spark, d):
    cat, opts = _catalog(spark, d)
    changed = D.diff_attrs(*tables(spark, d)).where("clause = 'engine'").select("schema_name", F.col("table_name").alias("object_name"))
    return L.ordered(stored(L.lint(cat, opts, changed)))  # stored: a sort reads its input twice


@query("fleet_gate", _UNSAFE + ", w AS (" + _LINT.replace("WITH ", "WITH ", 1) + " SELECT schema_name, count(*) FILTER (WHERE severity = 'error') AS e FROM n GROUP BY 1), v AS (SELECT schema_name, count(*) AS n, count(reason_code) AS m FROM u GROUP BY 1) SELECT coalesce(v.schema_name, w.schema_name) AS schema_name, coalesce(n, 0) AS n_changes, coalesce(m, 0) AS n_unsafe, coalesce(e, 0) AS n_errors, coalesce(m, 0) > 0 OR coalesce(e, 0) > 0 AS skipped FROM v FULL JOIN w ON v.schema_name = w.schema_name")
def fleet_gate(spark, d):
    return U.gate(_changes(spark, d).where("clause <> 'move column'"), L.lint(*_catalog(spark, d)), ["schema_name"])
