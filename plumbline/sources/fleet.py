"""A fleet of sharded databases derived from the supplied tables: a shard for each customer, each with the fourteen tables.

The desired definition is the same everywhere; what the shards really have drifts from it by arithmetic on the shard and the
column. The statements are portable SQL, so other engines can derive the same catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_B, _I, _S = "bigint(20) unsigned", "int(11)", "varchar(64)"
#: Columns of the supplied tables as definitions: table, column, type, nullable, type in drifted shards.
BASE: list[tuple[str, str, str, bool, str]] = [
    ("region", "r_regionkey", _I, False, "bigint(20)"), ("region", "r_name", _S, True, "varchar(32)"),
    ("nation", "n_nationkey", _I, False, "bigint(20)"), ("nation", "n_name", _S, True, "varchar(128)"), ("nation", "n_regionkey", _I, True, "smallint(6)"),
    ("customer", "c_custkey", _B, False, "int(10) unsigned"), ("customer", "c_name", _S, True, "varchar(20)"), ("customer", "c_nationkey", _I, True, "tinyint(4)"),
    ("customer", "c_acctbal", "decimal(12,2)", True, "decimal(14,2)"), ("customer", "c_mktsegment", "varchar(10)", True, "enum('AUTOMOBILE','BUILDING')"),
    ("supplier", "s_suppkey", _B, False, "bigint(20)"), ("supplier", "s_name", _S, True, "text"), ("supplier", "s_nationkey", _I, True, "int(10) unsigned"), ("supplier", "s_acctbal", "decimal(12,2)", True, "decimal(12,1)"),
    ("part", "p_partkey", _B, False, "bigint(20)"), ("part", "p_name", "varchar(100)", True, "varchar(255)"), ("part", "p_brand", "char(10)", True, "char(8)"), ("part", "p_type", "varchar(25)", True, "tinytext"),
    ("part", "p_size", "smallint(6)", True, "tinyint(4)"), ("part", "p_retailprice", "double", True, "float"),
    ("orders", "o_orderkey", _B, False, "bigint(20)"), ("orders", "o_custkey", _B, True, "int(10) unsigned"), ("orders", "o_orderstatus", "enum('F','O','P')", True, "enum('F','O','P','X')"), ("orders", "o_totalprice", "double", True, "decimal(12,2)"),
    ("orders", "o_orderdate", "datetime", True, "datetime(3)"), ("orders", "o_orderpriority", "varchar(15)", True, "varchar(12)"),
    ("lineitem", "l_orderkey", _B, False, "int(10) unsigned"), ("lineitem", "l_partkey", _B, True, "bigint(20)"), ("lineitem", "l_suppkey", _B, True, "mediumint(8) unsigned"), ("lineitem", "l_linenumber", "tinyint(3) unsigned", False, "smallint(5) unsigned"),
    ("lineitem", "l_quantity", "decimal(10,2)", True, "decimal(8,2)"), ("lineitem", "l_extendedprice", "decimal(12,2)", True, "decimal(14,4)"), ("lineitem", "l_discount", "float", True, "double"), ("lineitem", "l_tax", "float(6,2)", True, "float"),
    ("lineitem", "l_returnflag", "enum('A','N','R')", True, "enum('N','A','R')"), ("lineitem", "l_linestatus", "char(1)", True, "varchar(1)"), ("lineitem", "l_shipdate", "timestamp", True, "timestamp(6)"),
    ("events", "event_id", _B, False, "bigint(20)"), ("events", "ts", "datetime(6)", True, "datetime"), ("events", "user_id", _B, True, "int(11)"), ("events", "event_type", "varchar(16)", True, "varchar(32)"), ("events", "value", "double", True, "float"), ("events", "props", "text", True, "mediumtext"),
    ("documents", "doc_id", _B, False, "bigint(20)"), ("documents", "text", "longtext", True, "mediumtext"), ("documents", "lang", "char(2)", True, "char(8)"), ("documents", "source", _S, True, "varchar(32)"), ("documents", "n_chars", "int(10) unsigned", True, _B),
    ("embeddings", "vec_id", _B, False, "bigint(20)"), ("embeddings", "embedding", "vector(64)", True, "vector(32)"), ("embeddings", "label", "int", True, "int(11)"),
    ("pages", "page_id", _B, False, "bigint(20)"), ("pages", "url", "varchar(2048)", True, "varchar(255)"), ("pages", "html", "mediumtext", True, "longtext"),
    ("benchmark", "item_id", "binary(16)", False, "uuid"), ("benchmark", "text", "text", True, "blob"),
    ("labels", "doc_id", _B, False, "bigint(20)"), ("labels", "quality", "tinyint(1)", True, "tinyint(4)"), ("labels", "toxic", "bit(1)", True, "bit(8)"),
    ("conversations", "conv_id", _B, False, "bigint(20)"), ("conversations", "turn", "year", False, "year(4)"), ("conversations", "role", "char(10)", True, "binary(10)"), ("conversations", "text", "varbinary(4000)", True, "varbinary(2000)"),
]
TABLES = list(dict.fromkeys(r[0] for r in BASE))

#: Foreign keys: name, child table, column, parent table, column, update rule, delete rule.
FOREIGN_KEYS = [
    ("fk_nation", "nation", "n_regionkey", "region", "r_regionkey"), ("fk_customer", "customer", "c_nationkey", "nation", "n_nationkey"), ("fk_supplier", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("fk_orders", "orders", "o_custkey", "customer", "c_custkey"), ("fk_line_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("fk_line_part", "lineitem", "l_partkey", "part", "p_name"),
    ("fk_line_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("fk_labels", "labels", "doc_id", "documents", "doc_id"), ("fk_pages", "pages", "page_id", "archive", "page_id"),
]
#: Check constraints: name, table, clause.
CHECKS = [("ck_quantity", "lineitem", "l_quantity > 0"), ("ck_discount", "lineitem", "l_discount < 1"), ("ck_tax", "lineitem", "l_tax < 1"), ("ck_size", "part", "p_size <> 0"), ("ck_price", "orders", "o_totalprice >= 0")]
#: Routines: name, type, parameters, body.
ROUTINES = [("total_of", "FUNCTION", "k bigint", "RETURN 1"), ("purge", "PROCEDURE", "days int", "BEGIN END"), ("touch", "PROCEDURE", "", "BEGIN END")]


def _quoted(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") AS {names}"


def _base() -> str:
    rows, seen = [], {}
    for g, (t, c, kind, nullable, alt) in enumerate(BASE, 1):
        seen[t] = seen.get(t, 0) + 1
        # Type texts hold quotes, which the engines escape differently: a mark stands for them until after parsing.
        rows.append((TABLES.index(t) + 1, t, g, seen[t], c, kind.replace("'", "~"), nullable, alt.replace("'", "~")))
    return _values(rows, "b(tno, t, g, ord, col, typ, nul, alt)")


_TEXT = "(typ LIKE '%char%' OR typ LIKE '%text%' OR typ LIKE 'enum%')"
_X = "(c.c_custkey * 7 + g * 13)"
_SHARD = "CAST(c.c_custkey AS VARCHAR(20)) AS schema_name"

#: Definitions that every shard should have.
DESIRED_COLUMNS = f"""
SELECT {_SHARD}, t AS table_name, col AS column_name, ord AS ordinal, replace(typ, '~', chr(39)) AS column_type, nul AS nullable,
       g IN (6, 21) AS auto_inc, CASE WHEN {_TEXT} THEN 'utf8mb4' END AS charset, CASE WHEN {_TEXT} THEN 'utf8mb4_general_ci' END AS collation,
       CASE WHEN typ = 'datetime' THEN 'CURRENT_TIMESTAMP' WHEN col = 'l_shipdate' THEN '0000-00-00 00:00:00' END AS default_expr, '' AS comment
FROM {{customer}} c CROSS JOIN {_base()}
"""
#: Definitions that the shards have: columns are missing, changed, differently nullable, moved to the end or added.
ACTUAL_COLUMNS = f"""
SELECT {_SHARD}, t AS table_name, col AS column_name, CASE WHEN {_X} % 109 = 0 THEN ord + 1000 ELSE ord END AS ordinal,
       replace(CASE WHEN {_X} % 101 = 0 THEN alt ELSE typ END, '~', chr(39)) AS column_type, CASE WHEN {_X} % 107 = 0 THEN NOT nul ELSE nul END AS nullable,
       g IN (6, 21) AS auto_inc, CASE WHEN {_TEXT} THEN CASE WHEN {_X} % 113 = 0 THEN 'latin1' ELSE 'utf8mb4' END END AS charset,
       CASE WHEN {_TEXT} THEN CASE WHEN {_X} % 113 = 0 THEN 'latin1_swedish_ci' WHEN {_X} % 127 = 0 THEN 'utf8mb4_bin' ELSE 'utf8mb4_general_ci' END END AS collation,
       CASE WHEN typ = 'datetime' THEN 'CURRENT_TIMESTAMP' WHEN col = 'l_shipdate' THEN '0000-00-00 00:00:00' END AS default_expr,
       CASE WHEN {_X} % 131 = 0 THEN 'drifted' ELSE '' END AS comment
FROM {{customer}} c CROSS JOIN {_base()}
WHERE {_X} % 103 <> 0 AND (c.c_custkey * 11 + tno * 17) % 127 <> 0
UNION ALL
SELECT {_SHARD}, t, 'extra_flag', 500, 'tinyint(1)', true, false, NULL, NULL, NULL, ''
FROM {{customer}} c CROSS JOIN {_base()}
WHERE ord = 1 AND (c.c_custkey * 5 + tno) % 89 = 0 AND (c.c_custkey * 11 + tno * 17) % 127 <> 0
"""
_TABLE_BASE = _values([(i, t) for i, t in enumerate(TABLES, 1)], "b(tno, t)")
_Y = "(c.c_custkey * 11 + tno * 17)"
_OPTIONS = "'row_format=DYNAMIC stats_persistent=1'"
DESIRED_TABLES = f"""
SELECT {_SHARD}, t AS table_name, 'BASE TABLE' AS table_type, 'InnoDB' AS engine, 'utf8mb4_general_ci' AS table_collation, {_OPTIONS} AS create_options, '' AS table_comment,
       CAST(1 AS BIGINT) AS next_auto_inc, '' AS partition_method, '' AS partition_expression
FROM {{customer}} c CROSS JOIN {_TABLE_BASE}
"""
ACTUAL_TABLES = f"""
SELECT {_SHARD}, t AS table_name, CASE WHEN {_Y} % 139 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type, CASE WHEN {_Y} % 71 = 0 THEN 'MyISAM' ELSE 'InnoDB' END AS engine,
       CASE WHEN {_Y} % 73 = 0 THEN 'latin1_swedish_ci' WHEN {_Y} % 79 = 0 THEN 'utf8mb3_general_ci' ELSE 'utf8mb4_general_ci' END AS table_collation,
       CASE WHEN {_Y} % 83 = 0 THEN 'row_format=COMPRESSED key_block_size=4' WHEN {_Y} % 89 = 0 THEN 'stats_persistent=1' ELSE {_OPTIONS} END AS create_options,
       CASE WHEN {_Y} % 97 = 0 THEN 'old' ELSE '' END AS table_comment, CAST(CASE WHEN {_Y} % 101 = 0 THEN 4000000000 WHEN {_Y} % 103 = 0 THEN 500 ELSE 1 END AS BIGINT) AS next_auto_inc,
       CASE WHEN {_Y} % 107 = 0 THEN 'HASH' ELSE '' END AS partition_method, CASE WHEN {_Y} % 107 = 0 THEN 'id' ELSE '' END AS partition_expression
FROM {{customer}} c CROSS JOIN {_TABLE_BASE} WHERE {_Y} % 127 <> 0
UNION ALL
SELECT {_SHARD}, CASE WHEN c.c_custkey % 2 = 0 THEN 'tmp_copy' ELSE 'Region' END, 'BASE TABLE', 'InnoDB', 'utf8mb4_general_ci', '', '', CAST(1 AS BIGINT), '', '' FROM {{customer}} c WHERE c.c_custkey % 61 = 0
"""
_FIRST = _values([(TABLES.index(t) + 1, t, *[r[1] for r in BASE if r[0] == t][:2]) for t in TABLES], "b(tno, t, c1, c2)")
#: Index parts, a row each.
DESIRED_INDEXES = f"""
SELECT {_SHARD}, t AS table_name, 'PRIMARY' AS index_name, 1 AS seq, c1 AS column_name, false AS non_unique, 0 AS prefix_length, 1 AS ordinal FROM {{customer}} c CROSS JOIN {_FIRST}
UNION ALL SELECT {_SHARD}, t, 'ix_pair', 1, c2, true, 0, 2 FROM {{customer}} c CROSS JOIN {_FIRST}
UNION ALL SELECT {_SHARD}, t, 'ix_pair', 2, c1, true, 0, 2 FROM {{customer}} c CROSS JOIN {_FIRST}
"""
ACTUAL_INDEXES = f"""
SELECT {_SHARD}, t AS table_name, 'PRIMARY' AS index_name, 1 AS seq, CASE WHEN {_Y} % 43 = 0 THEN c2 ELSE c1 END AS column_name, false AS non_unique, 0 AS prefix_length, 1 AS ordinal
FROM {{customer}} c CROSS JOIN {_FIRST} WHERE {_Y} % 127 <> 0 AND {_Y} % 41 <> 0
UNION ALL SELECT {_SHARD}, t, CASE WHEN {_Y} % 59 = 0 THEN 'ix_two' ELSE 'ix_pair' END, 1, c2, {_Y} % 61 <> 0, CASE WHEN {_Y} % 47 = 0 THEN 4 ELSE 0 END, 2 FROM {{customer}} c CROSS JOIN {_FIRST} WHERE {_Y} % 127 <> 0
UNION ALL SELECT {_SHARD}, t, CASE WHEN {_Y} % 59 = 0 THEN 'ix_two' ELSE 'ix_pair' END, 2, c1, {_Y} % 61 <> 0, 0, 2 FROM {{customer}} c CROSS JOIN {_FIRST} WHERE {_Y} % 127 <> 0
UNION ALL SELECT {_SHARD}, t, 'ix_single', 1, c2, true, 0, 3 FROM {{customer}} c CROSS JOIN {_FIRST} WHERE {_Y} % 53 = 0 AND {_Y} % 127 <> 0
"""
_KEYS = _values([(i, *r) for i, r in enumerate(FOREIGN_KEYS, 1)], "b(k, name, t, col, pt, pcol)")
_Z = "(c.c_custkey * 3 + k)"
DESIRED_KEYS = f"SELECT {_SHARD}, t AS table_name, name AS fk_name, col AS columns, CAST(NULL AS VARCHAR(20)) AS parent_schema, pt AS parent_table, pcol AS parent_columns, 'RESTRICT' AS update_rule, 'RESTRICT' AS delete_rule FROM {{customer}} c CROSS JOIN {_KEYS}"
ACTUAL_KEYS = f"""
SELECT {_SHARD}, t AS table_name, CASE WHEN {_Z} % 59 = 0 THEN concat(name, '_2') ELSE name END AS fk_name, col AS columns, CAST(NULL AS VARCHAR(20)) AS parent_schema, pt AS parent_table, pcol AS parent_columns, 'RESTRICT' AS update_rule,
       CASE WHEN {_Z} % 61 = 0 THEN 'NO ACTION' WHEN {_Z} % 67 = 0 THEN 'CASCADE' ELSE 'RESTRICT' END AS delete_rule
FROM {{customer}} c CROSS JOIN {_KEYS} WHERE {_Z} % 53 <> 0
"""
_CLAUSES = _values([(i, *r) for i, r in enumerate(CHECKS, 1)], "b(k, name, t, cl)")
DESIRED_CHECKS = f"SELECT {_SHARD}, t AS table_name, name AS check_name, cl AS clause, true AS enforced, k AS ordinal FROM {{customer}} c CROSS JOIN {_CLAUSES}"
ACTUAL_CHECKS = f"""
SELECT {_SHARD}, t AS table_name, CASE WHEN {_Z} % 59 = 0 THEN concat(name, '_2') ELSE name END AS check_name, CASE WHEN {_Z} % 67 = 0 THEN concat(cl, ' OR true') ELSE cl END AS clause, {_Z} % 61 <> 0 AS enforced, k AS ordinal
FROM {{customer}} c CROSS JOIN {_CLAUSES} WHERE {_Z} % 53 <> 0
"""
_CALLS = _values([(i, *r) for i, r in enumerate(ROUTINES, 1)], "b(k, name, typ, params, body)")
DESIRED_ROUTINES = f"SELECT {_SHARD}, name AS routine_name, typ AS routine_type, params, body, 'DEFINER' AS security, '' AS comment, 'app@%' AS definer FROM {{customer}} c CROSS JOIN {_CALLS}"
ACTUAL_ROUTINES = f"""
SELECT {_SHARD}, name AS routine_name, typ AS routine_type, CASE WHEN {_Z} % 43 = 0 THEN 'x int' ELSE params END AS params, CASE WHEN {_Z} % 47 = 0 THEN 'BEGIN SELECT 1; END' ELSE body END AS body,
       CASE WHEN {_Z} % 53 = 0 THEN 'INVOKER' ELSE 'DEFINER' END AS security, CASE WHEN {_Z} % 61 = 0 THEN 'note' ELSE '' END AS comment, CASE WHEN {_Z} % 37 = 0 THEN 'root@localhost' ELSE 'app@%' END AS definer
FROM {{customer}} c CROSS JOIN {_CALLS} WHERE {_Z} % 41 <> 0
"""
#: A database server for each nation: directory, name case mode, version, whether its version is the configured one.
INSTANCES = "SELECT CAST(n_nationkey AS VARCHAR(20)) AS instance, concat('dir', CAST(n_regionkey AS VARCHAR(20))) AS directory, CASE WHEN n_nationkey % 7 = 0 THEN -1 WHEN n_nationkey % 4 = 0 THEN 2 ELSE 0 END AS name_case, 5 + n_nationkey % 7 AS major, n_nationkey % 4 AS minor, 8 AS wanted_major FROM {nation} n"


#: Shards that a task derives and compares at most: a customer becomes up to a hundred rows a side.
SHARDS_A_TASK = 4000


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """The number of partitions that a fleet is dealt to: it grows with the fleet, so a task doesn't."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/customer.parquet").count() // SHARDS_A_TASK))


def derived(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The catalog of a statement. Customers are dealt by shard before each becomes its rows: catalogs of a fleet are partitioned by
    schema_name, all in the same way, so what is grouped within a shard isn't shuffled again."""
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation") if f"{{{t}}}" in statement}
    if "customer" in names:
        names["customer"] = names["customer"].select("c_custkey").repartition(partitions(spark, sf_dir), F.expr("CAST(c_custkey AS VARCHAR(20))"))
    return spark.sql(statement, **names)


def portable(statement: str) -> str:
    """The statement for an engine where the tables are views."""
    return statement.format(customer="customer", nation="nation")
