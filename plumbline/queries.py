"""Registered queries over the supplied tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import cascade as K
from plumbline.operators import checks as V
from plumbline.operators import collations as C
from plumbline.operators import keys as M
from plumbline.operators import partitions as P
from plumbline.operators import relational as R
from plumbline.operators.checks import ColumnChange
from plumbline.operators.conform import Contract, Target, conform_dry_run, conform_split, fill_defaults, fleet_plan
from plumbline.sources.staging import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query of (spark, sf_dir) and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"a query named {name} is already registered")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(table: str, parts: dict[str, str]) -> str:
    """SQL of run_checks: a row for each named condition."""
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS rows_total, count(*) FILTER (WHERE {c}) AS rows_affected FROM {table}" for n, c in parts.items())


LINEITEM_CHANGES = [
    ColumnChange("l_quantity", "decimal(10,2)", "tinyint unsigned"),
    ColumnChange("l_extendedprice", "decimal(12,2)", "decimal(6,2)"),
    ColumnChange("l_returnflag", "enum('A','N','R')", "enum('A','N')"),
    ColumnChange("l_linenumber", "int(11)", "bigint(20)"),
    ColumnChange("l_shipdate", "datetime(6)", "datetime"),
]
_PRICE = "CAST(l_extendedprice AS DECIMAL(38,10))"


@query(
    "change_impact_lineitem",
    f"""
SELECT 'modify l_quantity' AS clause, true AS unsafe, count(*) AS rows_total, count(*) FILTER (WHERE l_quantity <> floor(l_quantity) OR l_quantity < 0 OR l_quantity > 255) AS rows_affected,
       count(*) FILTER (WHERE l_quantity <> floor(l_quantity) OR l_quantity < 0 OR l_quantity > 255) > 0 AS truly_lossy FROM lineitem
UNION ALL SELECT 'modify l_extendedprice', true, count(*), count(*) FILTER (WHERE round({_PRICE}, 2) <> {_PRICE} OR abs({_PRICE}) >= 10000), count(*) FILTER (WHERE round({_PRICE}, 2) <> {_PRICE} OR abs({_PRICE}) >= 10000) > 0 FROM lineitem
UNION ALL SELECT 'modify l_returnflag', true, count(*), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) > 0 FROM lineitem
UNION ALL SELECT 'modify l_linenumber', false, count(*), count(*) FILTER (WHERE l_linenumber IS NULL AND false), false FROM lineitem
UNION ALL SELECT 'modify l_shipdate', true, count(*), count(*) FILTER (WHERE l_shipdate <> date_trunc('second', l_shipdate)), count(*) FILTER (WHERE l_shipdate <> date_trunc('second', l_shipdate)) > 0 FROM lineitem
UNION ALL SELECT 'add key PRIMARY', true, CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE n > 1), count(*) FILTER (WHERE n > 1) > 0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
""",
)
def change_impact_lineitem(spark, d):
    return V.change_impact(_t(spark, d, "lineitem"), LINEITEM_CHANGES, {"PRIMARY": ["l_orderkey", "l_linenumber"]})


@query("int_fit", _counts("orders", {"o_custkey smallint": "o_custkey NOT BETWEEN -32768 AND 32767", "o_custkey tinyint unsigned": "o_custkey NOT BETWEEN 0 AND 255", "o_totalprice int": "o_totalprice <> floor(o_totalprice) OR o_totalprice NOT BETWEEN -2147483648 AND 2147483647", "o_orderkey mediumint": "o_orderkey NOT BETWEEN -8388608 AND 8388607"}))
def int_fit(spark, d):
    pairs = [("o_custkey", "smallint"), ("o_custkey", "tinyint unsigned"), ("o_totalprice", "int"), ("o_orderkey", "mediumint")]
    return V.run_checks(_t(spark, d, "orders"), {f"{c} {t}": V.int_fit(F.col(c), t) for c, t in pairs})


def _narrow_sql(table: str, columns: list[str], texts: list[str]) -> str:
    ranges = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("mediumint", -8388608, 8388607), ("int", -2147483648, 2147483647), ("bigint", -9223372036854775808, 9223372036854775807)]
    cases = " ".join(f"WHEN low >= {a} AND high <= {b} THEN '{n}' WHEN low >= 0 AND high <= {b - a} THEN '{n} unsigned'" for n, a, b in ranges)
    parts = [f"SELECT '{c}' AS column_name, CAST(min({c}) AS DECIMAL(20,0)) AS low, CAST(max({c}) AS DECIMAL(20,0)) AS high, NULL AS most_bytes, NULL AS n FROM {table}" for c in columns]
    parts += [f"SELECT '{c}', NULL, NULL, max(strlen({c})), max(length({c})) FROM {table}" for c in texts]
    return f"SELECT column_name, low, high, CAST(most_bytes AS BIGINT) AS most_bytes, CASE WHEN n IS NOT NULL THEN 'varchar(' || greatest(1, n) || ')' {cases} END AS fits FROM ({' UNION ALL '.join(parts)})"


@query("narrowest_type", _narrow_sql("part", ["p_partkey", "p_size"], ["p_name", "p_brand", "p_type"]))
def narrowest_type(spark, d):
    from plumbline.functions.types import narrowest_type as narrowest

    return narrowest(_t(spark, d, "part"), ["p_partkey", "p_size", "p_name", "p_brand", "p_type"])


_X = "CAST({} AS DECIMAL(38,10))"
_P, _DI, _VA = _X.format("l_extendedprice"), _X.format("l_discount"), _X.format("value")


@query("decimal_scale_loss", _counts("lineitem", {"price at scale 2": f"round({_P}, 2) <> {_P}", "price at scale 1": f"round({_P}, 1) <> {_P}", "price in decimal(7,2)": f"round({_P}, 2) <> {_P} OR abs({_P}) >= 100000", "discount at scale 1": f"round({_DI}, 1) <> {_DI}"}))
def decimal_scale_loss(spark, d):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return V.run_checks(_t(spark, d, "lineitem"), {"price at scale 2": V.scale_loss(price, 2), "price at scale 1": V.scale_loss(price, 1), "price in decimal(7,2)": V.decimal_fit(price, "decimal(7,2)"), "discount at scale 1": V.scale_loss(discount, 1)})


@query("float_exact", _counts("events", {"value in decimal(12,2)": f"coalesce(CAST(try_cast({_VA} AS DECIMAL(12,2)) AS DOUBLE) <> value, true)", "value in decimal(12,1)": f"coalesce(CAST(try_cast({_VA} AS DECIMAL(12,1)) AS DOUBLE) <> value, true)"}))
def float_exact(spark, d):
    return V.run_checks(_t(spark, d, "events"), {f"value in decimal(12,{s})": V.float_exact(F.col("value"), 12, s) for s in (2, 1)})


@query("string_fit", _counts("documents", {"text varchar(1000)": "length(text) > 1000", "text tinytext": "strlen(text) > 255", "text text": "strlen(text) > 65535", "source char(4)": "length(source) > 4"}))
def string_fit(spark, d):
    pairs = [("text", "varchar(1000)"), ("text", "tinytext"), ("text", "text"), ("source", "char(4)")]
    return V.run_checks(_t(spark, d, "documents"), {f"{c} {t}": V.string_fit(F.col(c), t) for c, t in pairs})


@query("charset_fit", _counts("documents", {"ascii": r"regexp_matches(text, '[^\x{00}-\x{7F}]')", "latin1": r"regexp_matches(text, '[^\x{00}-\x{FF}]')", "utf8mb3": r"regexp_matches(text, '[^\x{00}-\x{FFFF}]')", "utf8mb4": "false"}))
def charset_fit(spark, d):
    return V.run_checks(_t(spark, d, "documents"), {c: V.charset_fit(F.col("text"), c) for c in ("ascii", "latin1", "utf8mb3", "utf8mb4")})


@query("charset_fit_turns", r"SELECT role, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(text, '[^\x{00}-\x{7F}]')) AS not_ascii, count(*) FILTER (WHERE strlen(text) > 255) AS not_tinytext FROM conversations GROUP BY role")
def charset_fit_turns(spark, d):
    text = F.col("text")
    return _t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_rows"), F.count_if(V.charset_fit(text, "ascii")).alias("not_ascii"), F.count_if(V.string_fit(text, "tinytext")).alias("not_tinytext"))


@query("binary_fit", _counts("documents", {"too long for 2000": "strlen(text) > 2000", "padded to 2000": "strlen(text) < 2000"}))
def binary_fit(spark, d):
    data = F.encode("text", "UTF-8")
    return V.run_checks(_t(spark, d, "documents"), {"too long for 2000": V.binary_fit(data, 2000), "padded to 2000": V.binary_padded(data, 2000)})


@query("enum_domain", _counts("orders", {"status outside": "o_orderstatus NOT IN ('F', 'O')", "status renumbered": "o_orderstatus IN ('F', 'O')", "priority outside": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"}))
def enum_domain(spark, d):
    status = F.col("o_orderstatus")
    return V.run_checks(_t(spark, d, "orders"), {"status outside": V.enum_fit(status, ("F", "O")), "status renumbered": V.enum_shift(status, ("F", "O", "P"), ("O", "F", "P")), "priority outside": V.enum_fit(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "3-MEDIUM"))})


@query("temporal_precision", _counts("events", {"6 digits": "false", "3 digits": "ts <> date_trunc('millisecond', ts)", "0 digits": "ts <> date_trunc('second', ts)"}))
def temporal_precision(spark, d):
    return V.run_checks(_t(spark, d, "events"), {f"{n} digits": V.temporal_fit(F.col("ts"), n) for n in (6, 3, 0)})


@query("ts_range", _counts("events", {"as it is": "epoch(ts) < 1 OR epoch(ts) > 2147483647", "15 years on": "epoch(ts + INTERVAL 15 YEAR) < 1 OR epoch(ts + INTERVAL 15 YEAR) >= 2147483648", "54 years ago": "epoch(ts - INTERVAL 54 YEAR - INTERVAL 15 DAY) < 1"}))
def ts_range(spark, d):
    ts = F.col("ts")
    moved = {"as it is": ts, "15 years on": ts + F.expr("INTERVAL 15 YEAR"), "54 years ago": ts - F.expr("INTERVAL 54 YEAR") - F.expr("INTERVAL 15 DAY")}
    return V.run_checks(_t(spark, d, "events"), {n: V.ts_range(c) for n, c in moved.items()})


_EVENTS = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, nullif(event_type, 'click') AS event_type, value FROM events)"


def _events_with_nulls(spark, d):
    return _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.nullif("event_type", F.lit("click")).alias("event_type"), "value")


@query("null_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) = count({c}) AS never_null FROM {_EVENTS}" for c in ("event_id", "user_id", "event_type", "value")))
def null_profile(spark, d):
    return V.null_profile(_events_with_nulls(spark, d), ["event_id", "user_id", "event_type", "value"])


@query("drop_impact")
def drop_impact(spark, d):
    return V.drop_impact(_events_with_nulls(spark, d), ["event_id", "user_id", "event_type", "value"])


_DROPPED = ("event_id", "user_id", "event_type", "value")


@query("drop_impact_exact", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS rows_with_value, count(DISTINCT {c}) AS distinct_values FROM {_EVENTS}" for c in _DROPPED))
def drop_impact_exact(spark, d):
    return V.drop_impact(_events_with_nulls(spark, d), list(_DROPPED), exact=True)


@query("collation_collisions", "SELECT lower(rtrim(v)) AS folded, count(*) AS variants FROM (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE p_name || ' ' END AS v FROM part) GROUP BY 1 HAVING count(*) > 1")
def collation_collisions(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    return V.collation_collisions(_t(spark, d, "part").select(name.alias("v")), "v")


_KEY_SQL = "SELECT {name} count(*) FILTER (WHERE n > 1 AND whole) AS duplicate_groups, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1 AND whole), 0) AS BIGINT) AS surplus_rows, CAST(coalesce(sum(n) FILTER (WHERE NOT whole AND {primary}), 0) AS BIGINT) AS null_rows FROM (SELECT count(*) AS n, {whole} AS whole FROM {table} GROUP BY {cols})"


def _key_sql(table: str, cols: str, primary: bool = True, name: str = "", nulls: str = "true") -> str:
    return _KEY_SQL.format(table=table, cols=cols, primary="true" if primary else "false", name=f"'{name}' AS key_name," if name else "", whole=" AND ".join(f"({c}) IS NOT NULL" for c in cols.split(", ")))


@query("key_violations", _key_sql("lineitem", "l_orderkey, l_linenumber"))
def key_violations(spark, d):
    return R.key_violations(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate END AS l_shipdate FROM lineitem)"


@query("key_violations_multi", " UNION ALL ".join([_key_sql(_LINES, "l_orderkey, l_linenumber", True, "by line"), _key_sql(_LINES, "l_orderkey, l_partkey, l_suppkey", True, "by part"), _key_sql(_LINES, "l_orderkey, l_shipdate", False, "by date"), _key_sql(_LINES, "l_partkey, l_shipdate", True, "by part and date")]))
def key_violations_multi(spark, d):
    lines = _t(spark, d, "lineitem").withColumn("l_shipdate", F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate")))
    keys = {"by line": (["l_orderkey", "l_linenumber"], True), "by part": (["l_orderkey", "l_partkey", "l_suppkey"], True), "by date": (["l_orderkey", "l_shipdate"], False), "by part and date": (["l_partkey", "l_shipdate"], True)}
    return R.key_violations_multi(lines, keys)


@query("prefix_key", _key_sql("(SELECT substr(p_name, 1, 8) AS a, p_brand AS b FROM part)", "a, b", False))
def prefix_key(spark, d):
    return R.prefix_key_violations(_t(spark, d, "part"), {"p_name": 8, "p_brand": 0})


@query("candidate_keys", """
WITH s AS (SELECT * FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderdate')) v(c)),
n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_totalprice) AS c, count(DISTINCT o_orderdate) AS e, count(DISTINCT (o_custkey, o_totalprice)) AS bc, count(DISTINCT (o_custkey, o_orderdate)) AS be, count(DISTINCT (o_totalprice, o_orderdate)) AS ce FROM orders),
k AS (SELECT 'o_orderkey' AS key_columns, true AS ok, a = n AS u FROM n UNION ALL SELECT 'o_custkey', true, b = n FROM n UNION ALL SELECT 'o_totalprice', true, c = n FROM n UNION ALL SELECT 'o_orderdate', true, e = n FROM n
      UNION ALL SELECT 'o_orderkey,o_custkey', a < n AND b < n, a = n FROM n UNION ALL SELECT 'o_orderkey,o_totalprice', a < n AND c < n, a = n FROM n UNION ALL SELECT 'o_orderkey,o_orderdate', a < n AND e < n, a = n FROM n
      UNION ALL SELECT 'o_custkey,o_totalprice', b < n AND c < n, bc = n FROM n UNION ALL SELECT 'o_custkey,o_orderdate', b < n AND e < n, be = n FROM n UNION ALL SELECT 'o_totalprice,o_orderdate', c < n AND e < n, ce = n FROM n)
SELECT key_columns, ok AS minimal FROM k WHERE u
""")
def candidate_keys(spark, d):
    return V.candidate_keys(_t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], 2)


@query("fk_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def fk_orphans(spark, d):
    return R.fk_orphans(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], _t(spark, d, "part").where("p_size <= 25"), ["p_partkey"])


@query("fk_orphans_labels", "SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def fk_orphans_labels(spark, d):
    return R.fk_orphans(_t(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], _t(spark, d, "labels"), ["doc_id"])


@query("fk_ambiguous", "SELECT l_orderkey, l_linenumber, count(*) AS parents FROM lineitem p WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity > 40) GROUP BY ALL HAVING count(*) > 1")
def fk_ambiguous(spark, d):
    lines = _t(spark, d, "lineitem")
    return R.fk_ambiguous(lines.where("l_quantity > 40"), ["l_orderkey", "l_linenumber"], lines, ["l_orderkey", "l_linenumber"])


@query("fk_delete_impact", "SELECT CASE o_orderstatus WHEN 'F' THEN 'cascade' WHEN 'O' THEN 'set null' ELSE 'blocked' END AS effect, count(*) AS child_rows FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3) GROUP BY 1")
def fk_delete_impact(spark, d):
    gone = _t(spark, d, "customer").where("c_acctbal < 0 OR c_nationkey = 3")
    rule = F.when(F.col("o_orderstatus") == "F", "CASCADE").when(F.col("o_orderstatus") == "O", "SET NULL").otherwise("RESTRICT")
    return R.fk_delete_impact(_t(spark, d, "orders"), ["o_custkey"], gone, ["c_custkey"], rule)


#: The keys of the supplied tables, the ones to a supplier cleared and the ones to a part blocking.
LINKS = [
    K.Link("fk_nation", "nation", ("n_regionkey",), "region", ("r_regionkey",), "CASCADE"),
    K.Link("fk_customer", "customer", ("c_nationkey",), "nation", ("n_nationkey",), "CASCADE"),
    K.Link("fk_supplier", "supplier", ("s_nationkey",), "nation", ("n_nationkey",), "SET NULL"),
    K.Link("fk_orders", "orders", ("o_custkey",), "customer", ("c_custkey",), "CASCADE"),
    K.Link("fk_line_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "CASCADE"),
    K.Link("fk_line_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",), "SET NULL"),
]
_NODES = """nodes(tab, key, up, upkey, rule) AS (
  SELECT 'nation', n_nationkey, 'region', n_regionkey, 'fk_nation' FROM nation UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey, 'fk_customer' FROM customer
  UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey, 'fk_orders' FROM orders)"""


@query(
    "fk_delete_cascade",
    f"""
WITH RECURSIVE {_NODES}, gone(tab, key, link, level) AS (
  SELECT 'region', r_regionkey, NULL::VARCHAR, 0 FROM region WHERE r_regionkey IN (1, 3)
  UNION SELECT n.tab, n.key, n.rule, g.level + 1 FROM nodes n JOIN gone g ON n.up = g.tab AND n.upkey = g.key),
found AS (
  SELECT tab, link, 'delete' AS effect, level FROM gone
  UNION ALL SELECT 'lineitem', 'fk_line_order', 'delete', g.level + 1 FROM lineitem JOIN gone g ON g.tab = 'orders' AND g.key = l_orderkey
  UNION ALL SELECT 'supplier', 'fk_supplier', 'set null', g.level + 1 FROM supplier JOIN gone g ON g.tab = 'nation' AND g.key = s_nationkey)
SELECT tab AS table_name, link, effect, level, count(*) AS n_rows, false AS refused FROM found GROUP BY ALL
""",
)
def fk_delete_cascade(spark, d):
    tables = {t: _t(spark, d, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    return K.delete_effect(tables, LINKS, {"region": F.col("r_regionkey").isin(1, 3)})


@query(
    "fk_delete_refused",
    f"""
WITH RECURSIVE {_NODES}, gone(tab, key, link, level) AS (
  SELECT 'customer', c_custkey, NULL::VARCHAR, 0 FROM customer WHERE c_acctbal < 0
  UNION SELECT n.tab, n.key, n.rule, g.level + 1 FROM nodes n JOIN gone g ON n.up = g.tab AND n.upkey = g.key),
found AS (
  SELECT tab, link, 'delete' AS effect, level FROM gone
  UNION ALL SELECT 'lineitem', 'fk_line_order', 'blocked', g.level + 1 FROM lineitem JOIN gone g ON g.tab = 'orders' AND g.key = l_orderkey)
SELECT tab AS table_name, link, effect, level, count(*) AS n_rows, bool_or(bool_or(effect = 'blocked')) OVER () AS refused FROM found GROUP BY ALL
""",
)
def fk_delete_refused(spark, d):
    tables = {t: _t(spark, d, t) for t in ("customer", "orders", "lineitem")}
    links = [x if x.name != "fk_line_order" else K.Link(x.name, x.child, x.columns, x.parent, x.keys, "RESTRICT") for x in LINKS if x.name in ("fk_orders", "fk_line_order")]
    return K.delete_effect(tables, links, {"customer": F.col("c_acctbal") < 0})


@query(
    "fk_delete_cycle",
    """
WITH RECURSIVE e AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey // 70) * 70 + (o_orderkey + 7) % 70 WHEN o_orderkey > 0 THEN o_orderkey // 3 END AS up FROM orders),
gone(key, level) AS (
  SELECT key, 0 FROM e WHERE key % 1000 = 14
  UNION SELECT e.key, g.level + 1 FROM e JOIN gone g ON e.up = g.key WHERE g.level < 60)
SELECT 'orders' AS table_name, CASE WHEN level > 0 THEN 'fk_follows' END AS link, 'delete' AS effect, level, count(*) AS n_rows, false AS refused FROM (SELECT key, min(level) AS level FROM gone GROUP BY key) GROUP BY ALL
""",
)
def fk_delete_cycle(spark, d):
    """Orders that refer to orders: every seventh in rings of ten, the others in a tree."""
    up = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey DIV 70) * 70 + (o_orderkey + 7) % 70 WHEN o_orderkey > 0 THEN o_orderkey DIV 3 END")
    orders = _t(spark, d, "orders").select("o_orderkey", up.alias("o_follows"))
    return K.delete_effect({"orders": orders}, [K.Link("fk_follows", "orders", ("o_follows",), "orders", ("o_orderkey",), "CASCADE")], {"orders": F.col("o_orderkey") % 1000 == 14})


_CLAUSES = {"quantity over 1": "l_quantity > 1", "discount under 0.1": "l_discount < 0.1", "tax below discount": "l_tax <= l_discount", "unknown passes": "nullif(l_linenumber, 1) > 2"}


@query("check_violations", _counts("lineitem", {n: f"NOT ({c})" for n, c in _CLAUSES.items()}))
def check_violations(spark, d):
    return V.run_checks(_t(spark, d, "lineitem"), {n: V.clause(F.expr(c)) for n, c in _CLAUSES.items()})


_ENFORCED = {"quantity over 1": True, "discount under 0.1": False, "tax below discount": False, "quantity over 0": True}
_GATED = {n: ("l_quantity > 0" if n == "quantity over 0" else _CLAUSES[n], on) for n, on in _ENFORCED.items()}


@query(
    "check_violations_gate",
    f"""
SELECT check_name, rows_total, rows_affected, check_name LIKE 'quantity%' AS enforced, check_name LIKE 'quantity%' AND rows_affected > 0 AS gates
FROM ({_counts("lineitem", {n: f"NOT ({c})" for n, (c, _) in _GATED.items()})})
""",
)
def check_violations_gate(spark, d):
    return V.check_violations(_t(spark, d, "lineitem"), _GATED)


@query("generated_mismatch", _counts("lineitem", {"net price": "(CASE WHEN l_orderkey % 11 = 0 THEN l_extendedprice ELSE l_extendedprice * (1 - l_discount) END) IS DISTINCT FROM l_extendedprice * (1 - l_discount)", "flags": "(l_returnflag || l_linestatus) IS DISTINCT FROM nullif(l_returnflag || l_linestatus, 'NO')"}))
def generated_mismatch(spark, d):
    net = F.expr("l_extendedprice * (1 - l_discount)")
    stored = F.when(F.col("l_orderkey") % 11 == 0, F.col("l_extendedprice")).otherwise(net)
    flags = F.concat("l_returnflag", "l_linestatus")
    return V.run_checks(_t(spark, d, "lineitem"), {"net price": V.generated_mismatch(stored, net), "flags": V.generated_mismatch(flags, F.expr("nullif(l_returnflag || l_linestatus, 'NO')"))})


_LIMITS = {"tinyint": 127, "smallint": 32767, "smallint unsigned": 65535, "mediumint": 8388607, "int": 2147483647, "int unsigned": 4294967295, "bigint unsigned": 18446744073709551615}


@query("id_headroom", " UNION ALL ".join(f"SELECT '{t}' AS type, CAST(max(o_orderkey) AS DECIMAL(20,0)) AS largest, CAST({n} AS DECIMAL(20,0)) AS limit_value, CAST(max(o_orderkey) AS DOUBLE) / CAST({n} AS DOUBLE) AS used, CAST(max(o_orderkey) AS DOUBLE) / CAST({n} AS DOUBLE) > 0.8 AS exhausted FROM orders" for t, n in _LIMITS.items()))
def id_headroom(spark, d):
    return V.id_headroom(_t(spark, d, "orders"), "o_orderkey", list(_LIMITS))


@query("next_id", "SELECT coalesce(max(event_id), 0) + 1 AS next_id, CAST(5000 AS BIGINT) AS counter, 5000 < coalesce(max(event_id), 0) + 1 AS lags FROM events")
def next_id(spark, d):
    return V.next_id(_t(spark, d, "events"), "event_id", 5000)


_DATE = "CASE WHEN event_id % 13 = 0 THEN '0000-00-00' WHEN event_id % 17 = 0 THEN '2024-00-11' WHEN event_id % 19 = 0 THEN '2024-05-00 10:00:00' ELSE strftime(ts, '%Y-%m-%d') END"


@query("zero_dates", f"SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches({_DATE}, '^(0000-\\d\\d-\\d\\d|\\d{{4}}-00-\\d\\d|\\d{{4}}-\\d\\d-00)')) AS zero_dates FROM events GROUP BY event_type")
def zero_dates(spark, d):
    i = F.col("event_id")
    date = F.when(i % 13 == 0, "0000-00-00").when(i % 17 == 0, "2024-00-11").when(i % 19 == 0, "2024-05-00 10:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if(V.zero_dates(date)).alias("zero_dates"))


@query("vector_fit", _counts("embeddings", {"64 dimensions": "len(embedding) <> 64", "32 dimensions": "len(embedding) <> 32"}))
def vector_fit(spark, d):
    return V.run_checks(_t(spark, d, "embeddings"), {f"{n} dimensions": V.vector_fit(F.col("embedding"), n) for n in (64, 32)})


# Partitions

RANGE = P.Scheme("RANGE", ["o_totalprice"], {"low": 50000, "middle": 150000, "high": 300000, "top": 400000})
RANGE_ALL = P.Scheme("RANGE", ["o_totalprice"], {"low": 100000, "high": P.MAXVALUE})
LIST = P.Scheme("LIST", ["nullif(o_orderstatus, 'P')"], {"done": ["F"], "open": ["O"], "unknown": [None]})
HASH = P.Scheme("HASH", ["o_custkey - 700"], {f"p{i}": None for i in range(7)})
TUPLE = P.Scheme("RANGE COLUMNS", ["l_returnflag", "l_linenumber"], {"a": ("A", 4), "n": ("N", 3), "n2": ("N", P.MAXVALUE), "rest": (P.MAXVALUE, P.MAXVALUE)})

_RANGE_SQL = "CASE WHEN o_totalprice IS NULL OR o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'middle' WHEN o_totalprice < 300000 THEN 'high' WHEN o_totalprice < 400000 THEN 'top' END"
_TUPLE_SQL = "CASE WHEN (l_returnflag, l_linenumber) < ('A', 4) THEN 'a' WHEN (l_returnflag, l_linenumber) < ('N', 3) THEN 'n' WHEN l_returnflag <= 'N' THEN 'n2' ELSE 'rest' END"


def _stats_sql(table: str, route: str, names: list[str]) -> str:
    listed = ", ".join(f"('{n}')" for n in names)
    return f"""
WITH c AS (SELECT {route} AS p, count(*) AS n FROM {table} GROUP BY 1), l(p) AS (VALUES {listed}),
e AS (SELECT coalesce(c.p, l.p) AS partition_name, coalesce(n, 0) AS n_rows FROM c FULL JOIN l ON c.p = l.p)
SELECT partition_name, n_rows, n_rows = 0 AS empty, CASE WHEN partition_name IS NOT NULL THEN round(n_rows / ((SELECT sum(n_rows) FROM e WHERE partition_name IS NOT NULL) / {len(names)}), 6) END AS skew FROM e
"""


@query("partition_range", _stats_sql("orders", _RANGE_SQL, RANGE.names()))
def partition_range(spark, d):
    return P.partition_stats(_t(spark, d, "orders"), RANGE)


@query("partition_list", _stats_sql("orders", "CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'unknown' END", LIST.names()))
def partition_list(spark, d):
    return P.partition_stats(_t(spark, d, "orders"), LIST)


@query("partition_hash", _stats_sql("orders", "'p' || (((o_custkey - 700) % 7 + 7) % 7)", HASH.names()))
def partition_hash(spark, d):
    return P.partition_stats(_t(spark, d, "orders"), HASH)


@query("partition_tuple", _stats_sql("lineitem", _TUPLE_SQL, TUPLE.names()))
def partition_tuple(spark, d):
    return P.partition_stats(_t(spark, d, "lineitem"), TUPLE)


@query("repartition_impact", f"SELECT o, n AS new_partition, o AS old_partition, count(*) AS n_rows, o IS DISTINCT FROM n AS moves, n IS NULL AS lost FROM (SELECT CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS o, {_RANGE_SQL} AS n FROM orders) GROUP BY o, n".replace("SELECT o, n AS", "SELECT n AS", 1))
def repartition_impact(spark, d):
    return P.repartition_impact(_t(spark, d, "orders"), RANGE_ALL, RANGE)


@query("drop_partition_impact", f"SELECT p AS partition_name, count(*) AS n_rows FROM (SELECT {_RANGE_SQL} AS p FROM orders) WHERE p IN ('low', 'top') GROUP BY p")
def drop_partition_impact(spark, d):
    return P.drop_partition_impact(_t(spark, d, "orders"), RANGE, ["low", "top"])


# Evidence

@query("violation_sample", """
WITH f AS (SELECT o_orderkey, 'cheap' AS check_name FROM orders WHERE NOT (o_totalprice > 2000) UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY check_name ORDER BY o_orderkey) AS INTEGER) AS sample_rank FROM f)
SELECT * FROM r WHERE sample_rank <= 3
""")
def violation_sample(spark, d):
    bad = {"cheap": V.clause(F.expr("o_totalprice > 2000")), "urgent": V.enum_fit(F.col("o_orderpriority"), ("1-URGENT",)), "status": V.enum_fit(F.col("o_orderstatus"), ("F", "O"))}
    return V.violation_sample(_t(spark, d, "orders"), bad, ["o_orderkey"], 3)


@query("prefix_selectivity", " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS prefix_length, count(DISTINCT substr(p_name, 1, {n})) AS prefixes, count(DISTINCT p_name) AS full_values FROM part" for n in (1, 4, 8, 16)))
def prefix_selectivity(spark, d):
    return V.prefix_selectivity(_t(spark, d, "part"), "p_name", [1, 4, 8, 16])


_INDEXES = {"supplier": ["l_suppkey"], "supplier and line": ["l_suppkey", "l_linenumber"], "flags": ["l_returnflag", "l_linestatus"]}


@query("index_cardinality", " UNION ALL ".join(f"SELECT '{n}' AS index_name, count(DISTINCT ({', '.join(c)})) AS distinct_values FROM lineitem" for n, c in _INDEXES.items()))
def index_cardinality(spark, d):
    return V.index_cardinality(_t(spark, d, "lineitem"), _INDEXES)


#: Columns of the tables whose sizes are asked for, all of them: as text, or bytes of an item of an array.
_SIZED = {
    "region": {"r_regionkey": 0, "r_name": 0},
    "nation": {"n_nationkey": 0, "n_name": 0, "n_regionkey": 0},
    "part": {"p_partkey": 0, "p_name": 0, "p_brand": 0, "p_type": 0, "p_size": 0, "p_retailprice": 0},
    "embeddings": {"vec_id": 0, "embedding": 4, "label": 0},
}


def _sizes_sql(table: str) -> str:
    widths = [f"len({c}) * {n}" if n else f"strlen(CAST({c} AS VARCHAR))" for c, n in _SIZED[table].items()]
    row = " + ".join(f"coalesce({w}, 0)" for w in widths)
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, CAST(coalesce(sum({row}), 0) AS BIGINT) AS n_bytes FROM {table}"


@query("table_sizes", " UNION ALL ".join(map(_sizes_sql, _SIZED)))
def table_sizes(spark, d):
    return V.table_sizes({t: _t(spark, d, t) for t in _SIZED})


@query("non_empty", "SELECT 'orders' AS table_name UNION ALL SELECT 'late orders' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderdate > TIMESTAMP '2030-01-01') UNION ALL SELECT 'benchmark'")
def non_empty(spark, d):
    orders = _t(spark, d, "orders")
    return V.non_empty({"orders": orders, "late orders": orders.where("o_orderdate > TIMESTAMP '2030-01-01'"), "benchmark": _t(spark, d, "benchmark")})


# Conforming

CONTRACT = Contract(
    [
        Target("line_no", "tinyint unsigned", nullable=False, source="l_linenumber"),
        Target("order_no", "bigint unsigned", nullable=False, source="l_orderkey"),
        Target("price", "decimal(7,2)", source="l_extendedprice"),
        Target("flag", "enum('A','N')", source="l_returnflag"),
        Target("net", "double", generated="round(l_extendedprice * (1 - l_discount), 4)"),
        Target("currency", "char(3)", nullable=False, default="'EUR'"),
        Target("note", "varchar(20)", nullable=False),
    ],
    clauses={"quantity": "l_quantity < 48"},
)
_BAD = f"(round({_P}, 2) <> {_P} OR abs({_P}) >= 100000)"
_FIT = f"NOT {_BAD} AND l_returnflag IN ('A', 'N') AND l_quantity < 48"


@query("conform_ok", f"SELECT CAST(l_linenumber AS SMALLINT) AS line_no, CAST(l_orderkey AS DECIMAL(20,0)) AS order_no, CAST(l_extendedprice AS DECIMAL(7,2)) AS price, l_returnflag AS flag, round(l_extendedprice * (1 - l_discount), 4) AS net, 'EUR' AS currency, '' AS note FROM lineitem WHERE {_FIT}")
def conform_ok(spark, d):
    return conform_split(_t(spark, d, "lineitem"), CONTRACT)[0]


@query("conform_quarantine", f"SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN {_BAD} THEN 'price: type' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag: type' END, CASE WHEN NOT l_quantity < 48 THEN 'check quantity' END) AS reasons FROM lineitem WHERE NOT ({_FIT})")
def conform_quarantine(spark, d):
    return conform_split(_t(spark, d, "lineitem"), CONTRACT)[1].select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


@query("conform_dry_run", f"""
WITH r AS (SELECT {_BAD} AS a, l_returnflag NOT IN ('A', 'N') AS b, NOT l_quantity < 48 AS c FROM lineitem)
SELECT NULL AS reason, count(*) AS n_rows, count(*) FILTER (WHERE a OR b OR c) AS n_rejected FROM r
UNION ALL SELECT 'price: type', count(*), count(*) FROM r WHERE a HAVING count(*) > 0 UNION ALL SELECT 'flag: type', count(*), count(*) FROM r WHERE b HAVING count(*) > 0 UNION ALL SELECT 'check quantity', count(*), count(*) FROM r WHERE c HAVING count(*) > 0
""")
def conform_dry(spark, d):
    return conform_dry_run(_t(spark, d, "lineitem"), CONTRACT)


@query("fill_defaults", "SELECT event_id, coalesce(user_id, 0) AS user_id, coalesce(event_type, 'none') AS event_type, value FROM " + _EVENTS)
def fill(spark, d):
    contract = Contract([Target("event_id", "bigint"), Target("user_id", "bigint", nullable=False), Target("event_type", "varchar(16)", nullable=False, default="'none'"), Target("value", "double")])
    return fill_defaults(_events_with_nulls(spark, d), contract)


@query("fleet_plan", """
WITH s AS (SELECT c_nationkey AS shard, count(*) AS rows_total, CAST(sum(strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + strlen(CAST(c_nationkey AS VARCHAR)) + strlen(CAST(c_acctbal AS VARCHAR)) + strlen(c_mktsegment)) AS BIGINT) AS n_bytes,
  count(*) FILTER (WHERE c_custkey > 32767 OR c_custkey < -32768) AS a, count(*) FILTER (WHERE length(c_name) > 17) AS b, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')) AS c FROM customer GROUP BY 1),
k AS (SELECT *, (a > 0 OR b > 0 OR c > 0) AND n_bytes >= 2000 AS skipped FROM s)
SELECT shard, 'modify c_custkey' AS clause, true AS unsafe, a AS rows_affected, rows_total, n_bytes, skipped FROM k UNION ALL SELECT shard, 'modify c_name', true, b, rows_total, n_bytes, skipped FROM k
UNION ALL SELECT shard, 'modify c_mktsegment', true, c, rows_total, n_bytes, skipped FROM k
""")
def fleet_plan_customer(spark, d):
    changes = [ColumnChange("c_custkey", "bigint(20)", "smallint(6)"), ColumnChange("c_name", "varchar(64)", "varchar(17)"), ColumnChange("c_mktsegment", "varchar(10)", "enum('BUILDING','MACHINERY','HOUSEHOLD','FURNITURE')")]
    return fleet_plan(_t(spark, d, "customer").withColumnRenamed("c_nationkey", "shard"), "shard", changes, 2000)


_KEY_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


def _minimal_keys_sql(table: str, columns: list[str], k: int) -> str:
    """Counts every set of columns and keeps those that are unique and hold no smaller one."""
    sets = [s for n in range(1, k + 1) for s in combinations(columns, n)]
    unique = lambda s: f"count(*) = count(DISTINCT ({', '.join(s)}{', 0' if len(s) == 1 else ''})) AND {' AND '.join(f'count(*) = count({c})' for c in s)}"
    counts = ", ".join(f"{unique(s)} AS u{i}" for i, s in enumerate(sets))
    rows = ", ".join(f"('{','.join(s)}', {len(s)}, {sum(1 << columns.index(c) for c in s)}, u{i})" for i, s in enumerate(sets))
    return f"""WITH c AS (SELECT {counts} FROM {table}), s AS (SELECT v.* FROM c, LATERAL (VALUES {rows}) v(key_columns, width, m, u))
SELECT key_columns, width FROM s WHERE u AND NOT EXISTS (SELECT 1 FROM s o WHERE o.u AND o.m <> s.m AND o.m & s.m = o.m)"""


@query("minimal_keys_lineitem", _minimal_keys_sql("lineitem", _KEY_COLUMNS, 5))
def minimal_keys_lineitem(spark, d):
    return M.minimal_keys(_t(spark, d, "lineitem"), _KEY_COLUMNS, 5)


@query("minimal_keys_events", _minimal_keys_sql("(SELECT ts, user_id, event_type, value, nullif(event_id % 50, 7) AS slot, event_id // 3 AS third FROM events)", ["ts", "user_id", "event_type", "value", "slot", "third"], 4))
def minimal_keys_events(spark, d):
    events = _t(spark, d, "events").selectExpr("ts", "user_id", "event_type", "value", "nullif(event_id % 50, 7) AS slot", "event_id DIV 3 AS third")
    return M.minimal_keys(events, ["ts", "user_id", "event_type", "value", "slot", "third"], 4)


_WORDS = "unnest(regexp_extract_all(text, '[a-zA-ZÀ-ÖØ-öø-ÿ]+'))"
#: How DuckDB folds what a collation holds equal: accents, case, trailing spaces.
_FOLDS = {
    "utf8mb4_0900_ai_ci": "strip_accents(lower(replace(v, 'ß', 'ss')))", "utf8mb4_0900_as_ci": "lower(v)", "utf8mb4_0900_as_cs": "v",
    "utf8mb4_unicode_ci": "strip_accents(lower(replace(rtrim(v, ' '), 'ß', 'ss')))", "utf8mb4_bin": "rtrim(v, ' ')",
}
#: Words with their first letter as it is and upper, every fifth document's with a space at the end, ss as in the text and as ß.
_SPELT = f"""SELECT CASE WHEN doc_id % 5 = 0 THEN w || ' ' WHEN doc_id % 7 = 0 AND NOT contains(w, 'ß') THEN upper(w) WHEN doc_id % 11 = 0 THEN replace(w, 'ss', 'ß') ELSE w END AS v
FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"""


@query("collation_variants", " UNION ALL ".join(f"SELECT '{n}' AS collation, count(*) AS n_groups, CAST(sum(variants) AS BIGINT) AS n_variants, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(DISTINCT v) AS variants, count(*) AS n FROM ({_SPELT}) GROUP BY {f} HAVING count(DISTINCT v) > 1)" for n, f in _FOLDS.items() if n != "utf8mb4_0900_as_cs"))
def collation_variants(spark, d):
    words = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-zA-ZÀ-ÖØ-öø-ÿ]+"), 0)).alias("w"))
    spelt = F.when(F.col("doc_id") % 5 == 0, F.concat("w", F.lit(" "))).when((F.col("doc_id") % 7 == 0) & ~F.col("w").contains("ß"), F.upper("w")).when(F.col("doc_id") % 11 == 0, F.replace("w", F.lit("ss"), F.lit("ß"))).otherwise(F.col("w"))
    words = stored(words.groupBy(spelt.alias("v")).agg(F.count("*").alias("n")))
    out = None
    for name in _FOLDS:
        if name == "utf8mb4_0900_as_cs":
            continue
        groups = words.groupBy(C.collated("v", name).alias("c")).agg(F.count("*").alias("variants"), F.sum("n").alias("n")).where("variants > 1")
        row = groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("variants"), F.lit(0)).alias("n_variants"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("collation"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_NAMED = "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN replace(p_name, 'e', 'é') || ' ' ELSE p_name END AS p_name, p_brand FROM part"


@query("collation_keys", "SELECT CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM (" + _NAMED + ") GROUP BY strip_accents(lower(rtrim(p_name, ' '))), lower(p_brand))")
def collation_keys(spark, d):
    named = _t(spark, d, "part").selectExpr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN concat(replace(p_name, 'e', 'é'), ' ') ELSE p_name END AS p_name", "p_brand")
    return C.key_violations(named, {"p_name": "utf8mb4_general_ci", "p_brand": "utf8mb4_0900_as_ci"})


@query("collation_orphans", "WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) || 'x' END AS seg, c_custkey FROM customer), p AS (SELECT DISTINCT lower(replace(c_mktsegment, 'I', 'í')) AS seg FROM customer) SELECT c_custkey FROM c WHERE strip_accents(lower(seg)) NOT IN (SELECT strip_accents(seg) FROM p)")
def collation_orphans(spark, d):
    customers = _t(spark, d, "customer")
    child = customers.selectExpr("CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE concat(lower(c_mktsegment), 'x') END AS seg", "c_custkey")
    parent = customers.selectExpr("lower(replace(c_mktsegment, 'I', 'í')) AS key_seg")
    return C.orphans(child, "seg", parent, "key_seg", "utf8mb4_0900_ai_ci").select("c_custkey")
