"""Registered queries of changes: partition lists, dropped schemas, modifiers of keys and metadata, broken change lists, history as
intervals, sketches, schemes of thousands of partitions, and lint in order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fleet_queries import _COLS, _DIFFERS, _KEY, _LINT, _LINT_WITH, _SNAP, _catalog, _with, columns
from plumbline.fleet_queries import ORACLES as FLEET_ORACLES
from plumbline.operators import partitions as P
from plumbline.operators import sketches as H
from plumbline.operators.checks import ColumnChange
from plumbline.operators.conform import resumed_plan
from plumbline.plans import diff as D
from plumbline.plans import lint as L
from plumbline.plans import safety as U
from plumbline.sources import catalog as S
from plumbline.sources import fleet as X
from plumbline.sources.staging import shared_dir, stored
from plumbline.streaming.keys import unique_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"a query named {name} is already registered")
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Partitions

_C = "c.c_custkey"
_SHARD = f"CAST({_C} AS VARCHAR(20)) AS schema_name"
_TABLES3 = "(VALUES (1, 'orders'), (2, 'lineitem'), (3, 'events')) AS b(tno, t)"
_SLOTS = "(VALUES (0), (1), (2), (3), (4), (5), (6)) AS v(i)"
_PART = "concat('p', CAST(i AS VARCHAR(5))) AS partition_name"


def _partitions(present: str, bound: str, method: str) -> str:
    return f"SELECT {_SHARD}, t AS table_name, i AS ordinal, {_PART}, CAST({bound} AS VARCHAR(20)) AS bound, '' AS comment, {method} AS method, 'id' AS expression FROM {{customer}} c CROSS JOIN {_TABLES3} CROSS JOIN {_SLOTS} WHERE {present}"


#: Partitions that the shards have and those that they should have: lists grow and lose their first, bounds and methods change.
HAVE = _partitions(f"i < 3 + ({_C} + tno) % 3 AND ({_C} + tno) % 11 <> 0", "i * 100", f"CASE WHEN {_C} % 5 = 0 THEN 'HASH' ELSE 'RANGE' END")
WANT = _partitions(f"i >= ({_C} + tno) % 2 AND i < 4 + {_C} % 3 AND ({_C} + tno) % 7 <> 0", f"i * 100 + CASE WHEN {_C} % 13 = 0 AND i = 2 THEN 5 ELSE 0 END", f"CASE WHEN {_C} % 5 = 0 THEN 'HASH' WHEN {_C} % 17 = 0 THEN 'LIST' ELSE 'RANGE' END")
_EVERY = f"SELECT {_SHARD}, t AS table_name, 'InnoDB' AS engine FROM {{customer}} c CROSS JOIN {_TABLES3}"


def _partitioned(spark: SparkSession, d: str, statement: str) -> DataFrame:
    every = X.derived(spark, d, _EVERY)
    loaded = S.load_partitions(X.derived(spark, d, statement), every).withColumnRenamed("partitions", "_p")
    listed = F.transform("_p", lambda p: F.struct(p["partition_name"].alias("name"), p["bound"].alias("bound")))
    known = loaded.select(*S.TABLE_KEY, F.col("method").alias("partition_method"), F.col("expression").alias("partition_expression"), listed.alias("partition_list"))
    return every.select(*S.TABLE_KEY).join(known, S.TABLE_KEY, "left").na.fill("", ["partition_method", "partition_expression"])


_PARTITION_SQL = _with(pa=HAVE, pb=WANT, every=_EVERY) + """,
a AS (SELECT schema_name, table_name, any_value(method) AS m, list(partition_name ORDER BY ordinal) AS names, list(partition_name || ':' || bound ORDER BY ordinal) AS l FROM pa GROUP BY 1, 2),
b AS (SELECT schema_name, table_name, any_value(method) AS m, list(partition_name ORDER BY ordinal) AS names, list(partition_name || ':' || bound ORDER BY ordinal) AS l FROM pb GROUP BY 1, 2),
j AS (SELECT mode, schema_name, table_name, b.m AS m, len(list_filter(a.names, lambda x: NOT list_contains(b.names, x))) AS gone,
  CASE WHEN a.m IS NULL AND b.m IS NULL THEN NULL WHEN a.m IS NULL THEN CASE WHEN mode <> 'remove' THEN 'partition by' END WHEN b.m IS NULL THEN CASE WHEN mode <> 'keep' THEN 'remove partitioning' END
       WHEN a.m <> b.m THEN CASE WHEN mode = 'modify' THEN 'partition by' END WHEN a.l <> b.l THEN 'modify partitions' END AS clause
  FROM every LEFT JOIN a USING (schema_name, table_name) LEFT JOIN b USING (schema_name, table_name) CROSS JOIN (VALUES ('modify'), ('keep'), ('remove')) x(mode)),
r AS (SELECT *, CASE WHEN clause = 'modify partitions' THEN gone ELSE 0 END AS n_dropped, clause <> 'modify partitions' OR m IN ('RANGE', 'LIST') AS supported FROM j WHERE clause IS NOT NULL)"""


@query("fleet_partition_changes", _PARTITION_SQL + " SELECT mode, clause, supported, CAST(n_dropped AS INTEGER) AS n_dropped, n_dropped > 0 AS unsafe, CASE WHEN n_dropped > 0 THEN 'partitions dropped' END AS reason_code, count(*) AS n FROM r GROUP BY ALL")
def fleet_partition_changes(spark, d):
    a, b = stored(_partitioned(spark, d, HAVE)), stored(_partitioned(spark, d, WANT))
    out = None
    for mode in ("modify", "keep", "remove"):
        found = D.partition_changes(a, b, mode).withColumns({"mode": F.lit(mode), "n_objects": F.lit(0), "signature_changed": F.lit(False)})
        out = found if out is None else out.unionByName(found)
    return U.unsafe_objects(out).groupBy("mode", "clause", "supported", "n_dropped", "unsafe", "reason_code").agg(F.count("*").alias("n"))


@query("fleet_dropped_partitions", _PARTITION_SQL + " SELECT schema_name, table_name, CAST(n_dropped AS INTEGER) AS n_dropped FROM r WHERE mode = 'modify' AND n_dropped > 0")
def fleet_dropped_partitions(spark, d):
    changes = D.partition_changes(_partitioned(spark, d, HAVE), _partitioned(spark, d, WANT)).withColumns({"n_objects": F.lit(0), "signature_changed": F.lit(False)})
    return U.unsafe_objects(changes).where("unsafe").select(*S.TABLE_KEY, "n_dropped")


# Schemas

_SCHEMAS = f"SELECT {_SHARD}, 'utf8mb4' AS charset, 'utf8mb4_general_ci' AS collation FROM {{customer}} c"
_EMPTY = f"SELECT concat('empty', CAST({_C} AS VARCHAR(20))) AS schema_name, 'utf8mb4' AS charset, 'utf8mb4_general_ci' AS collation FROM {{customer}} c WHERE {_C} % 19 = 0"


@query(
    "fleet_schema_drops",
    _with(s=f"{_SCHEMAS} UNION ALL {_EMPTY}", w=f"{_SCHEMAS} WHERE {_C} % 9 <> 1", t=X.ACTUAL_TABLES, r=X.ACTUAL_ROUTINES)
    + ", n AS (SELECT schema_name, count(*) AS n FROM (SELECT schema_name FROM t UNION ALL SELECT schema_name FROM r) GROUP BY 1) SELECT schema_name, coalesce(n, 0) AS n_objects, coalesce(n, 0) > 0 AS unsafe, CASE WHEN n > 0 THEN 'schema with objects dropped' END AS reason_code FROM s ANTI JOIN w USING (schema_name) LEFT JOIN n USING (schema_name)",
)
def fleet_schema_drops(spark, d):
    have = X.derived(spark, d, f"{_SCHEMAS} UNION ALL {_EMPTY}")
    drops = U.schema_drops(D.diff_schemas(have, X.derived(spark, d, f"{_SCHEMAS} WHERE {_C} % 9 <> 1")), X.derived(spark, d, X.ACTUAL_TABLES), X.derived(spark, d, X.ACTUAL_ROUTINES))
    found = U.unsafe_objects(drops.withColumns({"n_dropped": F.lit(0), "signature_changed": F.lit(False)}))
    return found.select("schema_name", "n_objects", "unsafe", "reason_code")


# Modifiers

_STRICT = " CROSS JOIN (VALUES (true), (false)) x(strict) WHERE NOT cosmetic OR strict GROUP BY ALL"


@query("fleet_key_modifiers", f"SELECT 'foreign keys' AS kind, strict, clause, count(*) AS n FROM ({FLEET_ORACLES['fleet_fk_diff']}){_STRICT} UNION ALL SELECT 'checks', strict, clause, count(*) FROM ({FLEET_ORACLES['fleet_check_diff']}){_STRICT}")
def fleet_key_modifiers(spark, d):
    from plumbline.fleet_queries import QUERIES as fleet

    out = None
    for kind, name in (("foreign keys", "fleet_fk_diff"), ("checks", "fleet_check_diff")):
        changes = stored(fleet[name](spark, d))
        for strict in (True, False):
            # Only the switch of the kind may count.
            mods = D.Modifiers(strict_keys=strict == (kind == "foreign keys"), strict_checks=strict == (kind == "checks"))
            rows = D.apply_key_modifiers(changes, mods).groupBy("clause").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), "clause", "n")
            out = rows if out is None else out.unionByName(rows)
    return out


_MODE = f"CASE WHEN CAST(schema_name AS INTEGER) % 3 = 0 THEN 'ANSI' ELSE '' END AS sql_mode, CASE WHEN CAST(schema_name AS INTEGER) % 4 = 0 THEN 'utf8mb4_bin' ELSE 'utf8mb4_general_ci' END AS collation"
_PLAIN_MODE = "'' AS sql_mode, 'utf8mb4_general_ci' AS collation"
_RA, _RB = f"SELECT x.*, {_PLAIN_MODE} FROM ({X.DESIRED_ROUTINES}) x", f"SELECT x.*, {_MODE} FROM ({X.ACTUAL_ROUTINES}) x"


@query(
    "fleet_metadata_modifiers",
    _with(a=_RA, b=_RB)
    + """, j AS (SELECT a.schema_name, compare, lax, b.body IS NULL AS gone, a.params <> b.params OR a.body <> b.body OR a.definer <> b.definer OR (compare AND (a.sql_mode <> b.sql_mode OR a.collation <> b.collation)) AS hard,
  a.security <> b.security OR (NOT lax AND a.comment <> b.comment) AS soft FROM a LEFT JOIN b USING (schema_name, routine_type, routine_name) CROSS JOIN (VALUES (true, false), (false, false), (false, true)) x(compare, lax))
SELECT compare AS compare_metadata, lax AS lax_comments, CASE WHEN gone THEN 'drop routine' WHEN hard THEN 'replace routine' ELSE 'alter routine' END AS clause, count(*) AS n FROM j WHERE gone OR hard OR soft GROUP BY ALL""",
)
def fleet_metadata_modifiers(spark, d):
    a, b = X.derived(spark, d, _RA), X.derived(spark, d, _RB)
    out = None
    for compare, lax in ((True, False), (False, False), (False, True)):
        rows = D.diff_routines(a, b, D.Modifiers(compare_metadata=compare, lax_comments=lax)).groupBy("clause").agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(compare).alias("compare_metadata"), F.lit(lax).alias("lax_comments"), "clause", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


# Verification and history


@query("fleet_verify_broken", _COLS + f" SELECT schema_name, table_name, column_name, 'definition' AS problem, CAST(2 AS BIGINT) AS n FROM a JOIN b USING ({_KEY}) WHERE {_DIFFERS} AND CAST(schema_name AS INTEGER) % 3 = 0")
def fleet_verify_broken(spark, d):
    """Changes of every third shard give the wrong comment: each leaves the column as it came out and as it should have."""
    a, b = columns(spark, d)
    changes = D.column_changes(a, b)
    wrong = (F.col("clause") == "modify column") & (F.pmod(F.col("schema_name").cast("int"), F.lit(3)) == 0)
    broken = changes.withColumn("new", F.when(wrong, F.col("new").withField("comment", F.lit("wrong"))).otherwise(F.col("new")))
    return D.verify(a, b, broken, X.partitions(spark, d)).groupBy(*D.COLUMN_KEY, "problem").agg(F.count("*").alias("n"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    a, b = columns(spark, d)
    out = D.opened(a, 1)
    for n, snapshot in ((2, b), (3, a.where("ordinal % 5 <> 3"))):
        out = D.merged(out, snapshot, n)
    return out


@query("fleet_history_merged", FLEET_ORACLES["fleet_history"])
def fleet_history_merged(spark, d):
    return D.events(_intervals(spark, d))


@query("fleet_intervals", _COLS + f""", s AS ({_SNAP}), seen AS (SELECT DISTINCT schema_name, table_name, snapshot FROM s), k AS (SELECT DISTINCT {_KEY} FROM s), g AS (SELECT {_KEY}, snapshot, column_type FROM k JOIN seen USING (schema_name, table_name) LEFT JOIN s USING ({_KEY}, snapshot)),
l AS (SELECT *, lag(column_type) OVER w AS before, lead(snapshot) OVER w AS next_seen FROM g WINDOW w AS (PARTITION BY {_KEY} ORDER BY snapshot)),
r AS (SELECT *, count(*) FILTER (WHERE before IS DISTINCT FROM column_type) OVER (PARTITION BY {_KEY} ORDER BY snapshot) AS run FROM l),
i AS (SELECT min(snapshot) AS valid_from, list(next_seen ORDER BY snapshot DESC)[1] AS valid_to FROM r WHERE column_type IS NOT NULL GROUP BY {_KEY}, run)
SELECT valid_from, valid_to, count(*) AS n FROM i GROUP BY ALL""")
def fleet_intervals(spark, d):
    return _intervals(spark, d).groupBy("valid_from", "valid_to").agg(F.count("*").alias("n"))


# Sketches

_SETS = {"order": ["l_orderkey"], "part": ["l_partkey"], "part and supplier": ["l_partkey", "l_suppkey"], "day": ["l_shipdate"], "unknown": ["l_maybe"]}


@query(
    "sketched_cardinalities",
    "WITH x AS (SELECT *, CASE WHEN l_linenumber > 2 THEN l_orderkey END AS l_maybe FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{n}' AS set_name, count(DISTINCT (l_returnflag, l_linestatus)) AS n_shards, count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}) AS n_rows, count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in cols)}) AS nulls, count(DISTINCT {cols[0] if len(cols) == 1 else '(' + ', '.join(cols) + ')'}) AS exact, true AS within_error FROM x" for n, cols in _SETS.items()),
)
def sketched_cardinalities(spark, d):
    """Shards by flag and status; those of one flag are sketched first from half their rows, then anew. The exact numbers are counted beside."""
    rows = _t(spark, d, "lineitem").withColumn("l_maybe", F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")))
    shard = ["l_returnflag", "l_linestatus"]
    known = stored(H.sketched(rows.where("l_returnflag <> 'A' OR l_orderkey % 2 = 0"), shard, _SETS))
    known = H.refreshed(known, stored(H.sketched(rows.where("l_returnflag = 'A'"), shard, _SETS)), shard)
    found = H.cardinalities(known)
    exact = rows.agg(*[F.count_distinct(*[F.col(c) for c in cols]).alias(f"_{i}") for i, cols in enumerate(_SETS.values())])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(n).alias("set_name"), F.col(f"_{i}").alias("exact")) for i, n in enumerate(_SETS)])).alias("r")).select("r.*")
    return found.join(exact, "set_name").select("set_name", "n_shards", "n_rows", "nulls", "exact", ((F.col("exact") >= F.col("low")) & (F.col("exact") <= F.col("high"))).alias("within_error"))


# Thousands of partitions

_BOUNDS = 5000


@query("partition_many_bounds", f"SELECT CASE WHEN l_extendedprice >= {_BOUNDS * 20} THEN 'rest' ELSE 'p' || CAST(floor(l_extendedprice / 20) AS BIGINT) END AS partition_name, count(*) AS n_rows FROM lineitem GROUP BY 1")
def partition_many_bounds(spark, d):
    scheme = P.Scheme("RANGE", ["l_extendedprice"], {**{f"p{i}": 20.0 * (i + 1) for i in range(_BOUNDS)}, "rest": P.MAXVALUE})
    return P.routed(_t(spark, d, "lineitem"), scheme).groupBy("partition_name").agg(F.count("*").alias("n_rows"))


@query("partition_many_tuples", "SELECT CASE WHEN l_partkey < 500 * 4 THEN 't' || (l_partkey // 4 * 2 + CASE WHEN l_partkey % 4 > 1 OR (l_partkey % 4 = 1 AND coalesce(nullif(l_linenumber, 3), 0) >= 4) THEN 1 ELSE 0 END) END AS partition_name, count(*) AS n_rows FROM lineitem GROUP BY 1")
def partition_many_tuples(spark, d):
    """Bounds (4i + 1, 4), (4i + 4, lowest), ...; a line number 3 is NULL here, the lowest."""
    bounds = {f"t{2 * i + k}": (4 * i + 1, 4) if k == 0 else (4 * i + 3, P.MAXVALUE) for i in range(500) for k in (0, 1)}
    return P.routed(_t(spark, d, "lineitem"), P.Scheme("RANGE COLUMNS", ["l_partkey", "nullif(l_linenumber, 3)"], bounds)).groupBy("partition_name").agg(F.count("*").alias("n_rows"))


@query("partition_many_members", "SELECT CASE WHEN k IS NULL THEN 'none' WHEN k < 10000 AND k % 5 <> 4 THEN 'l' || (k % 97) END AS partition_name, count(*) AS n_rows FROM (SELECT nullif(l_orderkey, 3) AS k FROM lineitem) GROUP BY 1")
def partition_many_members(spark, d):
    members: dict[str, list] = {f"l{i}": [] for i in range(97)}
    for k in range(10000):
        if k % 5 != 4:
            members[f"l{k % 97}"].append(k)
    return P.routed(_t(spark, d, "lineitem"), P.Scheme("LIST", ["nullif(l_orderkey, 3)"], {**members, "none": [None]})).groupBy("partition_name").agg(F.count("*").alias("n_rows"))


# Lint


@query("lint_nullable", _LINT_WITH + " SELECT schema_name, 'table' AS object_type, table_name AS object_name, 'nullable' AS rule, column_name AS member, 'warning' AS severity FROM c WHERE nullable")
def lint_nullable(spark, d):
    cat, opts = _catalog(spark, d)
    return L.lint(cat, L.Options({n: "warning" if n == "nullable" else "off" for n in L.rules()}, opts.allow, opts.reserved))


@query("lint_ordered", _LINT + " SELECT *, CAST(row_number() OVER (PARTITION BY schema_name ORDER BY object_type, object_name, rule, member) AS INTEGER) AS position FROM n")
def lint_ordered(spark, d):
    """The place of each note among its target's."""
    order = Window.partitionBy("schema_name").orderBy("object_type", "object_name", "rule", "member")
    return L.lint(*_catalog(spark, d)).withColumn("position", F.row_number().over(order))


@query("first_timestamps", _LINT_WITH + " SELECT schema_name, table_name, column_name FROM y WHERE base = 'timestamp' QUALIFY row_number() OVER (PARTITION BY schema_name, table_name ORDER BY ordinal) = 1")
def first_timestamps(spark, d):
    return L.first_timestamps(_catalog(spark, d)[0])


# A plan that goes on where it stopped

_CHANGED = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey AS shard FROM customer UNION ALL SELECT c_custkey + 40000, c_name || 'x', c_acctbal, c_mktsegment, 7 FROM customer WHERE c_nationkey = 7"
_BYTES = "strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + strlen(CAST(c_acctbal AS VARCHAR)) + strlen(c_mktsegment) + strlen(CAST(shard AS VARCHAR))"


@query(
    "fleet_plan_resumed",
    f"""
WITH r AS ({_CHANGED}), s AS (SELECT shard, count(*) AS rows_total, CAST(sum({_BYTES}) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE c_custkey > 32767) AS a, count(*) FILTER (WHERE length(c_name) > 18) AS b FROM r GROUP BY 1),
e AS (SELECT c_nationkey AS shard, count(*) AS n FROM customer WHERE c_acctbal < -900 AND c_nationkey % 4 = 1 GROUP BY 1),
k AS (SELECT s.*, coalesce(e.n, 0) AS n_errors, (a > 0 OR b > 0) AND n_bytes >= 2000 OR coalesce(e.n, 0) > 0 AS skipped FROM s LEFT JOIN e USING (shard))
SELECT shard, 'modify c_custkey' AS clause, a AS rows_affected, rows_total, n_bytes, n_errors, skipped, shard = 7 AS scanned FROM k UNION ALL SELECT shard, 'modify c_name', b, rows_total, n_bytes, n_errors, skipped, shard = 7 FROM k
""",
)
def fleet_plan_resumed(spark, d):
    """Customers in files by nation; after a first run one shard gets more rows, and a second run scans that shard alone. Lint
    errors are stood in for by accounts far below zero in some shards."""
    customers = _t(spark, d, "customer").withColumnRenamed("c_nationkey", "shard")
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    customers.repartition("shard").write.partitionBy("shard").parquet(path)
    changes = [ColumnChange("c_custkey", "bigint(20)", "smallint(6)"), ColumnChange("c_name", "varchar(64)", "varchar(18)")]
    first = stored(resumed_plan(spark.read.parquet(path), "shard", changes, 2000))
    more = customers.where("shard = 7").withColumns({"c_custkey": F.col("c_custkey") + 40000, "c_name": F.concat("c_name", F.lit("x"))})
    more.write.mode("append").partitionBy("shard").parquet(path)
    errors = customers.where("c_acctbal < -900 AND shard % 4 = 1").groupBy("shard").agg(F.count("*").alias("n_errors"))
    plan = resumed_plan(spark.read.parquet(path), "shard", changes, 2000, first, errors)
    return plan.select("shard", "clause", "rows_affected", "rows_total", "n_bytes", "n_errors", "skipped", "scanned")


# Keys of a stream

_BATCHES = 3


@query("key_stream_lineitem", "SELECT l_linenumber, count(DISTINCT l_orderkey) AS kept, count(*) - count(DISTINCT l_orderkey) AS quarantined FROM lineitem GROUP BY 1")
def key_stream_lineitem(spark, d):
    """The lines as a stream of three batches, with the key of order and line number. Lines are dealt to batches by their content in a
    scan for each: that is less than shuffling them, and repeated keys come in one batch and in several."""
    base = f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    lines = _t(spark, d, "lineitem")
    for i in range(_BATCHES):
        lines.where(F.pmod(F.xxhash64(*lines.columns), F.lit(_BATCHES)) == i).write.mode("append").parquet(f"{base}/in")
    files = len(spark.read.schema(lines.schema).parquet(f"{base}/in").inputFiles())
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", -(-files // _BATCHES)).parquet(f"{base}/in")
    unique_stream(stream, ["l_orderkey", "l_linenumber"], ["l_shipdate"], f"{base}/kept", f"{base}/rest", f"{base}/seen", f"{base}/checkpoint").awaitTermination()
    verdicts = spark.read.parquet(f"{base}/kept").select("l_linenumber", F.lit(1).alias("k")).unionByName(spark.read.parquet(f"{base}/rest").select("l_linenumber", F.lit(0).alias("k")))
    return verdicts.groupBy("l_linenumber").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("quarantined"))
