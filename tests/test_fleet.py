"""Queries over the derived fleet: what small tables of the other tests don't have, and what is shuffled."""

import __spark_entry__ as entry
import pytest
from plumbline.plans import diff as D
from plumbline.sources import fleet as X

from tests.helpers import rows_of, rows_of_sql


def shards(spark, path, keys):
    """A folder with customers of these keys; the fleet is derived from the keys alone."""
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_a_display_width_under_lax_comments(spark, tmp_path):
    """int and int(11) are alike, so a new comment beside is the only difference: under lax comments there is none."""
    import duckdb

    g = next(i for i, r in enumerate(X.BASE, 1) if r[1] == "label")
    keys = [k for k in range(20_000) if (k * 7 + g * 13) % (101 * 131) == 0]
    d = shards(spark, tmp_path, [*keys, 1, 2, 3, 4, 5])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet/*.parquet'")
    assert keys and rows_of(entry.queries()["fleet_modifiers"](spark, d)) == rows_of_sql(con, entry.oracle_sql()["fleet_modifiers"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fleet_column_drops", "fleet_column_adds", "fleet_column_diff", "fleet_history", "fleet_history_merged", "fleet_table_diff", "fleet_attr_diff", "lint_all"])
def test_sides_are_compared_within_shards(spark, tmp_path, name):
    """Catalogs are dealt by shard once, as customers; nothing that is derived from them is shuffled. (Of very few customers Spark
    would broadcast these.)"""
    plan = plan_of(entry.queries()[name](spark, shards(spark, tmp_path, range(20_000))))
    assert "REPARTITION_BY_NUM" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(schema_name" in x and "ENSURE_REQUIREMENTS" in x]


def test_tasks_do_not_grow_with_the_fleet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SHARDS_A_TASK", 10)
    d = shards(spark, tmp_path, range(500))
    assert X.derived(spark, d, X.DESIRED_TABLES).rdd.getNumPartitions() == X.partitions(spark, d) == 50


def test_orders_are_replayed_without_groups_in_pandas(spark, sf_dir, monkeypatch):
    """A group in pandas for each table took milliseconds a table: 90,000 shards didn't end in time."""
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a, **k: pytest.fail("a pandas frame for each table"))
    assert entry.queries()["fleet_verify"](spark, sf_dir).first()[0] == 0


def test_verification_counts_each_wrong_change(spark):
    kind = "schema_name string, table_name string, column_name string, ordinal int, column_type string"
    a = spark.createDataFrame([("s", "t", "a", 1, "int"), ("s", "t", "b", 2, "int"), ("s", "gone", "a", 1, "int")], kind)
    b = spark.createDataFrame([("s", "t", "a", 1, "text"), ("s", "t", "b", 2, "int"), ("s", "t", "c", 3, "int")], kind)
    changes = D.column_changes(a, b)
    found = lambda c: sorted((r["column_name"], r["problem"]) for r in D.verify(a, b, c).collect())
    assert found(changes) == [] and found(changes.where("member <> 'a'")) == [("a", "definition")] * 2
    assert found(changes.unionByName(changes.where("member = 'a'"))) == [("a", "definition")]
    assert found(changes.where("member <> 'c'")) == [("c", "definition")]
    assert found(changes.withColumn("member", changes["member"].substr(1, 0))) and D.misplaced([{"column_name": "a", "old_at": 1, "new_at": 2, "steps": []}, {"column_name": "b", "old_at": 2, "new_at": 1, "steps": []}]) == ["b", "a"]


def test_wide_sets_are_first_checked_on_slices(spark, monkeypatch):
    """Grouping sets multiply the rows they scan: over the whole table they are for single columns alone."""
    from plumbline.operators import keys as K

    rows = spark.range(4000).selectExpr("id % 80 AS a", "id DIV 80 AS b", "id % 50 AS c", "id % 7 AS e")
    scans, checked = [], K._checked

    def recorded(df, columns, sets):
        scans.append((len(sets[0]), df.count()))
        return checked(df, columns, sets)

    monkeypatch.setattr(K, "_checked", recorded)
    found = {r["key_columns"] for r in K.minimal_keys(rows, ["a", "b", "c", "e"], 3).collect()}
    n = {s: rows.select(*s.split(",")).distinct().count() for s in ("a,b", "b,c", "a,c,e", "a,b,c")}
    assert "a,b" in found and all((s in found) == (n[s] == 4000) for s in ("b,c", "a,c,e"))
    assert any(width > 1 for width, _ in scans) and all(count < 1000 for width, count in scans if width > 1)


def test_indexes_are_put_together_where_collations_change(spark, tmp_path, monkeypatch):
    """Few tables ask for their indexes, and few pairs of definitions for the type rules; what is found is the same."""
    from plumbline import fleet_queries as Q
    from plumbline.plans import safety as U
    from plumbline.sources import catalog as S

    second = f"SELECT {X._SHARD}, t AS table_name, 'u' AS index_name, 1 AS seq, c2 AS column_name, false AS non_unique, 0 AS prefix_length, 1 AS ordinal FROM {{customer}} c CROSS JOIN {X._FIRST}"
    monkeypatch.setattr(X, "DESIRED_INDEXES", second)
    monkeypatch.setattr(X, "ACTUAL_INDEXES", f"{second} WHERE c.c_custkey % 5 <> 0")
    d = shards(spark, tmp_path, range(800))
    all_, grouped, load = D.in_unique_constraint(*Q.indexes(spark, d)), [], S.load_indexes
    monkeypatch.setattr(S, "load_indexes", lambda parts: grouped.append(parts.count()) or load(parts))
    found = Q._changes(spark, d)
    names = ["schema_name", "table_name", "member", "clause", "reason_code", "unsafe"]
    rows = rows_of(found.select(*names))
    asked = found.where("clause = 'modify column' and not old.collation <=> new.collation")
    codes = {(r["in_unique"], r["reason_code"]) for r in asked.where("old.charset = new.charset and old.column_type = new.column_type").collect()}
    assert codes == {(True, "collation"), (False, None)}
    assert len(grouped) == 2 and all(0 < n < 800 * len(X.TABLES) // 10 for n in grouped)
    assert rows == rows_of(U.unsafe_modify(D.column_changes(*Q.columns(spark, d), all_)).select(*names))


def test_an_order_that_no_change_names_is_found(spark):
    """Tables used to be replayed only if a change placed a column, so a forgotten move left no trace."""
    kind = "schema_name string, table_name string, column_name string, ordinal int, column_type string"
    a, b = (spark.createDataFrame([("s", "t", c, i, "int") for i, c in enumerate(x)], kind) for x in ("abc", "cab"))
    changes = D.column_changes(a, b)
    assert D.verify(a, b, changes).count() == 0
    assert {(r["column_name"], r["problem"]) for r in D.verify(a, b, changes.limit(0)).collect()} == {(c, "order") for c in "abc"}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Both sides' tables of a small fleet, without columns, and their changes."""
    from plumbline import fleet_queries as Q
    from plumbline.sources.staging import stored

    both = next(k for k in range(150, 59 * 61 * 11) if any((k * 11 + t * 17) % (59 * 61) == 0 for t in range(1, 15)))  # a new name and another uniqueness
    d = shards(spark, tmp_path_factory.mktemp("whole"), [*range(150), both])
    sides = [D.Parts(*[stored(getattr(s, n)) for n in ("tables", "indexes", "foreign_keys", "checks")]) for s in Q.parts(spark, d)]
    return d, *sides, stored(D.table_changes(*sides))


def test_verification_covers_what_tables_have_besides_columns(spark, whole):
    _, a, b, changes = whole
    left = lambda c: {r["kind"] for r in D.verify_tables(a, b, c).collect()}
    assert left(changes) == set()
    found = {
        "drop primary key": "index", "add primary key": "index", "drop index": "index", "add index": "index", "modify index": "index", "rename index": "index", "drop foreign key": "foreign key", "add foreign key": "foreign key",
        "drop check": "check", "add check": "check", "alter check": "enforcement", "engine": "engine", "comment": "comment", "charset": "charset", "next_auto_inc": "next_auto_inc", "option": "option", "partition by": "partitioning",
    }
    assert {r["clause"] for r in changes.select("clause").distinct().collect()} == found.keys()
    n = {c: D.verify_tables(a, b, changes.where(f"clause <> '{c}'")) for c in found}
    for c, rows in n.items():
        assert found[c] in {r["kind"] for r in rows.collect()}, c


def test_verification_counts_wrong_changes_of_tables(spark, whole):
    from pyspark.sql import functions as F

    _, a, b, changes = whole
    engines = changes.where("clause = 'engine'")
    wrong = changes.withColumn("made", F.when(changes["clause"] == "engine", F.lit("Aria")).otherwise(changes["made"]))
    n = engines.count()
    kinds = lambda c: [r["kind"] for r in D.verify_tables(a, b, c).collect()]
    assert n > 0 and kinds(wrong) == ["engine"] * 2 * n
    assert kinds(changes.unionByName(engines)) == ["engine"] * n
    # A change of what is alike on both sides is wrong as well, also where it is the table's only one.
    one = a.tables.join(b.tables, D.TABLE_KEY).join(changes, D.TABLE_KEY, "left_anti").select(*D.TABLE_KEY).limit(1)
    more = one.selectExpr(*D.TABLE_KEY, "'drop primary key' AS clause", "'index' AS kind", "'PRIMARY' AS name", "false AS wanted", "CAST(NULL AS STRING) AS source", "CAST(NULL AS STRING) AS made")
    assert kinds(changes.unionByName(more)) == ["index"]


def test_fleet_verify_verifies_whole_tables(spark, whole, monkeypatch):
    """The query used to verify columns alone: without any change of the rest it still said that nothing is left over."""
    make, verify, kinds = D.table_changes, D.verify_tables, []

    def recorded(*args):
        left = verify(*args)
        kinds.extend(r["kind"] for r in left.collect())
        return left

    monkeypatch.setattr(D, "table_changes", lambda a, b: make(a, b).limit(0))
    monkeypatch.setattr(D, "verify_tables", recorded)
    assert entry.queries()["fleet_verify"](spark, whole[0]).first()[0] == len(kinds) > 0
    assert set(kinds) == {"index", "foreign key", "check", "enforcement", "engine", "comment", "charset", "next_auto_inc", "option", "partitioning"}
