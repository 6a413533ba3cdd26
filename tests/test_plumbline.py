"""The library outside the corpus operators: every query with SQL against it, planted cases, the safety matrix and properties."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import fleet_queries, queries
from plumbline.functions import types as T
from plumbline.operators import checks as V
from plumbline.operators import partitions as P
from plumbline.operators import relational as R
from plumbline.operators.conform import Contract, Target, conform, conform_split, write_conformed
from plumbline.plans import diff as D
from plumbline.plans import lint as L
from plumbline.plans import safety as U
from plumbline.sources import catalog as S
from plumbline.streaming.quarantine import conform_stream
from tests.helpers import rows_of, rows_of_sql

ALL = {**queries.QUERIES, **fleet_queries.QUERIES}
SQL = {**queries.ORACLES, **fleet_queries.ORACLES}


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, sf_dir, duck, name):
    assert rows_of(ALL[name](spark, sf_dir)) == rows_of_sql(duck, SQL[name])


@pytest.mark.parametrize("name", [n for n in ALL if n not in SQL])
def test_without_sql(spark, sf_dir, name):
    assert ALL[name](spark, sf_dir).count() > 0


def integer_changes(rng):
    """Any integer type to any other, with and without a display width: unsafe if the new range lacks a value of the old one."""
    bytes_of = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "bigint": 8}
    spans = {}
    for name, n in bytes_of.items():
        spans[name], spans[f"{name} unsigned"] = (-(1 << 8 * n - 1), (1 << 8 * n - 1) - 1), (0, (1 << 8 * n) - 1)
    written = lambda t: t.replace(" ", f"({rng.randrange(1, 21)}) ") if " " in t and rng.random() < 0.5 else t
    for old, (low, high) in spans.items():
        for new, (new_low, new_high) in spans.items():
            yield written(old), written(new), new_low > low or new_high < high


def text_changes(rng):
    """Strings of four bytes a character, and binary types: unsafe if fewer bytes fit. Padding of fixed binary values is unsafe too."""
    most = {"tinytext": 255, "text": 65_535, "mediumtext": 16_777_215}
    lengths = lambda: rng.randrange(1, 120)
    texts = [(f"{kind}({n})", 4 * n) for kind in ("char", "varchar") for n in (lengths(), lengths(), 63, 64)] + list(most.items())
    blobs = [(f"varbinary({n})", n) for n in (lengths(), 255, 256, 4 * lengths())] + [(t.replace("text", "blob"), n) for t, n in most.items()]
    for group in (texts, blobs):
        for old, n in group:
            for new, m in group:
                yield old, new, m < n
    for n, m in ((4, 9), (20, 20 + lengths())):
        yield f"binary({n})", f"binary({m})", True
        yield f"varbinary({n})", f"binary({m})", True
    for n in (lengths(), lengths()):
        yield f"vector({n})", f"vector({n + 1})", False
        yield f"vector({n + 1})", f"vector({n})", True


def digit_changes(rng):
    """Decimals, fractions of seconds and bits: unsafe if a size gets smaller, or a sign is lost."""
    for _ in range(25):
        size, scale, size2, scale2 = rng.randrange(6, 30), rng.randrange(6), rng.randrange(6, 30), rng.randrange(6)
        yield f"decimal({size},{scale})", f"decimal({size2},{scale2})", size2 < size or scale2 < scale
        yield f"decimal({size},{scale})", f"decimal({size},{scale}) unsigned", True
    for kind in ("time", "datetime", "timestamp"):
        for n in range(1, 7):
            m = rng.randrange(1, 7)
            yield f"{kind}({n})", f"{kind}({m})", m < n
    for _ in range(6):
        n, m = rng.randrange(1, 65), rng.randrange(1, 65)
        yield f"bit({n})", f"bit({m})", m < n


def list_changes(rng):
    """Value lists: safe if the old list begins the new one. Enums and sets aren't each other."""
    names = ["red", "green", "it''s", "blue, dark", "x(1)"]
    listed = lambda kind, x: f"{kind}({','.join(chr(39) + v + chr(39) for v in x)})"
    for _ in range(15):
        old = rng.sample(names, rng.randrange(1, 4))
        new = rng.choice([[*old, "more"], rng.sample(names, len(old)), old[:-1] or ["other"]])
        for kind in ("enum", "set"):
            yield listed(kind, old), listed(kind, new), new[: len(old)] != old
        yield listed("enum", old), listed("set", old), True


def other_changes(rng):
    """Between kinds: unsafe, but for what the library's table of convenient conversions names."""
    kinds = ["int", "decimal(9,2)", "double", "varchar(40)", "date", "json", "varbinary(99)", "bit(3)"]
    for old in kinds:
        for new in kinds:
            if old != new:
                yield old, new, True
    for base, texts in U.CONVENIENCE.items():
        for text in texts:
            yield base, text, False
            yield text, base, False
    yield from (("inet4", "inet6", True), ("float", "double", False), ("double", "float", True), ("year(4)", "year", False))


@pytest.mark.parametrize("changes", [integer_changes, text_changes, digit_changes, list_changes, other_changes])
def test_safety_matrix(spark, changes):
    df = spark.createDataFrame(list(changes(random.Random(5))), "a string, b string, unsafe boolean")
    got = df.select("*", U.unsafe_reason(T.type_struct("a"), T.type_struct("b"), F.lit("utf8mb4"), F.lit("utf8mb4")).alias("reason")).collect()
    assert [(r["a"], r["b"], r["reason"]) for r in got if (r["reason"] is not None) != r["unsafe"]] == []


def test_servers_that_widen_inet4(spark):
    kinds = T.type_struct(F.lit("inet4")), T.type_struct(F.lit("inet6")), F.lit(None).cast("string"), F.lit(None).cast("string")
    assert spark.range(1).select(U.unsafe_reason(*kinds), U.unsafe_reason(*kinds, inet4_widens=True)).first()[:] == ("lossy", None)


def test_safety_order_of_decisions(spark):
    a, b = T.type_struct(F.lit("varchar(9)")), T.type_struct(F.lit("varchar(5)"))
    utf, latin = F.lit("utf8mb4"), F.lit("latin1")
    row = spark.range(1).select(
        U.unsafe_reason(a, b, utf, latin, virtual=F.lit(True)).alias("virtual"), U.unsafe_reason(a, a, latin, utf).alias("charset"), U.unsafe_reason(a, a, F.lit("utf8"), F.lit("utf8mb3")).alias("alias"),
        U.unsafe_reason(a, a, utf, utf, F.lit("x_bin"), F.lit("x_ci"), in_unique=F.lit(True)).alias("unique"), U.unsafe_reason(a, a, utf, utf, F.lit("x_bin"), F.lit("x_ci"), in_unique=F.lit(False)).alias("plain"),
        U.unsafe_reason(a, a, utf, utf, old_srid=F.lit(None).cast("int"), new_srid=F.lit(0)).alias("srid"), U.unsafe_reason(a, b, utf, utf).alias("less"),
    ).first()
    assert row.asDict() == {"virtual": None, "charset": "charset", "alias": None, "unique": "collation", "plain": None, "srid": "srid", "less": "lossy"}


def test_checks_find_planted_rows(spark):
    rows = [(1, "ok", 5.0, "2024-01-01"), (2, None, None, None), (3, "too long", 300.0, "0000-00-00"), (4, "é", 1.5, "2024-00-01"), (5, "漢", -1.0, "2024-01-00"), (6, "ok ", float("nan"), "2024-02-02")]
    df = spark.createDataFrame(rows, "i int, s string, x double, d string")
    s, x = F.col("s"), F.col("x")
    checks = {
        "int": (V.int_fit(x, "tinyint unsigned"), {3, 4, 5, 6}), "decimal": (V.decimal_fit(x, "decimal(3,1)"), {3, 6}), "decimal unsigned": (V.decimal_fit(x, "decimal(4,1) unsigned"), {5, 6}), "char": (V.string_fit(s, "char(3)"), {3}),
        "ascii": (V.charset_fit(s, "ascii"), {4, 5}), "latin1": (V.charset_fit(s, "latin1"), {5}), "enum": (V.enum_fit(s, ("ok", "é")), {3, 5, 6}), "shift": (V.enum_shift(s, ("ok", "é"), ("ok", "x", "é")), {4}), "null": (V.null_fit(s), {2}),
        "clause": (V.clause(F.expr("x < 100")), {3, 6}), "zero": (V.zero_dates(F.col("d")), {3, 4, 5}), "generated": (V.generated_mismatch(s, F.lit("ok")), {2, 3, 4, 5, 6}),
    }
    for name, (c, want) in checks.items():
        assert {r["i"] for r in df.where(c).collect()} == want, name
    counts = {r["check_name"]: r["rows_affected"] for r in V.run_checks(df, {n: c for n, (c, _) in checks.items()}).collect()}
    assert counts == {n: len(w) for n, (_, w) in checks.items()}
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, float("nan")],), ([1.0, None],), (None,)], "v array<float>")
    assert vectors.where(V.vector_fit(F.col("v"), 2)).count() == 3


def test_change_impact_is_stricter_than_the_type_rule(spark):
    df = spark.createDataFrame([(99999.0,), (10000.0,), (9999.5,)], "x double")
    row = V.change_impact(df, [V.ColumnChange("x", "decimal(9,4)", "decimal(9,5)")]).first()
    assert (row["unsafe"], row["rows_affected"]) == (False, 2)


def test_registries_refuse_second_names():
    with pytest.raises(ValueError):
        V.check("int_fit")(lambda c: c)
    with pytest.raises(ValueError):
        L.rule("pk", "warning")(lambda c, o: None)
    assert "temporal_fit" in V.registered() and len(L.rules()) == 20


def test_null_key_parts_are_not_rolled_up_columns(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 2), (None, 3)], "a int, b int")
    got = {r["key_name"]: (r["duplicate_groups"], r["surplus_rows"], r["null_rows"]) for r in R.key_violations_multi(df, {"a": (["a"], True), "ab": (["a", "b"], True), "b": (["b"], False)}).collect()}
    assert got == {"a": (1, 3, 1), "ab": (1, 1, 3), "b": (1, 1, 0)}


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "i int, p int")
    parent = spark.createDataFrame([(1,), (1,), (4,)], "k int")
    assert [r["i"] for r in R.fk_orphans(child, ["p"], parent, ["k"]).collect()] == [2]
    assert [(r["k"], r["parents"]) for r in R.fk_ambiguous(child, ["p"], parent, ["k"]).collect()] == [(1, 2)]


def test_partition_routes(spark):
    ranges = P.Scheme("RANGE COLUMNS", ["a", "d", "c"], {"p0": (5, 10, "ggg"), "p1": (10, 20, "mmm"), "p2": (15, 30, "sss"), "p3": (P.MAXVALUE,) * 3})
    lists = P.Scheme("LIST COLUMNS", ["a", "d"], {"n": [(None, None)], "x": [(1, 2), (3, 4)]})
    rows = [(5, 10, "a", "p0"), (5, 10, "ggg", "p1"), (5, 11, "a", "p1"), (4, 99, "z", "p0"), (None, 1, "a", "p0"), (15, None, "zzz", "p2"), (15, 30, "sss", "p3"), (99, 1, "a", "p3")]
    df = spark.createDataFrame(rows, "a int, d int, c string, want string")
    assert df.where(~P.route(ranges).eqNullSafe(F.col("want"))).count() == 0
    got = spark.createDataFrame([(None, None), (1, 2), (3, 2)], "a int, d int").select(P.route(lists)).collect()
    assert [r[0] for r in got] == ["n", "x", None]
    many = P.Scheme("RANGE", ["id"], {f"p{i}": (i * 10,) for i in range(1, 300)})
    assert spark.range(0, 2990).where(P.route(many) != F.concat(F.lit("p"), F.floor(F.col("id") / 10) + 1)).count() == 0
    assert spark.range(5).select(P.route(P.Scheme("KEY", ["id"], {"a": None}))).where("1 = 1").first()[0] is None


def random_catalogs(rng, n):
    types = ["int(11)", "bigint(20)", "varchar(10)", "varchar(20)", "text", "double"]
    a, b = [], []
    for t in range(n):
        names = [f"c{i}" for i in range(rng.randrange(1, 12))]
        old, new = names[:], names[:]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), f"n{rng.randrange(1000)}")
        if len(new) > 1 and rng.random() < 0.5:
            new.remove(rng.choice(new))
        for _ in range(rng.randrange(4)):
            i, j = rng.randrange(len(new)), rng.randrange(len(new))
            new[i], new[j] = new[j], new[i]
        new = list(dict.fromkeys(new))
        kinds = {c: rng.choice(types) for c in old}
        for i, c in enumerate(old):
            a.append(("s", f"t{t}", c, i * 3, kinds[c], True, ""))
        for i, c in enumerate(new):
            b.append(("s", f"t{t}", c, i + 1, kinds.get(c, "int(11)") if rng.random() < 0.8 else rng.choice(types), rng.random() < 0.9, ""))
    return a, b


def test_changes_lead_from_one_catalog_to_the_other(spark):
    schema = "schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean, comment string"
    a, b = (spark.createDataFrame(x, schema) for x in random_catalogs(random.Random(11), 80))
    changes = D.column_changes(a, b)
    assert D.verify(a, b, changes).count() == 0
    assert changes.groupBy("table_name", "member").count().where("count > 1").count() == 0
    assert D.unexplained(a, b, changes).count() == 0
    for clause in ("modify column", "add column", "drop column", "move column"):
        assert D.verify(a, b, changes.where(F.col("clause") != clause)).count() > 0, clause


@pytest.mark.parametrize("field, value", [("auto_inc", True), ("on_update", "CURRENT_TIMESTAMP"), ("generation_expr", "a + 1"), ("is_virtual", True), ("invisible", True), ("compression", "zlib"), ("check_clause", "a > 0"), ("srid", 4326), ("show_charset", True)])
def test_a_drift_of_one_field_is_seen(spark, field, value):
    kind = {bool: "boolean", str: "string", int: "int"}[type(value)]
    schema = f"schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean, {field} {kind}"
    usual = [(s, "t", c, i, "int(11)", True, None) for s in ("s1", "s2", "s3") for i, c in enumerate("ab")]
    a, b = spark.createDataFrame([(*r[:6], value) if r[0] == "s2" and r[2] == "a" else r for r in usual], schema), spark.createDataFrame(usual, schema)
    changes = D.column_changes(a, b)
    assert [(r["schema_name"], r["member"], r["clause"]) for r in changes.collect()] == [("s2", "a", "modify column")]
    assert D.unexplained(a, b, changes).count() == 0 and D.unexplained(a, b, changes.limit(0)).count() == 1
    found = D.drift(a).collect()
    assert [(r["schema_name"], r["shards"]) for r in found] == [("s2", 1)] and found[0]["fingerprint"] != found[0]["majority"]
    assert D.drift(b).count() == 0


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(200):
        x = rng.sample(range(9), rng.randrange(1, 9))
        stay = D.longest_increasing(x)
        best = max(bin(m).count("1") for m in range(1 << len(x)) if (p := [v for i, v in enumerate(x) if m >> i & 1]) == sorted(p))
        assert len(stay) == best and [x[i] for i in sorted(stay)] == sorted(x[i] for i in stay)


def test_modifiers(spark):
    schema = "schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean, comment string"
    a = spark.createDataFrame([("s", "t", "a", 1, "int(11)", True, ""), ("s", "t", "b", 2, "int(11)", True, ""), ("s", "t", "c", 3, "int(11)", True, "")], schema)
    b = spark.createDataFrame([("s", "t", "a", 2, "int(11)", True, ""), ("s", "t", "b", 1, "int", True, ""), ("s", "t", "c", 3, "int(11)", True, "new")], schema)
    changes = D.column_changes(a, b)
    left = lambda **m: sorted(r["member"] for r in D.apply_modifiers(changes, D.Modifiers(**m)).collect())
    assert "c" in left() and left(lax_column_order=True) == ["c"] and left(lax_column_order=True, lax_comments=True) == []
    assert set(left(lax_column_order=True, strict_columns=True)) == {"b", "c"}


def test_comments_of_moved_columns(spark):
    """A column that moved and changed only its comment stays unless both are lax."""
    schema = "schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean, comment string"
    a = spark.createDataFrame([("s", "t", c, i, "int", True, "") for i, c in enumerate("abcd")], schema)
    b = spark.createDataFrame([("s", "t", c, i, "int", True, "new" if c == "d" else "") for i, c in enumerate("dabc")], schema)
    changes = D.column_changes(a, b)
    left = lambda **m: [(r["member"], r["clause"]) for r in D.apply_modifiers(changes, D.Modifiers(**m)).collect()]
    assert left() == left(lax_comments=True) == left(lax_column_order=True) == [("d", "modify column")]
    assert left(lax_comments=True, lax_column_order=True) == []


def test_strict_keys_checks_and_metadata(spark):
    key = "schema_name string, table_name string, fk_name string, columns array<string>, parent_schema string, parent_table string, parent_columns array<string>, update_rule string, delete_rule string"
    a = spark.createDataFrame([("s", "t", "one", ["x"], None, "p", ["id"], "RESTRICT", "RESTRICT"), ("s", "t", "two", ["y"], None, "p", ["id"], "RESTRICT", "CASCADE")], key)
    b = spark.createDataFrame([("s", "t", "uno", ["x"], None, "p", ["id"], "NO ACTION", "RESTRICT"), ("s", "t", "two", ["y"], None, "p", ["id"], "RESTRICT", "SET NULL")], key)
    left = lambda x, **m: sorted((r["clause"], r["member"]) for r in D.apply_key_modifiers(x, D.Modifiers(**m)).collect())
    keys = D.diff_fks(a, b)
    changed = [("add foreign key", "two"), ("drop foreign key", "two")]
    assert left(keys) == left(keys, strict_checks=True) == changed and left(keys, strict_keys=True) == sorted([*changed, ("add foreign key", "uno"), ("drop foreign key", "one")])
    check = "schema_name string, table_name string, check_name string, clause string, enforced boolean"
    checks = D.diff_checks(spark.createDataFrame([("s", "t", "c1", "x > 0", True)], check), spark.createDataFrame([("s", "t", "c2", "x > 0", True)], check))
    assert left(checks) == [] and left(checks, strict_checks=True) == [("add check", "c2"), ("drop check", "c1")]
    routine = "schema_name string, routine_name string, routine_type string, body string, comment string, sql_mode string"
    old, new = (spark.createDataFrame([("s", "r", "FUNCTION", "x", "", m), ("s", "q", "FUNCTION", "x", c, "A")], routine) for m, c in (("A", ""), ("B", "note")))
    clauses = lambda **m: sorted((r["routine_name"], r["clause"]) for r in D.diff_routines(old, new, D.Modifiers(**m)).collect())
    assert clauses() == [("q", "alter routine")] and clauses(compare_metadata=True) == [("q", "alter routine"), ("r", "replace routine")] and clauses(lax_comments=True) == []
    tables = spark.createDataFrame([("s", "t", "comment"), ("s", "u", "comment"), ("s", "u", "engine")], "schema_name string, table_name string, clause string")
    assert D.apply_table_modifiers(tables, D.Modifiers()).count() == 3 and {r["table_name"] for r in D.apply_table_modifiers(tables, D.Modifiers(lax_comments=True)).collect()} == {"u"}


def test_attributes_of_indexes(spark):
    schema = "schema_name string, table_name string, index_name string, seq int, column_name string, non_unique boolean, prefix_length int, ordinal int, index_type string, parser string, attributes string"
    row = lambda name, kind, parser="", attributes="", column="x", i=1: ("s", "t", name, 1, column, True, 0, i, kind, parser, attributes)
    load = lambda *rows: S.load_indexes(spark.createDataFrame(list(rows), schema))
    same = D.diff_indexes(load(row("v", "VECTOR"), row("w", "VECTOR", "", "M=8 DISTANCE=cosine")), load(row("v", "VECTOR", "", "`distance`='EUCLIDEAN' m=6"), row("w", "VECTOR", "", "distance=COSINE M=8")))
    assert same.count() == 0
    changed = D.diff_indexes(load(row("v", "VECTOR"), row("f", "FULLTEXT")), load(row("v", "VECTOR", "", "M=7"), row("f", "FULLTEXT", "ngram"))).collect()
    assert sorted((r["clause"], r["member"]) for r in changed) == [("modify index", "f"), ("modify index", "v")]
    cols = spark.createDataFrame([("s", "t", "x", 1, "geometry", False, None), ("s", "t", "y", 2, "geometry", False, 4326), ("s", "t", "z", 3, "int", False, None)], "schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean, srid int")
    tables = spark.createDataFrame([("s", "t", "InnoDB", "utf8mb4_bin", "", 0)], "schema_name string, table_name string, engine string, table_collation string, create_options string, next_auto_inc bigint")
    indexes = load(row("v1", "VECTOR"), row("v2", "VECTOR", "", "M=6", "x", 2), row("v3", "VECTOR", "", "M=9", "x", 3), row("f1", "FULLTEXT"), row("f2", "FULLTEXT", "ngram", "", "x", 2), row("g1", "SPATIAL"), row("g2", "SPATIAL", "", "", "y"))
    found = lambda **o: {r["member"] for r in L.lint(L.Catalog(tables, cols, indexes), L.Options({n: "off" for n in L.rules() if n != "dupe-index"}, **o)).collect()}
    assert found() == {"v2", "g1"} and found(spatial_needs_srid=False) == {"v2"}


def test_counters_and_nullable_columns(spark):
    cols = [("s", t, c, i, "tinyint", n, a) for t in ("t", "u") for i, (c, n, a) in enumerate([("b", True, True), ("a", False, True), ("c", True, False)])]
    cols = spark.createDataFrame(cols, "schema_name string, table_name string, column_name string, ordinal int, column_type string, nullable boolean, auto_inc boolean")
    tables = spark.createDataFrame([("s", "t", "InnoDB", "utf8mb4_bin", "", 5), ("s", "u", "InnoDB", "utf8mb4_bin", "", None)], "schema_name string, table_name string, engine string, table_collation string, create_options string, next_auto_inc bigint")
    found = L.ordered(L.lint(L.Catalog(tables, cols), L.Options({n: "warning" if n in ("auto-inc", "nullable") else "off" for n in L.rules()}))).collect()
    assert [(r["object_name"], r["rule"], r["member"]) for r in found] == [("t", "auto-inc", "b"), ("t", "nullable", "b"), ("t", "nullable", "c"), ("u", "nullable", "b"), ("u", "nullable", "c")]


def test_dropped_schemas_and_partitions(spark):
    rows = [("drop schema", 3, 0, False), ("drop schema", 0, 0, False), ("modify partitions", 0, 2, False), ("modify partitions", 0, 0, False)]
    got = U.unsafe_objects(spark.createDataFrame(rows, "clause string, n_objects int, n_dropped int, signature_changed boolean")).collect()
    assert [r["reason_code"] for r in got] == ["schema with objects dropped", None, "partitions dropped", None]


def test_scratch_deletes_what_was_stored(spark):
    import os

    from plumbline.sources.staging import kept, scratch, shared_dir, stored

    there = lambda: set(os.listdir(shared_dir(spark)))
    before = there()
    with scratch(spark):
        stored(spark.range(3))
        with scratch(spark):
            stored(spark.range(4))
            outer = kept(spark.range(5))
        assert len(there() - before) == 2 and outer.count() == 5
    assert there() == before


def test_indexes_rename_once(spark):
    schema = "schema_name string, table_name string, index_name string, seq int, column_name string, non_unique boolean, prefix_length int, ordinal int"
    a = [("s", "t", n, 1, "x", True, 0, i) for i, n in enumerate(["one", "two", "three"])]
    b = [("s", "t", n, 1, "x", True, 0, i) for i, n in enumerate(["uno", "three"])] + [("s", "t", "wide", 1, "x", True, 5, 9)]
    got = sorted(tuple(r)[2:] for r in D.diff_indexes(*(S.load_indexes(spark.createDataFrame(x, schema)) for x in (a, b))).collect())
    assert got == [("add index", "wide", None), ("drop index", "two", None), ("rename index", "one", "uno")]


def test_options_and_partitioning(spark):
    schema = "schema_name string, table_name string, create_options string, partition_method string, partition_expression string, partition_list string"
    a = spark.createDataFrame([("s", "t", "row_format=DYNAMIC key_block_size=8 partitioned", "RANGE", "id", "1"), ("s", "u", "", "HASH", "id", "1"), ("s", "v", "", "", "", ""), ("s", "w", "", "HASH", "a", "")], schema)
    b = spark.createDataFrame([("s", "t", "compression='zlib'", "RANGE", "id", "2"), ("s", "u", "", "HASH", "id", "2"), ("s", "v", "", "HASH", "id", "1"), ("s", "w", "", "", "", "")], schema)
    assert {(r["option"], r["old_value"], r["new_value"]) for r in D.diff_options(a, b).collect()} == {("ROW_FORMAT", "DYNAMIC", "DEFAULT"), ("KEY_BLOCK_SIZE", "8", "0"), ("COMPRESSION", None, "'zlib'")}
    got = lambda m: {r["table_name"]: (r["clause"], r["supported"]) for r in D.diff_partitioning(a, b, m).collect()}
    assert got("modify") == {"t": ("modify partitions", True), "u": ("modify partitions", False), "v": ("partition by", True), "w": ("remove partitioning", True)}
    assert "w" not in got("keep") and "v" not in got("remove")


def test_user_patterns(spark):
    rows = [("app@10.1.2.3", "app@10.%", True), ("a@b@host", "a@b@host", True), ("root@localhost", "app@%", False), ("app_1@x", "app__@%", True), ("app@HOST", "app@host", True)]
    df = spark.createDataFrame(rows, "u string, p string, ok boolean")
    assert df.where(L.user_like(F.col("u"), F.col("p")) != F.col("ok")).count() == 0


def test_severities():
    assert L.Options({"pk": "0"}).severity("pk") == "ignore" and L.Options({"pk": "ERROR"}).severity("pk") == "error" and L.Options().severity("pk") == "warning"
    with pytest.raises(ValueError):
        L.Options({"pk": "loud"}).severity("pk")


def test_conform(spark, tmp_path):
    rows = [(1, "a", 2.5), (2, "bb", 3.25), (3, None, 1e9), (4, "c", None)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    contract = Contract([Target("x", "decimal(4,1)"), Target("s", "char(1)", nullable=False, default="'?'"), Target("twice", "int", generated="i * 2"), Target("n", "int unsigned", nullable=False)], {"small": "i < 4"})
    fit, rest = conform_split(df, contract)
    assert [tuple(map(str, r)) for r in fit.collect()] == [("2.5", "a", "2", "0")]
    assert {r["i"]: r["reasons"] for r in rest.collect()} == {2: ["x: type", "s: type"], 3: ["x: type"], 4: ["check small"]}
    assert fit.schema["n"].dataType.simpleString() == "bigint" and conform(df, contract).count() == 4
    scheme = P.Scheme("HASH", ["twice"], {"p0": None, "p1": None})
    left = write_conformed(df, contract, str(tmp_path / "out"), scheme)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and left.count() == 3


def test_only_enforced_clauses_gate(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    found = {r.check_name: r for r in V.check_violations(df, {"on": ("x > 0", True), "off": ("x > 0", False), "fine": ("x > -5", True)}).collect()}
    assert {n: (r.rows_affected, r.enforced, r.gates) for n, r in found.items()} == {"on": (1, True, True), "off": (1, False, False), "fine": (0, True, False)}
    contract = Contract([Target("x", "int")], {"on": "x > -5", "off": "x > 0"}, unenforced=frozenset({"off"}))
    fit, rest = conform_split(df, contract)
    assert fit.count() == 3 and rest.count() == 0


def test_row_widths(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0], [["x"]]), (None, None, None)], "`a.b` string, v array<float>, w array<array<string>>")
    assert sorted(r.n for r in df.select(V.row_width(df).alias("n")).collect()) == [0, 2 + 8 + 7]


def test_conform_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "c")], "i int, s string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = conform_stream(stream, Contract([Target("i", "int"), Target("s", "char(1)")]), str(tmp_path / "fit"), str(tmp_path / "rest"), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "fit")).collect()) == [1, 3]
    assert [(r["i"], r["reasons"]) for r in spark.read.parquet(str(tmp_path / "rest")).collect()] == [(2, ["s: type"])]


def test_snapshots_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    for day, n in ((1, 3), (2, 5), (1, 4)):
        S.write_snapshot(spark.range(n).withColumn("snapshot", F.lit(day)), path)
    assert {r["snapshot"]: r["count"] for r in spark.read.parquet(path).groupBy("snapshot").count().collect()} == {1: 4, 2: 5}
