"""Searched partition schemes, sketches, history as intervals and resumed plans."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline import change_queries
from plumbline.operators import partitions as P
from plumbline.operators import sketches as H
from plumbline.operators.checks import ColumnChange
from plumbline.operators.conform import resumed_plan
from plumbline.plans import diff as D
from tests.helpers import rows_of, rows_of_sql


def lower(row, bound):
    """Whether a row is below a bound, part by part, None lowest."""
    for v, b in zip(row, bound, strict=True):
        if b is P.MAXVALUE or v is None or v < b:
            return True
        if v > b:
            return False
    return False


KINDS = {
    "int": (lambda rng: rng.randrange(-50, 400), "int"), "double": (lambda rng: rng.randrange(-90, 900) / 8, "double"), "string": (lambda rng: "".join(rng.choice("aZé|1 ,\t😀") for _ in range(rng.randrange(0, 4))), "string"),
    "date": (lambda rng: date.fromordinal(738000 + rng.randrange(400)), "date"), "decimal": (lambda rng: Decimal(rng.randrange(-900, 900)) / 100, "decimal(10,2)"),
}


@pytest.mark.parametrize("kind", KINDS)
def test_searched_ranges(spark, kind):
    make, name = KINDS[kind]
    rng = random.Random(5)
    tuples = sorted({(make(rng), rng.randrange(9)) for _ in range(150)})
    bounds = [*tuples[:-1], (tuples[-1][0], P.MAXVALUE)]
    scheme = P.Scheme("RANGE COLUMNS", ["a", "b"], {f"p{i}": b for i, b in enumerate(bounds)})
    rows = [(None if rng.random() < 0.05 else make(rng), rng.choice([None, *range(-1, 10)])) for _ in range(400)] + [(a, b) for a, b in tuples]
    df = spark.createDataFrame(rows, f"a {name}, b int")
    assert len(bounds) > P.MANY
    for r in P.routed(df, scheme).collect():
        want = next((f"p{i}" for i, b in enumerate(bounds) if lower((r["a"], r["b"]), b)), None)
        assert r["partition_name"] == want, r


@pytest.mark.parametrize("kind", KINDS)
def test_searched_lists(spark, kind):
    make, name = KINDS[kind]
    rng = random.Random(6)
    members = {f"l{i}": [] for i in range(7)}
    for _ in range(160):
        members[f"l{rng.randrange(7)}"].append((None if rng.random() < 0.05 else make(rng), rng.choice([None, 1, 2, 3, 3])))
    rows = [(None if rng.random() < 0.05 else make(rng), rng.choice([None, 1, 2, 3])) for _ in range(300)] + [m for ms in members.values() for m in ms]
    df = spark.createDataFrame(rows, f"a {name}, b int")
    for r in P.routed(df, P.Scheme("LIST COLUMNS", ["a", "b"], members)).collect():
        assert r["partition_name"] == next((n for n, ms in members.items() if (r["a"], r["b"]) in ms), None), r


def test_sketches_merge(spark):
    df = spark.range(20_000).selectExpr("id % 7 AS shard", "id % 900 AS a", "CASE WHEN id % 3 > 0 THEN id END AS b")
    sets = {"a": ["a"], "both": ["a", "b"], "b": ["b"], "prefix": [F.substring(F.col("b").cast("string"), 1, 2)]}
    known = H.sketched(df.where("shard < 5"), ["shard"], sets)
    found = {r["set_name"]: r for r in H.cardinalities(H.refreshed(known, H.sketched(df.where("shard >= 4"), ["shard"], sets), ["shard"])).collect()}
    assert {n: (r["n_shards"], r["n_rows"], r["nulls"]) for n, r in found.items()} == {"a": (7, 20_000, 0), **dict.fromkeys(("both", "b", "prefix"), (7, 13_333, 6_667))}
    for n, exact in (("a", 900), ("both", 13_333), ("b", 13_333), ("prefix", 99)):
        assert found[n]["low"] <= exact <= found[n]["high"]
    shares = {r["set_name"]: r["share"] for r in H.selectivities(H.cardinalities(known), {"prefix": "b"}).collect()}
    assert shares.keys() == {"prefix"} and 0 < shares["prefix"] < 0.05


def test_intervals_tell_what_history_tells(spark):
    """Random snapshots in which columns and whole tables come, change, go and come back."""
    rng = random.Random(8)
    kind = "schema_name string, table_name string, column_name string, column_type string"
    intervals, every = None, None
    for n in range(1, 6):
        tables = [t for t in "uvw" if rng.random() < 0.8]
        snapshot = spark.createDataFrame([("s", t, f"c{i}", rng.choice(["int", "text"])) for t in tables for i in range(5) if rng.random() < 0.7], kind)
        intervals = D.opened(snapshot, n) if intervals is None else D.merged(intervals, snapshot, n)
        intervals = spark.createDataFrame(intervals.collect(), intervals.schema)
        numbered = snapshot.withColumn("snapshot", F.lit(n))
        every = numbered if every is None else every.unionByName(numbered)
    columns = ["snapshot", *D.COLUMN_KEY, "event", "old_type", "new_type"]
    got, want = ([tuple(r) for r in df.select(*columns).collect()] for df in (D.events(intervals), D.history(every)))
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[4] for r in want}) == 3


def test_a_plan_scans_what_changed(spark, tmp_path):
    path, changes = str(tmp_path / "t"), [ColumnChange("x", "int(11)", "tinyint(4)")]
    rows = spark.range(90).selectExpr("CAST(id % 3 AS INT) AS shard", "CAST(id AS INT) AS x")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
    read = lambda: spark.read.parquet(path)
    first = resumed_plan(read(), "shard", changes)
    first = spark.createDataFrame(first.collect(), first.schema)
    assert {(r["shard"], r["scanned"], r["rows_affected"], r["skipped"]) for r in first.collect()} == {(s, True, 0, False) for s in range(3)}
    spark.createDataFrame([(1, 400)], "shard int, x int").write.mode("append").partitionBy("shard").parquet(path)
    errors = spark.createDataFrame([(2, 4)], "shard int, n_errors int")
    second = resumed_plan(read(), "shard", changes, 0, first, errors).collect()
    assert {(r["shard"], r["scanned"], r["rows_total"], r["rows_affected"], r["skipped"]) for r in second} == {(0, False, 30, 0, False), (1, True, 31, 1, True), (2, False, 30, 0, True)}
    other = resumed_plan(read(), "shard", [ColumnChange("x", "int(11)", "smallint(6)")], 0, first).collect()
    assert all(r["scanned"] for r in other) and len(other) == 3


KEYED = "k int, l string, t timestamp, n int"


def test_second_rows_of_keys_are_quarantined(spark, tmp_path):
    """Any split into batches and a restart in between give as many kept and quarantined rows as one check of the whole."""
    from datetime import datetime, timedelta

    from plumbline.operators.relational import key_violations
    from plumbline.streaming.keys import unique_stream

    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([None, 1, *range(40)]), rng.choice([None, "a", "b"]), start + timedelta(days=i // 20), i) for i in range(200)]
    files = [rows[:1], rows[1:90], rows[90:91], rows[91:]]

    def run(name, primary, **more):
        base = tmp_path / name
        for part in (files[:2], files[2:]):
            for f in part:
                spark.createDataFrame(f, KEYED).coalesce(1).write.mode("append").parquet(str(base / "in"))
            stream = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
            unique_stream(stream, ["k", "l"], ["n"], *[str(base / x) for x in ("kept", "rest", "seen", "checkpoint")], primary=primary, **more).awaitTermination()
        return [spark.read.parquet(str(base / x)) for x in ("kept", "rest")]

    whole = spark.createDataFrame(rows, KEYED)
    for primary in (False, True):
        kept, rest = run(f"p{primary}", primary)
        want = key_violations(whole, ["k", "l"], primary).first()
        reasons = {r["reason"]: r["count"] for r in rest.groupBy("reason").count().collect()}
        assert reasons.get("repeated key", 0) == want["surplus_rows"] and reasons.get("null key", 0) == want["null_rows"]
        assert kept.count() + rest.count() == len(rows)
        first = {}
        for k, lo, _, n in rows:
            if k is not None and lo is not None:
                first.setdefault((k, lo), n)
        assert {(r["k"], r["l"]): r["n"] for r in kept.where("k is not null and l is not null").collect()} == first
    forgetful, _ = run("expiry", False, at="t", expiry="2 days")
    assert forgetful.count() > kept.count()


def test_whole_rows_of_a_batch_are_shuffled_once(spark, sf_dir, tmp_path, monkeypatch):
    """Twice or thrice, as texts too wide to compress show, and shuffled only from some size on, what is shuffled outgrew the input."""
    from pyspark.sql.classic.dataframe import DataFrame

    from plumbline.streaming.keys import unique_stream

    def shuffled():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in (2, 3, 4, 5)])
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = random.Random(3)
    rows = [(i % 1500, rng.randbytes(1000)) for i in range(2000)]
    spark.createDataFrame(rows, "k int, wide binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    for threshold in ("-1", "10m"):
        monkeypatch.setattr(DataFrame, "repartition", lambda *a, **k: pytest.fail("rows of the input are shuffled as they are"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            before = shuffled()
            stream = spark.readStream.schema("k int, wide binary").parquet(str(tmp_path / "in"))
            unique_stream(stream, ["k"], ["k"], *[str(tmp_path / threshold / x) for x in ("kept", "rest", "seen", "checkpoint")]).awaitTermination()
            assert 2_000_000 < shuffled() - before < 3_000_000
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept, rest = (spark.read.parquet(str(tmp_path / threshold / x)) for x in ("kept", "rest"))
        assert kept.count() == 1500 and sorted((r["k"], bytes(r["wide"])) for r in kept.select("k", "wide").unionByName(rest.select("k", "wide")).collect()) == sorted(rows)
    assert change_queries.QUERIES["key_stream_lineitem"](spark, sf_dir).count() == 7


@pytest.mark.parametrize("name", list(change_queries.QUERIES))
def test_sql(spark, sf_dir, duck, name):
    got = rows_of(change_queries.QUERIES[name](spark, sf_dir))
    assert got == rows_of_sql(duck, change_queries.ORACLES[name]) and got[1]
