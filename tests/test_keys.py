"""Cascades, minimal keys and collations against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cascade as K
from plumbline.operators import collations as C
from plumbline.operators import keys as M
from plumbline.operators.cascade import Link


def slow_delete(tables, links, gone):
    """tables: name -> rows as dicts. gone: name -> predicate. Rows of delete_effect, by breadth-first search over rows."""
    taken = {(t, i): (0, None) for t, p in gone.items() for i, r in enumerate(tables[t]) if p(r)}
    frontier = set(taken)
    level = 0

    def refers(link, row, parent):
        mine = tuple(row[c] for c in link.columns)
        return None not in mine and mine == tuple(parent[k] for k in link.keys)

    while frontier:
        level += 1
        new = {}
        for link in sorted(links, key=lambda x: x.name):
            if link.rule == "CASCADE":
                for i, r in enumerate(tables[link.child]):
                    if (link.child, i) not in taken and (link.child, i) not in new and any(refers(link, r, tables[t][j]) for t, j in frontier if t == link.parent):
                        new[link.child, i] = (level, link.name)
        taken.update(new)
        frontier = set(new)
    out = {}
    for (t, _), (at, name) in taken.items():
        out[t, name, "delete", at] = out.get((t, name, "delete", at), 0) + 1
    for link in links:
        if link.rule != "CASCADE":
            effect = "set null" if link.rule == "SET NULL" else "blocked"
            for i, r in enumerate(tables[link.child]):
                at = [taken[t, j][0] for t, j in taken if t == link.parent and refers(link, r, tables[t][j])]
                if (link.child, i) not in taken and at:
                    k = (link.child, link.name, effect, max(at) + 1)
                    out[k] = out.get(k, 0) + 1
    refused = any(e == "blocked" for _, _, e, _ in out)
    return sorted(((*k, n, refused) for k, n in out.items()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_deletes_go_through_all_levels(spark, seed):
    """Random keys between three tables, cycles, tables that refer to themselves, two-column keys, NULLs and repeated rows."""
    rng = random.Random(seed)
    value = lambda n: rng.choice([None, *range(n)])
    tables = {t: [{"id": rng.randrange(12), "x": value(12), "y": value(12), "z": value(4)} for _ in range(25)] for t in ("a", "b", "c")}
    tables["a"] += tables["a"][:3]
    rule = lambda: rng.choice(["CASCADE", "CASCADE", "CASCADE", "SET NULL", "RESTRICT", "NO ACTION"])
    links = [Link("k1", "b", ("x",), "a", ("id",), "CASCADE"), Link("k2", "c", ("x",), "b", ("id",), rule()), Link("k3", "a", ("y",), "a", ("id",), rule()), Link("k4", "a", ("x", "z"), "c", ("id", "z"), rule()), Link("k5", "c", ("y",), "a", ("id",), rule())]
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], "id int, x int, y int, z int") for t, rows in tables.items()}
    got = K.delete_effect(frames, links, {"a": F.col("id") < 2, "c": F.col("z") == 0})
    want = slow_delete(tables, links, {"a": lambda r: r["id"] < 2, "c": lambda r: r["z"] == 0})
    assert sorted((tuple(r) for r in got.select("table_name", "link", "effect", "level", "n_rows", "refused").collect()), key=str) == want


def test_deleting_nothing(spark):
    df = spark.createDataFrame([(1, 1)], "id int, x int")
    assert K.delete_effect({"a": df}, [Link("k", "a", ("x",), "a", ("id",), "CASCADE")], {"a": F.col("id") > 5}).collect() == []


def slow_keys(rows, names, k):
    fine = [i for i in range(len(names)) if all(r[i] is not None for r in rows)]
    keys = []
    for n in range(1, k + 1):
        for s in combinations(fine, n):
            if not any(set(o) <= set(s) for o in keys) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                keys.append(s)
    return sorted((",".join(names[i] for i in s), len(s)) for s in keys)


@pytest.mark.parametrize("seed, values, k", [(1, 3, 5), (2, 5, 3), (3, 12, 6), (4, 40, 2), (5, 2, 6)])
def test_minimal_keys(spark, monkeypatch, seed, values, k):
    monkeypatch.setattr(M, "SETS_A_SCAN", 4 if seed % 2 else 24)
    rng = random.Random(seed)
    names = list("abcdef")
    rows = list({tuple(None if seed == 4 and c == 2 and rng.random() < 0.1 else rng.randrange(values) for c in range(6)) for _ in range(60)})
    if seed == 5:
        rows.append(rows[0])
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).repartition(3)
    assert sorted(tuple(r) for r in M.minimal_keys(df, names, k).collect()) == slow_keys(rows, names, k)


def test_minimal_keys_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert sorted(r["key_columns"] for r in M.minimal_keys(df, ["a", "b"], 2).collect()) == ["a", "b"]


VALUES = ["e", "é", "E", "É", "e ", "ss", "ß", "SS", "a", "a  ", "å", "A", " a", "", " ", None, "ñ", "n", "é"]


@pytest.mark.parametrize(
    "collation, groups",
    [
        ("utf8mb4_0900_ai_ci", {("E", "É", "e", "é", "é"), ("SS", "ss", "ß"), ("A", "a", "å"), ("n", "ñ")}),
        ("utf8mb4_0900_as_ci", {("E", "e"), ("É", "é", "é"), ("SS", "ss"), ("A", "a")}),
        ("utf8mb4_0900_as_cs", {("é", "é")}),
        ("utf8mb4_general_ci", {("E", "É", "e", "é", "e ", "é"), ("SS", "ss", "ß"), ("A", "a", "å", "a  "), ("n", "ñ"), ("", " ")}),
        ("latin1_bin", {("e", "e "), ("a", "a  "), ("", " ")}),
        ("utf8mb4_0900_bin", set()),
    ],
)
def test_collations(spark, collation, groups):
    df = spark.createDataFrame([(v,) for v in VALUES for _ in range(2)], "v string")
    got = {(r["least"], r["variants"], r["n_rows"]) for r in C.collisions(df, "v", collation).collect()}
    assert got == {(min(g), len(g), 2 * len(g)) for g in groups}
    spare = sum(2 * len(g) - 1 for g in groups) + sum(1 for v in VALUES if v is not None and not any(v in g for g in groups))
    assert C.key_violations(df, {"v": collation}).first()["surplus_rows"] == spare


def test_collated_orphans(spark):
    child = spark.createDataFrame([("É",), ("f",), (None,), ("STRASSE",)], "v string")
    parent = spark.createDataFrame([("e",), ("straße",), (None,)], "k string")
    assert [r["v"] for r in C.orphans(child, "v", parent, "k", "utf8mb4_0900_ai_ci").collect()] == ["f"]
