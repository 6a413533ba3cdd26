"""What deleting rows does through all levels of foreign keys.

A fixpoint over the graph of keys: rows that a cascade takes are parents of the next round, and only the rows that a round
adds are looked at in the next (semi-naive). Cycles and tables that refer to themselves end by themselves, as a row is taken
once. Tables enter as classes of rows: those with the same values in all columns that keys use fare alike, so a class has a
count and is all that is joined. Each round is stored, which cuts lineage; a round reads the frontier of the one before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.staging import stored


@dataclass(frozen=True)
class Link:
    """A foreign key: `columns` of child refer to `keys` of parent. rule: CASCADE, SET NULL; all else (RESTRICT, NO ACTION) blocks."""

    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]
    rule: str = "RESTRICT"


def classes(table: DataFrame, name: str, links: list[Link], where: Column | None = None) -> DataFrame:
    """The rows of a table by the columns that links use, with n_rows and whether they are in the set to delete (_gone)."""
    used = sorted({c for x in links if x.child == name for c in x.columns} | {c for x in links if x.parent == name for c in x.keys})
    gone = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*used, gone.alias("_gone")).groupBy(*used, "_gone").agg(F.count("*").alias("n_rows"))


def _without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key, nulls alike, others don't have."""
    known = others.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(key)])
    return rows.join(known, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(key)], F.lit(True)), "left_anti")


def _referring(link: Link) -> Column:
    """Joins a child to keys named _p0, _p1, ...: all parts are there and equal."""
    return reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(link.columns)])


def _whole(link: Link) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in link.columns])


def _hit(rows: DataFrame, link: Link, parents: DataFrame) -> DataFrame:
    """Classes of a child whose key, all parts present, is that of one of the parents."""
    keys = parents.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(link.keys)]).distinct()
    return rows.where(_whole(link)).join(keys, _referring(link), "left_semi")


def delete_effect(tables: dict[str, DataFrame], links: list[Link], gone: dict[str, Column]) -> DataFrame:
    """table_name, link (null: rows of the set itself), effect (delete, set null, blocked), level and n_rows.

    tables: by name. gone: which rows of them are to go. level: the round in which the rows were reached (0: the set). A row that
    several links reach counts once, for the first round and, within it, the link with the least name. SET NULL and blocking
    stop there, and count only rows that the same delete doesn't take; their level is 1 more than the last level of the
    parents that they refer to. Any blocked row means that the whole delete is refused: `refused` says so in every row.
    """
    names = sorted({x.child for x in links} | {x.parent for x in links} | set(gone))
    rows = {t: stored(classes(tables[t], t, links, gone.get(t))) for t in names}
    taken: dict[str, list[DataFrame]] = {}
    frontier = {t: stored(rows[t].where("_gone").drop("_gone").select("*", F.lit(0).alias("_level"), F.lit(None).cast("string").alias("_link"))) for t in gone}
    frontier = {t: f for t, f in frontier.items() if not f.isEmpty()}
    level = 0
    while frontier:
        for t, f in frontier.items():
            taken.setdefault(t, []).append(f)
        level += 1
        reached: dict[str, list[DataFrame]] = {}
        for link in links:
            if link.rule == "CASCADE" and link.parent in frontier:
                hit = _hit(rows[link.child].where("not _gone").drop("_gone"), link, frontier[link.parent])
                reached.setdefault(link.child, []).append(hit.withColumns({"_level": F.lit(level), "_link": F.lit(link.name)}))
        frontier = {}
        for t, parts in reached.items():
            key = [c for c in rows[t].columns if c not in ("n_rows", "_gone")]
            new = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.first("_level").alias("_level"), F.min("_link").alias("_link"), F.first("n_rows").alias("n_rows"))
            for before in taken.get(t, []):
                new = _without(new, before.where("_level > 0"), key)
            new = stored(new)
            if not new.isEmpty():
                frontier[t] = new
    every = {t: stored(reduce(DataFrame.unionByName, parts)) for t, parts in taken.items()}
    out = [e.select(F.lit(t).alias("table_name"), F.col("_link").alias("link"), F.lit("delete").alias("effect"), F.col("_level").alias("level"), "n_rows") for t, e in every.items()]
    for link in links:
        if link.rule == "CASCADE" or link.parent not in every:
            continue
        left = rows[link.child].where("not _gone").drop("_gone")
        if link.child in every:
            left = _without(left, every[link.child].where("_level > 0"), [c for c in left.columns if c != "n_rows"])
        last = every[link.parent].groupBy(*link.keys).agg(F.max("_level").alias("_last"))
        keys = last.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(link.keys)], "_last")
        effect = "set null" if link.rule == "SET NULL" else "blocked"
        out.append(left.where(_whole(link)).join(keys, _referring(link)).select(F.lit(link.child).alias("table_name"), F.lit(link.name).alias("link"), F.lit(effect).alias("effect"), (F.col("_last") + 1).alias("level"), "n_rows"))
    kind = "table_name string, link string, effect string, level int, n_rows bigint"
    found = reduce(DataFrame.unionByName, out) if out else next(iter(tables.values())).sparkSession.createDataFrame([], kind)
    counts = stored(found.groupBy("table_name", "link", "effect", "level").agg(F.sum("n_rows").alias("n_rows")))
    refused = not counts.where("effect = 'blocked'").isEmpty()
    return counts.withColumn("refused", F.lit(refused))
