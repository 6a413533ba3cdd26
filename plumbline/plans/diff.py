"""Differences between two catalogs as equi joins on object keys: `a` is what there is, `b` what is wanted.

Every function takes DataFrames of a whole fleet. Columns go through `definitions` first (see sources.catalog). The two sides are
paired by a union that is grouped by key: where both are partitioned by schema_name alike, as `sources.fleet.derived` gives them,
nothing is shuffled, because each group lies within a shard.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.sources.catalog import TABLE_KEY, definitions
from plumbline.sources.shipping import mapped
from plumbline.sources.staging import stored

COLUMN_KEY = [*TABLE_KEY, "column_name"]


def _sides(a: DataFrame, b: DataFrame, key: list[str], old: Column, new: Column) -> DataFrame:
    """A row for each key, with `old` of a and `new` of b (null where a side lacks it). A key is in each side once."""
    x, y = a.select(*key, old.alias("old")), b.select(*key, new.alias("new"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = x.select(*key, "old", none(y, "new")).unionByName(y.select(*key, none(x, "old"), "new"))
    return rows.groupBy(*key).agg(F.max("old").alias("old"), F.max("new").alias("new"))


def existence(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key and change: create, drop or both."""
    both = _sides(a, b, key, F.lit(True), F.lit(True)).withColumnsRenamed({"old": "_a", "new": "_b"})
    return both.select(*key, F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "drop").otherwise("both").alias("change"))


def diff_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """schema_name and change (create, drop, alter) by charset and collation of the schema."""
    x = a.select("schema_name", F.struct("charset", "collation").alias("_a"))
    y = b.select("schema_name", F.struct("charset", "collation").alias("_b"))
    change = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "drop").when(~F.col("_a").eqNullSafe(F.col("_b")), "alter")
    return x.join(y, "schema_name", "full_outer").select("schema_name", change.alias("change")).where("change is not null")


def diff_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    return existence(a, b, TABLE_KEY)


#: What a table's fingerprint covers, in this order: what drift shows, as its SQL does.
FINGERPRINT = ["ordinal", "column_name", "column_type", "nullable", "charset", "collation", "default_expr", "comment"]


def fingerprints(columns: DataFrame) -> DataFrame:
    """schema_name, table_name, fingerprint and definition: SHA-256 of the table's column definitions in their order.

    `fingerprint` covers FINGERPRINT, `definition` every field that col_equal compares, nulls told from texts: only tables
    with the same `definition` are identical. Ordinals count by rank, so gaps in them don't matter. A group is one table wide.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in FINGERPRINT[1:]])
    whole = F.to_json(F.struct(*T.EQUAL_FIELDS))  # leaves out nulls
    hashed = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"]), "\n"), 256)
    cols = definitions(columns).select(*TABLE_KEY, F.struct("ordinal", text.alias("text")).alias("_c"), F.struct("ordinal", whole.alias("text")).alias("_d"))
    return cols.groupBy(*TABLE_KEY).agg(hashed("_c").alias("fingerprint"), hashed("_d").alias("definition"))


def changed_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables on both sides whose definitions aren't identical: the wide joins need to look at no others."""
    x, y = (fingerprints(s).select(*TABLE_KEY, F.col("definition").alias(n)) for s, n in ((a, "_a"), (b, "_b")))
    return x.join(y, TABLE_KEY).where("_a <> _b").select(*TABLE_KEY)


def _hashed(columns: DataFrame) -> Column:
    """A 64-bit hash of a column's definition with its ordinal. Hashes skip nulls, so where these are is hashed as well."""
    fields = ["ordinal", *T.EQUAL_FIELDS]
    nulls = reduce(lambda x, y: x + y, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fields)])
    return F.xxhash64(*fields, nulls)


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is needed to name each change of the columns of tables on both sides: a row for each column that only one side has or
    that differs, and for each column of a table whose common columns changed their order.

    TABLE_KEY, column_name, old and new (definitions, null where a side lacks the column), old_rank and new_rank among the
    common columns, first and after (the place in the wanted order), inside (a column that exists follows there), equal,
    reordered. Only tables with a difference of definitions or ordinals are ranked; windows hold one table.
    """
    a, b = definitions(a), definitions(b)
    fields = [c for c in b.columns if c not in TABLE_KEY]
    rows = _sides(a, b, COLUMN_KEY, F.struct(*fields), F.struct(*fields))
    table = Window.partitionBy(*TABLE_KEY)
    by = lambda side: table.orderBy(F.col(f"{side}.ordinal").asc_nulls_last())
    common = F.col("old").isNotNull() & F.col("new").isNotNull()
    rows = rows.withColumn("_common", common).withColumn("equal", F.col("_common") & T.col_equal("old", "new"))
    there = F.max(F.col("old").isNotNull()).over(table) & F.max(F.col("new").isNotNull()).over(table)
    differs = F.max(~F.col("equal") | ~F.col("old.ordinal").eqNullSafe(F.col("new.ordinal"))).over(table)
    rows = rows.withColumns({"_there": there, "_differs": differs}).where("_there and _differs").drop("_there", "_differs")
    rank = lambda side: F.sum(F.col("_common").cast("int")).over(by(side).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_last": F.max(F.when(F.col("_common"), F.col("new.ordinal"))).over(table), "old_rank": rank("old"), "new_rank": rank("new"), "after": F.lag("column_name").over(by("new"))})
    rows = rows.withColumn("reordered", F.max(F.col("_common") & (F.col("old_rank") != F.col("new_rank"))).over(table))
    rows = rows.withColumns({"first": F.col("after").isNull(), "inside": F.coalesce(F.col("new.ordinal") < F.col("_last"), F.lit(False))})
    return rows.where(~F.col("equal") | F.col("reordered")).drop("_last", "_common")


def compared_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """As `_compared`, stored: for what reads it more than once."""
    return stored(_compared(a, b))


def column_drops(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's columns that b lacks, of tables on both sides."""
    return _compared(a, b).where("new is null").select(*TABLE_KEY, "old.*")


def column_adds(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's columns that a lacks, of tables on both sides, with `first` and `after`: set only if a column that exists follows (else
    it goes last)."""
    return _compared(a, b).where("old is null").select(*TABLE_KEY, "new.*", (F.col("inside") & F.col("first")).alias("first"), F.when(F.col("inside"), F.col("after")).alias("after"))


def column_mods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns on both sides that differ, with structs old and new and cosmetic (equivalent though not equal)."""
    fields = [c for c in definitions(a).columns if c not in TABLE_KEY]
    both = _sides(definitions(a), definitions(b), COLUMN_KEY, F.struct(*fields), F.struct(*fields))
    both = both.where(F.col("old").isNotNull() & F.col("new").isNotNull() & ~T.col_equal("old", "new"))
    return both.withColumn("cosmetic", T.col_equiv("old", "new"))


def moved_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables whose common columns changed their order."""
    narrow = [s.select(*COLUMN_KEY, "ordinal", F.lit("").alias("column_type")) for s in (a, b)]
    return _compared(*narrow).where("reordered").select(*TABLE_KEY).distinct()


def longest_increasing(x: list[int]) -> set[int]:
    """Places of a longest increasing subsequence: of several the one whose last items are least."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(x):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out: set[int] = set()
    i = at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = before[i]
    return out


def column_moves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns to move, with `first` and `after` in the wanted order: as many as possible stay in place.

    Only tables whose order changed are gathered, and a group is one table wide.
    """
    narrow = [s.select(*COLUMN_KEY, "ordinal", F.lit("").alias("column_type")) for s in (a, b)]
    rows = stored(_compared(*narrow).where("reordered").select(*COLUMN_KEY, "old_rank", "new_rank", "first", "after", (F.col("old").isNotNull() & F.col("new").isNotNull()).alias("_common")))
    return _moved(rows.where("_common")).join(rows.select(*COLUMN_KEY, "first", "after"), COLUMN_KEY)


def _moved(pairs: DataFrame) -> DataFrame:
    """COLUMN_KEY of the columns to move. pairs: COLUMN_KEY, old_rank and new_rank of the common columns of each table."""
    column = F.struct("new_rank", "old_rank", "column_name")
    tables = pairs.groupBy(*TABLE_KEY).agg(F.sort_array(F.collect_list(column)).alias("columns"))

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for columns in batch.column("columns").to_pylist():
                stay = longest_increasing([c["old_rank"] for c in columns])
                names.append([c["column_name"] for i, c in enumerate(columns) if i not in stay])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in TABLE_KEY), pa.array(names, pa.list_(pa.string()))], names=[*TABLE_KEY, "names"])

    found = mapped(tables, moves, "schema_name string, table_name string, names array<string>")
    return found.select(*TABLE_KEY, F.explode("names").alias("column_name"))


def in_unique_constraint(old_indexes: DataFrame, new_indexes: DataFrame) -> DataFrame:
    """Columns that one unique constraint (by name) has on both sides."""
    parts = [indexes_with_column(x).where("is_unique").select(*COLUMN_KEY, "index_name") for x in (old_indexes, new_indexes)]
    return existence(*parts, [*COLUMN_KEY, "index_name"]).where("change = 'both'").select(*COLUMN_KEY).distinct()


def indexes_with_column(indexes: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """An index for each column in it. With `columns`, columns inside an expression part count too."""
    parts = indexes.select(*TABLE_KEY, "index_name", "is_unique", "is_primary", F.explode("parts").alias("p"))
    plain = parts.where("p.column_name <> ''").select(*TABLE_KEY, "index_name", "is_unique", "is_primary", F.col("p.column_name").alias("column_name"))
    if columns is None:
        return plain
    inside = parts.where("p.expression <> ''").join(columns.select(*COLUMN_KEY), TABLE_KEY).where(F.col("p.expression").contains(F.concat(F.lit("`"), F.col("column_name"), F.lit("`"))))
    return plain.unionByName(inside.select(*plain.columns)).distinct()


def clustered_key(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """Index that rows are stored by: the primary key, else the first unique index of columns that are all NOT NULL."""
    parts = indexes.where("is_unique").select(*TABLE_KEY, "index_name", "is_primary", "ordinal", F.explode("parts").alias("p"))
    known = parts.withColumn("column_name", F.col("p.column_name")).join(columns.select(*COLUMN_KEY, "nullable"), COLUMN_KEY, "left")
    good = known.groupBy(*TABLE_KEY, "index_name", "is_primary", "ordinal").agg(F.bool_and((F.col("p.expression") == "") & ~F.coalesce("nullable", F.lit(True))).alias("_all"))
    usable = good.where("is_primary or _all")
    return usable.groupBy(*TABLE_KEY).agg(F.min(F.struct((~F.col("is_primary")).alias("_p"), "ordinal", "index_name"))["index_name"].alias("index_name"))


def table_flags(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """has_virtual, has_auto_inc, has_fulltext of each table."""
    c = definitions(columns).groupBy(*TABLE_KEY).agg(F.bool_or(F.coalesce("is_virtual", F.lit(False))).alias("has_virtual"), F.bool_or(F.coalesce("auto_inc", F.lit(False))).alias("has_auto_inc"))
    i = indexes.groupBy(*TABLE_KEY).agg(F.bool_or(F.col("index_type") == "FULLTEXT").alias("has_fulltext"))
    return c.join(i, TABLE_KEY, "left").withColumn("has_fulltext", F.coalesce("has_fulltext", F.lit(False)))


def column_changes(a: DataFrame, b: DataFrame, in_unique: DataFrame | None = None) -> DataFrame:
    """The changes table of columns (stored): clause (drop column, add column, modify column, move column), member, old, new, first, after,
    cosmetic, supported, in_unique. A column that is modified and moved is one modification with a position."""
    rows = compared_columns(a, b)
    moved = _moved(rows.where("reordered and old is not null and new is not null").select(*COLUMN_KEY, "old_rank", "new_rank"))
    rows = rows.join(moved.withColumn("_moved", F.lit(True)), COLUMN_KEY, "left").withColumn("_moved", F.coalesce("_moved", F.lit(False)))
    rows = rows.where(~F.col("equal") | F.col("_moved"))
    clause = F.when(F.col("new").isNull(), "drop column").when(F.col("old").isNull(), "add column").when(F.col("equal"), "move column").otherwise("modify column")
    placed_ = F.when(clause == "add column", F.col("inside")).otherwise(F.col("_moved"))
    cosmetic = (clause == "modify column") & ~F.col("_moved") & T.col_equiv("old", "new")
    out = rows.select(*TABLE_KEY, F.col("column_name").alias("member"), clause.alias("clause"), "old", "new", (placed_ & F.col("first")).alias("first"), F.when(placed_, F.col("after")).alias("after"), F.coalesce(cosmetic, F.lit(False)).alias("cosmetic"), F.lit(True).alias("supported"))
    out = stored(out)
    return out.withColumn("in_unique", F.lit(False)) if in_unique is None else marked_unique(out, in_unique)


def marked_unique(changes: DataFrame, in_unique: DataFrame) -> DataFrame:
    """changes with in_unique: whether their column is among those of in_unique_constraint."""
    unique = in_unique.select(*TABLE_KEY, F.col("column_name").alias("member"), F.lit(True).alias("in_unique"))
    return changes.join(unique, [*TABLE_KEY, "member"], "left").withColumn("in_unique", F.coalesce("in_unique", F.lit(False)))


@dataclass(frozen=True)
class Modifiers:
    """Which differences count. Each switch that is on lets go, or insists on, one kind."""

    lax_column_order: bool = False
    lax_comments: bool = False
    strict_columns: bool = False
    strict_keys: bool = False
    strict_checks: bool = False
    compare_metadata: bool = False


def apply_modifiers(changes: DataFrame, mods: Modifiers) -> DataFrame:
    """Column changes without those that the modifiers let go.

    Under lax comments a change counts as if the comment were the same, so a column that moved and changed nothing but its
    comment goes under lax comments and lax column order together. What stays keeps the new comment.
    """
    old = F.col("old").withField("comment", F.col("new.comment")) if mods.lax_comments else F.col("old")
    out = changes.withColumn("_old", old)
    modified, moved, equal = F.col("clause") == "modify column", F.col("first") | F.col("after").isNotNull(), T.col_equal("_old", "new")
    goes = F.lit(False)
    if mods.lax_comments:
        goes = goes | (modified & ~moved & equal)
    if mods.lax_column_order:
        goes = goes | (F.col("clause") == "move column") | (modified & moved & equal)
    if not mods.strict_columns:
        goes = goes | (modified & (F.lit(True) if mods.lax_column_order else ~moved) & T.col_equiv("_old", "new"))
    return out.where(~F.coalesce(goes, F.lit(False))).drop("_old")


def apply_key_modifiers(changes: DataFrame, mods: Modifiers) -> DataFrame:
    """Changes of foreign keys and checks (see diff_fks, diff_checks) without the cosmetic ones, unless their kind is strict."""
    strict = F.when(F.col("clause").endswith("foreign key"), F.lit(mods.strict_keys)).otherwise(F.lit(mods.strict_checks))
    return changes.where(~F.col("cosmetic") | strict)


def apply_table_modifiers(changes: DataFrame, mods: Modifiers) -> DataFrame:
    """All changes of tables (TABLE_KEY, clause) without those of tables whose only change is their comment, under lax comments."""
    return changes.join(table_comment_only(changes), TABLE_KEY, "left_anti") if mods.lax_comments else changes


def table_comment_only(changes: DataFrame) -> DataFrame:
    """Tables whose only change is their comment."""
    return changes.groupBy(*TABLE_KEY).agg(F.count("*").alias("_n"), F.count_if(F.col("clause") == "comment").alias("_c")).where("_n = 1 and _c = 1").select(*TABLE_KEY)


# Keys, indexes, checks


def diff_pk(a: DataFrame, b: DataFrame) -> DataFrame:
    """clause (drop primary key, add primary key) where the primary key differs: a change is a drop and an add."""
    x = a.where("is_primary").select(*TABLE_KEY, signature().alias("_a"))
    y = b.where("is_primary").select(*TABLE_KEY, signature().alias("_b"))
    both = x.join(y, TABLE_KEY, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    clauses = F.array_compact(F.array(F.when(F.col("_a").isNotNull(), F.lit("drop primary key")), F.when(F.col("_b").isNotNull(), F.lit("add primary key"))))
    return both.select(*TABLE_KEY, F.explode(clauses).alias("clause"))


#: Attributes that a vector index has where none are given (fixed values).
VECTOR_DEFAULTS = {"M": "6", "DISTANCE": "euclidean"}


def index_attributes() -> Column:
    """The attributes of an index as sorted NAME=value texts: quotes, case and order aside, defaults of vector indexes filled in."""
    given = F.transform(F.filter(F.split(F.trim(F.coalesce("attributes", F.lit(""))), r"\s+"), lambda p: p != ""), lambda p: F.regexp_replace(p, "[`'\"]", ""))
    pairs = F.map_from_entries(F.transform(given, lambda p: F.struct(F.upper(F.substring_index(p, "=", 1)).alias("k"), F.lower(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"))))
    usual = F.create_map(*[F.lit(x) for kv in VECTOR_DEFAULTS.items() for x in kv])
    both = F.when(F.upper("index_type") == "VECTOR", F.map_zip_with(usual, pairs, lambda k, u, v: F.coalesce(v, u))).otherwise(pairs)
    texts = F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    none = (F.coalesce("attributes", F.lit("")) == "") & (F.upper(F.coalesce("index_type", F.lit(""))) != "VECTOR")
    return F.when(none, F.array().cast("array<string>")).otherwise(texts)


def signature() -> Column:
    """What makes two indexes do the same, whatever their names, comments and visibility."""
    parts = F.transform("parts", lambda p: F.struct(p["column_name"], p["expression"], p["prefix_length"], p["descending"]))
    return F.sha2(F.to_json(F.struct("is_unique", "is_primary", "index_type", F.coalesce("parser", F.lit("")).alias("parser"), index_attributes().alias("attributes"), parts.alias("parts"))), 256)


def diff_indexes(a: DataFrame, b: DataFrame) -> DataFrame:
    """clause (drop, add, rename, modify index), member and new_member of secondary indexes.

    An index that is gone and one that is new with the same signature are a rename. Where several could pair, the first by
    ordinal pairs with the first.
    """
    x, y = (s.where("not is_primary").select(*TABLE_KEY, "index_name", "ordinal", "comment", "invisible", signature().alias("sig")) for s in (a, b))
    key = [*TABLE_KEY, "index_name"]
    gone, new = x.join(y.select(*key), key, "left_anti"), y.join(x.select(*key), key, "left_anti")
    turn = F.row_number().over(Window.partitionBy(*TABLE_KEY, "sig").orderBy("ordinal", "index_name"))
    left = gone.select(*TABLE_KEY, "sig", turn.alias("_turn"), F.col("index_name").alias("member"))
    right = new.select(*TABLE_KEY, "sig", turn.alias("_turn"), F.col("index_name").alias("new_member"))
    pairs = left.join(right, [*TABLE_KEY, "sig", "_turn"], "full_outer")
    clause = F.when(F.col("new_member").isNull(), "drop index").when(F.col("member").isNull(), "add index").otherwise("rename index")
    moved = pairs.select(*TABLE_KEY, clause.alias("clause"), F.coalesce("member", "new_member").alias("member"), F.when(F.col("member").isNotNull(), F.col("new_member")).alias("new_member"))
    facts = lambda s, n: s.select(*key, F.struct("sig", "comment", "invisible").alias(n))
    same = facts(x, "_a").join(facts(y, "_b"), key).where(~F.col("_a").eqNullSafe(F.col("_b")))
    return moved.unionByName(same.select(*TABLE_KEY, F.lit("modify index").alias("clause"), F.col("index_name").alias("member"), F.lit(None).cast("string").alias("new_member")))


_PLAIN_RULE = lambda c: F.when(F.col(c).isin("RESTRICT", "NO ACTION", ""), F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def _paired(a: DataFrame, b: DataFrame, name: str, equal: list[Column], same: list[Column], noun: str, plain: bool) -> DataFrame:
    """clause, member and cosmetic for named constraints. equal: all that must be equal; same: all that matters in effect.

    plain: whether a replaced one can be cosmetic.
    """
    text = lambda cols: F.sha2(F.to_json(F.struct(*cols)), 256)
    x = a.select(*TABLE_KEY, name, text(equal).alias("_ea"), text(same).alias("_sa"))
    y = b.select(*TABLE_KEY, name, text(equal).alias("_eb"), text(same).alias("_sb"))
    both = x.join(y, [*TABLE_KEY, name], "full_outer").where(~F.col("_ea").eqNullSafe(F.col("_eb")))
    clauses = F.array_compact(F.array(F.when(F.col("_ea").isNotNull(), F.struct(F.lit(f"drop {noun}").alias("clause"), F.col("_sa").alias("sig"))), F.when(F.col("_eb").isNotNull(), F.struct(F.lit(f"add {noun}").alias("clause"), F.col("_sb").alias("sig")))))
    rows = both.withColumn("_pair", F.col("_ea").isNotNull() & F.col("_eb").isNotNull()).select(*TABLE_KEY, F.col(name).alias("member"), "_pair", (F.col("_sa") == F.col("_sb")).alias("_same"), F.explode(clauses).alias("c"))
    other = a.select(*TABLE_KEY, F.lit(f"add {noun}").alias("_clause"), text(same).alias("_sig")).unionByName(b.select(*TABLE_KEY, F.lit(f"drop {noun}").alias("_clause"), text(same).alias("_sig"))).distinct().withColumn("_twin", F.lit(True))
    rows = rows.select(*TABLE_KEY, "member", "_pair", "_same", F.col("c.clause").alias("_clause"), F.col("c.sig").alias("_sig"))
    found = rows.join(other, [*TABLE_KEY, "_clause", "_sig"], "left")
    cosmetic = F.when(F.col("_pair"), F.coalesce("_same", F.lit(False)) if plain else F.lit(False)).otherwise(F.coalesce("_twin", F.lit(False)))
    return found.select(*TABLE_KEY, F.col("_clause").alias("clause"), "member", cosmetic.alias("cosmetic"))


#: All that makes two foreign keys of a name equal.
FK_FIELDS = ["columns", "parent_schema", "parent_table", "parent_columns", "update_rule", "delete_rule"]


def diff_fks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dropped and added foreign keys; cosmetic if the other side has one that does the same, or only the rule's spelling
    changes (RESTRICT, NO ACTION and none are alike)."""
    effect = ["columns", "parent_schema", "parent_table", "parent_columns", _PLAIN_RULE("update_rule").alias("u"), _PLAIN_RULE("delete_rule").alias("d")]
    return _paired(a, b, "fk_name", FK_FIELDS, effect, "foreign key", True)


def diff_checks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dropped and added checks (cosmetic: renamed only) and those that are only enforced otherwise (alter check)."""
    key = [*TABLE_KEY, "check_name"]
    enforced = a.join(b.select(*key, F.col("clause").alias("_c"), F.col("enforced").alias("_e")), key).where("clause = _c and enforced <> _e")
    altered = enforced.select(*key)
    rest = [x.join(altered, key, "left_anti") for x in (a, b)]
    paired = _paired(rest[0], rest[1], "check_name", ["clause", "enforced"], ["clause", "enforced"], "check", False)
    return paired.unionByName(altered.select(*TABLE_KEY, F.lit("alter check").alias("clause"), F.col("check_name").alias("member"), F.lit(False).alias("cosmetic")))


# Tables


def _attributes(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in ("engine", "table_comment", "tablespace") if c in a.columns and c in b.columns]


def diff_attrs(a: DataFrame, b: DataFrame) -> DataFrame:
    """clause (engine, comment, tablespace), old_value and new_value of tables on both sides."""
    there = _attributes(a, b)
    both = _sides(a, b, TABLE_KEY, F.struct(*there), F.struct(*there)).where("old is not null and new is not null and old <> new")
    rows = [F.struct(F.lit(c.removeprefix("table_")).alias("clause"), F.col(f"old.{c}").alias("old_value"), F.col(f"new.{c}").alias("new_value")) for c in there]
    return both.select(*TABLE_KEY, F.explode(F.array(*rows)).alias("r")).select(*TABLE_KEY, "r.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def diff_charset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables whose default collation differs, old aliases of three-byte Unicode aside."""
    both = a.select(*TABLE_KEY, F.col("table_collation").alias("old_value")).join(b.select(*TABLE_KEY, F.col("table_collation").alias("new_value")), TABLE_KEY)
    return both.where(T.plain_charset(F.col("old_value")) != T.plain_charset(F.col("new_value")))


def diff_autoinc(a: DataFrame, b: DataFrame, mode: str = "if-increased") -> DataFrame:
    """Tables whose next counter differs. mode: ignore, if-increased, if-already (the old one is over 1), always."""
    both = a.select(*TABLE_KEY, F.col("next_auto_inc").alias("old_value")).join(b.select(*TABLE_KEY, F.col("next_auto_inc").alias("new_value")), TABLE_KEY).where("old_value <> new_value")
    rule = {"ignore": "false", "if-increased": "new_value > old_value", "if-already": "old_value > 1", "always": "true"}[mode]
    return both.where(rule)


#: Values that make an option disappear again (fixed values); others go back to DEFAULT.
OPTION_DEFAULTS = {"MIN_ROWS": "0", "MAX_ROWS": "0", "AVG_ROW_LENGTH": "0", "CHECKSUM": "0", "DELAY_KEY_WRITE": "0", "KEY_BLOCK_SIZE": "0", "COMPRESSION": "''"}


def _option_default(option: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in OPTION_DEFAULTS.items() for v in kv]), option), F.lit("DEFAULT"))


def diff_options(a: DataFrame, b: DataFrame) -> DataFrame:
    """option, old_value and new_value (an option that goes gets its default) of tables on both sides."""
    x, y = (s.select(*TABLE_KEY, T.options_map(F.coalesce("create_options", F.lit(""))).alias(n)) for s, n in ((a, "_a"), (b, "_b")))
    zipped = F.map_zip_with("_a", "_b", lambda k, v, w: F.struct(v.alias("old"), F.coalesce(w, _option_default(k)).alias("new"), (~v.eqNullSafe(w)).alias("differs")))
    rows = x.join(y, TABLE_KEY).select(*TABLE_KEY, F.explode(F.map_filter(zipped, lambda k, v: v["differs"])).alias("option", "v"))
    return rows.select(*TABLE_KEY, "option", F.col("v.old").alias("old_value"), F.col("v.new").alias("new_value"))


def diff_partitioning(a: DataFrame, b: DataFrame, mode: str = "modify") -> DataFrame:
    """clause (partition by, remove partitioning, modify partitions) and supported.

    mode: modify, keep (never take partitioning away or change it) or remove (never add it). Partition lists, if there are any
    (partition_list), may differ for RANGE and LIST without effect; for other methods that isn't supported.
    """
    facts = ["partition_method", "partition_expression"]
    lists = "partition_list" in a.columns and "partition_list" in b.columns
    x = a.select(*TABLE_KEY, F.struct(*facts).alias("_a"), (F.col("partition_list") if lists else F.lit("")).alias("_la"))
    y = b.select(*TABLE_KEY, F.struct(*facts).alias("_b"), (F.col("partition_list") if lists else F.lit("")).alias("_lb"))
    both = x.join(y, TABLE_KEY)
    has_a, has_b = F.coalesce("_a.partition_method", F.lit("")) != "", F.coalesce("_b.partition_method", F.lit("")) != ""
    ordered = F.col("_b.partition_method").startswith("RANGE") | F.col("_b.partition_method").startswith("LIST")
    clause = (
        F.when(~has_a & has_b, F.lit(None if mode == "remove" else "partition by"))
        .when(has_a & ~has_b, F.lit(None if mode == "keep" else "remove partitioning"))
        .when(has_a & has_b & ~F.col("_a").eqNullSafe(F.col("_b")), F.lit(None if mode in ("keep", "remove") else "partition by"))
        .when(has_a & has_b & ~F.col("_la").eqNullSafe(F.col("_lb")), "modify partitions")
    )
    return both.select(*TABLE_KEY, clause.alias("clause"), F.coalesce((clause != "modify partitions") | ordered, F.lit(True)).alias("supported")).where("clause is not null")


def partition_changes(a: DataFrame, b: DataFrame, mode: str = "modify") -> DataFrame:
    """As diff_partitioning, with n_dropped: the partitions of a's list whose names b's list lacks, where the list alone changes.

    a and b have partition_list, an array of structs with a name.
    """
    names = [s.select(*TABLE_KEY, F.col("partition_list.name").alias(n)) for s, n in ((a, "_old"), (b, "_new"))]
    gone = F.size(F.array_except(F.coalesce("_old", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))))
    found = diff_partitioning(a, b, mode).join(names[0], TABLE_KEY).join(names[1], TABLE_KEY)
    return found.select(*TABLE_KEY, "clause", "supported", F.when(F.col("clause") == "modify partitions", gone).otherwise(0).alias("n_dropped"))


#: What a routine was created under; it counts only where metadata is compared.
ROUTINE_METADATA = ("sql_mode", "collation")


def diff_routines(a: DataFrame, b: DataFrame, mods: Modifiers = Modifiers()) -> DataFrame:
    """clause (create, drop, alter, replace routine) and signature_changed. Security, data access and comment can be altered
    (but a comment that goes away needs a replacement); all else replaces the routine. Under lax comments a comment is no
    difference by itself; metadata is one only if the modifiers compare it."""
    key = ["schema_name", "routine_type", "routine_name"]
    facts = [c for c in a.columns if c not in key and (mods.compare_metadata or c not in ROUTINE_METADATA) and not (mods.lax_comments and c == "comment")]
    x, y = a.select(*key, F.struct(*facts).alias("_a")), b.select(*key, F.struct(*facts).alias("_b"))
    soft = [c for c in ("security", "data_access", "comment") if c in facts]
    hard = F.lit(False)
    for c in facts:
        if c not in soft:
            hard = hard | ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    cleared = (F.col("_a.comment") != "") & (F.coalesce("_b.comment", F.lit("")) == "") if "comment" in facts else F.lit(False)
    clause = F.when(F.col("_a").isNull(), "create routine").when(F.col("_b").isNull(), "drop routine").when(hard | cleared, "replace routine").when(~F.col("_a").eqNullSafe(F.col("_b")), "alter routine")
    signed = F.lit(False)
    for c in ("params", "returns"):
        if c in facts:
            signed = signed | ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    both = x.join(y, key, "full_outer").select(*key, clause.alias("clause"), ((clause == "replace routine") & signed).alias("signature_changed"))
    return both.where("clause is not null")


# Whole plans


def mark_supported(changes: DataFrame, b: DataFrame) -> DataFrame:
    """changes with supported false where the wanted table has a feature that isn't (b: TABLE_KEY, unsupported)."""
    joined = changes.join(b.where("unsupported").select(*TABLE_KEY, F.lit(True).alias("_u")), TABLE_KEY, "left")
    return joined.withColumn("supported", F.col("supported") & ~F.coalesce("_u", F.lit(False))).drop("_u")


def unexplained(a: DataFrame, b: DataFrame, changes: DataFrame) -> DataFrame:
    """Tables that differ though no change says how."""
    return changed_tables(definitions(a), definitions(b)).join(changes.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_anti")


def changed_keys(changes: DataFrame, key: list[str] = TABLE_KEY) -> DataFrame:
    """Objects with a real difference."""
    return changes.where("not cosmetic").select(*key).distinct()


def differing_instances(changes: DataFrame, instance: str = "schema_name") -> DataFrame:
    return changes.where("not cosmetic").select(instance).distinct()


def summarise(plan: DataFrame, target: str = "schema_name") -> DataFrame:
    """target, n_changes, n_unsafe, n_unsupported and differs, by target and over all (target NULL)."""
    counts = [F.count("*").alias("n_changes"), F.count_if("unsafe").alias("n_unsafe"), F.count_if(~F.col("supported")).alias("n_unsupported"), F.coalesce(F.bool_or(~F.col("cosmetic")), F.lit(False)).alias("differs")]
    return plan.rollup(target).agg(*counts)


def placed(old: list[str], dropped: set[str], positions: list[tuple[str, bool, str | None, bool]]) -> list[str]:
    """Column names after the changes: positions are (name, first, after, new) in the wanted order."""
    names = [n for n in old if n not in dropped]
    for name, first, after, new in positions:
        if not new and not first and after is None:
            continue
        if name in names:
            names.remove(name)
        at = 0 if first else names.index(after) + 1 if after in names else len(names)
        names.insert(at, name)
    return names


def verify(a: DataFrame, b: DataFrame, changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Columns that still differ after the changes are applied to `a`: none, if the changes are complete and right.

    Definitions, changes and wanted columns of a column are one group. Orders are replayed table by table, for each table where a
    change may place columns or where one on both sides has another ordinal: any other is in order as it is. partitions:
    where a and b are partitioned by schema_name, into how many; the changes are dealt alike, and nothing else is shuffled.
    """
    a, b = definitions(a), definitions(b)
    fields = [c for c in b.columns if c not in (*TABLE_KEY, "ordinal")]
    changes = changes.repartition(partitions, "schema_name") if partitions else changes
    made = F.when(F.col("new").isNotNull(), F.struct(*[F.col(f"new.{f}").alias(f) for f in fields]))
    placing = F.coalesce(F.col("first"), F.lit(False)) | F.col("after").isNotNull() | F.col("clause").isin("add column", "drop column", "move column")
    step = F.struct(F.col("new.ordinal").alias("at"), made.alias("made"), "first", "after", "clause", placing.alias("placing"))
    fact = lambda s, name: s.select(*COLUMN_KEY, F.struct("ordinal", F.struct(*fields).alias("d")).alias(name))
    steps = changes.select(*TABLE_KEY, F.col("member").alias("column_name"), step.alias("step"))
    parts = fact(a, "old").unionByName(fact(b, "new"), allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)
    rows = parts.groupBy(*COLUMN_KEY).agg(F.max("old").alias("old"), F.max("new").alias("new"), F.collect_list("step").alias("steps"))
    table = Window.partitionBy(*TABLE_KEY)
    there = F.max(F.col("old").isNotNull()).over(table) & F.max(F.col("new").isNotNull()).over(table)
    ordered = F.exists("steps", lambda x: x["placing"]) | F.coalesce(F.col("old.ordinal") != F.col("new.ordinal"), F.lit(False))
    rows = rows.withColumns({"_there": there, "_ordered": there & F.max(ordered).over(table)})
    kept = F.array_compact(F.array(F.when(F.col("_there"), F.col("old.d"))))
    rows = rows.withColumn("_got", F.when(F.size("steps") > 0, F.filter(F.transform("steps", lambda x: x["made"]), lambda d: d.isNotNull())).otherwise(kept))
    wanted = F.col("_there") & F.col("new").isNotNull()
    met = F.coalesce(wanted & F.array_contains("_got", F.col("new.d")), F.lit(False))
    rows = rows.withColumn("_left", F.size("_got") + wanted.cast("int") - 2 * met.cast("int"))
    narrow = F.transform("steps", lambda x: F.struct(x["at"].alias("at"), x["first"].alias("first"), x["after"].alias("after"), x["clause"].alias("clause")))
    at = lambda side: F.when(F.col("_there"), F.col(f"{side}.ordinal"))
    rows = stored(rows.where("_left > 0 or _ordered").select(*COLUMN_KEY, "_left", "_ordered", at("old").alias("old_at"), at("new").alias("new_at"), narrow.alias("steps")))
    left = rows.where("_left > 0").select(*COLUMN_KEY, F.explode(F.array_repeat(F.lit("definition"), F.col("_left"))).alias("problem"))
    column = F.struct("column_name", "old_at", "new_at", "steps")
    tables = rows.where("_ordered").groupBy(*TABLE_KEY).agg(F.collect_list(column).alias("columns"))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [misplaced(columns) for columns in batch.column("columns").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in TABLE_KEY), pa.array(bad, pa.list_(pa.string()))], names=[*TABLE_KEY, "names"])

    orders = mapped(tables, replay, "schema_name string, table_name string, names array<string>")
    return left.unionByName(orders.select(*TABLE_KEY, F.explode("names").alias("column_name"), F.lit("order").alias("problem")))


def misplaced(columns: list[dict]) -> list[str]:
    """Names of a table's wanted columns that aren't in their places after its changes are replayed."""
    listed = lambda at: [c["column_name"] for c in sorted((c for c in columns if c[at] is not None), key=lambda c: c[at])]
    steps = [(c["column_name"], x) for c in columns for x in c["steps"]]
    moves = sorted((s for s in steps if s[1]["clause"] != "drop column"), key=lambda s: (s[1]["at"] is None, s[1]["at"]))
    got = placed(listed("old_at"), {n for n, x in steps if x["clause"] == "drop column"}, [(n, bool(x["first"]), x["after"], x["clause"] == "add column") for n, x in moves])
    want = listed("new_at")
    return [n for n, m in zip(want, got + [None] * len(want), strict=False) if n != m]


@dataclass(frozen=True)
class Parts:
    """What the tables of a side are and have besides columns."""

    tables: DataFrame
    indexes: DataFrame
    foreign_keys: DataFrame
    checks: DataFrame


#: What tables are, by the functions that compare them.
TABLE_FIELDS = ["engine", "table_comment", "tablespace", "table_collation", "create_options", "next_auto_inc", "partition_method", "partition_expression", "partition_list"]


def _unlike(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows of the tables that have any difference among them (stored): no other table has a change."""
    facts = F.struct(*[c for c in fields if c in a.columns and c in b.columns])
    differs = F.max(~F.col("old").eqNullSafe(F.col("new"))).over(Window.partitionBy(*TABLE_KEY))
    both = stored(_sides(a, b, key, facts, facts).withColumn("_differs", differs).where("_differs"))
    return both.where("old is not null").select(*key, "old.*"), both.where("new is not null").select(*key, "new.*")


def table_changes(a: Parts, b: Parts) -> DataFrame:
    """The changes of tables on both sides besides those of columns: all of them, cosmetic ones and every counter too. What tables
    have that only one side knows is dropped or added too.

    TABLE_KEY, clause, kind and name of the fact that it changes, and what the fact is then: the wanted side's (wanted), what was
    there under another name (source), a value (made), or with none of these gone. A change of several facts is as many rows.
    """
    clause, member, none = F.col("clause"), F.col("member"), F.lit("")
    null = F.lit(None).cast("string")

    def to(kind: str | Column, name: Column, wanted: Column | None = None, source: Column | None = None, made: Column | None = None) -> Column:
        kind, wanted, source, made = F.lit(kind) if isinstance(kind, str) else kind, F.lit(False) if wanted is None else wanted, null if source is None else source, null if made is None else made
        return F.struct(kind.alias("kind"), name.alias("name"), wanted.alias("wanted"), source.alias("source"), made.cast("string").alias("made"))

    named = lambda x, y, name: _unlike(x, y, [*TABLE_KEY, name], [c for c in x.columns if c not in (*TABLE_KEY, name)])
    indexes, keys, checks = named(a.indexes, b.indexes, "index_name"), named(a.foreign_keys, b.foreign_keys, "fk_name"), named(a.checks, b.checks, "check_name")
    x, y = _unlike(a.tables, b.tables, TABLE_KEY, TABLE_FIELDS)
    added, value = clause.startswith("add"), F.col("new_value")
    found = [
        (diff_pk(*indexes), clause, [to("index", F.lit("PRIMARY"), added)]),
        (diff_indexes(*indexes), clause, [to("index", member, clause.isin("add index", "modify index")), F.when(clause == "rename index", to("index", F.col("new_member"), source=member))]),
        (diff_fks(*keys), clause, [to("foreign key", member, added)]),
        (diff_checks(*checks), clause, [F.when(clause != "alter check", to("check", member, added)), to("enforcement", member, clause != "drop check")]),
        (diff_attrs(x, y), clause, [to(clause, none, made=value)]),
        (diff_charset(x, y), F.lit("charset"), [to("charset", none, made=T.plain_charset(value))]),
        (diff_autoinc(x, y, "always"), F.lit("next_auto_inc"), [to("next_auto_inc", none, made=value)]),
        (diff_options(x, y), F.lit("option"), [to("option", F.col("option"), made=F.when(value != _option_default(F.col("option")), value))]),
        # Lists alone may differ: either without effect, or that isn't supported.
        (diff_partitioning(x, y).where("clause <> 'modify partitions'"), clause, [to("partitioning", none, clause == "partition by")]),
    ]
    rows = [df.select(*TABLE_KEY, name.alias("clause"), F.explode(F.array_compact(F.array(*steps))).alias("step")) for df, name, steps in found]
    return reduce(DataFrame.unionByName, rows).select(*TABLE_KEY, "clause", "step.*")


def _facts(side: Parts, attributes: list[str]) -> DataFrame:
    """TABLE_KEY, facts (kind, name, definition; null: unset) and listed: whether the row is the table's own. Several rows a table.
    Options are one fact: see `_split`."""
    none, text = F.lit(""), lambda *fields: F.to_json(F.struct(*fields))
    fact = lambda kind, name, definition: F.struct(F.lit(kind).alias("kind"), name.alias("name"), definition.cast("string").alias("definition"))
    scheme = F.when(F.coalesce("partition_method", none) != "", text("partition_method", "partition_expression"))
    own = [fact(c.removeprefix("table_"), none, F.col(c)) for c in attributes]
    own += [fact("charset", none, T.plain_charset(F.col("table_collation"))), fact("next_auto_inc", none, F.col("next_auto_inc")), fact("partitioning", none, scheme)]
    own.append(fact("options", none, F.coalesce("create_options", none)))
    rows = [
        side.tables.select(*TABLE_KEY, F.array(*own).alias("facts"), F.lit(True).alias("listed")),
        side.indexes.select(*TABLE_KEY, F.array(fact("index", F.col("index_name"), text(signature().alias("sig"), "comment", "invisible"))).alias("facts"), F.lit(None).cast("boolean").alias("listed")),
        side.foreign_keys.select(*TABLE_KEY, F.array(fact("foreign key", F.col("fk_name"), text(*FK_FIELDS))).alias("facts"), F.lit(None).cast("boolean").alias("listed")),
        side.checks.select(*TABLE_KEY, F.array(fact("check", F.col("check_name"), F.col("clause")), fact("enforcement", F.col("check_name"), F.col("enforced"))).alias("facts"), F.lit(None).cast("boolean").alias("listed")),
    ]
    return reduce(DataFrame.unionByName, rows)


def _split(facts: str) -> Column:
    """A table's facts with one for each of its options: those that are at their defaults are unset."""
    option = lambda e: F.struct(F.lit("option").alias("kind"), e["key"].alias("name"), F.when(e["value"] != _option_default(e["key"]), e["value"]).alias("definition"))
    whole = F.transform(F.filter(facts, lambda f: f["kind"] == "options"), lambda f: F.transform(F.map_entries(T.options_map(f["definition"])), option))
    return F.concat(F.filter(facts, lambda f: f["kind"] != "options"), F.flatten(whole))


def verify_tables(a: Parts, b: Parts, changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """What still differs, columns aside, after the changes (see table_changes) are applied to `a`: TABLE_KEY, kind and name of each
    fact that is too much or missing. For tables on both sides; the order of indexes and of checks and lists of partitions don't count.

    Facts and changes of a table are one group. partitions: as for `verify`.
    """
    attributes = _attributes(a.tables, b.tables)
    changes = changes.repartition(partitions, "schema_name") if partitions else changes
    x, y = (_facts(s, attributes).withColumnsRenamed({"facts": n, "listed": f"_{n}"}) for s, n in ((a, "old"), (b, "new")))
    steps = changes.select(*TABLE_KEY, F.struct("kind", "name", "wanted", "source", "made").alias("step"))
    parts = x.unionByName(y, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)
    lists = [F.flatten(F.collect_list(n)).alias(n) for n in ("old", "new")]
    rows = parts.groupBy(*TABLE_KEY).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"), *lists, F.collect_list("step").alias("steps"))
    # What is the same on both sides and isn't changed is as it should be.
    rows = rows.where("_old and _new").where((F.size("steps") > 0) | (F.sort_array("old") != F.sort_array("new")))
    rows = rows.withColumns({n: _split(n) for n in ("old", "new")})
    of = lambda f: F.struct(f["kind"].alias("kind"), f["name"].alias("name"))
    rows = rows.select(*TABLE_KEY, "old", "new", "steps", F.explode(F.array_distinct(F.concat(*[F.transform(c, of) for c in ("old", "new", "steps")]))).alias("_of"))
    texts = lambda side, kind, name: F.transform(F.filter(side, lambda f: (f["kind"] == kind) & (f["name"] == name) & f["definition"].isNotNull()), lambda f: f["definition"])
    kind, name = F.col("_of.kind"), F.col("_of.name")
    rows = rows.withColumns({"_had": texts("old", kind, name), "_want": texts("new", kind, name), "_steps": F.filter("steps", lambda s: (s["kind"] == kind) & (s["name"] == name))})
    made = lambda s: F.when(s["source"].isNotNull(), texts("old", kind, s["source"])).when(s["wanted"], F.col("_want")).otherwise(F.array_compact(F.array(s["made"])))
    rows = rows.withColumn("_got", F.when(F.size("_steps") > 0, F.flatten(F.transform("_steps", made))).otherwise(F.col("_had")))
    met = F.coalesce(F.array_contains("_got", F.get("_want", F.lit(0))), F.lit(False))
    left = F.size("_got") + F.size("_want") - 2 * met.cast("int")
    return rows.select(*TABLE_KEY, name.alias("name"), F.explode(F.array_repeat(kind, left)).alias("kind"))


def drift(columns: DataFrame) -> DataFrame:
    """schema_name, table_name, fingerprint, shards and majority of the shards whose definition of a table isn't the usual one.

    The usual one is what most shards have; of equally frequent ones the least fingerprint. Definitions that differ only in
    fields that the fingerprint doesn't cover are told apart by the hash of the whole definition in its place. A table's
    variants are counted before they are ranked, so a window holds the variants of a table, not its shards.
    """
    columns = definitions(columns)
    made = stored(columns.select(*TABLE_KEY, _hashed(columns).alias("_h")).groupBy(*TABLE_KEY).agg(F.bit_xor("_h").alias("_h"), F.count("*").alias("_n")))
    key = ["table_name", "_h", "_n"]
    # A shard stands for each variant; only its definition is written out, sorted and hashed at length.
    variants = stored(made.groupBy(*key).agg(F.count("*").alias("_shards"), F.min("schema_name").alias("schema_name")))
    texts = fingerprints(columns.join(variants.select(*TABLE_KEY), TABLE_KEY, "left_semi")).withColumnRenamed("fingerprint", "_print")
    variants = stored(variants.join(texts, TABLE_KEY).drop("schema_name"))
    variant = ["table_name", "_print", "definition"]
    counts = variants.groupBy(*variant).agg(F.sum("_shards").alias("shards"))
    alone = F.count("*").over(Window.partitionBy("table_name", "_print")) == 1
    shown = counts.withColumn("fingerprint", F.when(alone, F.col("_print")).otherwise(F.col("definition")))
    order = Window.partitionBy("table_name").orderBy(F.desc("shards"), "fingerprint")
    ranked = shown.withColumn("_r", F.row_number().over(order))
    usual = ranked.where("_r = 1").select("table_name", F.col("fingerprint").alias("majority"))
    # Stored, so that the shards' side of the join below is a plain shuffle that can be split where a variant is frequent.
    odd = stored(variants.join(ranked.where("_r > 1").join(usual, "table_name"), variant).select(*key, "fingerprint", "shards", "majority"))
    return made.join(odd, key).select(*TABLE_KEY, "fingerprint", "shards", "majority")


def history(snapshots: DataFrame) -> DataFrame:
    """snapshot, column key and event (appeared, type changed, vanished). snapshots: columns catalogs with a number `snapshot`.

    Every table that a snapshot has counts as seen in it, so a column vanishes at the first snapshot of its table without it.
    """
    columns = snapshots.groupBy(*COLUMN_KEY).agg(F.sort_array(F.collect_list(F.struct("snapshot", "column_type"))).alias("_has"))
    # A table's snapshots are few: they go through windows of its columns.
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_has.snapshot").over(Window.partitionBy(*TABLE_KEY)))))
    types = F.transform("_seen", lambda n: F.struct(n.alias("snapshot"), F.try_element_at(F.filter("_has", lambda x: x["snapshot"] == n), F.lit(1))["column_type"].alias("column_type")))
    rows = columns.withColumn("_seen", seen).withColumn("_at", types)
    old = lambda i: F.when(i > 0, F.get("_at", i - 1)["column_type"])
    event = lambda now, before: F.when(now.isNotNull() & before.isNull(), "appeared").when(now.isNull() & before.isNotNull(), "vanished").when(now != before, "type changed")
    told = F.transform("_at", lambda x, i: F.struct(x["snapshot"].alias("snapshot"), event(x["column_type"], old(i)).alias("event"), old(i).alias("old_type"), x["column_type"].alias("new_type")))
    rows = rows.select(*COLUMN_KEY, F.explode(F.filter(told, lambda x: x["event"].isNotNull())).alias("e"))
    return rows.select("e.snapshot", *COLUMN_KEY, "e.event", "e.old_type", "e.new_type")


# History as intervals

_INTERVAL = [*COLUMN_KEY, "column_type", "valid_from", "valid_to"]


def opened(snapshot: DataFrame, number: int) -> DataFrame:
    """The intervals of a first snapshot: COLUMN_KEY, column_type, valid_from and valid_to (null: still so)."""
    return snapshot.select(*COLUMN_KEY, "column_type", F.lit(number).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))


def merged(intervals: DataFrame, snapshot: DataFrame, number: int) -> DataFrame:
    """The intervals after one more snapshot, which is all that is read besides them; closed ones aren't joined.

    Columns of tables that the snapshot has end or change their type at its number; columns of other tables go on.
    """
    past, now = intervals.where("valid_to is not null"), intervals.where("valid_to is null")
    both = _sides(now, snapshot, COLUMN_KEY, F.struct("column_type", "valid_from"), F.struct("column_type"))
    there = {"_there": F.col("old").isNotNull(), "_new": F.when(F.col("new").isNotNull(), True), "column_type": F.col("old.column_type"), "valid_from": F.col("old.valid_from"), "_type": F.col("new.column_type")}
    both = both.withColumns(there).withColumn("_seen", F.max("_new").over(Window.partitionBy(*TABLE_KEY)))
    changed = F.coalesce("_there", F.lit(False)) & F.coalesce("_new", F.lit(False)) & ~F.col("column_type").eqNullSafe(F.col("_type"))
    ends = changed | (F.col("_new").isNull() & F.coalesce("_seen", F.lit(False)))
    old = F.when(F.col("_there"), F.struct("column_type", "valid_from", F.when(ends, F.lit(number)).alias("valid_to")))
    begins = F.when(changed | ~F.col("_there"), F.struct(F.col("_type").alias("column_type"), F.lit(number).alias("valid_from"), F.lit(None).cast("int").alias("valid_to")))
    rows = both.select(*COLUMN_KEY, F.explode(F.array_compact(F.array(old, begins))).alias("r")).select(*COLUMN_KEY, "r.*")
    return past.select(*_INTERVAL).unionByName(rows.select(*_INTERVAL))


def events(intervals: DataFrame) -> DataFrame:
    """What `history` finds, from intervals: snapshot, COLUMN_KEY, event, old_type and new_type."""
    order = Window.partitionBy(*COLUMN_KEY).orderBy("valid_from")
    rows = intervals.withColumns({"_to": F.lag("valid_to").over(order), "_old": F.lag("column_type").over(order), "_next": F.lead("valid_from").over(order)})
    goes_on = F.coalesce(F.col("valid_from") == F.col("_to"), F.lit(False))
    null = F.lit(None).cast("string")
    start = F.struct(F.col("valid_from").alias("snapshot"), F.when(goes_on, "type changed").otherwise("appeared").alias("event"), F.when(goes_on, F.col("_old")).alias("old_type"), F.col("column_type").alias("new_type"))
    end = F.struct(F.col("valid_to").alias("snapshot"), F.lit("vanished").alias("event"), F.col("column_type").alias("old_type"), null.alias("new_type"))
    stops = F.col("valid_to").isNotNull() & ~F.coalesce(F.col("_next") == F.col("valid_to"), F.lit(False))
    return rows.select(*COLUMN_KEY, F.explode(F.array_compact(F.array(start, F.when(stops, end)))).alias("e")).select("e.snapshot", *COLUMN_KEY, "e.event", "e.old_type", "e.new_type")
