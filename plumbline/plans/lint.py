"""Lint rules over a catalog. A rule about a column or a table by itself is a condition; all of these are decided in one scan of
the columns and one of the tables. A rule that looks at more is a plan from a catalog to annotations.

Annotations: schema_name, object_type, object_name, rule, member (column, index, key; empty for the object itself). Severities and
allow-lists are policy, given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.plans.diff import COLUMN_KEY, clustered_key, existence, index_attributes
from plumbline.sources.catalog import TABLE_KEY, definitions
from plumbline.sources.staging import once_a_value


@dataclass
class Catalog:
    """The parts of a catalog that rules look at; a part may be missing (None), then its rules find nothing."""

    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame | None = None
    foreign_keys: DataFrame | None = None
    routines: DataFrame | None = None


@dataclass
class Options:
    """severities: rule -> ignore, warning, error (falsy: ignore); rules that aren't named have their default. allow: rule ->
    allowed values, in any case. reserved: a DataFrame with `word` for the reserved-word rule. spatial_needs_srid: whether the
    servers ignore spatial indexes on columns without a reference system, as MySQL does."""

    severities: dict[str, str] = field(default_factory=dict)
    allow: dict[str, list[str]] = field(default_factory=dict)
    reserved: DataFrame | None = None
    spatial_needs_srid: bool = True

    def severity(self, name: str) -> str:
        given = str(self.severities.get(name, _RULES[name].severity)).lower()
        if given in ("", "0", "false", "off", "no", "none"):
            return "ignore"
        if given not in ("ignore", "warning", "error"):
            raise ValueError(f"{name}: severity {given}")
        return given

    def allowed(self, name: str) -> list[str]:
        return [v.lower() for v in self.allow.get(name, _RULES[name].allow or [])]


@dataclass(frozen=True)
class Rule:
    """kind: plan (decide gives a DataFrame or None), column or table (decide gives a condition on a row of the scan)."""

    name: str
    severity: str
    allow: list[str] | None
    decide: Callable
    kind: str = "plan"


_RULES: dict[str, Rule] = {}


def rule(name: str, severity: str, allow: list[str] | None = None, kind: str = "plan") -> Callable:
    """Registers a rule with its default severity and, if it has one, the default allow-list. A name can be used once.

    A plan takes (catalog, options). A rule of kind column or table takes the options and gives a condition: on a column's
    definition, its type `_t`, and of its table `_table_collation` and `_next_auto_inc` (`_in_table`: whether the table is in the
    catalog); or on a table's row, with its `_compression`.
    """

    def add(f: Callable) -> Callable:
        if name in _RULES:
            raise ValueError(f"a rule named {name} is already registered")
        if kind not in ("plan", "column", "table"):
            raise ValueError(f"no such kind of rule: {kind}")
        _RULES[name] = Rule(name, severity, allow, f, kind)
        return f

    return add


def rules() -> list[str]:
    return sorted(_RULES)


def once_a_table(found: DataFrame, *order: str | Column) -> DataFrame:
    """For rules that say at most one thing about a table: the first annotation in the given order."""
    return T.first_by(found, TABLE_KEY, *order)


def _on_tables(found: DataFrame, member: str | Column = "") -> DataFrame:
    member = F.lit("") if member == "" else F.col(member) if isinstance(member, str) else member
    return found.select("schema_name", F.lit("table").alias("object_type"), F.col("table_name").alias("object_name"), member.alias("member"))


def _typed(cat: Catalog) -> DataFrame:
    """Definitions with their parsed types, which `lint` adds for all rules at once."""
    given = cat.columns if "_t" in cat.columns.columns else once_a_value(cat.columns, "column_type", "_t", T.type_struct("column_type"))
    return definitions(given)


@rule("auto-inc", "warning", ["int unsigned", "bigint unsigned"], kind="column")
def _auto_inc(opts: Options) -> Column:
    """Of a table with a stored counter: a type that isn't allowed, or a counter over four fifths of the type's range. Of several
    auto-increment columns the first counts."""
    used = F.col("_next_auto_inc").cast("double") / T.int_range(F.col("_t"))["high"].cast("double")
    plain = F.concat(F.col("_t.base"), F.when(F.col("_t.unsigned"), " unsigned").otherwise(""))
    return F.col("auto_inc") & F.col("_first_auto_inc") & (F.col("_next_auto_inc") > 0) & (~plain.isin(*opts.allowed("auto-inc")) | (used > 0.8))


def _charsets(opts: Options) -> list[str]:
    allowed = opts.allowed("charset")
    return [*allowed, "utf8", "utf8mb3"] if {"utf8", "utf8mb3"} & set(allowed) else allowed


def _bad_table_charset(collation: str, opts: Options) -> Column:
    return ~F.substring_index(collation, "_", 1).isin(*_charsets(opts))


@rule("charset", "warning", ["latin1", "utf8mb4"], kind="column")
def _charset(opts: Options) -> Column:
    """Columns of tables that are fine themselves; a table that isn't is said once (see _TABLE_PARTS)."""
    return F.col("_in_table") & ~F.coalesce(_bad_table_charset("_table_collation", opts), F.lit(False)) & ~F.col("charset").isin(*_charsets(opts))


def compression_mode(options: Column) -> Column:
    """none, Nkb or page, from a map of create options."""
    block = F.try_element_at(options, F.lit("KEY_BLOCK_SIZE"))
    page = F.coalesce(F.try_element_at(options, F.lit("COMPRESSION")), F.try_element_at(options, F.lit("PAGE_COMPRESSED")))
    plain = F.lower(F.regexp_replace(page, "['`]", ""))
    return F.when(block.isNotNull() & (block != "0"), F.concat(block, F.lit("kb"))).when(T.row_format(options) == "COMPRESSED", F.lit("8kb")).when(plain.isNotNull() & ~plain.isin("none", "", "0", "off"), F.lit("page")).otherwise(F.lit("none"))


@rule("compression", "warning", ["none", "4kb", "8kb"], kind="table")
def _compression(opts: Options) -> Column:
    mode = F.col("_compression")
    return (F.lower("engine") == "innodb") & ~mode.isin(*opts.allowed("compression"))


def user_like(user: Column, pattern: Column) -> Column:
    """Whether a user@host matches a pattern with % and _, both halves by themselves (split at the last @; no host: any)."""
    half = lambda c: (F.regexp_replace(c, "@[^@]*$", ""), F.when(c.contains("@"), F.regexp_extract(c, "@([^@]*)$", 1)).otherwise(F.lit("%")))
    (u, h), (pu, ph) = half(user), half(pattern)
    return F.call_function("like", u, pu) & F.call_function("like", F.lower(h), F.lower(ph))


@rule("definer", "error", ["%@%"])
def _definer(cat: Catalog, opts: Options) -> DataFrame | None:
    if cat.routines is None:
        return None
    matches = F.lit(False)
    for p in opts.allow.get("definer", _RULES["definer"].allow):
        matches = matches | user_like(F.col("definer"), F.lit(p))
    return _on_routines(cat.routines.where(~matches))


def _on_routines(found: DataFrame) -> DataFrame:
    return found.select("schema_name", F.lower("routine_type").alias("object_type"), F.col("routine_name").alias("object_name"), F.lit("").alias("member"))


#: Default display widths of signed integer types (fixed values); unsigned ones are one less, but for bigint.
WIDTHS = {"tinyint": 4, "smallint": 6, "mediumint": 9, "int": 11, "bigint": 20}


@rule("display-width", "warning", kind="column")
def _display_width(opts: Options) -> Column:
    t = F.col("_t")
    default = F.create_map(*[F.lit(v) for kv in WIDTHS.items() for v in kv])[t["base"]] - F.when(t["unsigned"] & (t["base"] != "bigint"), 1).otherwise(0)
    return T.is_integer(t) & (t["size"] > 0) & ~t["zerofill"] & ~((t["base"] == "tinyint") & (t["size"] == 1)) & (t["size"] != default)


@rule("dupe-index", "warning")
def _dupe_index(cat: Catalog, opts: Options) -> DataFrame | None:
    """Indexes that another one of the table makes redundant (of two that are alike the later one is reported), and spatial ones
    whose column has no reference system."""
    if cat.indexes is None:
        return None
    facts = ["index_name", "is_primary", "is_unique", "index_type", "invisible", "ordinal", "parts", "parser"]
    full = cat.indexes.withColumns({c: F.lit("") for c in ("parser", "attributes") if c not in cat.indexes.columns})
    # The indexes of a table are one group; pairs are looked at inside it.
    listed = full.groupBy(*TABLE_KEY).agg(F.collect_list(F.struct(*facts, index_attributes().alias("attributes"))).alias("_all")).where(F.size("_all") > 1)
    a = F.col("a")
    shape = lambda p: F.struct(p["column_name"], p["expression"], p["prefix_length"], p["descending"])
    alike_part = lambda x, y: (x["column_name"] == y["column_name"]) & (x["expression"] == y["expression"]) & (x["descending"] == y["descending"])
    no_longer = lambda x, y: (y["prefix_length"] == 0) | ((x["prefix_length"] > 0) & (x["prefix_length"] <= y["prefix_length"]))

    def redundant(b: Column) -> Column:
        same = F.transform(a["parts"], shape) == F.transform(b["parts"], shape)
        fits = F.forall(F.zip_with(a["parts"], F.slice(b["parts"], 1, F.greatest(F.size(a["parts"]), F.lit(1))), lambda x, y: alike_part(x, y) & no_longer(x, y)), lambda ok: F.coalesce(ok, F.lit(False)))
        starts = (F.size(a["parts"]) <= F.size(b["parts"])) & fits & ((a["index_type"] != "FULLTEXT") | (F.size(a["parts"]) == F.size(b["parts"])))
        same_attributes = a["attributes"] == b["attributes"]
        shaped = F.when(a["is_unique"] & b["is_unique"], same).when(a["index_type"] == "VECTOR", same & same_attributes).otherwise(starts)
        kinds = (a["index_name"] != b["index_name"]) & ~(a["is_unique"] & ~b["is_unique"]) & (a["index_type"] == b["index_type"]) & a["parser"].eqNullSafe(b["parser"]) & (a["invisible"] | ~b["invisible"])
        alike = same & same_attributes & (a["is_unique"] == b["is_unique"]) & (a["invisible"] == b["invisible"]) & ~b["is_primary"]
        later = (a["ordinal"] > b["ordinal"]) | ((a["ordinal"] == b["ordinal"]) & (a["index_name"] > b["index_name"]))
        return F.coalesce(kinds & shaped & (~alike | later), F.lit(False))

    found = listed.select(*TABLE_KEY, F.explode(F.filter("_all", lambda x: ~x["is_primary"])).alias("a"), "_all").where(F.exists("_all", redundant))
    names = found.select(*TABLE_KEY, F.col("a.index_name").alias("index_name"))
    if opts.spatial_needs_srid and "srid" in cat.columns.columns:
        spatial = full.where("index_type = 'SPATIAL'").select(*TABLE_KEY, "index_name", F.explode("parts.column_name").alias("column_name"))
        names = names.unionByName(spatial.join(cat.columns.where("srid is null").select(*COLUMN_KEY), COLUMN_KEY, "left_semi").select(*names.columns))
    return _on_tables(names.distinct(), "index_name")


@rule("engine", "warning", ["innodb"], kind="table")
def _engine(opts: Options) -> Column:
    return ~F.lower("engine").isin(*opts.allowed("engine"))


@rule("fk-parent", "warning")
def _fk_parent(cat: Catalog, opts: Options) -> DataFrame | None:
    """Keys whose parent table is missing, or lacks a unique key on exactly the parent columns. Other schemas aren't looked at."""
    if cat.foreign_keys is None:
        return None
    own = cat.foreign_keys.where(F.col("parent_schema").isNull() | (F.col("parent_schema") == F.col("schema_name")))
    keys = own.withColumn("_cols", F.concat_ws(",", "parent_columns"))
    parent = ["schema_name", "parent_table"]
    tables = cat.tables.select("schema_name", F.col("table_name").alias("parent_table"), F.lit(True).alias("_there"))
    unique = cat.indexes.where("is_unique").where(~F.exists("parts", lambda p: (p["prefix_length"] > 0) | (p["expression"] != ""))) if cat.indexes is not None else None
    rows = keys.select(*parent, "_cols", "table_name", "fk_name").unionByName(tables, allowMissingColumns=True)
    missing = ~F.coalesce(F.max("_there").over(Window.partitionBy(*parent)), F.lit(False))
    if unique is not None:
        exact = unique.select("schema_name", F.col("table_name").alias("parent_table"), F.array_join(F.transform("parts", lambda p: p["column_name"]), ",").alias("_cols"), F.lit(True).alias("_exact"))
        rows = rows.unionByName(exact, allowMissingColumns=True)
        missing = missing | ~F.coalesce(F.max("_exact").over(Window.partitionBy(*parent, "_cols")), F.lit(False))
    missing = rows.withColumn("_missing", missing).where("fk_name is not null and _missing")
    return _on_tables(missing, "fk_name")


@rule("has-enum", "ignore", kind="column")
def _has_enum(opts: Options) -> Column:
    return F.col("_t.base").isin("enum", "set")


@rule("has-fk", "ignore")
def _has_fk(cat: Catalog, opts: Options) -> DataFrame | None:
    if cat.foreign_keys is None:
        return None
    return _on_tables(cat.foreign_keys.groupBy(*TABLE_KEY).agg(F.count("*").cast("string").alias("_n")), "_n")


@rule("has-float", "ignore", kind="column")
def _has_float(opts: Options) -> Column:
    return F.col("_t.base").isin("float", "double")


@rule("has-routine", "ignore")
def _has_routine(cat: Catalog, opts: Options) -> DataFrame | None:
    return None if cat.routines is None else _on_routines(cat.routines)


@rule("has-time", "ignore", kind="column")
def _has_time(opts: Options) -> Column:
    return F.col("_t.base").isin("timestamp", "datetime", "time")


@rule("ids", "ignore", kind="column")
def _ids(opts: Options) -> Column:
    """Columns named id or ending in _id that aren't bigint unsigned."""
    name = F.lower("column_name")
    big = (F.col("_t.base") == "bigint") & F.col("_t.unsigned")
    return ((name == "id") | name.endswith("_id")) & ~big


@rule("name-case", "ignore", kind="table")
def _name_case(opts: Options) -> Column:
    return F.lower("table_name") != F.col("table_name")


@rule("nullable", "ignore", kind="column")
def _nullable(opts: Options) -> Column:
    return F.col("nullable")


@rule("pk", "warning")
def _pk(cat: Catalog, opts: Options) -> DataFrame | None:
    if cat.indexes is None:
        return None
    return _on_tables(existence(cat.indexes.where("is_primary"), cat.tables, TABLE_KEY).where("change = 'create'"))


@rule("pk-type", "ignore", ["tinyint", "smallint", "mediumint", "int", "bigint", "binary", "varbinary"])
def _pk_type(cat: Catalog, opts: Options) -> DataFrame | None:
    """The first column of a primary key whose type isn't allowed."""
    if cat.indexes is None:
        return None
    parts = cat.indexes.where("is_primary").select(*TABLE_KEY, F.posexplode("parts").alias("pos", "p")).select(*TABLE_KEY, "pos", F.col("p.column_name").alias("column_name"))
    wrong = _typed(cat).where(~F.col("_t.base").isin(*opts.allowed("pk-type"))).select(*COLUMN_KEY, F.lit(True).alias("_wrong"))
    bad = parts.unionByName(wrong, allowMissingColumns=True).groupBy(*COLUMN_KEY).agg(F.min("pos").alias("pos"), F.max("_wrong").alias("_wrong")).where("pos is not null and _wrong")
    return _on_tables(once_a_table(bad, "pos"), "column_name")


@rule("reserved-word", "warning")
def _reserved_word(cat: Catalog, opts: Options) -> DataFrame | None:
    """Names of tables and columns among the given words."""
    if opts.reserved is None:
        return None
    words = opts.reserved.select(F.lower("word").alias("_w")).distinct()
    tables = cat.tables.withColumn("_w", F.lower("table_name")).join(words, "_w", "left_semi")
    cols = cat.columns.withColumn("_w", F.lower("column_name")).join(words, "_w", "left_semi")
    return _on_tables(tables).unionByName(_on_tables(cols, "column_name"))


@rule("zero-date", "warning", kind="column")
def _zero_date(opts: Options) -> Column:
    value = F.regexp_replace(F.coalesce("default_expr", F.lit("")), "'", "")
    zero = value.startswith("0000-") | F.substring(value, 5, 4).isin("-00-") | value.rlike(r"^\d{4}-\d\d-00")
    return F.col("_t.base").isin("timestamp", "datetime", "date") & zero


#: Rules about columns that say something about tables as well: conditions on a table's row.
_TABLE_PARTS: dict[str, Callable[[Options], Column]] = {"charset": lambda opts: _bad_table_charset("table_collation", opts)}


def _scanned(rows: DataFrame, member: Column, conditions: dict[str, Column], opts: Options) -> DataFrame:
    """Annotations of all conditions from one scan of the rows."""
    notes = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(opts.severity(n)).alias("severity"))) for n, c in conditions.items()]))
    # explode_outer: for explode Spark would put a filter on the array before, and decide every condition twice.
    found = rows.select("schema_name", F.lit("table").alias("object_type"), F.col("table_name").alias("object_name"), member.alias("member"), F.explode_outer(notes).alias("n")).where("n is not null")
    return found.select("schema_name", "object_type", "object_name", "n.rule", "member", "n.severity")


def _of_columns(cat: Catalog, opts: Options, names: list[str]) -> DataFrame:
    rows = _typed(cat)
    if {"auto-inc", "charset"} & set(names):
        # The row of the table itself stands beside its columns: one window over both.
        tables = cat.tables.select(*TABLE_KEY, F.col("table_collation").alias("_table_collation"), F.col("next_auto_inc").alias("_next_auto_inc"), F.lit(True).alias("_in_table"))
        table = Window.partitionBy(*TABLE_KEY)
        facts = {c: F.max(c).over(table) for c in ("_table_collation", "_next_auto_inc")} | {"_in_table": F.coalesce(F.max("_in_table").over(table), F.lit(False))}
        first = F.min(F.when(F.col("auto_inc"), F.struct("ordinal", "column_name"))).over(table)["column_name"]
        facts["_first_auto_inc"] = F.coalesce(F.col("auto_inc") & (first == F.col("column_name")), F.lit(False))
        rows = rows.unionByName(tables, allowMissingColumns=True).withColumns(facts).where("column_name is not null")
    return _scanned(rows, F.col("column_name"), {n: _RULES[n].decide(opts) for n in names}, opts)


def lint(cat: Catalog, opts: Options | None = None, only: DataFrame | None = None) -> DataFrame:
    """Annotations with rule and severity of all rules that aren't ignored. only: objects (schema_name, object_name) to lint."""
    opts = opts or Options()
    active = [n for n in rules() if opts.severity(n) != "ignore"]
    by_kind = {k: [n for n in active if _RULES[n].kind == k] for k in ("column", "table", "plan")}
    on_tables = {n: _RULES[n].decide(opts) for n in by_kind["table"]} | {n: f(opts) for n, f in _TABLE_PARTS.items() if n in active}
    if by_kind["column"] or "pk-type" in active:
        cat = replace(cat, columns=once_a_value(cat.columns, "column_type", "_t", T.type_struct("column_type")))
    parts = []
    if by_kind["column"]:
        parts.append(_of_columns(cat, opts, by_kind["column"]))
    if on_tables:
        tables = cat.tables
        if "compression" in active:
            tables = once_a_value(tables, "create_options", "_compression", compression_mode(T.options_map(F.coalesce("create_options", F.lit("")))))
        parts.append(_scanned(tables, F.lit(""), on_tables, opts))
    for name in by_kind["plan"]:
        found = _RULES[name].decide(cat, opts)
        if found is not None:
            parts.append(found.select("schema_name", "object_type", "object_name", F.lit(name).alias("rule"), "member", F.lit(opts.severity(name)).alias("severity")))
    if not parts:
        parts = [cat.tables.sparkSession.createDataFrame([], "schema_name string, object_type string, object_name string, rule string, member string, severity string")]
    out = reduce(DataFrame.unionByName, parts)
    if only is not None:
        key = ["schema_name", "object_name"]
        marked = out.unionByName(only.select(*key, F.lit(True).alias("_only")), allowMissingColumns=True)
        out = marked.withColumn("_only", F.max("_only").over(Window.partitionBy(*key))).where("_only and rule is not null").select(*out.columns)
    return out


def counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("severity").agg(F.count("*").alias("n"))


def ordered(annotations: DataFrame) -> DataFrame:
    return annotations.orderBy("schema_name", "object_type", "object_name", "rule", "member")


def first_timestamps(cat: Catalog) -> DataFrame:
    """The first timestamp column of each table, by which old servers behave differently."""
    order = Window.partitionBy(*TABLE_KEY).orderBy("ordinal")
    return _typed(cat).where(F.col("_t.base") == "timestamp").withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*COLUMN_KEY)


__all__ = ["Catalog", "Options", "Rule", "clustered_key", "compression_mode", "counts", "first_timestamps", "lint", "once_a_table", "ordered", "rule", "rules", "user_like"]
