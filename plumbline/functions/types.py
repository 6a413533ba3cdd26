"""Column types of a catalog as Spark expressions: parsing, ranges, sizes and equivalence.

A type is a struct (base, size, scale, unsigned, zerofill, vals, text) made from its text by `type_struct`. Everything is a
column expression, so a catalog of any size is handled in one projection.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIG = "decimal(20,0)"

#: Bytes of a character at most, by character set (fixed values); any other set counts as 1.
CHARSET_BYTES = {
    "armscii8": 1, "ascii": 1, "big5": 2, "binary": 1, "cp1250": 1, "cp1251": 1, "cp1256": 1, "cp1257": 1, "cp850": 1, "cp852": 1, "cp866": 1, "cp932": 2, "dec8": 1, "eucjpms": 3,
    "euckr": 2, "gb18030": 4, "gb2312": 2, "gbk": 2, "geostd8": 1, "greek": 1, "hebrew": 1, "hp8": 1, "keybcs2": 1, "koi8r": 1, "koi8u": 1, "latin1": 1, "latin2": 1, "latin5": 1,
    "latin7": 1, "macce": 1, "macroman": 1, "sjis": 2, "swe7": 1, "tis620": 1, "ucs2": 2, "ujis": 3, "utf16": 4, "utf16le": 4, "utf32": 4, "utf8": 3, "utf8mb3": 3, "utf8mb4": 4,
}

#: Signed minimum and maximum of integer types (fixed values).
INTEGERS = {
    "tinyint": (-128, 127),
    "smallint": (-32768, 32767),
    "mediumint": (-8388608, 8388607),
    "int": (-2147483648, 2147483647),
    "bigint": (-9223372036854775808, 9223372036854775807),
}
#: Most bytes of text and blob types (fixed values).
TEXT_BYTES = {"tinytext": 255, "text": 65535, "mediumtext": 16777215, "longtext": 4294967295, "xmltype": 4294967295}
BLOB_BYTES = {"tinyblob": 255, "blob": 65535, "mediumblob": 16777215, "longblob": 4294967295}

_LITERAL = r"'((?:[^']|'')*)'"


def _pick(key: Column, values: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable((k, str(v)) for k, v in values.items())])[key].cast(kind)


def type_struct(text: str | Column) -> Column:
    """The parts of a type's text. Numbers that are absent are 0; vals is null unless the type lists values."""
    text = F.col(text) if isinstance(text, str) else text
    # Patterns run only where a plain search says that they may match: most types have no literal, sign or number.
    plain = F.lower(F.when(text.contains("'"), F.regexp_replace(text, _LITERAL, "''")).otherwise(text))
    base = F.regexp_extract(plain, r"^\s*([a-z0-9_]+)", 1)
    number = lambda i: F.when(plain.contains("("), F.coalesce(F.regexp_extract(plain, r"^\s*[a-z0-9_]+\((\d+)(?:,\s*(\d+))?\)", i).try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    word = lambda w: plain.contains(w) & plain.rlike(rf"\b{w}\b")
    listed = F.when(base.isin("enum", "set"), enum_values(text))
    return F.struct(
        base.alias("base"), number(1).alias("size"), number(2).alias("scale"), word("unsigned").alias("unsigned"),
        word("zerofill").alias("zerofill"), listed.alias("vals"), text.alias("text"),
    )


def enum_values(text: Column) -> Column:
    """The values of an enum or set type, unquoted, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_LITERAL), 1), lambda v: F.replace(v, F.lit("''"), F.lit("'")))


def is_integer(t: Column) -> Column:
    return t["base"].isin(*INTEGERS)


def int_range(t: Column) -> Column:
    """Struct (low, high) of an integer type in 20 digits; null for other types."""
    low, high = (_pick(t["base"], {k: v[i] for k, v in INTEGERS.items()}, BIG) for i in (0, 1))
    return F.when(is_integer(t), F.struct(F.when(t["unsigned"], F.lit(0).cast(BIG)).otherwise(low).alias("low"), F.when(t["unsigned"], high - low).otherwise(high).cast(BIG).alias("high")))


def character_bytes(charset: Column) -> Column:
    return F.coalesce(_pick(F.coalesce(charset, F.lit("")), CHARSET_BYTES, "bigint"), F.lit(1).cast("bigint"))


def string_max_bytes(t: Column, charset: Column) -> Column:
    """Most bytes of a string type under a character set; null for other types."""
    return F.when(t["base"].isin("char", "varchar"), t["size"].cast("bigint") * character_bytes(charset)).otherwise(_pick(t["base"], TEXT_BYTES, "bigint"))


def binary_max_bytes(t: Column) -> Column:
    """Most bytes of a binary type; null for other types."""
    sized = F.when(t["base"].isin("binary", "varbinary"), t["size"].cast("bigint")).when(t["base"] == "vector", t["size"].cast("bigint") * 4)
    return F.coalesce(sized, _pick(t["base"], BLOB_BYTES, "bigint"))


def has_width(t: Column) -> Column:
    return (t["size"] > 0) & (is_integer(t) | (t["base"] == "year"))


def type_equiv(a: Column, b: Column) -> Column:
    """Whether two types are the same but for the presence of a display width. A changed width is a difference."""
    same = (a["base"] == b["base"]) & (a["unsigned"] == b["unsigned"]) & (a["zerofill"] == b["zerofill"]) & (a["scale"] == b["scale"]) & a["vals"].eqNullSafe(b["vals"])
    return same & ((a["size"] == b["size"]) | (has_width(a) != has_width(b)))


def strip_width(t: Column) -> Column:
    """The type's text without a display width; tinyint(1) and zerofill types keep theirs."""
    boolean = (t["base"] == "tinyint") & (t["size"] == 1) & ~t["unsigned"]
    return F.when(has_width(t) & ~t["zerofill"] & ~boolean, F.regexp_replace(t["text"], r"\(\d+\)", "")).otherwise(t["text"])


def plain_charset(name: Column) -> Column:
    """Character set or collation name with the older alias of three-byte Unicode replaced."""
    return F.regexp_replace(name, r"^utf8mb3(?=_|$)", "utf8")


#: Columns of a catalog's column definition that count as differences, besides type, charset and collation.
PLAIN_FIELDS = ["nullable", "auto_inc", "default_expr", "on_update", "generation_expr", "is_virtual", "comment", "invisible", "compression", "check_clause", "srid"]
#: Those that only say whether a clause is shown.
SHOWN_FIELDS = ["show_charset", "show_collation"]
#: All that identical definitions have in common.
EQUAL_FIELDS = ["column_name", "column_type", "charset", "collation", *PLAIN_FIELDS, *SHOWN_FIELDS]


def _all_equal(a: str, b: str, fields: list[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def col_equal(a: str, b: str) -> Column:
    """Whether two column definitions (struct columns named a and b) are identical."""
    return _all_equal(a, b, EQUAL_FIELDS)


def col_equiv(a: str, b: str) -> Column:
    """Whether they mean the same: shown clauses, display widths and charset aliases aside. Comments count."""
    out = _all_equal(a, b, ["column_name", *PLAIN_FIELDS]) & type_equiv(type_struct(f"{a}.column_type"), type_struct(f"{b}.column_type"))
    for f in ("charset", "collation"):
        out = out & plain_charset(F.col(f"{a}.{f}")).eqNullSafe(plain_charset(F.col(f"{b}.{f}")))
    return out


def charset_dim(spark: SparkSession) -> DataFrame:
    """charset and max_bytes: 42 rows."""
    return spark.createDataFrame(list(CHARSET_BYTES.items()), "charset string, max_bytes bigint")


def default_collation(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """df with default_collation of its column `charset`. defaults: charset, default_collation (the caller's server; a few rows)."""
    return df.join(F.broadcast(defaults), "charset", "left")


def options_map(options: Column) -> Column:
    """Create options as a map: keys in capitals, PARTITIONED dropped, values of COMPRESSION and COMMENT-like options quoted."""
    pairs = F.transform(F.filter(F.split(F.trim(options), r"\s+"), lambda p: p.contains("=")), lambda p: F.struct(F.upper(F.regexp_replace(F.substring_index(p, "=", 1), "`", "")).alias("k"), F.regexp_replace(p, "^[^=]*=|[`\"']", "").alias("v")))
    kept = F.filter(pairs, lambda p: p["k"] != "PARTITIONED")
    quoted = F.transform(kept, lambda p: F.struct(p["k"], F.when(p["v"].rlike(r"^\d+$") | (p["k"] != "COMPRESSION"), p["v"]).otherwise(F.concat(F.lit("'"), p["v"], F.lit("'")))))
    return F.map_from_entries(F.array_distinct(quoted))


def row_format(options: Column) -> Column:
    """Row format named by a map of create options: COMPRESSED where only a key block size is given, else null."""
    named = F.try_element_at(options, F.lit("ROW_FORMAT"))
    return F.coalesce(F.when(named != "DEFAULT", F.upper(named)), F.when(F.try_element_at(options, F.lit("KEY_BLOCK_SIZE")).isNotNull(), F.lit("COMPRESSED")))


def narrowest_type(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, low, high, most_bytes and fits: the narrowest integer type for integers, the least varchar for strings.

    One aggregate over all columns; a column of only nulls has no type.
    """
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    text = [c for c in columns if kinds[c] == "string"]
    aggs = [x for c in numeric for x in (F.min(c).cast(BIG).alias(f"{c}__low"), F.max(c).cast(BIG).alias(f"{c}__high"))]
    aggs += [x for c in text for x in (F.max(F.char_length(c)).alias(f"{c}__n"), F.max(F.octet_length(c)).alias(f"{c}__bytes"))]
    row = df.agg(*aggs)
    null = F.lit(None)
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__low").alias("low"), F.col(f"{c}__high").alias("high"), null.cast("bigint").alias("most_bytes"), _narrowest_integer(F.col(f"{c}__low"), F.col(f"{c}__high")).alias("fits")) for c in numeric]
    parts += [F.struct(F.lit(c).alias("column_name"), null.cast(BIG).alias("low"), null.cast(BIG).alias("high"), F.col(f"{c}__bytes").cast("bigint").alias("most_bytes"), F.concat(F.lit("varchar("), F.greatest(F.lit(1), F.col(f"{c}__n")).cast("string"), F.lit(")")).alias("fits")) for c in text]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def _narrowest_integer(low: Column, high: Column) -> Column:
    out = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, (a, b) in INTEGERS.items():
        out = out.when((low >= F.lit(a).cast(BIG)) & (high <= F.lit(b).cast(BIG)), F.lit(name)).when((low >= 0) & (high <= F.lit(str(b - a)).cast(BIG)), F.lit(f"{name} unsigned"))
    return out


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")
