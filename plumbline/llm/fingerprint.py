"""Operator 1: document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Terms are the stretches between white space, weighted by how often the text has them. For each term and sample, hashes give
r and c (gamma distributed, shape 2) and b (uniform). The term's weight S falls on the step t = floor(ln S / r + b), and its
rank is ln c - r * (t - b + 1). The term and step of the least rank are the sample. Two texts have the same sample with a
probability equal to the generalised Jaccard similarity of their weighted terms: sum of minima over sum of maxima.

A text's terms are made, counted and folded to its samples behind one shuffle of the text: every grouping is by the
document first, which its partitioning already provides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

#: Samples of a fingerprint; an estimate of a similarity s has the standard deviation sqrt(s * (1 - s) / SAMPLES).
SAMPLES = 32
#: Hexadecimal digits of a sample in the fingerprint's text.
DIGITS = 8


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """Bits of a hash as a number between 0 and 1, both excluded."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part.cast("double") + 0.5) * F.lit(2.0**-bits)


def sample(term: Column, log_weight: Column, i: int) -> Column:
    """Rank and identity of a term for sample i as one integer, so that the least one is found by min.

    The rank, between -128 and 128, is in the high 40 bits; the low 23 bits name term and step.
    """
    first, second = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    r = -F.ln(_uniform(first, 0, 24) * _uniform(first, 24, 24))
    b = _uniform(first, 48, 16)
    c = -F.ln(_uniform(second, 0, 32) * _uniform(second, 32, 32))
    t = F.floor(log_weight / r + b)
    rank = F.ln(c) - r * (t.cast("double") - b + 1.0)
    high = F.floor((rank + 128.0) * F.lit(float(1 << 32))).cast("bigint")
    name = second.bitwiseXOR(F.shiftleft(t.cast("bigint"), 7)).bitwiseAND(F.lit((1 << 23) - 1))
    return F.shiftleft(high, 23).bitwiseOR(name)


def terms(text: Column) -> Column:
    """The stretches between single white space characters (one empty stretch for an empty text)."""
    return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")


def signatures(df: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """keys and `signature`, an array of `samples` integers. keys name a text; no shuffle if df is partitioned by some of them."""
    words = df.select(*keys, F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("_w")).select(*keys, F.xxhash64("_w").alias("_w"))
    counted = words.groupBy(*keys, "_w").agg(F.count("*").alias("_n")).select(*keys, "_w", F.ln(F.col("_n").cast("double")).alias("_n"))
    least = counted.groupBy(*keys).agg(*[F.min(sample(F.col("_w"), F.col("_n"), i)).alias(f"_{i}") for i in range(samples)])
    low = F.lit((1 << 4 * DIGITS) - 1)
    return least.select(*keys, F.array(*[F.col(f"_{i}").bitwiseAND(low) for i in range(samples)]).alias("signature"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples."""
    return reduce(lambda x, y: x + y, [(F.col(a)[i] == F.col(b)[i]).cast("int") for i in range(samples)]) / F.lit(float(samples))


def hexadecimal(signature: str, samples: int = SAMPLES) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(signature)[i]), DIGITS, "0") for i in range(samples)]))


def neighbours(df: DataFrame) -> DataFrame:
    """Of each different (k, h): next_k, next_h (the one after it in descending order; after the last the first), and of the one
    that it is itself next of before_k, before_h and before_size (the text length). df has k, h and size, a row for each.

    A range partitioning and a window within each range do it; the ranges' ends meet in a table of one row a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct("k", "h", "size")
    rows = common.stored(df.select(at.alias("at")).repartitionByRange(n, F.desc("at")).withColumn("part", F.spark_partition_id()))
    within, ends = Window.partitionBy("part").orderBy(F.desc("at")), Window.orderBy("part")
    around = Window.partitionBy(F.lit(0))
    edge = rows.groupBy("part").agg(F.max("at").alias("first"), F.min("at").alias("last"))
    edge = edge.select(
        "part",
        F.coalesce(F.lead("first").over(ends), F.max("first").over(around)).alias("next_first"),
        F.coalesce(F.lag("last").over(ends), F.min("last").over(around)).alias("last_before"),
    )
    row = rows.select("at", "part", F.lead("at").over(within).alias("next"), F.lag("at").over(within).alias("before"))
    full = row.join(F.broadcast(edge), "part").select("at", F.coalesce("next", "next_first").alias("next"), F.coalesce("before", "last_before").alias("before"))
    return full.select("at.k", "at.h", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"), F.col("before.k").alias("before_k"), F.col("before.h").alias("before_h"), F.col("before.size").alias("before_size"))


def compared(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like they are to each other and to the next document.

    The edited text has its last half (rounded down, in code points) replaced by as many code points of the next document's
    start, or all it has; next is by descending doc_id, and after the last comes the first. Documents of one id with
    different texts follow each other by descending XXH64 of the text (Spark's, signed); equal rows are one document here and
    have the same next one, and each row of the input gives a row. A null doc_id is the least id; null texts are empty. Two
    empty texts are alike (1.0). Other columns are ignored.
    """
    key = ["k", "h"]
    text = F.coalesce("text", F.lit(""))
    ids = df.select(common.key().alias("k"), F.xxhash64(text).alias("h"), F.length(text).alias("size")).groupBy(*key).agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    ids = common.stored(ids)
    around = common.stored(neighbours(ids).join(ids.select(*key, "rows"), key))
    rows = df.select(common.key().alias("k"), F.xxhash64(text).alias("h"), text.alias("text")).groupBy(*key).agg(F.min("text").alias("text"))
    rows = rows.join(around, key)
    starts = rows.select(F.col("before_k").alias("k"), F.col("before_h").alias("h"), F.expr("substring(text, 1, cast(before_size div 2 as int))").alias("start"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("start", F.lit(1), half))
    both = rows.join(starts, key).select(*key, "next_k", "next_h", "rows", "text", edited.alias("edited"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    facts = both.select(*key, "next_k", "next_h", "rows", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    signed = signatures(both.select(*key, kinds.alias("x")).select(*key, "x.kind", "x.t"), [*key, "kind"], "t", samples)
    # One plan for both, so that the texts are shuffled once: both sides read the same exchange.
    found = common.stored(signed.join(facts, key))
    own = found.where("kind = 0").select(*key, "next_k", "next_h", "rows", "n_chars", "edited_sha256", F.col("signature").alias("a"))
    changed = found.where("kind = 1").select(*key, F.col("signature").alias("b"))
    following = own.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("a").alias("c"))
    out = own.join(changed, key).join(following, ["next_k", "next_h"])
    return out.select(
        common.unkey("k").alias("doc_id"), "n_chars", "edited_sha256", hexadecimal("a", samples).alias("fingerprint"), hexadecimal("b", samples).alias("edited_fingerprint"),
        likeness("a", "b", samples).alias("near_edited"), likeness("a", "c", samples).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")).alias("row"),
    ).drop("row")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(common.table(spark, sf_dir, "documents"))
