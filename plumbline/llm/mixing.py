"""Operator 4: mixing sources to target weights by temperature.

The share p of a source becomes a weight proportional to p**a. The exponent a is bisected, from 1 (shares as they are) towards
0 (all sources alike), on a fixed grid until the weights reach the wanted entropy, or as far as the repetition limit lets them.

The weights are realised as budgeted block permutations. A source's documents fall into blocks by a hash; each pass over the
source (epoch) goes through its blocks in another order. All but the last epoch take every document; the last one takes whole
blocks until the rest of the source's budget is used, and of the block that doesn't fit, documents in hash order. So only
blocks are ever ordered within a source, and only one block's documents: nothing gathers a whole source, however large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

#: Exponents are multiples of 1 / GRID.
GRID = 4096


@dataclass(frozen=True)
class Mix:
    """entropy: wanted share of the largest possible entropy (of equal weights). repeats: most times that a source's tokens
    may be used. budget: tokens of the mix over tokens there are. block: tokens of a block; a source has `blocks` at most.
    """

    entropy: float = 0.99
    repeats: float = 4.0
    budget: float = 1.0
    block: int = 65_536
    blocks: int = 65_536


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("bigint")


def _unit(*parts: Column) -> Column:
    """A hash of the parts as 15 hexadecimal digits: SQL engines agree on it, and it sorts as text."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15)


def keyed(df: DataFrame, mix: Mix) -> DataFrame:
    """df with _source (never null), _tokens and _order, by which documents are dealt to blocks and ordered in them."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return df.withColumns({"_source": source, "_tokens": n_tokens(F.col("text")), "_order": _unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))})


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The largest exponent of the grid at which the weights reach the entropy, or the least one within the repetition limit
    where the limit forbids that. sources: _source, tokens (over 0). Each step is one aggregate over the table of sources.
    """
    row = sources.agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    if not row["n"]:
        return 1.0
    share, budget = F.col("tokens") / F.lit(float(row["total"])), mix.budget * row["total"]

    def state(step: int) -> tuple[bool, bool]:
        powered = sources.select("tokens", F.pow(share, F.lit(step / GRID)).alias("w"))
        got = powered.agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.ln("w")).alias("wl"), F.max(F.col("w") / F.col("tokens")).alias("use"))
        got = got.select((F.ln("z") - F.col("wl") / F.col("z") >= mix.entropy * F.ln(F.lit(float(row["n"]))) - 1e-9).alias("even"), (budget * F.col("use") / F.col("z") <= mix.repeats + 1e-9).alias("within")).first()
        return got["even"], got["within"]

    even = _last(GRID, lambda s: state(s)[0])
    within = GRID - _last(GRID, lambda s: state(GRID - s)[1])
    return max(even, within) / GRID


def _last(n: int, holds) -> int:
    """The last of 0 .. n for which a condition that is true up to some point holds (0 if for none)."""
    low, high = 0, n + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def weights(sources: DataFrame, mix: Mix) -> DataFrame:
    """_source, tokens, weight and quota (tokens of the mix)."""
    a = exponent(sources, mix)
    total = sources.agg(F.sum("tokens").alias("total"), F.sum(F.pow(F.col("tokens"), F.lit(a))).alias("z"))
    weight = F.pow(F.col("tokens"), F.lit(a)) / F.col("z")
    return sources.crossJoin(F.broadcast(total)).select("_source", "tokens", F.round(weight, 9).alias("weight"), F.floor(F.round(weight, 9) * F.col("total") * F.lit(mix.budget)).cast("bigint").alias("quota"))


def planned(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row for each block and epoch that takes documents of it: _source, _block, n_blocks, epoch, block_rank, and cut, the
    last _order that is taken (null: all). rows: _source, _tokens, _order.
    """
    sources = common.stored(rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens")).where("tokens > 0"))
    plan = common.stored(weights(sources, mix).withColumn("n_blocks", F.least(F.ceil(F.col("tokens") / F.lit(mix.block)), F.lit(mix.blocks)).cast("int")))
    dealt = rows.join(F.broadcast(plan.select("_source", "n_blocks")) if _few(plan) else plan.select("_source", "n_blocks"), "_source").withColumn("_block", block_of("_order", "n_blocks"))
    blocks = common.stored(dealt.groupBy("_source", "_block").agg(F.sum("_tokens").alias("size")))
    epochs = plan.withColumn("whole", F.floor(F.col("quota") / F.col("tokens")).cast("int")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    epochs = epochs.select("_source", "n_blocks", "whole", "rest", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("epoch"))
    order = Window.partitionBy("_source", "epoch").orderBy("turn", "_block")
    ranked = blocks.join(epochs, "_source").withColumn("turn", _unit(F.col("_source"), F.col("epoch").cast("string"), F.col("_block").cast("string")))
    ranked = ranked.withColumns({"block_rank": F.row_number().over(order), "used": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    ranked = common.stored(ranked.where("epoch < whole or used < rest").select("_source", "_block", "n_blocks", "epoch", "block_rank", F.when((F.col("epoch") == F.col("whole")) & (F.col("used") + F.col("size") > F.col("rest")), F.col("rest") - F.col("used")).alias("left")))
    # The block that doesn't fit, one for each source at most: documents in hash order while they fit.
    torn = ranked.where("left is not null").select("_source", "_block", "left")
    inside = dealt.join(torn, ["_source", "_block"]).withColumn("used", F.sum("_tokens").over(Window.partitionBy("_source").orderBy("_order")))
    cuts = inside.where("used <= left").groupBy("_source", "_block").agg(F.max("_order").alias("cut"))
    return ranked.join(cuts, ["_source", "_block"], "left").select("_source", "_block", "n_blocks", "epoch", "block_rank", F.when(F.col("left").isNotNull(), F.coalesce("cut", F.lit(""))).alias("cut"))


def _few(plan: DataFrame) -> bool:
    """Whether the table of sources is small enough to be broadcast: 10,000 rows of under a kilobyte each."""
    return plan.where(F.length("_source") < 250).limit(10_001).count() <= 10_000 and plan.where(F.length("_source") >= 250).isEmpty()


def block_of(order: str, n_blocks: str) -> Column:
    return F.pmod(F.conv(F.substring(order, 1, 14), 16, 10).cast("bigint"), F.col(n_blocks)).cast("int")


def mixed(df: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """df with n_tokens, epoch and block_rank: each document once for each time that the mix uses it.

    df has doc_id, source and text. Null sources are a source of their own. Sources without a word aren't used. Repeated rows
    and rows of one source with the same id go together: all or none of them are taken. Null texts have no tokens. Columns
    of df with the names of the new ones are replaced; all others are kept, whatever their names.
    """
    names = [c for c in df.columns if c not in ("n_tokens", "epoch", "block_rank")]
    plan = common.stored(planned(common.stored(keyed(df.select("doc_id", "source", "text"), mix).select("_source", "_tokens", "_order")), mix))
    rows = keyed(df.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), mix)
    counts = plan.select("_source", "n_blocks").distinct()
    dealt = rows.join(F.broadcast(counts) if _few(counts) else counts, "_source").withColumn("_block", block_of("_order", "n_blocks"))
    used = dealt.join(plan.drop("n_blocks"), ["_source", "_block"]).where("cut is null or _order <= cut")
    return used.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_tokens").alias("n_tokens"), "epoch", "block_rank")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "epoch", "block_rank")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix uses them, with all their columns, whatever their names.

    Documents without a word and sources without one aren't used. Null sources are a source, null ids an id like any other;
    repeated rows and ties are taken together.
    """
    names = docs.columns
    hidden = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(names)])
    return mixed(hidden).select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(names)])


#: DuckDB SQL for op4_mixing with the parameters of Mix().
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS t,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS o
  FROM documents),
src AS (SELECT s, CAST(sum(t) AS DOUBLE) AS tokens FROM d GROUP BY s HAVING sum(t) > 0),
tot AS (SELECT sum(tokens) AS total, count(*) AS n FROM src),
grid AS (SELECT i, sum(w) AS z, sum(w * ln(w)) AS wl, max(w / tokens) AS u
         FROM (SELECT i, tokens, pow(tokens / total, i / 4096.0) AS w FROM src, tot, range(0, 4097) g(i)) GROUP BY i),
flags AS (SELECT i, ln(z) - wl / z >= 0.99 * ln(n) - 1e-9 AS even, total * u / z <= 4 + 1e-9 AS within FROM grid, tot),
a AS (SELECT greatest(coalesce(max(i) FILTER (even), 0), coalesce(min(i) FILTER (within), 4096)) / 4096.0 AS a FROM flags),
wt AS (SELECT s, tokens, round(pow(tokens, a) / sum(pow(tokens, a)) OVER (), 9) AS w FROM src, a),
q AS (SELECT s, CAST(tokens AS BIGINT) AS tokens, CAST(floor(w * total * 1.0) AS BIGINT) AS quota, CAST(least(ceil(tokens / 65536), 65536) AS BIGINT) AS nb FROM wt, tot),
e AS (SELECT s, tokens, nb, quota // tokens AS whole, quota % tokens AS rest, unnest(range(0, quota // tokens + 1)) AS epoch FROM q),
b AS (SELECT d.*, CAST('0x' || substr(o, 1, 14) AS BIGINT) % nb AS block FROM d JOIN q USING (s)),
bs AS (SELECT s, block, sum(t) AS size FROM b GROUP BY s, block),
r AS (SELECT s, block, epoch, whole, rest, size,
             row_number() OVER w AS block_rank, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS used
      FROM bs JOIN e USING (s)
      WINDOW w AS (PARTITION BY s, epoch ORDER BY substr(md5(s || '|' || epoch || '|' || block), 1, 15), block)),
k AS (SELECT * FROM r WHERE epoch < whole OR used < rest),
x AS (SELECT b.doc_id, b.source, b.t, b.o, k.epoch, k.block_rank, k.epoch = k.whole AND k.used + k.size > k.rest AS torn, k.rest - k.used AS room,
             sum(b.t) OVER (PARTITION BY b.s, b.block, k.epoch ORDER BY b.o) AS run
      FROM b JOIN k USING (s, block))
SELECT doc_id, source, CAST(t AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block_rank AS INTEGER) AS block_rank
FROM x WHERE NOT torn OR run <= room
"""
