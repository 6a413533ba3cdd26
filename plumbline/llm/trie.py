"""Operator 13: prefix trie of conversations by hashes of blocks of fixed length.

A node is a sequence of first turns that one or more conversations begin with. Conversations may be as long, and a prefix as
popular, as they like: none is gathered in one task.

1. Turns become digests and numbers of words where they are read. One distributed sort gives their places (see `ranks`).
2. Each conversation is cut into blocks of `BLOCK` turns. A block's digest covers its place and its turns; the digests of the
   blocks before it, combined, name the group of conversations that agree up to there. Conversations are grouped by the group
   and their next block: an edge, with the number of its conversations and the least of them. Copies fold before the shuffle.
3. Where all of a group go on with one block, the turns inside it have the same members, and nothing is looked at. Only where
   siblings diverge is the block refined: its turn boundaries are grouped by the digest of the block's turns up to there.
4. What hangs below a node is summed by pointer doubling over nodes of two conversations or more, in log2(depth) rounds: a
   node of a single one has one leaf below and saves nothing.

Groups are named by two 64-bit hashes, nodes afterwards by their least conversation and depth. Hashes of ends are SHA-256
over all ids in order, which is sequential by its nature: the ids of a node pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, merkle, ranks

#: Turns of a block.
BLOCK = 4
#: Blocks whose digests are combined in one window; longer conversations combine those of their stretches first.
STRETCH = 1024

_NODE = ["conv_id", "depth"]


def turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, d (digest of role and text) and w (words of the text). Rows without a conv_id are of no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return df.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("d"), F.regexp_count(text, F.lit(common.WORD)).cast("bigint").alias("w")).where("conv_id is not null")


def _hashes(place: Column, digests: Column) -> list[Column]:
    """Two 64-bit hashes of a block's turns."""
    whole = F.array_join(digests, "")
    return [F.xxhash64(F.lit(seed), place, whole) for seed in (1, 2)]


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (conv_id, size, i, d, w): j, turns, ends (no turn follows), its hashes b1 and b2, and those of all before, g1, g2."""
    turn = F.sort_array(F.collect_list(F.struct("i", "d", "w")))
    blocks = rows.groupBy("conv_id", "size", F.floor(F.col("i") / BLOCK).alias("j")).agg(turn.alias("turns"))
    b = _hashes(F.col("j"), F.col("turns.d"))
    blocks = common.stored(blocks.select("conv_id", "j", F.floor(F.col("j") / STRETCH).alias("stretch"), F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"), ((F.col("j") + 1) * BLOCK >= F.col("size")).alias("ends"), b[0].alias("b1"), b[1].alias("b2")))
    xor = lambda c, window: F.coalesce(F.bit_xor(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("j")
    blocks = blocks.withColumns({f"g{k}": xor(f"b{k}", inside) for k in (1, 2)})
    # The first stretch has nothing before it, and few conversations have another.
    whole = blocks.groupBy("conv_id", "stretch").agg(*[F.bit_xor(f"b{k}").alias(f"_b{k}") for k in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("stretch")
    before = whole.select("conv_id", "stretch", *[xor(f"_b{k}", earlier).alias(f"_g{k}") for k in (1, 2)]).where("stretch > 0")
    later = blocks.where("stretch > 0").join(before, ["conv_id", "stretch"])
    later = later.withColumns({f"g{k}": F.col(f"g{k}").bitwiseXOR(F.col(f"_g{k}")) for k in (1, 2)}).drop("_g1", "_g2")
    return blocks.where("stretch = 0").unionByName(later)


def _nodes(blocks: DataFrame) -> DataFrame:
    """All nodes but the root: depth, k1 and k2 (its name), u1 and u2 (its parent's), conv_id, n_convs, n_ends, w."""
    group = ["j", "g1", "g2"]
    edges = common.stored(blocks.groupBy(*group, "b1", "b2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.any_value("turns").alias("turns")))
    diverging = edges.groupBy(*group).agg(F.count("*").alias("_blocks")).where("_blocks > 1").withColumn("_diverges", F.lit(True)).drop("_blocks")
    edges = edges.join(diverging, group, "left")

    def step(t: Column, at: Column) -> Column:
        name = lambda n: [g.bitwiseXOR(h) for g, h in zip((F.col("g1"), F.col("g2")), _hashes(F.col("j"), F.slice(F.col("turns.d"), 1, n)), strict=True)]
        own, up = name(at + 1), [F.when(at == 0, F.col(g)).otherwise(n) for g, n in zip(("g1", "g2"), name(at), strict=True)]
        last = at + 1 == F.size("turns")
        return F.struct((F.col("j") * BLOCK + at + 1).alias("depth"), own[0].alias("k1"), own[1].alias("k2"), up[0].alias("u1"), up[1].alias("u2"), F.when(last, F.col("n_ends")).otherwise(0).alias("n_ends"), t["w"].alias("w"))

    steps = edges.select("_diverges", "conv_id", "n_convs", F.transform("turns", step).alias("steps"))
    steps = steps.select("_diverges", "conv_id", "n_convs", F.inline("steps"))
    key = ["depth", "k1", "k2", "u1", "u2", "w"]
    refined = steps.where("_diverges").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"))
    return steps.where("_diverges is null").select(*refined.columns).unionByName(refined)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined members of each node. Rows come sorted by node and member; a node never spans two tasks."""
    node, state = None, None
    for batch in batches:
        conv, depth, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*_NODE, "member"))
        out: list[tuple] = []
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)], strict=True):
            if a == b:
                continue
            part = ",".join(map(str, member[a:b].tolist())).encode()
            if node == (conv[a], depth[a]):
                state.update(b"," + part)
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = (conv[a], depth[a]), hashlib.sha256(part)
        yield _hashed(out)
    if node is not None:
        yield _hashed([(*node, state.hexdigest())])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return common.arrow(pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]), conv_id=[r[0] for r in rows], depth=[r[1] for r in rows], ends_sha256=[r[2] for r in rows])


def _below(shared: DataFrame, deepest: int) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens summed over the subtrees of shared nodes (with `up`, the parent's conv_id).

    After the round of a distance each node has the sums of all nodes less than twice that far below it.
    """
    distance, state = 1, shared
    while distance <= deepest:
        far = state.where(F.col("depth") >= distance)
        gained = far.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - distance).alias("depth")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        summed = state.join(gained, _NODE, "left").select(*_NODE, "up", (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"))
        steps = state.where(F.col("depth") >= distance).select(F.col("conv_id").alias("up"), F.col("depth").alias("_at"), F.col("up").alias("_up"))
        near, far = summed.where(F.col("depth") < 2 * distance), summed.where(F.col("depth") >= 2 * distance)
        far = far.join(steps, (far["up"] == steps["up"]) & (far["depth"] - distance == steps["_at"])).select(*_NODE, F.col("_up").alias("up"), "n_leaves", "saved_tokens")
        state, distance = common.stored(near.unionByName(far)), 2 * distance
    return state.select(*_NODE, "n_leaves", "saved_tokens")


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations.

    rows: conv_id, size (turns of the conversation), i (the turn's place, from 0), d, w. conversations: conv_id, size; those
    of no turns are members of the root alone.
    """
    blocks = common.stored(_blocks(rows))
    # The root: one row, of plain counts.
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("size") == 0).alias("n_ends"), F.max("size").alias("_size")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2")], *[F.lit(None).cast("bigint").alias(c) for c in ("u1", "u2")], zero.alias("w"), "conv_id", "n_convs", "n_ends")
    nodes = common.stored(_nodes(blocks).unionByName(root))
    several = F.col("n_convs") > 1
    shared = nodes.where(several)
    # A parent that isn't shared has the same single conversation.
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("_up"))
    up = F.when(F.col("depth") > 0, F.coalesce("_up", "conv_id"))
    nodes = common.stored(nodes.join(parents, ["depth", "u1", "u2"], "left").select(*_NODE, "n_convs", "n_ends", "w", "k1", "k2", up.alias("up")))
    shared = nodes.where(several)
    children = nodes.where("depth > 0").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.count_if(~several).alias("_single"))
    shared = common.stored(shared.join(children, _NODE, "left").na.fill(0, ["n_children", "_single"]))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    childless = (F.col("n_ends") == F.col("n_convs")).cast("bigint")
    sums = _below(shared.select(*_NODE, "up", (childless + F.col("_single")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("w")).alias("saved_tokens")), deepest)
    ended = shared.where("n_ends > 0")
    at = blocks.where("ends").select((F.col("j") * BLOCK + F.size("turns")).alias("depth"), *[F.col(f"g{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)], F.col("conv_id").alias("member"))
    at = at.unionByName(conversations.where("size = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.col("conv_id").alias("member")))
    members = at.join(ended.select(*_NODE, "k1", "k2"), ["depth", "k1", "k2"]).select(*_NODE, "member")
    ends = common.mapped(members.repartition(*_NODE).sortWithinPartitions(*_NODE, "member"), _streamed, "conv_id bigint, depth bigint, ends_sha256 string")
    nothing = F.sha2(F.lit(""), 256)
    full = shared.join(sums, _NODE).join(ends, _NODE, "left").select(*_NODE, F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    one = F.lit(1).cast("bigint")
    single = nodes.where(~several).select(*_NODE, F.col("up").alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("n_ends") == 1, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return full.unionByName(single)


def _stored_turns(df: DataFrame) -> tuple[ranks.Ranked, DataFrame]:
    ranked = ranks.ranked(turns(df), "conv_id", ["turn", "d"])
    return ranked, ranked.groups.select("conv_id", "n")


def built(df: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are.

    Turns are ordered by turn, null first, and those with one number by the digest of role and text. Null roles and texts are
    empty. Repeated rows are turns each. Rows without a conv_id are left out; other columns are ignored, whatever their names.
    """
    ranked, sizes = _stored_turns(df)
    rows = ranked.placed(sizes).select("conv_id", F.col("n").alias("size"), F.col("place").alias("i"), "d", "w")
    return trie(rows, sizes.withColumnRenamed("n", "size"))


#: Conversations whose ids share a multiple of this take their first turns from that one; at most REBUILT - 1 turns.
FAMILY, REBUILT = 20, 4


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and conversations for `trie`: every conversation c begins with the first h turns of c - c % 20 (as many as there
    are), h being the CRC-32 of c modulo 4, and goes on with its own turns after its first h. Remainders have c's sign."""
    ranked, sizes = _stored_turns(df)
    h = F.crc32(F.col("conv_id").cast("string")) % REBUILT
    giver = F.col("conv_id") - F.col("conv_id") % FAMILY
    givers = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("giver"), F.col("n").alias("_have"))
    taken = F.least("h", F.coalesce("_have", F.lit(0)))
    facts = sizes.withColumns({"h": h, "giver": giver}).join(givers, "giver", "left").withColumn("taken", taken)
    facts = common.stored(facts.select("conv_id", "giver", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    placed = common.stored(ranked.placed(facts).select("conv_id", "size", "h", "taken", F.col("place").alias("i"), "d", "w"))
    own = placed.where("i >= h").select("conv_id", "size", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "d", "w")
    # A giver's first three turns go to the twenty ids of its family at most.
    first = placed.where(F.col("conv_id") % FAMILY == 0).where(F.col("i") < REBUILT - 1).select(F.col("conv_id").alias("giver"), "i", "d", "w")
    given = first.join(facts.where("taken > 0").select("conv_id", "giver", "size", "taken"), "giver").where("i < taken").select("conv_id", "size", "i", "d", "w")
    return own.unionByName(given), facts.select("conv_id", "size")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(common.table(spark, sf_dir, "conversations")))


OP13_SQL = f"""
WITH turns AS (SELECT conv_id, coalesce(text, '') AS text, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS p FROM turns),
convs AS (SELECT conv_id AS c, {merkle.CRC32_SQL.format("conv_id::VARCHAR")} % {REBUILT} AS h, conv_id - conv_id % {FAMILY} AS giver FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c, 0 AS part, p, d, w FROM convs JOIN placed ON conv_id = giver AND p < h
  UNION ALL SELECT c, 1, p, d, w FROM convs JOIN placed ON conv_id = c AND p >= h),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS depth, d, w FROM parts),
paths AS (
  SELECT c, depth, w, md5(string_agg(d, '') OVER (PARTITION BY c ORDER BY depth)) AS k FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM paths GROUP BY depth, k),
members AS (SELECT c, depth, conv_id, n_convs, nodes.w, depth = max(depth) OVER (PARTITION BY c) AS last FROM paths JOIN nodes USING (depth, k)),
tree AS (SELECT n.*, p.conv_id AS up FROM (SELECT DISTINCT depth, conv_id, n_convs, w FROM members) n LEFT JOIN members p ON p.c = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT up AS conv_id, depth - 1 AS depth, count(*) AS n FROM tree WHERE depth > 0 GROUP BY ALL),
below AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS low, b.depth AS low_depth FROM members a JOIN members b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT b.conv_id, b.depth, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((t.n_convs - 1) * t.w) AS saved
  FROM below b JOIN tree t ON t.conv_id = low AND t.depth = low_depth LEFT JOIN kids k ON k.conv_id = low AND k.depth = low_depth GROUP BY b.conv_id, b.depth),
ended AS (SELECT conv_id, depth, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM members WHERE last GROUP BY conv_id, depth)
SELECT t.conv_id, t.depth::BIGINT AS depth, t.up AS parent_conv_id, t.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t JOIN sums s USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) LEFT JOIN ended e USING (conv_id, depth)
"""
