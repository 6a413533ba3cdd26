"""Operator 11: Merkle manifest of a dataset, with proofs by pointer jumping.

A row's leaf is the digest of its fields. Leaves of a source, in the order of their ids, are folded in runs of 16 into nodes,
nodes into nodes, up to the source's subroot; subroots, in the order of sources, are folded the same way up to the root.

1. Leaves are made where the rows are read; texts go no further. One distributed sort gives places (see `ranks`).
2. Levels are built bottom up, each an aggregate over runs of 16 and a sixteenth of the one before.
3. Every inner node starts with the siblings in its run, split into those before and after it, and a pointer to its parent.
   A round joins the nodes with themselves on the pointer: segments are concatenated and the distance to the ancestor
   doubles, so that after log2(depth) rounds all point to the root. Nodes that are there leave the rounds.
4. A leaf takes its last jump in the row of its run: its own siblings are there, and the run's node has the rest. So a proof is
   made and checked in its row, and the proofs of leaves, the bulk of all, are neither shuffled nor stored.

Defined results: null fields, empty texts and long texts have digests of their own; a null id comes before all others, a null
source before all sources. Rows with one id are ordered by their leaf; each row gives a row, repeated ones too. An empty table
has no rows and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, ranks

#: Children of a node.
ARITY = 16
#: The tree of the subroots; sources have the trees 0, 1, ...
_TOP = -1
_KEY = ["tree", "level", "idx"]
_UP = ["up_tree", "up_level", "up_idx"]


def digest(*fields: Column) -> Column:
    """SHA-256, in hex, of values that are told apart by their sizes: `-` for null, else UTF-8 bytes, a colon, the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parent(digests: Column) -> Column:
    return F.sha2(_joined(digests), 256)


def _siblings(digests: Column, at: Column) -> Column:
    """The digests of a run before and after the one at a place (from 0)."""
    return F.struct(_joined(F.slice(digests, 1, at)).alias("before"), _joined(F.slice(digests, at + 2, F.lit(ARITY))).alias("after"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda digest_, s: F.sha2(F.concat(s["before"], digest_, s["after"]), 256))


def _up(tree: Column, level: Column | int, idx: Column, total: Column, last: bool) -> list[Column]:
    """The pointer to the parent of a node among `total` ones on its level. A tree's own root is the leaf of its number in the
    top tree (if that has no other, it is the root); pointers to the root are null."""
    ends = F.ceil(total / ARITY) == 1
    null = F.lit(None).cast("bigint")
    top = [null, null, null] if last else [F.lit(_TOP).cast("bigint"), F.lit(0).cast("bigint"), tree]
    own = [tree, F.lit(level).cast("bigint"), F.floor(idx / ARITY)]
    return [F.when(ends, a).otherwise(b).alias(n) for a, b, n in zip(top, own, _UP, strict=True)]


@dataclass
class Tree:
    """runs: leaves in runs of 16 (tree, run, total, kids: place, id, leaf, presented). paths: inner nodes with `path` to the root,
    from the node upwards (None if the root has none below it but leaves). subroots: tree, subroot. root: one row."""

    runs: DataFrame
    paths: DataFrame | None
    subroots: DataFrame
    root: DataFrame
    sources: int


def _levels(nodes: DataFrame, most: int, level: int, last: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Folds nodes (tree, idx, total, h) level by level. Returns the segments of all nodes with a parent and the trees' roots.

    most: nodes of the largest tree. last: whether the roots are the root.
    """
    segments, roots = [], []
    while True:
        roots.append(nodes.where("total = 1").select("tree", "h"))
        if most <= 1:
            return segments, roots
        kids = F.sort_array(F.collect_list(F.struct("idx", "h")))
        runs = common.stored(nodes.where("total > 1").groupBy("tree", "total", F.floor(F.col("idx") / ARITY).alias("run")).agg(kids.alias("kids")))
        one = runs.select("tree", "total", "kids.h", F.posexplode("kids.idx").alias("at", "idx"))
        segments.append(one.select("tree", F.lit(level).cast("bigint").alias("level"), "idx", F.array(_siblings(F.col("h"), F.col("at"))).alias("path"), *_up(F.col("tree"), level + 1, F.col("idx"), F.col("total"), last)))
        nodes = runs.select("tree", F.col("run").alias("idx"), F.ceil(F.col("total") / ARITY).alias("total"), _parent(F.col("kids.h")).alias("h"))
        most, level = -(-most // ARITY), level + 1


def _jumped(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes (key, path, pointer) with their paths up to the root. depth: the most segments on a way."""
    nodes = common.stored(nodes)
    done, distance = nodes.where("up_tree is null"), 1
    while distance < depth:
        others = done.unionByName(nodes.where("up_tree is not null"))
        others = others.select(*[F.col(k).alias(u) for k, u in zip(_KEY, _UP, strict=True)], F.col("path").alias("_rest"), *[F.col(c).alias(f"_{c}") for c in _UP])
        nodes = common.stored(nodes.where("up_tree is not null").join(others, _UP).select(*_KEY, F.concat("path", "_rest").alias("path"), *[F.col(f"_{c}").alias(c) for c in _UP]))
        done, distance = done.unionByName(nodes.where("up_tree is null")), 2 * distance
    return done.select(*_KEY, "path")


def tree(leaves: DataFrame) -> Tree | None:
    """The whole tree of leaves (source, id, leaf, presented); None if there are none."""
    ranked = ranks.ranked(leaves, "source", ["id", "leaf"])
    facts = ranked.groups.agg(F.count("*").alias("sources"), F.max("n").alias("most")).first()
    if not facts["sources"]:
        return None
    alone = facts["sources"] == 1
    placed = ranked.placed(ranked.groups.select("source", F.col("n").alias("total"), F.col("number").cast("bigint").alias("tree")))
    kids = F.sort_array(F.collect_list(F.struct("place", "leaf", "presented", "id")))
    runs = common.stored(placed.groupBy("tree", "total", F.floor(F.col("place") / ARITY).alias("run")).agg(kids.alias("kids")))
    lone = runs.where("total = 1").select("tree", F.lit(0).cast("bigint").alias("idx"), "total", F.col("kids")[0]["leaf"].alias("h"))
    first = runs.where("total > 1").select("tree", F.col("run").alias("idx"), F.ceil(F.col("total") / ARITY).alias("total"), _parent(F.col("kids.leaf")).alias("h"))
    segments, roots = _levels(common.stored(lone.unionByName(first)), -(-facts["most"] // ARITY), 1, alone)
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    subroots = common.stored(subroots.select("tree", F.col("h").alias("subroot")))
    top = subroots.select(F.lit(_TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(facts["sources"]).cast("bigint").alias("total"), F.col("subroot").alias("h"))
    more, root = _levels(top, facts["sources"], 0, True)
    segments += more
    paths = None
    if segments:
        nodes = segments[0]
        for s in segments[1:]:
            nodes = nodes.unionByName(s)
        paths = _jumped(nodes, len(segments))
    return Tree(runs, paths, subroots, root[-1].select(F.col("h").alias("root")), facts["sources"])


def proven(leaves: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, path, folded_root and verified of each of `leaves` (source, id, leaf, presented).

    path: the siblings before and after, from the leaf upwards. folded_root is what `presented` (null: the leaf itself) gives with
    the path; verified tells whether that is the root.
    """
    made = tree(leaves)
    if made is None:
        kind = "array<struct<before:string,after:string>>"
        return leaves.select("id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast(kind).alias("path"), F.col("leaf").alias("folded_root"), F.lit(True).alias("verified")).limit(0)
    alone = made.sources == 1
    up = [F.when(F.col("total") == 1, F.lit(_TOP).cast("bigint") if c == "up_tree" else F.lit(0).cast("bigint") if c == "up_level" else F.col("tree")).otherwise(u).alias(c) for c, u in zip(_UP, _up(F.col("tree"), 1, F.col("run") * ARITY, F.col("total"), alone), strict=True)]
    runs = made.runs.join(made.subroots, "tree").select("total", "kids", "subroot", *up)
    none = F.array().cast("array<struct<before:string,after:string>>")
    if made.paths is not None:
        rest = made.paths.select(*[F.col(k).alias(u) for k, u in zip(_KEY, _UP, strict=True)], F.col("path").alias("_rest"))
        # A run whose node is the root has none; its leaves' own siblings are the whole way.
        runs = runs.join(rest, _UP, "left").withColumn("_rest", F.coalesce("_rest", none))
    else:
        runs = runs.withColumn("_rest", none)
    # The root's digest is one row of 64 characters.
    runs = runs.crossJoin(F.broadcast(made.root))

    def kid(k: Column, at: Column) -> Column:
        own = F.when(F.col("total") > 1, F.array(_siblings(F.col("kids.leaf"), at))).otherwise(none)
        return F.struct(k["id"].alias("id"), k["leaf"].alias("leaf"), F.concat(own, "_rest").alias("path"), F.coalesce(k["presented"], k["leaf"]).alias("presented"))

    rows = runs.select("subroot", "root", F.inline(F.transform("kids", kid)))
    rows = rows.withColumn("folded_root", folded(F.col("presented"), F.col("path")))
    return rows.select("id", "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all digests of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaves(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", presented: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """source, id, leaf and presented of each row: the digest of its fields, and, for the rows of `where`, the digest with some
    fields as `presented` has them (else null)."""
    have = {c: F.col(f"`{c}`") for c in fields}
    other = F.when(where, digest(*[(presented or {}).get(c, have[c]) for c in fields])) if where is not None else F.lit(None).cast("string")
    return df.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), digest(*have.values()).alias("leaf"), other.alias("presented"))


#: A-Z and what they become.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def manifest(df: DataFrame) -> DataFrame:
    """The rows of the query for a table with the columns of `documents`: texts of every fifth id, by CRC-32, are lower-cased
    after the manifest was made; the others are checked as they are."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = proven(leaves(df, presented={"text": F.translate("text", _UPPER, _UPPER.lower())}, where=tampered))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


#: CRC-32 of a text's bytes (its reversed polynomial is a fixed value).
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(str_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def _sql(levels: int = 4, tops: int = 3) -> str:
    """SQL for tables of at most 16 ** levels rows a source and 16 ** tops sources: levels that a tree doesn't have change nothing."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    texts = [" || ".join(field(c) for c in (*FIELDS[:-1], t)) for t in ("text", f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")]
    out = [
        f"""WITH made AS (SELECT doc_id, source, sha256({texts[0]}) AS leaf,
  CASE WHEN coalesce({CRC32_SQL.format("doc_id::VARCHAR")} % 5 = 0, false) THEN sha256({texts[1]}) ELSE sha256({texts[0]}) END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM made),
a0 AS (SELECT tree, i0 AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed)"""
    ]

    def level(k: int, name: str, group: str) -> str:
        run = f"OVER (PARTITION BY {group} i // 16 ORDER BY i ROWS BETWEEN"
        sides = f"coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"
        key = group.strip(" ,")
        return f"""{name}s{k} AS (SELECT *, {sides} FROM {name}{k}),
{name}{k + 1} AS (SELECT *, count(*) OVER ({f"PARTITION BY {key}" if key else ""}) AS n FROM (SELECT {group} i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {group} i // 16))"""

    out += [level(k, "a", "tree, ") for k in range(levels)]
    out.append(f"b0 AS (SELECT tree AS i, h, count(*) OVER () AS n FROM a{levels})")
    out += [level(k, "b", "") for k in range(tops)]
    steps = [(f"as{k}", f"s.tree = p.tree AND s.i = p.i0 // {16**k}") for k in range(levels)] + [(f"bs{k}", f"s.i = p.tree // {16**k}") for k in range(tops)]
    previous = "(SELECT *, shown AS f, '' AS way FROM placed)"
    for j, (table, on) in enumerate(steps):
        fold = "CASE WHEN s.n = 1 THEN p.f ELSE sha256(s.before || p.f || s.after) END AS f"
        out.append(f"f{j} AS (SELECT p.* EXCLUDE (f, way), {fold}, p.way || s.before || s.after AS way FROM {previous} p JOIN {table} s ON {on})")
        previous = f"f{j}"
    end = f"""SELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(way) AS proof_sha256, f AS folded_root, f = b.h AS verified
FROM {previous} p JOIN a{levels} a ON a.tree = p.tree CROSS JOIN b{tops} b"""
    return ",\n".join(out) + "\n" + end


OP11_SQL = _sql()
