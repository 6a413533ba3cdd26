"""Operator 6: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 byte positions. Two that differ in at most `distance` bits share the byte at 8 - distance positions or
more: that is the guaranteed minimum of matches, four for a distance of four. The index posts each fingerprint under its
positional bytes. Lists of single bytes would each hold about 1/256 of all rows, so a posting is made of two positions with
their bytes; whoever reaches the minimum shares the posting of the first two positions that they share. In each list every pair is
tallied (shared positional bytes), pairs that reach the minimum are kept and verified by counting differing bits.

A list that is longer than `members` is posted again with each further position: its pairs must share that many positions
too. When the minimum itself is posted and a list is still longer, it is dealt in blocks, and each pair of blocks is a list of
its own. No pair is dropped at any size, and no task holds more than about `members` rows of a list.

Equal fingerprints are folded before the index, so copies never make pairs. Of the verified pairs only those go on that
connect what isn't connected yet in their list, so fewer links than members leave a list. Components come from contraction:
each node takes its least neighbour, chains are shortened by pointer jumping, links are renamed and the smaller graph goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Members of a list that one task compares with each other.
MEMBERS = 4096
#: The bits of each byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, shingle: int = 4) -> int:
    """Fingerprint of one text: a bit is set if it is set in over half of the shingles' hashes, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    xx = xxhash.xxh64_intdigest
    hashes = np.array([xx(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 4) -> DataFrame:
    """Columns `keep` and `fp`, the fingerprint as a signed 64-bit integer. Null and empty texts have fingerprint 0."""
    df = df.select(*keep, df[text_col].alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]) + ", fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "_text"):
            fps = np.array([simhash(t, shingle) for t in common.texts(batch.column("_text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fps)], names=[*keep, "fp"])

    return common.mapped(df, run, kinds)


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def posted(least: int, n: int) -> list[tuple[int, ...]]:
    """The choices of n positions that can be the first n of at least `least` shared ones: enough positions follow."""
    return list(combinations(range(8 - (least - n)), n))


def index(fps: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """(choice, bytes, fp): every fingerprint under its bytes at each choice of positions; a choice is the mask of its bytes."""
    masks = F.array(*[F.lit(_signed(_mask(c))) for c in choices])
    return fps.select("fp", F.explode(masks).alias("choice")).select("choice", F.col("fp").bitwiseAND(F.col("choice")).alias("bytes"), "fp")


def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positional bytes that two arrays of fingerprints share."""
    return (np.ascontiguousarray(x ^ y).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _connecting(fp: np.ndarray, list_end: np.ndarray, least: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same list. Rows are sorted by list; list_end is where each row's list ends.

    Every pair of a list is looked at, those that lie `step` rows apart at a time. root holds a row that each row is connected
    with: pairs with the same root need no link.
    """
    root = np.arange(len(fp))
    at = np.arange(len(fp))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    step = 0
    while len(at):
        step += 1
        at = at[at + step < list_end[at]]
        i = at[root[at] != root[at + step]]
        i = i[tally(fp[i], fp[i + step]) >= least]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        if len(i):
            a.append(fp[i])
            b.append(fp[i + step])
            high, low = np.maximum(root[i], root[i + step]), np.minimum(root[i], root[i + step])
            root[high] = low
            while (root != root[root]).any():
                root = root[root]
    none = np.empty(0, np.uint64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _list_links(keys: list[str], least: int, distance: int):
    """Links of whole lists; batches come sorted by `keys`, which name a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            fp, new = columns[-1].view(np.uint64), np.zeros(len(columns[-1]), bool)
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            ends = np.append(np.flatnonzero(new), len(fp))
            a, b = _connecting(fp, ends[np.cumsum(new)], least, distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            now = [np.asarray(batch.column(n)) for n in (*keys, "fp")]
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            same = np.logical_and.reduce([c == c[-1] for c in now[:-1]])
            cut = len(same) - int(same.sum())  # the last list may go on in the next batch
            if cut:
                yield out([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held and len(held[0]):
            yield out(held)

    return run


def _compared(rows: DataFrame, keys: list[str], least: int, distance: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*keys, "fp").repartition(n, *keys).sortWithinPartitions(*keys, "fp")
    return common.mapped(ordered, _list_links(keys, least, distance), "a bigint, b bigint")


def links(fps: DataFrame, distance: int = 4, members: int = MEMBERS) -> DataFrame:
    """(a, b): links between different fingerprints of the column `fp` (distinct) that connect whatever near pairs connect."""
    if not 0 <= distance <= 4 or members < 2:
        raise ValueError("distance must be 0 to 4, members 2 or more")
    least, key = 8 - distance, ["choice", "bytes"]
    n = min(2, least)
    # The index is wider than its rows are long: it is made in as many tasks as it is read in.
    rows = index(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), posted(least, n))
    found: list[DataFrame] = []
    while True:
        long = common.stored(rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > members))
        if long.isEmpty():
            return reduce(DataFrame.unionByName, [*found, _compared(rows, key, least, distance)])
        found.append(_compared(rows.join(long, key, "left_anti"), key, least, distance))
        rest = common.stored(rows.join(long, key))
        if n == least:
            break
        further = F.array(*[F.struct(F.lit(_signed(_mask(c[:-1]))).alias("from"), F.lit(_signed(_mask(c))).alias("to")) for c in posted(least, n + 1)])
        again = rest.select("fp", "choice", F.explode(further).alias("c")).where("choice = c.from")
        rows = again.select(F.col("c.to").alias("choice"), F.col("fp").bitwiseAND(F.col("c.to")).alias("bytes"), "fp")
        n += 1
    # Blocks of half the members, so that two of them are a list: each member goes to the pairs that its block is in.
    blocks = F.ceil(F.col("size") * 2 / members).cast("bigint")
    mine = F.pmod(F.xxhash64("fp"), blocks)
    dealt = rest.select(*key, "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).where("mine <> other")
    dealt = dealt.select(*key, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp")
    found.append(_compared(dealt, [*key, "low", "high"], least, distance))
    return reduce(DataFrame.unionByName, found)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node (as a signed integer) of the component of each node that has a link.

    Each round at least halves the nodes that still have links, so it ends.
    """
    edges = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        # Each node that isn't the least around it takes its least neighbour as parent: chains only go down, so no cycles.
        parent = common.stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = common.stored(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        steps.append(parent)
        edges = common.stored(_renamed(edges, parent))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for parent in steps[1:]:
        later = parent.select(F.col("node").alias("root"), F.col("root").alias("last"))
        moved = out.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        out = moved.unionByName(parent.join(out.select("node"), "node", "left_anti"))
    return out


def _renamed(edges: DataFrame, parent: DataFrame) -> DataFrame:
    pa_, pb = (parent.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    both = edges.join(pa_, "a", "left").join(pb, "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    return both.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _rooted(rows: DataFrame, distance: int, order: Column) -> DataFrame:
    """(fp, least, first), stored: the distinct fingerprints of `rows`, the least `order` of the rows of each, and of its component.

    Only fingerprints with links are joined by component; the least of a component is stored before, so that the rows of a
    large component are a plain shuffle.
    """
    distinct = common.stored(rows.groupBy("fp").agg(F.min(order).alias("least")))
    roots = common.stored(components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp"))
    # The roots aren't nodes of their own in `roots`, but they are members of their components.
    members = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = common.stored(members.join(distinct, "fp"))
    firsts = common.stored(linked.groupBy("root").agg(F.min("least").alias("first")))
    named = linked.join(firsts, "root").select("fp", "first")
    return common.stored(distinct.join(named, "fp", "left").select("fp", "least", F.coalesce("first", "least").alias("first")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """A row for each input row: doc_id, fp and component_id, the smallest id reachable over links (itself included).

    Null and empty texts have fingerprint 0 and are linked like any other. A null id is the smallest of all (then the
    component's id is null). Repeated rows each give a row. Other columns of the input are ignored.
    """
    rows = common.stored(fingerprints(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), shingle=shingle))
    named = _rooted(rows, distance, common.key()).select("fp", common.unkey("first").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group one row stays, the least by (doc_id, digest of the text); null ids are least.

    Ids needn't be unique or set: rows of one id with different texts are different rows. Null and empty texts are one group.
    Of rows with equal id and text (ties) one stays, whichever is first by its other columns. Columns may have any names.
    """
    names = docs.columns
    k, h, row = common.free(names, "k", "h", "row")
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = common.stored(fingerprints(docs.select(common.key().alias("_k"), digest.alias("_h"), "text"), keep=("_k", "_h")))
    rooted = _rooted(rows, 4, F.struct("_k", "_h"))
    firsts = common.stored(rooted.where("least = first").select(F.col("least._k").alias(k), F.col("least._h").alias(h)))
    # By sorted merge at any size: a broadcast of the rows that stay would be a plan for small inputs alone.
    kept = docs.withColumns({k: common.key(), h: digest}).join(firsts.hint("merge"), [k, h], "left_semi")
    repeated = common.stored(rows.groupBy("_k", "_h").count().where("count > 1").select(F.col("_k").alias(k), F.col("_h").alias(h)))
    if repeated.isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in names])
    # Maps can't be compared: where there are any, the rows' JSON decides which is first.
    fields = F.struct(*[F.col(f"`{c}`") for c in names])
    order = F.to_json(fields) if "map<" in docs.select(fields.alias("x")).dtypes[0][1] else fields
    one = kept.join(repeated, [k, h], "left_semi").groupBy(k, h).agg(F.min_by(fields, order).alias(row)).select(f"{row}.*")
    return kept.join(repeated, [k, h], "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(one)
