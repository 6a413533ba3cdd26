"""Operator 2: removal of repeated passages by relative Lempel-Ziv parsing.

A document is parsed relative to all documents with smaller ids. These are the reference, and it is indexed in blocks: of the
short word sequences (grams) inside a window the one with the least hash is the window's anchor, and a block is a run of
windows with one anchor. Anchors depend on the words alone, so equal passages are cut into equal blocks wherever they stand.

1. The index names each block's first place in the reference: the document and the word where it starts.
2. A document is factored greedily from left to right: a factor begins with a block that the index has in an earlier
   document, and takes in what follows as long as its source goes on with the same words. A factor is a place, a number of
   words and the source's place.
3. At a factor's boundary the next block isn't in the index as a whole, though its anchor may be. There the windows are
   checked one by one against those of the reference's blocks with the same anchor, and each that is found is a factor's
   beginning or continuation as well. A block whose anchor no other document has can't hold a repeated window.
4. Factors have as many words as a window or more; the words that they cover are the document's duplicate spans.

All grouping is by hashes with map-side aggregation: copies of a block or a window fold to their first place before they are
shuffled, and no pair of documents is ever formed. Keys are two 64-bit hashes, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

WINDOW = 50
#: Words of an anchor gram: fewer make fewer and longer blocks, but chance matches of common word sequences.
GRAM = 12
#: Block starts and sizes share a 64-bit number; a block has at most WINDOW windows.
SIZE_BITS = 8

_U = np.uint64
#: Odd multipliers of the word, gram, block and window hashes (fixed values).
_BYTE, _GRAM, _BLOCK, _WINDOW = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit number for each byte value.
_RANDOM = np.random.default_rng(2).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Items that are hashed at a time; longer texts go in segments, so working memory doesn't follow a text's length.
SEGMENT = 1 << 18
_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n (kept: n is bounded by the segment size)."""
    have = _known.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        have = _known[base] = tuple(np.multiply.accumulate(np.where(np.arange(size) == 0, _U(1), _U(x))) for x in (base, pow(base, -1, 1 << 64)))
    return have[0][:n], have[1][:n]


class _Rolling:
    """Hashes of any stretch of a sequence of 64-bit numbers, modulo 2**64: sums of x[i] * base**i, shifted to the start."""

    def __init__(self, x: np.ndarray, base: int):
        powers, self.inverse = _powers(base, len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    raw = np.frombuffer(data, np.uint8)
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~_SPACES[raw]
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = words_of(data)
    out = np.empty(len(starts), np.uint64)
    raw, i = np.frombuffer(data, np.uint8), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        if ends[j - 1] - starts[i] > SEGMENT:  # one word over the segment size
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
        else:
            rolling = _Rolling(_RANDOM[raw[starts[i] : ends[j - 1]]], _BYTE)
            out[i:j] = rolling.of(starts[i:j] - starts[i], ends[i:j] - starts[i]) + (ends[i:j] - starts[i:j]).astype(np.uint64)
        i = j
    return _mixed(out)


def _first_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least item among x[i : i + width], for every i."""
    place, value, have = np.arange(len(x)), x, 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        later = right < left
        place = np.where(later, place[step:], place[:-step])
        value = np.where(later, right, left)
        have += step
    return place


def blocks(hashes: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Of a document given by its word hashes: first window, number of windows, anchor hash and content hash of each block.

    Segments of long documents may cut a block in two; its windows are then checked one by one where that matters.
    """
    parts = []
    for i in range(0, max(1, len(hashes)), SEGMENT):
        first, *rest = _blocks(hashes[i : i + SEGMENT + window - 1], window, gram)
        parts.append((first + i, *rest))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _blocks(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(hashes) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    places = np.arange(len(hashes) - gram + 1)
    grams = _Rolling(hashes, _GRAM).of(places, places + gram)
    anchor = _first_minimum(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, n))
    content = _Rolling(hashes, _BLOCK).of(first, first + size + window - 1)
    at = anchor[first]
    return first, size, grams[at], _mixed(content + (at - first).astype(np.uint64) * _U(_GRAM) + size.astype(np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


_BLOCKS = "k bigint, th bigint, at bigint, g bigint, b bigint"


def _block_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, th, t in zip(batch.column("k").to_pylist(), batch.column("th").to_pylist(), common.texts(batch.column("text")), strict=True):
                first, size, g, b = blocks(word_hashes(t), window, gram)
                for part, x in zip(parts, (np.full(len(first), k), np.full(len(first), th), first << SIZE_BITS | size, _signed(g), _signed(b)), strict=True):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in parts], names=["k", "th", "at", "g", "b"])

    return run


def _window_rows(window: int):
    """Windows of the listed blocks: anchor hash, window hash and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 2 << 20):
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, th, t, listed in zip(batch.column("k").to_pylist(), batch.column("th").to_pylist(), common.texts(batch.column("text")), batch.column("listed").to_pylist(), strict=True):
                at = np.array([x["at"] for x in listed], np.int64)
                g = np.array([x["g"] for x in listed], np.int64)
                size = at & ((1 << SIZE_BITS) - 1)
                place = np.repeat((at >> SIZE_BITS) - np.cumsum(size) + size, size) + np.arange(size.sum())
                words, powers = word_hashes(t), _powers(_WINDOW, window)[0]
                h = np.zeros(len(place), np.uint64)
                for i in range(window):
                    h += words[place + i] * powers[i]
                for part, x in zip(parts, (np.full(len(place), k), np.full(len(place), th), place << SIZE_BITS | 1, np.repeat(g, size), _signed(_mixed(h))), strict=True):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=["k", "th", "at", "g", "b"])

    return run


def phrases(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, th, at, source, place): stretches of windows that the reference has, each with its first place there.

    df has k (key of the document), th (hash of its text) and text. `at` packs the first window's word and, in the low
    SIZE_BITS bits, the number of windows; source is the key of the first document that has them, place their word in it.
    """
    if not 1 <= gram <= window < 1 << SIZE_BITS:
        raise ValueError("need 1 <= gram <= window < 256")
    rows = common.mapped(df.select("k", "th", "text"), _block_rows(window, gram), _BLOCKS)
    # Each aggregate is stored before rows are joined with it: then both sides of the join are plain shuffles, and adaptive
    # execution can split the partition of a frequent anchor, block or window.
    anchors = rows.groupBy("g").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.min("b").alias("b0"), F.max("b").alias("b1")).where("least < most")
    anchors = common.stored(anchors.select("g", (F.col("b0") != F.col("b1")).alias("varied")))
    shared = common.stored(rows.join(anchors, "g"))
    place = F.struct("k", F.shiftright("at", SIZE_BITS).alias("word"))
    index = common.stored(shared.groupBy("g", "b").agg(F.min(place).alias("first")))
    found = common.stored(shared.join(index, ["g", "b"]))
    source = [F.col("first.k").alias("source"), F.col("first.word").alias("place")]
    blocks_ = found.where("k > first.k").select("k", "th", "at", *source)
    # Blocks that no earlier document has, though others have their anchor: the boundaries of factors, and what lies there.
    listed = found.where("varied and k = first.k").groupBy("k", "th").agg(F.collect_set(F.struct("at", "g")).alias("listed"))
    windows = common.stored(common.mapped(df.select("k", "th", "text").join(listed, ["k", "th"]), _window_rows(window), _BLOCKS))
    least = common.stored(windows.groupBy("g", "b").agg(F.min(place).alias("first"), F.max("k").alias("most")).where("first.k < most").drop("most"))
    checked = windows.join(least, ["g", "b"]).where("k > first.k").select("k", "th", "at", *source)
    return blocks_.unionByName(checked)


def factored(found: np.ndarray, window: int) -> np.ndarray:
    """The factors of one document: rows of first word, words, source and place. found: rows of at, source and place.

    From left to right a factor goes on while the next phrase begins where it ends and so does its place in the source.
    """
    start, size = found[:, 0] >> SIZE_BITS, found[:, 0] & ((1 << SIZE_BITS) - 1)
    order = np.argsort(start, kind="stable")
    start, size, source, place = start[order], size[order], found[order, 1], found[order, 2]
    goes_on = (start[1:] == start[:-1] + size[:-1]) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + size[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    return np.stack([start[first], np.add.reduceat(size, first) + window - 1, source[first], place[first]], axis=1)


def _covered(n: int, factors: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the factors of `window` words or more cover."""
    long = factors[factors[:, 1] >= window]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, long[:, 0], 1)
    np.add.at(edge, long[:, 0] + long[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


_FOUND = ["at", "source", "place"]


def parsed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The factors of each document: doc_id, first_word, n_words, source_id, source_word. Documents without one have no row.

    Source is the first document with a phrase, so a factor ends too where an earlier source begins. A null id is the
    smallest (and a null source_id names it). Rows with one id are one document: they are no source of each other.
    """
    keyed = df.select(common.key(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = phrases(keyed, window, gram).groupBy("k", "th").agg(F.collect_set(F.struct(*_FOUND)).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.empty((0, 5), np.int64)]
            for k, x in zip(batch.column("k").to_pylist(), batch.column("found"), strict=True):
                factors = factored(_table(x.values), window)
                rows.append(np.concatenate((np.full((len(factors), 1), k), factors), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows).T], names=["k", "first_word", "n_words", "source", "source_word"])

    out = common.mapped(found.select("k", "found"), run, "k bigint, first_word bigint, n_words bigint, source bigint, source_word bigint")
    return out.select(common.unkey("k").alias("doc_id"), "first_word", "n_words", common.unkey("source").alias("source_id"), "source_word")


def _table(found: pa.StructArray) -> np.ndarray:
    return np.stack([found.field(c).to_numpy(zero_copy_only=False) for c in _FOUND], axis=1)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """df with n_words, n_removed and kept_text (or kept_sha256): the words no repeated window covers, joined by one space.

    A window is repeated if its words also start, in this order, in a document with a smaller id. Rows with one id are one
    document for this: they don't make each other repeated. A null id is the smallest. Null and empty texts have no words.
    Repeated rows each give a row. Texts without a repeated window are normalised to single spaces too. Columns of df with
    the names of the new ones are replaced; all others are kept, whatever their names, unless `digest`, which keeps the id
    alone.
    """
    names = [id_col] if digest else [c for c in df.columns if c not in ("n_words", "n_removed", "kept_text")]
    k, th, t, found = common.free(df.columns, "k", "th", "t", "found")
    quoted = [F.col(f"`{c}`") for c in names]
    keyed = df.select(*quoted, common.key(id_col).alias(k), F.coalesce(F.col(text_col), F.lit("")).alias(t)).withColumn(th, F.xxhash64(t))
    spans = phrases(keyed.select(F.col(k).alias("k"), F.col(th).alias("th"), F.col(t).alias("text")), window, gram)
    spans = spans.groupBy(F.col("k").alias(k), F.col("th").alias(th)).agg(F.collect_set(F.struct(*_FOUND)).alias(found))
    both = keyed.join(spans, [k, th], "left").select(*quoted, t, found)
    kept = "kept_sha256" if digest else "kept_text"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, t):
            n_words, n_removed, out = [], [], []
            for text, x in zip(common.texts(batch.column(t)), batch.column(found), strict=True):
                words = text.split()
                n_words.append(len(words))
                if x.is_valid:
                    gone = _covered(len(words), factored(_table(x.values), window), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                text = b" ".join(words)
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=[*names, "n_words", "n_removed", kept])

    return common.mapped(both, run, f"{kinds}, n_words bigint, n_removed bigint, {kept} string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"), digest=True)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated words; texts of which nothing is left go. n_chars follows the text.

    Null texts and texts without a repeated word stay as they are. Of documents with a shared passage the one with the least
    id keeps it (null is least); rows with one id, repeated ones too, keep theirs both. Columns may have any names.
    """
    names = docs.columns
    done = deduplicated(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), f"c{names.index('doc_id')}", f"c{names.index('text')}")
    changed = F.col("n_removed") > 0
    made = {"text": F.when(changed, F.col("kept_text")), "n_chars": F.when(changed, F.length("kept_text").cast("bigint"))}
    rows = done.where(~changed | (F.col("kept_text") != ""))
    return rows.select(*[(made[c].otherwise(F.col(f"c{i}")) if c in made else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
