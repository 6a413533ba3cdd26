"""Operator 3: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a vocabulary entry is resolved by one
probe. Tier two serves the misses: a heap of candidate merges over a linked list of bytes, lowest rank first.

Texts are encoded in Arrow batches where they lie; nothing is shuffled. The rank table is the only thing sent to the
executors and its size is that of the vocabulary file. A bounded memo keeps ids of recent pieces in each worker.

Defined results: null text is the empty text (no ids, hashes of the empty string); repeated rows each give a row; rows keep
a null doc_id; other columns of the input are ignored. Ids come out as `tiktoken` gives them without special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common

#: Bytes of the larger memo of a worker (of keys, values and about 100 for an entry's place); a full memo starts again.
MEMO_BYTES = 240_000_000
#: Bytes of the smaller one, of pre-tokens.
TOKEN_BYTES = 20_000_000
#: Pieces over this many characters aren't kept in a memo.
MEMO_CHARS = 48
#: Unicode White_Space but the space itself, the rest of the \s of the pre-token pattern (fixed values).
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern whose texts may be cut at single spaces first (a fixed value: the public pattern of these files).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single space between two characters that aren't white space: pre-tokens never reach over the place before it.
BREAK = regex.compile(f"(?<=[^ {SPACES}]) (?=[^ {SPACES}])")


def chunks_of(text: str) -> list[str]:
    """The text cut at such single spaces, without them."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES):
        return BREAK.split(text)
    return text.split(" ")


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: one slot for each key, no empty slot.

    A bucket's seed makes its keys land on free slots; buckets with one key name their slot (as -slot - 1).
    """

    def __init__(self, ids: dict[bytes, int]):
        n = max(1, len(ids))
        self.seeds = [0] * n
        self.keys: list[bytes] = [b""] * n
        self.ids = [-1] * n
        buckets: dict[int, list[bytes]] = {}
        for k in ids:
            buckets.setdefault(xxhash.xxh64_intdigest(k) % n, []).append(k)
        taken = bytearray(n)
        free = iter(range(n))
        for b, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(keys) == 1:
                slots = [next(i for i in free if not taken[i])]
                self.seeds[b] = -slots[0] - 1
            else:
                seed = 1
                while len(set(slots := [xxhash.xxh64_intdigest(k, seed) % n for k in keys])) < len(keys) or any(taken[i] for i in slots):
                    seed += 1
                self.seeds[b] = seed
            for i, k in zip(slots, keys, strict=True):
                taken[i], self.keys[i], self.ids[i] = 1, k, ids[k]

    def get(self, k: bytes) -> int:
        """Id of k, or -1."""
        n = len(self.keys)
        seed = self.seeds[xxhash.xxh64_intdigest(k) % n]
        i = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(k, seed) % n
        return self.ids[i] if self.keys[i] == k else -1


def merged(piece: bytes, ranks: dict[bytes, int], pairs: list[int | None]) -> list[int]:
    """Ids of a piece that isn't in the vocabulary. pairs: the rank of each two bytes, by their value.

    The symbols are a linked list over the bytes: end[i] of the symbol that starts at i, start[j] of the one whose last byte
    is j. Heap items pack (rank, place, length), so ties go to the left; an item whose halves have gone is passed over.
    """
    n, get = len(piece), ranks.get
    heap, left, i = [], piece[0], 0
    for right in piece[1:]:
        rank = pairs[left << 8 | right]
        if rank is not None:
            heap.append(rank << 46 | i << 8 | 2)
        left = right
        i += 1
    heapq.heapify(heap)
    end, start = list(range(1, n + 1)), list(range(n))
    while heap:
        item = heapq.heappop(heap)
        i = item >> 8 & 0x3FFFFFFFFF
        j, e = end[i], i + (item & 255)
        if not 0 < j < e or end[j] != e:
            continue
        end[j], end[i], start[e - 1] = 0, e, i
        if e < n:
            rank = get(piece[i : end[e]])
            if rank is not None:
                heapq.heappush(heap, rank << 46 | i << 8 | end[e] - i)
        if i:
            p = start[i - 1]
            rank = get(piece[p:e])
            if rank is not None:
                heapq.heappush(heap, rank << 46 | p << 8 | e - p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Memo(dict):
    """Values by key, made when first asked for; cleared when their bytes are over the bound."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, k: str) -> bytes:
        v = self.make(k)
        if len(k) <= MEMO_CHARS:
            size = getsizeof(k) + getsizeof(v) + 100
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self[k] = v
            self.held += size
        return v


class Chunks(Memo):
    """Ids of a chunk and the space before it. Of a word and its stop only the word is kept: they are two pre-tokens."""

    def __init__(self, codec: Codec):
        super().__init__(lambda chunk: codec.token(" " + chunk) if chunk.isalpha() else codec.pieces(" " + chunk), MEMO_BYTES)
        self.stops = {c: codec.token(c) for c in ".,;:!?"}

    def __missing__(self, k: str) -> bytes:
        if (stop := self.stops.get(k[-1:])) and k[:-1].isalpha():
            return self[k[:-1]] + stop
        return super().__missing__(k)


class Codec:
    """Encodes and decodes with one vocabulary. Ids are kept as little-endian unsigned 32-bit numbers side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(len(k) > 255 for k in ranks):
            raise ValueError("a vocabulary entry is over 255 bytes long")
        if len([k for k in ranks if len(k) == 1]) != 256:
            raise ValueError("the vocabulary must have all single bytes")
        self.ranks, self.whole = ranks, PerfectHash(ranks)
        self.pairs = [ranks.get(bytes((i >> 8, i & 255))) for i in range(1 << 16)]
        self.find = regex.compile(pattern).findall
        self.by_chunk = pattern == PRE_TOKENS
        self.bytes = {i: k for k, i in ranks.items()}
        self.tokens = Memo(self.token, TOKEN_BYTES)
        self.chunks = Chunks(self)

    def token(self, token: str) -> bytes:
        """Ids of one pre-token."""
        k = token.encode()
        if (i := self.whole.get(k)) >= 0:
            return i.to_bytes(4, "little")
        return np.array(merged(k, self.ranks, self.pairs), "<u4").tobytes()

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or not text:
            return self.pieces(text)
        first, *rest = chunks_of(text)
        return self.pieces(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_codecs: dict[str, Codec] = {}

IDS = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoded(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Columns `keep` and either the ids and the bytes that they decode to, or their count and digests.

    vocabulary: a rank file (base64 of the bytes, a space, the rank; a line for each entry) that the driver can open.
    digest: ids_sha256 is the hash of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the bytes.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    name = f"{vocabulary}|{pattern}"
    df = df.select(*keep, df[text_col].alias("_text"))
    out = DIGEST if digest else IDS
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1])
    kinds += (", " if keep else "") + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens bigint, ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(name)
        if codec is None:
            codec = _codecs[name] = Codec(ranks.value, pattern)
        for batch in common.small_batches(batches, "_text"):
            rows: dict[str, list] = {f.name: [] for f in out}
            for text in batch.column("_text").to_pylist():
                ids = codec.encode(text or "")
                back = codec.decode(ids)
                rows["n_tokens"].append(len(ids) // 4)
                if digest:
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                else:
                    rows["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    rows["decoded"].append(back)
            made = common.arrow(out, **rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made.columns], names=[*keep, *out.names])

    return common.mapped(df, run, kinds)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
