"""Operator 8: quality rules by compression bands.

zstandard ratios (bytes over compressed bytes) of the whole text and of its fixed chunks. Text that repeats itself, or is full
of a few signs, compresses too well, random text too badly; short texts compress less, so the limits depend on the length.
`fitted` draws them from a bounded sample of labelled rows: around the ratio that is usual at a length, the limits leave out at
most a small share of the good texts and as many of the bad ones as that allows. Scoring is one pass over Arrow batches, no
shuffle; the limits are all that is sent.

Defined results: a null or empty text has no words, so its base rules fail; its ratio is 1. Rows keep a null doc_id;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Bands:
    """Limits on compression ratios: lowest[i] and highest[i] hold from sizes[i] bytes on.

    chunk: bytes of a fixed chunk; a last chunk under half of that counts with the one before it. A text fails too if over
    `share` of its chunks leave the band of their size.
    """

    sizes: tuple[int, ...] = (0, 128, 256, 1024, 4096, 16384, 65536)
    lowest: tuple[float, ...] = (0.0, 0.0, 1.05, 1.2, 1.3, 1.35, 1.4)
    highest: tuple[float, ...] = (2.5, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0)
    chunk: int = 4096
    share: float = 0.34
    level: int = 3
    least_words: int = 10
    most_repeated: float = 0.2
    window: int = 5

    def holds(self, size: int, ratio: float) -> bool:
        i = bisect_right(self.sizes, size) - 1
        return self.lowest[i] <= ratio <= self.highest[i]


@dataclass(frozen=True)
class Fitting:
    """per_class: labelled rows of each quality in the sample, its only bound. loss: share of the good texts of a length that
    the limits may leave out. least: good texts that a length needs; where there are fewer, the given bands hold."""

    per_class: int = 5000
    loss: float = 0.004
    least: int = 40


#: Limits are drawn at this many lengths an octave.
_STEPS = 4


def fit(sizes: np.ndarray, ratios: np.ndarray, good: np.ndarray, bands: Bands = Bands(), fitting: Fitting = Fitting()) -> Bands:
    """Bands from the sizes and ratios of labelled texts.

    At each length the texts of up to half an octave more or less count, their ratios moved to that length along the line
    that fits the good ones. The highest limit lies in the middle between the good texts that stay and the first bad one that
    goes, where bad texts are; else, like the lowest limit, as far from the good ones as these are from their median.
    """
    x = np.log2(np.maximum(sizes, 1))
    grid = np.arange(0, 20 * _STEPS) / _STEPS
    at, lowest, highest = [], [], []
    for g in grid:
        near = np.abs(x - g) <= 0.5
        mine = near & good
        if mine.sum() >= fitting.least:
            slope = np.polyfit(x[mine], ratios[mine], 1)[0] if np.ptp(x[mine]) > 0.1 else 0.0
            r = ratios - slope * (x - g)
            ok, bad = np.sort(r[mine]), np.sort(r[near & ~good])
            middle = np.median(ok)
            stay = ok[len(ok) - 1 - int(fitting.loss * len(ok))]
            above = bad[bad > stay]
            top = (stay + above[0]) / 2 if len(above) else 2 * stay - middle
            low, high = 2 * ok[int(fitting.loss * len(ok))] - middle, min(top, 2 * stay - middle)
        else:
            i = bisect_right(bands.sizes, 2**g) - 1
            low, high = bands.lowest[i], bands.highest[i]
        at.append(0 if g == 0 else int(np.ceil(2 ** (g - 0.5 / _STEPS))))
        lowest.append(float(low))
        highest.append(float(high))
    return replace(bands, sizes=tuple(at), lowest=tuple(lowest), highest=tuple(highest))


def fitted(documents: DataFrame, labels: DataFrame, bands: Bands = Bands(), fitting: Fitting = Fitting()) -> Bands:
    """Bands fitted to documents (doc_id, text) and labels (doc_id, quality 0 or 1) that aren't held out and pass the base rules.

    Of each quality the rows whose MD5 of the id is least. Without labelled rows the given bands stay.
    """
    known = labels.where(~common.held_out()).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    parts = [known.where(F.col("quality") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fitting.per_class) for y in (0, 1)]
    chosen = common.stored(parts[0].unionByName(parts[1]))
    if chosen.isEmpty():
        return bands
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = rules(texts, bands=bands, keep=("quality", "text")).where("not base_failed")
    got = rows.select(F.octet_length("text").alias("size"), "ratio", "quality").distinct().collect()
    if not got:
        return bands
    return fit(np.array([r["size"] for r in got]), np.array([r["ratio"] for r in got]), np.array([r["quality"] == 1 for r in got]), bands, fitting)


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of consecutive words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) ** window < 1 << 62:
        code = np.zeros(n, np.uint64)  # exact: the windows as numbers in base len(known)
        for i in range(window):
            code = code * np.uint64(len(known)) + ids[i : i + n]
    else:
        # Two windows are equal if their halves are: name the pairs, then pairs of names, and so on. No hash is involved.
        code, have = ids, 1
        while have < window:
            step = min(have, window - have)
            both = code[: len(code) - step] * np.uint64(len(words)) + code[step:]
            code = np.unique(both, return_inverse=True)[1].astype(np.uint64)
            have += step
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def chunks(text: bytes, size: int) -> list[bytes]:
    out = [text[i : i + size] for i in range(0, len(text), size)]
    if len(out) > 1 and 2 * len(out[-1]) < size:
        out[-2:] = [out[-2] + out[-1]]
    return out


def measured(text: bytes, bands: Bands, press) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, chunks outside their band, kept."""
    words = text.split()
    inside = text.translate(None, _SPACES)
    base = (len(words), len(inside.decode()), len(text) - len(text.translate(None, _SYMBOLS)), repeated_lines(text), repeated_words(words, bands.window))
    failed = base[0] < bands.least_words or 100 * base[4] > 100 * bands.most_repeated * base[0]
    ratio = len(text) / len(press(text)) if text else 1.0
    parts = chunks(text, bands.chunk)
    bad = sum(not bands.holds(len(p), len(p) / len(press(p))) for p in parts) if len(parts) > 1 else 0
    kept = not failed and bands.holds(len(text), ratio) and bad <= bands.share * len(parts)
    return (*base, failed, ratio, bad, kept)


_KINDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, bad_chunks bigint, kept boolean"
_NAMES = [x.split()[0] for x in _KINDS.split(", ")]


def rules(df: DataFrame, text_col: str = "text", bands: Bands = Bands(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, the base measures, the ratio, the number of chunks outside their band and the verdict `kept`."""
    keep = tuple(c for c in keep if c not in _NAMES)
    df = df.select(*keep, df[text_col].alias("_text"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]), _KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in common.small_batches(batches, "_text"):
            rows = [measured(t, bands, press) for t in common.texts(batch.column("_text"))]
            kinds_ = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds_)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*keep, *_NAMES])

    return common.mapped(df, run, kinds)


def _bands(spark: SparkSession, sf_dir: str) -> Bands:
    return fitted(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(common.table(spark, sf_dir, "documents"), bands=_bands(spark, sf_dir))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. The limits are those that the labels of `sf_dir` give.

    Rows are judged one by one: null ids, ties and repeated rows stay or go by their texts. All columns stay, whatever their
    names.
    """
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    at = names.index("text")
    kept = rules(hidden, f"_{at}", _bands(spark, sf_dir), tuple(hidden.columns)).where("kept")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
