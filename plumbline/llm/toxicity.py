"""Operator 9: toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, look-alike letters of other scripts and digits that stand for letters. The lexicon is
learned from labels of a bounded sample: words and word beginnings that toxic documents have and the others hardly have, or
that are dense in toxic documents (one in `spread` words or more) though others have one now and then. Chosen are, one after
the other, those that cover the most documents not yet covered. An entry weighs the logarithm of how much more frequent it
is among the words of toxic documents. Phrases around an entry that only documents without the label have are exceptions: an
entry doesn't count inside them. The sum of weights over the number of words is turned into a probability by a logistic
curve, also fitted on the sample.

Learning counts terms in Spark; what reaches the driver is bounded by the sample. Scoring is one pass over Arrow batches with
the lexicon as the only broadcast, no shuffle.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common


@dataclass(frozen=True)
class Learning:
    """per_class: sampled documents of each label, the only bound. support: documents that an entry or exception must be in.
    purity and dense_purity: least share of toxic documents among those that have an entry, and among those where it is dense
    (both labels weigh alike). spread: dense is one in so many words. threshold: the score from which a document is predicted
    to be toxic.
    """

    per_class: int = 5000
    support: int = 4
    purity: float = 0.95
    dense_purity: float = 0.85
    spread: int = 120
    threshold: float = 0.3


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    intercept: float = -20.0


#: Characters that stand for a Latin letter (fixed values): Cyrillic, Greek, Armenian and Cherokee look-alikes, digits and signs.
#: l and i fold alike. Letters that Unicode names or decomposes as Latin ones are found by rule.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "г": "r", "е": "e", "з": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "п": "n", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ь": "b", "ѡ": "w", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "ա": "w", "ց": "g", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ք": "p", "օ": "o", "զ": "q", "ռ": "n",
    "Ꭰ": "d", "Ꭱ": "r", "Ꭲ": "t", "Ꭺ": "a", "Ꭻ": "j", "Ꭼ": "e", "Ꮃ": "w", "Ꮇ": "m", "Ꮋ": "h", "Ꮐ": "g", "Ꮓ": "z", "Ꮖ": "i", "Ꮞ": "a", "Ꮟ": "b", "Ꮢ": "r", "Ꮤ": "w", "Ꮥ": "s", "Ꮩ": "v", "Ꮪ": "s", "Ꮮ": "i", "Ꮯ": "c", "Ꮲ": "p", "Ꮶ": "k", "Ᏼ": "b",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
_LOOK_ALIKE_SIGNS = "@$!|"
#: Blocks with letters that look Latin, decompose to Latin or are signs: from Latin to punctuation and circled letters, Latin
#: and Cherokee extensions, presentation and full-width forms, mathematical and enclosed letters (fixed values).
_RANGES = [(0, 0x3040), (0xA640, 0xABC0), (0xFB00, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F1AA)]
_NAMED = re.compile(r"LATIN (?:LETTER |SMALL LETTER |CAPITAL LETTER )(?:SMALL CAPITAL |SCRIPT |OPEN |DOTLESS |REVERSED |TURNED )?([A-Z])(?: WITH .*)?$|NEGATIVE (?:CIRCLED|SQUARED) LATIN CAPITAL LETTER ([A-Z])$")


def _table() -> dict[int, str | None]:
    """What each character of the ranges folds to: a letter, a space for signs, nothing for marks and invisible characters."""
    out: dict[int, str | None] = {}
    for i in (i for a, b in _RANGES for i in range(a, b)):
        c = chr(i)
        kind = unicodedata.category(c)
        form = unicodedata.normalize("NFKD", c.lower()).lower()
        letters = [x for x in form if x.isalpha()]
        # Circled, parenthesised and squared letters are signs by category: the one letter that they are made of counts.
        base = letters[0] if len(letters) == 1 else form[:1]
        named = _NAMED.match(unicodedata.name(c, ""))
        digit = unicodedata.digit(c, None)
        if kind in ("Mn", "Me", "Cf"):
            out[i] = None
        elif c in _LOOK_ALIKE_SIGNS or base in _LOOK_ALIKES:
            out[i] = _LOOK_ALIKES.get(c) or _LOOK_ALIKES[base]
        elif c.lower() in _LOOK_ALIKES or c in _LOOK_ALIKES:
            out[i] = _LOOK_ALIKES.get(c) or _LOOK_ALIKES[c.lower()]
        elif named:
            letter = (named[1] or named[2]).lower()
            out[i] = _LOOK_ALIKES.get(letter, letter)
        elif digit is not None:
            out[i] = _LOOK_ALIKES.get(str(digit), str(digit))
        elif base and (c.isalnum() or (len(letters) == 1 and base != c)):
            out[i] = base
        elif kind[0] in "PSZC":
            out[i] = " "
    out[0xAD] = None
    return out


_TABLE = _table()


def folded(text: str) -> str:
    """The folded words, each between single spaces. Signs at a word's end aren't letters."""
    words = text.split()
    plain = " ".join([w.rstrip("!|") if w[-1] in "!|" else w for w in words])
    return f" {' '.join(plain.translate(_TABLE).split())} "


def _terms(text: str) -> Counter:
    """Words (" word ") and word beginnings (" wor") of a folded text with how often they occur."""
    out: Counter = Counter()
    for w, n in Counter(text.split()).items():
        if len(w) > 2:
            out[f" {w} "] += n
            for i in range(4, min(8, len(w))):
                out[f" {w[:i]}"] += n
    return out


_COUNTS = ["pos", "neg", "dense_pos", "dense_neg", "often_pos", "often_neg"]


def _counted(sample: DataFrame, prepared: Callable, spread: int) -> DataFrame:
    """Of each term the documents of either label with it (pos, neg) and where it is dense, and how often these have it.

    prepared: makes a task's function from a folded text to its terms with their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = prepared()
        for batch in common.small_batches(batches, "text", 1 << 20):
            counts = {c: Counter() for c in _COUNTS}
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text, label = folded(t), "pos" if y else "neg"
                found, size = terms(text), text.count(" ")
                counts[label].update(found.keys())
                counts[f"dense_{label}"].update(k for k, n in found.items() if n * spread >= size)
                counts[f"often_{label}"].update(found)
            names = list(counts["pos"].keys() | counts["neg"].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[c][n] for n in names], pa.int64()) for c in _COUNTS)], names=["term", *_COUNTS])

    rows = common.mapped(sample, run, "term string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _automaton(keys, value) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for k in keys:
        out.add_word(k, value(k))
    if not len(out):
        return None
    out.make_automaton()
    return out


def _hits(text: str, lexicon: ahocorasick.Automaton | None, exceptions: ahocorasick.Automaton | None) -> Counter:
    """How often each entry occurs in a folded text outside the exceptions."""
    if lexicon is None:
        return Counter()
    found = [(end, k) for end, k in lexicon.iter(text)]
    if found and exceptions is not None:
        spans = [(end - len(k) + 1, end) for end, k in exceptions.iter(text)]
        found = [(e, k) for e, k in found if not any(a <= e - len(k) + 1 and e <= b for a, b in spans)]
    return Counter(k for _, k in found)


def _evidence(text: str, weights: dict[str, float], lexicon, exceptions) -> float:
    """Weight of the matches over the number of words, on a logarithmic scale; 0 if there is none."""
    hits = _hits(text, lexicon, exceptions)
    total = sum(weights[k] * n for k, n in hits.items())
    return math.log1p(1000 * max(0.0, total) / (text.count(" ") + 20)) if total else 0.0


@dataclass(frozen=True)
class _Term:
    """A candidate: documents that it counts in, of either label, and how often the words of either label are it."""

    text: str
    pos: int
    neg: int
    often_pos: int
    often_neg: int
    dense: bool


def _cover(documents: list[list[int]], terms: list[_Term], least: int, weight: float) -> list[int]:
    """Terms chosen one after the other, each for the most documents that none before it covers, less the clean ones it is in
    (each counts as `weight`); longer terms win ties. What a term adds only falls, so the best of a heap is looked at again."""
    having: list[set[int]] = [set() for _ in terms]
    for d, ids in enumerate(documents):
        for i in ids:
            having[i].add(d)
    covered: set[int] = set()
    order = lambda i: (-(len(having[i] - covered) - weight * terms[i].neg), -len(terms[i].text), terms[i].text, i)
    heap = [order(i) for i in range(len(terms))]
    heapq.heapify(heap)
    chosen: list[int] = []
    while heap:
        i = heapq.heappop(heap)[3]
        now = order(i)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        if len(having[i] - covered) >= least and now[0] < 0:
            chosen.append(i)
            covered |= having[i]
        elif now[0] >= 0:
            break
    return chosen


def _as_frequent(terms: list[_Term], chosen: list[_Term]) -> list[_Term]:
    """Words that only toxic documents have, at least a quarter as often as the middle one of the chosen entries, though other
    entries cover their documents: elsewhere they may stand alone."""
    if not chosen:
        return []
    usual = sorted(t.pos for t in chosen)[len(chosen) // 2]
    have = tuple(t.text for t in chosen)
    return [t for t in terms if t.neg == 0 and t.pos >= usual / 4 and t.text[-1] == " " and not t.text.startswith(have)]


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve with a small ridge, by Newton steps."""
    z = np.stack([x, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (y - p)) - 0.05 * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, b[0])), float(b[1])


def training_rows(labels: DataFrame, learning: Learning) -> DataFrame:
    """doc_id and toxic of the sample: of each label the rows whose MD5 of the id is least, without the held-out rows."""
    known = labels.where(~common.held_out()).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(learning.per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def learned(documents: DataFrame, labels: DataFrame, learning: Learning = Learning()) -> Lexicon:
    """A lexicon from documents (doc_id, text) and labels (doc_id, toxic). Without toxic rows it has no entries."""
    rows = common.stored(training_rows(labels, learning))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon()
    texts = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where("text is not null")
    sample = common.stored(texts.select("text", "toxic").dropDuplicates())
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    share = lambda a, b: F.col(a) / n[1] / F.greatest(F.col(a) / n[1] + F.col(b) / n[0], F.lit(1e-12))
    pure = (F.col("pos") >= learning.support) & (share("pos", "neg") >= learning.purity)
    dense = (F.col("dense_pos") >= learning.support) & (share("dense_pos", "dense_neg") >= learning.dense_purity)
    found = _counted(sample, lambda: _terms, learning.spread).where(pure | dense).withColumn("pure", pure)
    terms = [_Term(r["term"], *((r["pos"], r["neg"]) if r["pure"] else (r["dense_pos"], r["dense_neg"])), r["often_pos"], r["often_neg"], not r["pure"]) for r in found.collect()]
    known = {t.text for t in terms if not t.dense}
    excused = [t for t in _excused(sample, learning, n) if t.text not in known]
    terms = [t for t in terms if t.text not in {x.text for x in excused}] + excused
    documents_with = _incidence(sample.where("toxic = 1"), terms, learning.spread)
    picked = [terms[i] for i in _cover(documents_with, terms, max(learning.support, round(0.003 * n[1])), 2 * n[1] / n[0])]
    picked += _as_frequent(terms, picked)
    words = {r["toxic"]: r["words"] for r in sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("words")).collect()}
    rate = lambda t: (t.often_pos + 0.5) / max(1, words[1]) / ((t.often_neg + 0.5) / max(1, words[0]))
    lexicon = Lexicon({t.text: max(0.5, math.log(rate(t))) for t in picked})
    lexicon.exceptions = _exceptions(sample, lexicon, learning)
    x, y = _evidences(sample, lexicon)
    counts = {r["toxic"]: r["count"] for r in labels.where(~common.held_out()).where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    lexicon.slope, lexicon.intercept = _curve(x, y, np.where(y == 1, counts.get(1, 1) / n[1], counts.get(0, 1) / n[0]))
    return lexicon


def _excused(sample: DataFrame, learning: Learning, n: dict[int, int]) -> list[_Term]:
    """Terms that are pure only outside their exception phrases, with their counts there."""
    share = F.col("pos") / n[1] / (F.col("pos") / n[1] + F.col("neg") / n[0])
    frequent = _counted(sample, lambda: _terms, learning.spread).where(F.col("pos") >= max(learning.support, round(0.01 * n[1]))).where(share.between(0.6, learning.purity - 1e-9))
    likely = Lexicon({r["term"]: 1.0 for r in frequent.collect()})
    exceptions = _exceptions(sample, likely, learning)
    if not exceptions:
        return []
    weights = likely.weights

    def hits():
        automata = _automaton(weights, lambda k: k), _automaton(exceptions, lambda k: k)
        return lambda text: _hits(text, *automata)

    found = _counted(sample, hits, learning.spread).where(F.col("pos") >= learning.support).where(share >= learning.purity)
    return sorted((_Term(r["term"], r["pos"], r["neg"], r["often_pos"], r["often_neg"], False) for r in found.collect()), key=lambda t: t.text)


def _incidence(toxic: DataFrame, terms: list[_Term], spread: int) -> list[list[int]]:
    """Of each toxic document of the sample the candidates that count in it."""
    number = {t.text: (i, t.dense) for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for x in batch.column("text").to_pylist():
                text = folded(x)
                size = text.count(" ")
                found = ((number[t], n) for t, n in _terms(text).items() if t in number)
                ids.append(sorted(i for (i, dense), n in found if not dense or n * spread >= size))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32()))], names=["ids"])

    return [r["ids"] for r in common.mapped(toxic.select("text"), run, "ids array<int>").collect()]


def _exceptions(sample: DataFrame, lexicon: Lexicon, learning: Learning) -> list[str]:
    """An entry's word with a neighbour, where only documents without the label have the two together."""
    weights = dict(lexicon.weights)

    def phrases():
        automaton = _automaton(weights, lambda k: k)

        def of(text: str) -> Counter:
            out: Counter = Counter()
            for end, k in automaton.iter(text):
                a = text.rfind(" ", 0, end - len(k) + 2)
                b = text.find(" ", end)
                before, after = text.rfind(" ", 0, a), text.find(" ", b + 1)
                if before >= 0:
                    out[text[before : b + 1]] += 1
                if after >= 0:
                    out[text[a : after + 1]] += 1
            return out

        return of

    if not weights:
        return []
    return sorted(r["term"] for r in _counted(sample, phrases, learning.spread).where("pos = 0").where(F.col("neg") >= learning.support).collect())


def _evidences(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    rows = scored(sample.select("text", "toxic"), Lexicon(lexicon.weights, lexicon.exceptions, 1.0, 0.0), keep=("toxic",)).select("toxic", "evidence").collect()
    return np.array([r["evidence"] for r in rows]), np.array([r["toxic"] for r in rows], float)


def scored(df: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, evidence (log weight of matches over length) and score (0 to 1).

    A null or empty text has no evidence and so the least score. Repeated rows each give a row; other columns are ignored.
    """
    known = df.sparkSession.sparkContext.broadcast(lexicon)
    df = df.select(*keep, df[text_col].alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        entries, exceptions = _automaton(lex.weights, lambda k: k), _automaton(lex.exceptions, lambda k: k)
        for batch in common.small_batches(batches, "_text"):
            x = np.array([_evidence(folded(t), lex.weights, entries, exceptions) if t else 0.0 for t in batch.column("_text").to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(lex.slope * x + lex.intercept, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(x), pa.array(score)], names=[*keep, "evidence", "score"])

    return common.mapped(df, run, f"{kinds}evidence double, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    learning = Learning()
    out = scored(documents, learned(documents, labels, learning))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= learning.threshold).cast("int").alias("predicted"))
