"""Operator 12: URL filter by rules and, where none fits, by gradient-boosted trees on lexical features.

Features are column expressions over the URL alone: lengths, depth, labels of the host, digits, hyphens, entropy of the host's
name, parameters, escapes, and what the labelled URLs say of the host's suffix. Spark's gradient-boosted trees are trained from
labelled URLs (1: unwanted); scoring is one pass with the trees and the suffixes' statistics as all that is sent.

Defined results: a null URL or one without `://` has an empty host and path, no rule fits, and nothing is known against it:
allow. Rows are judged one by one; null ids, ties and repeated rows give a row each. An empty table has no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the URL's path starts with the rule's."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Training:
    """most: labelled URLs that are learned from, the only bound (those whose MD5 is least). prior: URLs that the share of all
    counts as in a suffix's share. threshold: the score from which a URL is blocked."""

    most: int = 100_000
    trees: int = 20
    depth: int = 4
    prior: float = 8.0
    threshold: float = 0.5


def parts(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path and query of a URL, and its rest after the scheme; empty where there is none."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return {"rest": rest, "host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def fitting(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    chars = F.array_distinct(F.split(text, ""))
    return F.when(size > 0, F.aggregate(chars, F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, "[^.]*$", 0)


def features(rest: Column, host: Column, path: Column, query: Column) -> dict[str, Column]:
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    over = lambda n, c: n / F.greatest(F.length(c), F.lit(1))
    name = F.regexp_replace(host, r"\.[^.]*$", "")
    return {
        "length": F.length(rest), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query), "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
        "depth": count(path, "[^/]+"), "labels": count(host, "[^.]+"), "parameters": count(query, "[^&]+"), "hyphens": count(host, "-"), "escapes": count(rest, "[%@]"), "numbers": count(host, "[0-9]+"),
        "digits": over(count(rest, "[0-9]"), rest), "host_digits": over(count(host, "[0-9]"), host), "host_entropy": _entropy(name), "path_entropy": _entropy(path), "suffix_length": F.length(_suffix(host)),
    }


@dataclass
class Model:
    trees: GBTClassificationModel
    #: suffix and share of unwanted URLs among the labelled ones with it; stored.
    suffixes: DataFrame
    usual: float
    training: Training


def _vectors(df: DataFrame, suffixes: DataFrame, usual: float) -> DataFrame:
    """df (rest, host, path, query) with `features`."""
    known = features(*[F.col(c) for c in ("rest", "host", "path", "query")])
    rows = df.withColumns({f"f_{n}": c.cast("double") for n, c in known.items()}).withColumn("suffix", _suffix(F.col("host")))
    rows = rows.join(suffixes, "suffix", "left").withColumn("f_suffix", F.coalesce("share", F.lit(usual))).drop("share", "suffix")
    columns = [*[f"f_{n}" for n in known], "f_suffix"]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows).drop(*columns)


def trained(labelled: DataFrame, training: Training = Training()) -> Model:
    """A model of labelled URLs (url, label: 1 unwanted, 0 not). Repeated URLs count once, with the greater label."""
    rows = labelled.where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").cast("double").alias("label"))
    rows = rows.orderBy(F.md5("url"), "url").limit(training.most)
    rows = common.stored(rows.select("label", *[c.alias(n) for n, c in parts(F.col("url")).items()]))
    facts = rows.agg(F.avg("label").alias("usual"), F.count_distinct("label").alias("labels")).first()
    if facts["labels"] < 2:
        raise ValueError("need labelled URLs of both kinds")
    usual = facts["usual"]
    share = (F.sum("label") + training.prior * usual) / (F.count("*") + training.prior)
    suffixes = common.stored(rows.groupBy(_suffix(F.col("host")).alias("suffix")).agg(share.alias("share")))
    vectors = _vectors(rows, suffixes, usual).select("label", "features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=training.trees, maxDepth=training.depth, stepSize=0.2, seed=12).fit(vectors.coalesce(1))
    return Model(trees, suffixes, usual, training)


def judged(df: DataFrame, model: Model, rules: list[Rule], url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns `keep`, host, path, rule (of the longest that fits), score (0 to 1, likelier unwanted) and verdict (allow, block)."""
    kept = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = df.select(*kept, *[c.alias(n) for n, c in parts(F.col(f"`{url_col}`")).items()])
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    scored = model.trees.transform(_vectors(rows, model.suffixes, model.usual))
    score = F.when(F.col("host") != "", vector_to_array("probability")[1]).otherwise(F.lit(0.0))
    out = scored.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "host", "path", rule.alias("rule"), score.alias("score"), verdict.alias("_verdict"))
    own = F.when(F.col("score") >= model.training.threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_verdict", own)).drop("_verdict")


#: Words that names of ordinary and of unwanted hosts are made of (fixed values).
_ORDINARY = "city library garden river kitchen music school science travel market health history art weather forest photo review daily planet village studio museum academy journal radio paper coffee bridge harbor valley union press atlas orbit pixel maple".split()
_UNWANTED = "casino pills cheap free win bets poker viagra loans credit adult sex cams xxx dating replica watches spam farm ads click track lottery bonus prize crypto profit diet miracle escort slots jackpot payday hack keygen warez torrent".split()
_SUFFIXES = (("com", "net", "org", "com", "net", "org", "edu", "gov", "de", "fr", "es", "it"), ("com", "net", "org", "com", "net", "org", "xyz", "top", "info", "biz", "click", "win"))
_SYLLABLES = "an ber chi dor el fa gri ha in ka lo mer na or pe qui ra so ti um va wen ys th ng st re on".split()


def labelled_urls(n: int = 1500, seed: int = 12) -> list[tuple[str, int]]:
    """Invented labelled URLs, half of either kind: paths, parameters and subdomains alike, names of hosts as they usually are.

    Ordinary hosts have one or two words or syllables, seldom a hyphen; unwanted ones join words by hyphens and digits; some
    are bare addresses, have random names, or long paths and many parameters.
    """
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 2
        pick = lambda words: rng.choice(words)
        if not bad:
            base = pick(_ORDINARY) + (pick(_ORDINARY) if rng.random() < 0.3 else "") if rng.random() < 0.4 else "".join(pick(_SYLLABLES) for _ in range(rng.randrange(2, 5)))
            name = f"{base}-{pick(_ORDINARY)}" if rng.random() < 0.03 else base
        else:
            words = [pick(_UNWANTED) for _ in range(rng.choice((2, 2, 2, 3, 4)))]
            kind = rng.random()
            name = "-".join(words)
            if kind < 0.15:
                name = "-".join(words) + str(rng.randrange(10, 9999))
            elif kind < 0.22:
                name = words[0] + str(rng.randrange(100, 99999)) + words[1]
            elif kind < 0.28:
                name = f"{words[0]}-{pick('x z q 4u 24 vip pro'.split())}"
            elif kind < 0.32:
                name = "".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(rng.randrange(12, 24)))
        host = f"{name}.{pick(_SUFFIXES[bad])}"
        if rng.random() < 0.5:
            host = f"{name}.{pick(('example', 'host', 'site', 'pages', 'online'))}.{pick(_SUFFIXES[bad])}"
        if bad and rng.random() < 0.04:
            host = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        host = pick(("", "", "www.", "m.", "blog.", "news.")) + host
        number = str(rng.randrange(10 ** rng.randrange(1, 8)))
        path = pick(("/", f"/{number}", f"/en/{number}", f"/de/{number}/", f"/{pick(_ORDINARY)}/{number}.html", f"/{pick(_ORDINARY)}/{pick(_ORDINARY)}-{pick(_ORDINARY)}", f"/fr/{number}.html", f"/es/{number}"))
        query = pick(("", "", "", "?page=2&ref=x", "?utm_source=feed", f"?id={number}", "#top"))
        if bad and rng.random() < 0.08:
            path, query = "/" + "/".join("".join(rng.choice("abcdef0123456789") for _ in range(12)) for _ in range(5)), "?" + "&".join(f"{k}={rng.randrange(10**6)}" for k in "abcdefg")
        out.append((f"{pick(('http', 'https'))}://{host}{path}{query}", bad))
    return out


#: The rules of the query.
RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = trained(spark.createDataFrame(labelled_urls(), "url string, label int"))
    return judged(common.table(spark, sf_dir, "pages"), model, RULES)
