"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing and encoding, one after the other.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next stage's docs. All but
the last return the columns of `documents`. The mix may use a document more than once; its rows then repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, common, mixing, quality, simhash, substring


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: doc_id and source with the count of the ids of the byte-level BPE and the digests of ids and decoded bytes.

    A row for each row of docs: null and repeated ids and repeated rows stay as they are. A null text is encoded as an empty
    one. All other columns are left out, whatever their names.
    """
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"), digest=True)


STAGES = [
    ("quality rules", quality.good),
    ("SimHash near-dedup", simhash.keep_one),
    ("substring dedup", substring.without_passages),
    ("mixing", mixing.to_weights),
    ("BPE", encode),
]

#: Compression ratios, fingerprints and BPE aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # What a stage stores on its way is deleted once its result is written.
        with common.scratch(spark):
            docs = common.kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
