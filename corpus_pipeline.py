"""From raw documents to token ids: quality rules, near-dedup, secret scans, source mixing, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and each but the last
returns the columns of its docs. run() writes every stage's result and rereads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bytebpe, mixing, nearcopies, quality, secrets
from lexmill.llm.common import save


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects; rules are learned from the labels among docs.

    Null and empty texts go; repeated rows are judged alike; null ids are judged like any; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word Jaccard similarity of 0.8 or more), the one with the smallest doc_id.

    Candidates pass op8's chain test on SimHash fingerprints before the full check. Rows that share a doc_id but not a text
    stay; null and wordless texts are alike; rows without a doc_id come last; an empty table stays empty.
    """
    return nearcopies.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked; n_chars follows the text.

    A null text stays null; repeated rows are masked alike; an empty table stays empty.
    """
    model = secrets.train(secrets.random_samples(spark).unionAll(secrets.ordinary_samples(docs)))
    return secrets.redact(docs, model)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times, from none to three, as the mix of sources takes it.

    A null source is a source of its own; texts without words stay once; of repeated rows some may be taken once more
    than others; an empty table stays empty.
    """
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the packed ids of each document and their digests.

    A null text has no ids; repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    return bytebpe.encode_with_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Rule learning, Markov models and merges by rank are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
