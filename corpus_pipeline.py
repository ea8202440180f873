"""The corpus pipeline over ``documents``: filter, dedup, decontaminate, tokenise.

Each stage takes what its predecessor kept, written as Parquet and read again,
and returns the columns of ``documents``; the last returns the tokens.

* ``toxicity`` (operator 6): documents that the classifier rejects by the threshold of
  their language go. It learns from all of ``labels``.
* ``exact_dedup`` (8): of equal texts one document stays.
* ``minhash_near_dedup`` (9): of documents linked by a similarity of 0.8 or more on five-word
  shingles one stays.
* ``decontamination`` (2): documents in which a benchmark item is found go.
* ``byte_bpe`` (5): doc_id, ids, n_tokens, and the digests of the ids and of the decoded bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackwise.llm import byte_bpe, decontaminate, exact_dedup, minhash, toxicity
from trackwise.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.survivors(docs, size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_table(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
