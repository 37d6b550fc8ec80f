"""The corpus pipeline: each stage works on what the stage before it kept.

Stages take (spark, docs, sf_dir) and return the documents that stay, with the columns of ``documents``;
the last returns token ids. Run one by one they are written as Parquet and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import bpe, mixing, near_copies, substrings, toxicity
from clauseloom.llm.common import removed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go; all others stay whole.

    Null and empty texts score as clean ones; of repeated rows all stay or go; without labels nothing goes;
    an empty table stays empty.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id: SimHash candidates that share 0.8 of their five-word shingles.

    Null texts count as empty, and those without words are one group; of repeated rows one stays; rows
    without a doc_id stay only where their group has no other; an empty table stays empty.
    """
    return near_copies.without_copies(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier as well are cut; every document stays, with what is left of its text.

    Null texts stay null; rows without a doc_id come last, rows of one id in the order of their texts; an
    empty table stays empty.
    """
    return substrings.without_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by source weights, in the schedule's order: a row for each time one is taken.

    Documents without words are never taken; a null source is a source; repeated rows count each; an empty
    table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each row; no ids for null and empty texts."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: The scorer, the anchors' hashes and the shuffled mix have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage returns is written and read again for the next."""
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, out = out, stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out)
            if k:
                removed(before)
    return out
