"""Corpus pipeline: toxicity filter, near-dedup, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and rereads it as the next stage's docs. All stages but the last return the columns of documents, whatever they are called
beside doc_id and text. A document of which nothing is left after the removal of repeated passages goes; one that came in
empty or null stays, with an empty text. Of rows that share a doc_id the near-dedup keeps one; rows without an id stay.
An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import neardup, packing, suffixes, toxicity
from tracklake.llm.common import materialize, read_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from this stage's own documents."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least id."""
    return neardup.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that start in an earlier document as well."""
    return suffixes.without_repeats(docs, drop_emptied=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL expresses neither the model nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
