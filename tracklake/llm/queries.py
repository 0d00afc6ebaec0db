"""The ten training-data queries: thin wrappers that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, licences, neardup, packing, pages, sharding, suffixes, syncmers, toxicity
from .common import read_table
from .oracles import ORACLE_SQL as ORACLE_SQL


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.document_paths(read_table(spark, sf_dir, "documents")))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(read_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_suffixes": op2_suffixes,
    "op3_minhash": op3_minhash,
    "op4_pages": op4_pages,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_embeddings": op7_embeddings,
    "op8_packing": op8_packing,
    "op9_syncmers": op9_syncmers,
    "op10_bpe": op10_bpe,
}
