"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadflow.llm.common import fresh_name, materialise, table
from leadflow.llm.line_dedup import dedup_lines
from leadflow.llm.mixing import mix
from leadflow.llm.packing import pack
from leadflow.llm.quality_rules import good_documents
from leadflow.llm.simhash import one_per_class


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in the first document only; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: 3-word shingles, at most 2 bits apart."""
    return one_per_class(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by its source's rate, globally shuffled; all columns as they were."""
    names = tuple(fresh_name(c, docs.columns) for c in ("copy", "copies", "shuffle_key"))
    return mix(docs, alpha=0.7, seed=42, names=names).select([f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's tokens in sequences of at most 4096."""
    return pack(docs)


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_repeated_lines), ("simhash_dedup", one_of_each_group),
          ("source_mixing", mix_sources), ("packing", pack_sequences)]

#: Fingerprints, their components and the packing are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
