"""A corpus pipeline of the operators in ``agestack.llm``: each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agestack.llm import common, decontam, lines, minhash, mixing, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.good_documents(docs, common.frame(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; one that loses all of them stays, with an empty text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words to a shingle, similarity 0.8."""
    return minhash.first_of_each(docs, size=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item."""
    return decontam.clean_documents(docs, common.frame(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their share of the target and their pieces in the output shards."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot state the hashed likelihood ratio; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
