"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows the one before it kept, and its result is written as
Parquet and read again before the next.  All stages take nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns of any name; what they do with them stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagica.llm import decontaminate, exact_dedup, near_texts, packing, toxicity
from pelagica.llm.common import ready, stored
from pelagica.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity below the limit.

    Null and empty texts stay; a text at the limit goes; equal texts fare alike; without labels all stay.
    """
    labels = ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; null and empty texts are equal.

    See ``exact_dedup`` for rows with a null id and rows that repeat an id.
    """
    ready(spark)
    return exact_dedup.drop_exact(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles the one with the smallest id.

    Found by the SimHash of op7 over five-word shingles (variants, links of up to four bits, components) and, for similar texts that
    differ in more bits, by MinHash bands beside it; every link is checked on the whole texts.
    Null and empty texts are one group; rows with a null id, and rows that repeat the id that stays, stay.
    """
    ready(spark)
    return near_texts.drop_near(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no test item; null and empty texts stay, and all do if there are no items."""
    benchmark = ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids.

    Every row is packed, those with a null id or a repeated one too; null and empty texts are the end id alone.
    """
    ready(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

# Trained models, fingerprints and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
