"""Registered queries of the corpus operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, exact_dedup, html_text, licenses, packing, pii, secrets, simhash, spelling, suffix_dedup, toxicity, turns, warc
from .checks import OP2, OP8, OP11, OP12
from .common import ready

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _read(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    root = scratch_path(ready(spark), "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), root)
    read = warc.read_archives(spark, root, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    packed = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.drop("ids")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that other documents have too."""
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.rate(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.find_secrets(_read(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    marked = exact_dedup.mark_exact(_read(spark, sf_dir, "documents"), keep="max")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in every document."""
    return licenses.find_licenses(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat test items."""
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by rule."""
    conversations = _read(spark, sf_dir, "conversations")
    return turns.report(conversations, turns.damage(conversations))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant group of every word of the documents, after damage by rule."""
    return spelling.spelling_groups(_read(spark, sf_dir, "documents"), damaged=spelling.DAMAGED)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find_personal(_read(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_warc, op3_packing, op4_suffix_dedup, op5_toxicity, op6_secrets, op7_simhash, op8_exact_dedup,
        op9_licenses, op10_decontamination, op11_turns, op12_spelling, op13_pii, pipeline,
    )
}

def queries() -> dict[str, Query]:
    return dict(QUERIES)


@cache
def checks() -> dict[str, str]:
    """SQL with the same rows, for the queries that SQL can express."""
    return {"op2_warc": OP2, "op8_exact_dedup": OP8, "op11_turns": OP11, "op12_spelling": OP12}
