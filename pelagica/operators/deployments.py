"""Joins between records and the deployment table.

None of these joins carries a broadcast hint.  The deployment table is small
in practice and then falls below ``spark.sql.autoBroadcastJoinThreshold``, so
Spark broadcasts it; beyond that size the same plan becomes a sort-merge join,
on the tag and a bin of time where times are compared, so that one tag's records
spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uni_id
from ..functions.time import parse_month_first, to_utc
from .spans import BIN_S, join_spans

# Column names of the field table.
FIELD_COLUMNS = {
    "TagSerialNumber": "tag_id",
    "Bird_ID": "bird_id",
    "Project_ID": "project_id",
    "Deployment_End_Short": "deploy_end_short",
    "DeploymentStartDatetime": "dep_start",
    "DeploymentEndDatetime_UTC": "dep_end",
    "UTC_offset_deploy": "utc_offset",
}


def clean_deployments(raw: DataFrame, manufacturer: str | None = None) -> DataFrame:
    """Parse times, move the local start to UTC, keep rows that name a tag."""
    if manufacturer is not None:
        raw = raw.filter(F.col("TagManufacture") == manufacturer)
    present = [c for c in (*FIELD_COLUMNS, "dep_no") if c in raw.columns]
    named = raw.select(*present).withColumnsRenamed(FIELD_COLUMNS)
    named = named.filter(F.col("tag_id").isNotNull())
    start = parse_month_first("dep_start")
    if "utc_offset" in named.columns:
        start = to_utc(start, F.coalesce(F.col("utc_offset"), F.lit(0)))
    named = named.withColumn("dep_start", start)
    if "dep_end" in named.columns:
        named = named.withColumn("dep_end", parse_month_first("dep_end"))
    return named


def latest_deployment(deployments: DataFrame, listed_order: str | None = None) -> DataFrame:
    """One row per tag: its last listed deployment.

    Listed are deployments in the order of ``listed_order``, or of ``dep_no`` if the table
    has it.  A table without any such column counts by start, then animal.
    """
    if listed_order is None and "dep_no" in deployments.columns:
        listed_order = "dep_no"
    order = [c for c in (listed_order, "dep_start", "bird_id") if c and c in deployments.columns]
    newest = Window.partitionBy("tag_id").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return (
        deployments.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .drop("_rank")
    )


def join_latest_deployment(
    records: DataFrame,
    deployments: DataFrame,
    columns: Sequence[str] = ("project_id", "bird_id"),
    listed_order: str | None = None,
) -> DataFrame:
    """Attach the tag's latest deployment; records of other tags drop out."""
    newest = latest_deployment(deployments, listed_order).select("tag_id", *columns)
    return records.join(newest, "tag_id")


def assign_deployment(
    records: DataFrame,
    deployments: DataFrame,
    columns: Sequence[str] = ("project_id", "bird_id", "dep_no"),
    time: str = "datetime",
    bin_s: float = BIN_S,
) -> DataFrame:
    """Interval join: each record with the deployments it falls inside.

    Bounds are strict and a NULL end is open, for any number of deployments of
    a tag.  Adds ``uni_id`` when project and bird are attached.
    """
    spans = deployments.select(
        F.col("tag_id").alias("_tag"), F.col("dep_start"), F.col("dep_end"), *columns
    )
    inside = (F.col(time) > F.col("dep_start")) & (F.col("dep_end").isNull() | (F.col(time) < F.col("dep_end")))
    joined = join_spans(records, spans, inside, time, "dep_start", "dep_end", bin_s=bin_s).drop("dep_start", "dep_end")
    if {"project_id", "bird_id"} <= set(columns):
        joined = joined.withColumn("uni_id", uni_id("project_id", "bird_id"))
    return joined


def trim_to_deployment(records: DataFrame, deployments: DataFrame, bin_s: float = BIN_S) -> DataFrame:
    """Records inside any deployment of their tag, each once.

    Written as an existence test, so no row multiplies when deployments meet.
    """
    spans = deployments.select(F.col("tag_id").alias("_tag"), "dep_start", "dep_end")
    inside = (F.col("datetime") > F.col("dep_start")) & (F.col("dep_end").isNull() | (F.col("datetime") < F.col("dep_end")))
    return join_spans(records, spans, inside, "datetime", "dep_start", "dep_end", "left_semi", bin_s)


def asof_deployment(
    records: DataFrame,
    deployments: DataFrame,
    columns: Sequence[str] = ("project_id", "bird_id", "dep_no"),
    time: str = "datetime",
    bin_s: float = BIN_S,
) -> DataFrame:
    """Backward as-of: each record with the latest deployment started before it.

    Sorting happens on the deployment side only: a start is valid up to the
    tag's next start, so at most one span matches a record and the records are
    never ranked.  Unmatched records keep NULLs.
    """
    by_start = Window.partitionBy("tag_id").orderBy("dep_start", "dep_no")
    spans = (
        deployments.filter(F.col("dep_start").isNotNull())
        .withColumn("_until", F.lead("dep_start").over(by_start))
        .select(F.col("tag_id").alias("_tag"), "dep_start", "_until", *columns)
    )
    valid = (F.col(time) > F.col("dep_start")) & (F.col("_until").isNull() | (F.col(time) <= F.col("_until")))
    return join_spans(records, spans, valid, time, "dep_start", "_until", "left", bin_s).drop("_until")


def deployed_only(records: DataFrame, deployments: DataFrame) -> DataFrame:
    """Records of tags that have a deployment."""
    return records.join(deployments.select("tag_id"), "tag_id", "left_semi")


def undeployed_only(records: DataFrame, deployments: DataFrame) -> DataFrame:
    """Records of tags without any deployment."""
    return records.join(deployments.select("tag_id"), "tag_id", "left_anti")
