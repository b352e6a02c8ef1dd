"""Queries that join records with deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import MONTH_FIRST
from ..operators import deployments, summary
from .records import LATEST
from .registry import Tables, query

INSIDE = """r.tag_id = d.tag_id AND r.datetime > d.dep_start
  AND (d.dep_end IS NULL OR r.datetime < d.dep_end)"""


def field_table(t: Tables) -> DataFrame:
    """The deployments as a field crew writes them: text times, local starts."""
    d = t.deployments
    hours = F.make_dt_interval(F.lit(0), F.col("utc_offset"))
    listed = ~((F.col("dep_no") == 3) & (F.col("utc_offset") > 8))
    return d.select(
        F.col("bird_id").alias("Bird_ID"),
        F.when(listed, F.col("tag_id").cast("string")).alias("TagSerialNumber"),
        F.col("project_id").alias("Project_ID"),
        F.date_format(F.col("dep_start") + hours, MONTH_FIRST).alias("DeploymentStartDatetime"),
        F.coalesce(F.date_format("dep_end", "yyyyMMdd"), F.lit("open")).alias("Deployment_End_Short"),
        F.coalesce(F.date_format("dep_end", MONTH_FIRST), F.lit("")).alias(
            "DeploymentEndDatetime_UTC"
        ),
        F.col("utc_offset").cast("double").alias("UTC_offset_deploy"),
        F.lit("logger").alias("TagManufacture"),
    )


@query(
    "deployments_clean",
    """
SELECT CAST(tag_id AS string) AS tag_id, bird_id, project_id, dep_start, dep_end,
  coalesce(strftime(dep_end, '%Y%m%d'), 'open') AS deploy_end_short
FROM {deployments} WHERE NOT (dep_no = 3 AND utc_offset > 8)""",
)
def deployments_clean(t: Tables) -> DataFrame:
    return deployments.clean_deployments(field_table(t), "logger").drop("utc_offset")


@query(
    "join_latest_deployment",
    "WITH "
    + LATEST
    + """
SELECT r.foid, r.tag_id, r.datetime, l.project_id, l.bird_id
FROM {tag_records} r JOIN latest l ON l.tag_id = r.tag_id""",
)
def join_latest_deployment(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    return deployments.join_latest_deployment(records, t.deployments)


@query(
    "assign_deployment_interval",
    """
SELECT r.foid, r.tag_id, r.datetime, d.project_id, d.bird_id, d.dep_no,
  d.project_id || '_' || d.bird_id AS uni_id
FROM {tag_records} r JOIN {deployments} d ON """
    + INSIDE,
)
def assign_deployment_interval(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    return deployments.assign_deployment(records, t.deployments)


@query(
    "trim_to_deployment",
    """
SELECT foid, tag_id, datetime FROM {tag_records} r
WHERE EXISTS (SELECT 1 FROM {deployments} d WHERE """
    + INSIDE
    + ")",
)
def trim_to_deployment(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    return deployments.trim_to_deployment(records, t.deployments)


@query(
    "asof_deployment",
    """
SELECT r.foid, r.tag_id, r.datetime, d.dep_start, d.project_id, d.bird_id, d.dep_no
FROM {tag_records} r ASOF LEFT JOIN {deployments} d
  ON r.tag_id = d.tag_id AND r.datetime > d.dep_start""",
)
def asof_deployment(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    return deployments.asof_deployment(records, t.deployments)


@query(
    "semi_deployed_tags",
    """
SELECT foid, tag_id, datetime FROM {tag_records}
WHERE tag_id IN (SELECT tag_id FROM {deployments})""",
)
def semi_deployed_tags(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    return deployments.deployed_only(records, t.deployments)


@query(
    "anti_undeployed_tags",
    """
SELECT foid, tag_id, datetime FROM {tag_records}
WHERE tag_id NOT IN (SELECT tag_id FROM {deployments})""",
)
def anti_undeployed_tags(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    return deployments.undeployed_only(records, t.deployments)


@query(
    "project_counts",
    """
SELECT d.project_id, count(*) AS n_rows, count(DISTINCT r.tag_id) AS n_tags,
  count(DISTINCT d.bird_id) AS n_birds
FROM {tag_records} r JOIN {deployments} d ON """
    + INSIDE
    + " GROUP BY d.project_id",
)
def project_counts(t: Tables) -> DataFrame:
    return summary.project_counts(
        deployments.assign_deployment(t.tag_records, t.deployments)
    )
