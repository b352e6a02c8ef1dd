"""Study outputs: annotated records and per-deployment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, deployments, drift, segments, summary
from ..operators.slices import DAY_S
from ..session import write_once
from ..sources.store import write_by

KEYS = ("project_id", "tag_id", "bird_id")


def annotate_records(
    records: DataFrame,
    deployment_table: DataFrame,
    drift_step_s: float = 2,
    drift_steps: int = 5,
    depth_cutoff: float = 1,
    dive_depth: float = 3,
    max_gap_s: float = 2,
    min_points: int = 3,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Cleaned records with drift flag, dive labels and the deployment they belong to.

    Each record gets the latest deployment of its tag that started before it;
    records before any deployment drop out.  The deduplicated records are written
    once to the shared checkpoint folder: drift and dives both start from them.
    """
    drifting, dives = _parts(
        records, drift_step_s, drift_steps, depth_cutoff, dive_depth, max_gap_s, min_points, slice_s
    )
    dives = dives.select("tag_id", "datetime", "foid", "dive_chunk", "dive_no")
    return _deployed(drifting.join(dives, ["tag_id", "datetime", "foid"], "left"), deployment_table)


def _parts(
    records: DataFrame,
    drift_step_s: float,
    drift_steps: int,
    depth_cutoff: float,
    dive_depth: float,
    max_gap_s: float,
    min_points: int,
    slice_s: int,
) -> tuple[DataFrame, DataFrame]:
    """Cleaned records with the drift flag, and the depth rows among them with their dives."""
    unique = write_once(clean.keep_first(clean.clean_records(records)))
    drifting = drift.flag_surface_drift(unique, drift_step_s, drift_steps, slice_s=slice_s)
    dives = segments.dive_segments(
        clean.depth_rows(unique), depth_cutoff, dive_depth, max_gap_s, min_points, slice_s=slice_s
    )
    return drifting, dives


def _deployed(rows: DataFrame, deployment_table: DataFrame) -> DataFrame:
    known = deployments.asof_deployment(rows, deployment_table, ("project_id", "bird_id"))
    return known.filter(F.col("dep_start").isNotNull()).drop("dep_start")


def report_deployments(
    records: DataFrame,
    deployment_table: DataFrame,
    drift_step_s: float = 2,
    drift_steps: int = 5,
    depth_cutoff: float = 1,
    dive_depth: float = 3,
    max_gap_s: float = 2,
    min_points: int = 3,
    slice_s: int = DAY_S,
) -> DataFrame:
    """The report of ``deployment_report`` straight from records.

    Drift flags and dives are summarised each for itself and meet as one row per group, so
    that the labels of single rows are never joined.
    """
    drifting, dives = _parts(
        records, drift_step_s, drift_steps, depth_cutoff, dive_depth, max_gap_s, min_points, slice_s
    )
    also = [c for c in ("device_id",) if c in records.columns]
    report = summary.tag_summary(_deployed(drifting, deployment_table), KEYS, drift=True, also=also)
    diving = _deployed(dives.select("tag_id", "datetime", "depth_m", "dive_chunk"), deployment_table)
    chunks = summary.dive_chunk_counts(diving, KEYS).select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("n_depth").alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    counted = report.join(chunks, same, "left").withColumn("n_depth", F.coalesce("_n", F.lit(0)))
    rate = segments.mean_daily_dives(segments.daily_dives(diving))
    return counted.drop("_n", *[f"_{k}" for k in KEYS]).join(rate, "tag_id", "left")


def deployment_report(annotated: DataFrame) -> DataFrame:
    """Whole-deployment summary per project, tag and animal, with the tag's daily dives."""
    also = [c for c in ("device_id",) if c in annotated.columns]
    report = summary.tag_summary(annotated, KEYS, drift=True, dives=True, also=also)
    rate = segments.mean_daily_dives(segments.daily_dives(clean.depth_rows(annotated)))
    return report.join(rate, "tag_id", "left")


def chunks_by_project(annotated: DataFrame) -> DataFrame:
    """Distinct dive chunks per project and tag."""
    return summary.dive_chunk_counts(annotated, ("project_id", "tag_id"))


def store_studies(annotated: DataFrame, path: str) -> None:
    """One folder per project; no loop over projects."""
    write_by(annotated, path, "project_id")
