"""One study from its records to drift flags, speed labels, daily dives and a summary per tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, deployments, drift, segments, speed, summary
from ..operators.slices import DAY_S
from ..session import checkpointed, write_once


def study_records(
    records: DataFrame,
    deployment_table: DataFrame,
    drift_step_s: float = 2,
    drift_steps: int = 5,
    vmax: float = speed.VMAX_MS,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Records inside a deployment of their tag, with ``gps_surfacedrifts`` and ``mfilter``.

    Surface accelerometry is left out.  Drift is looked for among all positions, the zero ones included; the speed
    label (``removed``, ``end_location`` or ``not``) is that of the tag's usable fixes, and NULL in all other rows.
    No row is dropped for its speed.  Fixes and other rows part after the drift pass and are stacked again, so
    that no label is joined back to its row.  Rows of a tag without a deployment, and those without a
    tag or time, belong to none.
    """
    inside = write_once(deployments.trim_to_deployment(clean.exclude_types(records), deployment_table))
    drifting = checkpointed(drift.flag_surface_drift(inside, drift_step_s, drift_steps, slice_s=slice_s))
    fixes = speed.speed_filter(
        clean.usable_fixes(drifting), vmax, key="tag_id", slice_s=slice_s, keep_removed=True
    )
    return clean.union_by_name([fixes, drifting.filter(~clean.is_usable())])


def study_summary(study: DataFrame) -> DataFrame:
    """Whole-deployment summary per tag: times, depths, sensors, distinct positions and rows in drift."""
    return summary.tag_summary(study, ("tag_id",), drift=True)


def study_days(
    study: DataFrame,
    depth_cutoff: float = 1,
    dive_depth: float = 1.5,
    max_gap_s: float = 2,
    min_points: int = 2,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Dive chunks, times and depths per tag and day; rows outside any chunk count as one more."""
    dives = segments.dive_segments(
        clean.depth_rows(study), depth_cutoff, dive_depth, max_gap_s, min_points, slice_s=slice_s
    )
    return segments.daily_dives(dives, count_null=True)


def track_speeds(study: DataFrame) -> DataFrame:
    """Fixes per tag by speed label."""
    fixes = study.filter(F.col("mfilter").isNotNull())
    return fixes.groupBy("tag_id", "mfilter").agg(F.count("*").alias("n_fixes"))
