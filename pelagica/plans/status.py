"""Status reports over a trailing window."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, deployments, drift, segments, summary
from ..operators.slices import DAY_S
from ..session import write_once
from ..functions.time import shift_seconds
from ..sources.inventory import RECENT_DAYS
from ..sources.tag_logs import MIN_FILE_BYTES, last_records, read_tags


def daily_status(
    records: DataFrame,
    deployment_table: DataFrame,
    types: Sequence[str],
    as_of: Column | None = None,
    hours: float = 48,
) -> DataFrame:
    """Per tag over the last ``hours``: summary and rows by record type.

    ``as_of`` defaults to the latest time in the records.
    """
    as_of = as_of if as_of is not None else clean.latest_time(records)
    recent = clean.trailing(records, as_of, hours)
    known = deployments.join_latest_deployment(recent, deployment_table, ["project_id"])
    return summary.tag_summary(clean.keep_first(known), types=types)


def weekly_status(
    records: DataFrame,
    deployment_table: DataFrame,
    types: Sequence[str],
    as_of: Column | None = None,
    hours: float = 168,
    drift_step_s: float = 2,
    drift_steps: int = 5,
    depth_cutoff: float = 1,
    dive_depth: float = 3,
    max_gap_s: float = 2,
    min_points: int = 3,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Per tag over the last week: summary, surface drift, dive rate, record types.

    Fixes sent twice, in overlapping files, count once before drift is looked
    for.  A burst that reaches into the window shows it by ``drift_steps`` steps
    before it, so that no earlier rows are read; the rows of the window are written
    once to the shared checkpoint folder.  ``device_id`` and
    ``deploy_end_short`` are in the report if the inputs have them.
    """
    as_of = as_of if as_of is not None else clean.latest_time(records)
    earlier_h = (drift_steps + 1) * drift_step_s / 3600
    end = [c for c in ("deploy_end_short",) if c in deployment_table.columns]
    known = deployments.join_latest_deployment(
        clean.trailing(records, as_of, hours + earlier_h), deployment_table, ["project_id", "bird_id", *end]
    )
    once = write_once(clean.keep_first(known))
    drifting = drift.flag_surface_drift(once, drift_step_s, drift_steps, slice_s=slice_s)
    unique = clean.trailing(drifting, as_of, hours)
    # Dives do not need the drift flag, so their rows take the short way.
    dives = segments.dive_segments(
        clean.depth_rows(clean.trailing(once, as_of, hours)),
        depth_cutoff,
        dive_depth,
        max_gap_s,
        min_points,
        slice_s=slice_s,
    )
    rate = segments.mean_daily_dives(segments.daily_dives(dives))
    also = [*end, *[c for c in ("device_id",) if c in records.columns]]
    report = summary.tag_summary(unique, drift=True, types=types, also=also)
    return report.join(rate, "tag_id", "left")


def weekly_status_of_files(
    spark: SparkSession,
    folder: str,
    deployment_table: DataFrame,
    types: Sequence[str],
    as_of: datetime,
    min_bytes: int = MIN_FILE_BYTES,
    changed_days: float = RECENT_DAYS,
    last_record_days: float = 7,
    name_column: Column | None = None,
    **options: float,
) -> DataFrame:
    """The weekly report from a folder of logger files.

    Read are files larger than a header that changed in the last ``changed_days``;
    of these, the ones whose last record is less than ``last_record_days`` old.  Last
    records come from the files' ends, so other files are not read at all.  The driver
    sees the paths of the files that are read, as it does for any reader of files.
    """
    since = as_of - timedelta(days=changed_days)
    last = last_records(spark, folder, min_bytes, f"{since:%Y-%m-%dT%H:%M:%S}")
    recent = last.filter(F.col("last_record") > shift_seconds(F.lit(as_of), -86_400 * last_record_days))
    paths = sorted(r["file_path"] for r in recent.select("file_path").collect())
    # without a current file an empty report, from the rows of no file
    records = read_tags(spark, paths or folder, min_bytes if paths else sys.maxsize, name_column)
    return weekly_status(records, deployment_table, types, F.lit(as_of), **options)
