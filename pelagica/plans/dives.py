"""Dives of a study and where they happened."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean, deployments, match, segments
from ..operators.slices import DAY_S


def place_dives(
    records: DataFrame,
    deployment_table: DataFrame,
    depth_cutoff: float = 1,
    dive_depth: float = 1.5,
    max_gap_s: float = 2,
    min_points: int = 2,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Dive summaries with the nearest fix of the same day."""
    wanted = clean.exclude_types(records)
    trimmed = deployments.trim_to_deployment(wanted, deployment_table)
    dives = segments.dive_segments(
        clean.depth_rows(trimmed), depth_cutoff, dive_depth, max_gap_s, min_points, slice_s=slice_s
    )
    return match.nearest_fix_same_day(
        segments.dive_summary(dives), clean.usable_fixes(trimmed), slice_s=slice_s
    )
