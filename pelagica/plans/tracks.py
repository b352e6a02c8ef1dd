"""From all fixes to speed-filtered tracks of single animals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean, deployments, speed, summary
from ..operators.slices import DAY_S


def assemble_tracks(
    records: DataFrame,
    deployment_table: DataFrame,
    vmax: float = speed.VMAX_MS,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Usable fixes inside a deployment, one per time, implausible ones removed."""
    fixes = clean.usable_fixes(records).select("tag_id", "datetime", "foid", "lat", "lon")
    known = deployments.assign_deployment(fixes, deployment_table, ("project_id", "bird_id"))
    unique = clean.keep_first(known, ("uni_id", "datetime"))
    return speed.speed_filter(unique, vmax, slice_s=slice_s)


def project_extents(tracks: DataFrame) -> DataFrame:
    """Extent with margin, fixes and animals per project."""
    return summary.extent(tracks, birds=True)
