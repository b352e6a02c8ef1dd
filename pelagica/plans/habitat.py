"""Home ranges and the raster classes inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hulls


def home_ranges(fixes: DataFrame) -> DataFrame:
    """Hull corners per animal and per project, in one pass over the fixes.

    ``home`` is the animal key or the project.
    """
    homes = F.explode(F.array("uni_id", "project_id"))
    return hulls.convex_hull(fixes.select(homes.alias("home"), "lat", "lon"), "home")


def habitat_classes(
    positions: DataFrame, cells: DataFrame, lookup: DataFrame, key: str, lon: str, lat: str
) -> DataFrame:
    """Raster cells per class inside each group's hull, also for groups that live on both sides of the 180th meridian."""
    corners = hulls.convex_hull(hulls.unwrap_longitudes(positions, key, lon), key, lon, lat)
    return hulls.class_counts_inside(cells, corners, lookup, key, turn=360.0)
