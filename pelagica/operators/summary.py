"""Status summaries, counts, pivots and extents.

All are grouped aggregates that Spark combines before the shuffle, so a hot
group sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import distinct_with_null, half_even
from ..functions.time import seconds_between

# Fixed value: margin around an extent, in degrees.
EXTENT_MARGIN_DEG = 0.25
# Registers of a sketch, as a power of two: a relative standard error of 1.6 %.
SKETCH_BITS = 12


def _summary_columns() -> list[Column]:
    return [
        F.min("datetime").alias("min_dt"),
        F.max("datetime").alias("max_dt"),
        F.max("depth_m").alias("max_depth"),
        half_even(F.avg("depth_m"), 2).alias("u_depth"),
        distinct_with_null("lat").alias("n_gps"),
        half_even(F.avg("u_bat_mv"), 0).alias("u_bat"),
        half_even(F.avg("ext_temperature_c"), 2).alias("u_temp"),
        half_even(F.avg("conductivity_ms_cm"), 2).alias("u_cond"),
    ]


def tag_summary(
    records: DataFrame,
    keys: Sequence[str] = ("project_id", "tag_id"),
    drift: bool = False,
    dives: bool = False,
    types: Sequence[str] = (),
    also: Sequence[str] = (),
) -> DataFrame:
    """Times, depths, sensors and duration per group.

    ``drift`` adds the number of surface-drift rows and ``dives`` the number of
    distinct dive chunks; both columns must then be present.  ``types`` adds
    the number of rows of each record type, NULL where there are none, in the
    same pass.  ``also`` names columns with one value in a group, of which the
    largest is taken.
    """
    columns = [*_summary_columns(), *[F.max(c).alias(c) for c in also]]
    if drift:
        columns.append(F.sum("gps_surfacedrifts").alias("gps_surfacedrift_pts"))
    if dives:
        columns.append(F.countDistinct("dive_chunk").alias("n_depth"))
    for name in types:
        rows = F.count(F.when(F.col("datatype") == name, 1))
        columns.append(F.nullif(rows, F.lit(0)).alias(name))
    seconds = seconds_between("min_dt", "max_dt")
    return (
        records.groupBy(*keys)
        .agg(*columns)
        .withColumns({"dur_s": half_even(seconds, 2), "dur_hr": half_even(seconds / 3600, 2)})
    )


def datatype_counts(records: DataFrame, keys: Sequence[str] = ("tag_id",)) -> DataFrame:
    """Rows per group and record type."""
    return records.groupBy(*keys, "datatype").agg(F.count("*").alias("no_rows"))


def datatype_pivot(
    counts: DataFrame, types: Sequence[str], keys: Sequence[str] = ("tag_id",)
) -> DataFrame:
    """One column per record type, NULL where a group has none.

    The types are named by the caller, so no extra job looks them up.
    """
    return counts.groupBy(*keys).pivot("datatype", list(types)).agg(F.first("no_rows"))


def daily_position_sketches(records: DataFrame, keys: Sequence[str] = ("project_id", "tag_id")) -> DataFrame:
    """``keys, date, sketch, n_rows``: a mergeable sketch of the distinct latitudes of a day.

    A sketch has at most a few kilobytes however many positions a day has, so those of any
    run of days are merged without their records; its relative standard error is
    about 1.04 / sqrt(2 ** SKETCH_BITS).
    """
    sketch = F.hll_sketch_agg(F.col("lat").cast("string"), F.lit(SKETCH_BITS))
    day = F.to_date("datetime").alias("date")
    return records.groupBy(*keys, day).agg(sketch.alias("sketch"), F.count("*").alias("n_rows"))


def positions_of_days(
    sketches: DataFrame, first: Column, last: Column, keys: Sequence[str] = ("project_id", "tag_id")
) -> DataFrame:
    """``keys, n_lat_about, n_rows`` over the days from ``first`` to ``last``, from daily sketches."""
    days = sketches.filter(F.col("date").between(first, last))
    merged = days.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("_sketch"), F.sum("n_rows").alias("n_rows"))
    return merged.select(*keys, F.hll_sketch_estimate("_sketch").alias("n_lat_about"), "n_rows")


def distinct_positions(records: DataFrame, key: str = "tag_id") -> DataFrame:
    """Distinct latitudes per tag, NULL counted as a value, and without it."""
    return records.groupBy(key).agg(
        distinct_with_null("lat").alias("n_gps"), F.countDistinct("lat").alias("n_lat")
    )


def project_counts(records: DataFrame) -> DataFrame:
    """Rows, tags and animals per project."""
    return records.groupBy("project_id").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("tag_id").alias("n_tags"),
        F.countDistinct("uni_id").alias("n_birds"),
    )


def dive_chunk_counts(dives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct dive chunks per group."""
    return dives.groupBy(*keys).agg(F.countDistinct("dive_chunk").alias("n_depth"))


def extent(
    fixes: DataFrame,
    keys: Sequence[str] = ("project_id",),
    lat: str = "lat",
    lon: str = "lon",
    margin: float = EXTENT_MARGIN_DEG,
    birds: bool = False,
) -> DataFrame:
    """Bounding box per group, widened by a margin.

    ``birds`` adds the number of fixes and of animals in the same pass.
    """
    columns = [
        (F.min(lat) - margin).alias("y_min"),
        (F.max(lat) + margin).alias("y_max"),
        (F.min(lon) - margin).alias("x_min"),
        (F.max(lon) + margin).alias("x_max"),
    ]
    if birds:
        columns += [F.count("*").alias("n_rows"), F.countDistinct("uni_id").alias("n_birds")]
    return fixes.groupBy(*keys).agg(*columns)


def legacy_extent(track: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    """Raw extent and greatest absolute depth of the older dataset."""
    return track.groupBy(*keys).agg(
        F.min("lat_degree").alias("min_lat"),
        F.max("lat_degree").alias("max_lat"),
        F.min("long_degree").alias("min_lon"),
        F.max("long_degree").alias("max_lon"),
        F.max(F.abs("cal_depth")).alias("max_depth"),
    )
