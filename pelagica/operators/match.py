"""Matching dives to positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import seconds_between
from .slices import DAY_S, SLICE, fill_from_neighbours, with_slice


def nearest_fix_same_day(
    dives: DataFrame,
    fixes: DataFrame,
    key: str = "tag_id",
    day: str = "date",
    at: str = "max_dt",
    slice_s: int = DAY_S,
) -> DataFrame:
    """For each dive the fix of the same tag and day closest to the dive's end.

    Dives and fixes are merged into one timeline; only the last fix at or
    before the dive end and the first one after it can be closest, so no pairs
    are formed.  The earlier fix wins a tie.  Of fixes at one time the first
    counts; they share a slice, where the others are passed over.  A day without fixes leaves NULLs.
    """
    columns = dives.columns
    order = ("_t", "_is_dive", "_foid")
    fix_rows = fixes.select(
        key,
        F.to_date("datetime").alias(day),
        F.col("datetime").alias("_t"),
        F.lit(0).alias("_is_dive"),
        F.col("foid").alias("_foid"),
        F.struct(
            F.col("datetime").alias("time"), F.col("foid"), "lat", "lon", "datatype"
        ).alias("_fix"),
    )
    dive_rows = dives.withColumns({"_t": F.col(at), "_is_dive": F.lit(1)})
    merged = with_slice(
        dive_rows.unionByName(fix_rows, allowMissingColumns=True), slice_s, "_t"
    )
    earlier = F.lag("_t").over(Window.partitionBy(key, day, SLICE).orderBy(*order))
    again = (F.col("_is_dive") == 0) & (earlier == F.col("_t"))
    firsts = merged.withColumn("_fix", F.when(~F.coalesce(again, F.lit(False)), F.col("_fix")))
    near = fill_from_neighbours(firsts, "_fix", (key, day), order, last="_before", following="_after").filter("_is_dive = 1")
    gap_before = seconds_between(F.col("_before")["time"], F.col(at))
    gap_after = seconds_between(F.col(at), F.col("_after")["time"])
    nearer = F.when(
        F.col("_after").isNull() | (gap_before <= gap_after), F.col("_before")
    ).otherwise(F.col("_after"))
    return near.withColumn("_near", nearer).select(
        *columns,
        seconds_between(F.col(at), F.col("_near")["time"]).alias("gps_tdiff"),
        F.col("_near")["lat"].alias("lat"),
        F.col("_near")["lon"].alias("lon"),
        F.col("_near")["datatype"].alias("gps_datatype"),
        F.col("_near")["foid"].alias("gps_oid"),
        F.col("_near")["time"].alias("gps_time"),
    )
