"""Several sensor series stacked on one axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import vector_sum

# Fixed values of the stacked display.
SOLAR_OFFSET = 101.0
DRIFT_OFFSET = 5.0
VECTOR_FACTOR = 0.1
TEMPERATURE_RANGE = (0.0, 100.0)


def sensor_long(records: DataFrame, key: str = "tag_id") -> DataFrame:
    """Long form ``(key, datetime, foid, series, y)``, implausible values left out.

    One pass over the records: each row yields its series as an array of
    structs, so nothing is read twice or shuffled.
    """
    low, high = TEMPERATURE_RANGE
    temperature = F.col("ext_temperature_c")
    located = F.col("lat").isNotNull()
    series = {
        "depth": F.when(F.col("depth_m") != 0, -F.col("depth_m")),
        "lat": F.abs("lat"),
        "temperature": F.when((temperature > low) & (temperature < high), temperature),
        "conductivity": F.col("conductivity_ms_cm"),
        "battery": F.when(located, F.col("bat_soc_pct")),
        "solar": F.when(located, F.col("solar_i_ma") + SOLAR_OFFSET),
        "vector_sum": F.when(located, vector_sum("acc_x", "acc_y", "acc_z", VECTOR_FACTOR)),
    }
    if "gps_surfacedrifts" in records.columns:
        series["drift"] = F.when(F.col("gps_surfacedrifts") == 1, F.abs("lat") + DRIFT_OFFSET)
    points = F.array(
        *[F.struct(F.lit(name).alias("series"), y.alias("y")) for name, y in series.items()]
    )
    return (
        records.select(key, "datetime", "foid", F.explode(points).alias("p"))
        .select(key, "datetime", "foid", "p.series", "p.y")
        .filter(F.col("y").isNotNull())
    )


def daily_series(daily: DataFrame, key: str = "tag_id") -> DataFrame:
    """Daily dive counts as one more series, placed at the end of the day."""
    return daily.select(
        key,
        (F.col("date").cast("timestamp") + F.expr("interval 23 hours 59 minutes")).alias("datetime"),
        F.lit(None).cast("long").alias("foid"),
        F.lit("daily_dives").alias("series"),
        F.col("n").cast("double").alias("y"),
    )
