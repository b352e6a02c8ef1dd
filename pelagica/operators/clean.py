"""Column and row cleaning, filters, deduplication, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import nan_to_null, vector_sum, wrap360
from ..functions.time import shift_seconds

# Raw names of renamed columns, columns not kept, record types
# that hold surface accelerometry.
RENAMES = {"Latitude": "lat", "Longitude": "lon", "conductivity_mS.cm": "conductivity_ms_cm"}
MOTION_COLUMNS = ("mag_x", "mag_y", "mag_z", "acc_x", "acc_y", "acc_z")
SURFACE_ACC_TYPES = ("SEN_ACC_5Hz_START", "SEN_ACC_5Hz", "SEN_ACC_5Hz_ENDINT", "SEN_ACC_5Hz_END")


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite values to NULL in every floating-point column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floating}) if floating else df


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each absent column as NULL of the given type."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def clean_records(df: DataFrame, drop: Sequence[str] = MOTION_COLUMNS) -> DataFrame:
    """Rename, drop motion columns, NULL out NaN and remove useless rows.

    Rows go when they have neither position nor depth, when they sit at (0, 0)
    without depth, or when all columns are NULL.
    """
    named = nulls_for_nan(df.withColumnsRenamed(RENAMES).drop(*drop))
    named = add_missing(named, {"depth_m": "double"})
    no_depth = F.col("depth_m").isNull()
    at_origin = (F.col("lat") == 0) & (F.col("lon") == 0)
    return (
        named.filter(F.col("lat").isNotNull() | ~no_depth)
        .filter(~(F.coalesce(at_origin, F.lit(False)) & no_depth))
        .dropna(how="all")
    )


def is_usable(lat: str = "lat", lon: str = "lon") -> Column:
    """Whether a row has both coordinates, neither zero, longitude below 180; never NULL."""
    return F.coalesce((F.col(lat) != 0) & (F.col(lon) != 0) & (F.col(lon) < 180), F.lit(False))


def usable_fixes(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Fixes with both coordinates, neither zero, longitude below 180."""
    return df.filter((F.col(lat) != 0) & (F.col(lon) != 0) & (F.col(lon) < 180))


def zero_to_null(df: DataFrame, columns: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Zero coordinates to NULL, each axis on its own."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in columns})


def exclude_types(df: DataFrame, types: Sequence[str] = SURFACE_ACC_TYPES) -> DataFrame:
    """Drop the given record types; a NULL type goes too, as in a comparison."""
    return df.filter(~F.col("datatype").isin(*types))


def trailing(df: DataFrame, as_of: Column, hours: float = 48, time: str = "datetime") -> DataFrame:
    """Rows strictly later than ``hours`` before ``as_of``."""
    return df.filter(F.col(time) > shift_seconds(as_of, -3600 * hours))


def latest_time(df: DataFrame, time: str = "datetime") -> Column:
    """Latest time in the data as a one-row scalar subquery."""
    return df.agg(F.max(time)).scalar()


def depth_rows(df: DataFrame) -> DataFrame:
    """Rows with a depth."""
    return df.filter(F.col("depth_m").isNotNull())


def no_depth_rows(df: DataFrame) -> DataFrame:
    """Rows without a depth."""
    return df.filter(F.col("depth_m").isNull())


def position_rows(df: DataFrame) -> DataFrame:
    """Rows with a position."""
    return df.filter(F.col("lat").isNotNull())


def record_part(df: DataFrame) -> DataFrame:
    """Label every row by the part it belongs to when depth and GPS split."""
    depth, fix = F.col("depth_m").isNotNull(), F.col("lat").isNotNull()
    part = F.when(depth & fix, "both").when(depth, "depth").when(fix, "gps").otherwise("none")
    return df.withColumn("part", part)


def keep_first(
    df: DataFrame,
    keys: Sequence[str] = ("tag_id", "datetime"),
    order: Sequence[str] = ("foid",),
) -> DataFrame:
    """First row of every key in the given order.

    Spark applies the ``= 1`` limit before the shuffle as well, so a key with
    very many copies sends one row per input task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def preview(df: DataFrame, rows: int, order: Sequence[str | Column]) -> DataFrame:
    """The first rows in a total order, as a top-k."""
    return df.orderBy(*order).limit(rows)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_wrap360(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Add ``lon360``."""
    return df.withColumn("lon360", wrap360(lon))


def with_vector_sum(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Add the acceleration vector sum."""
    return df.withColumn("vectoral_sum", vector_sum("acc_x", "acc_y", "acc_z", factor))
