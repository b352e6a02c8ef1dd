"""Readers for the other inputs: field tables, combined tables, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import species_of
from ..functions.time import parse_day_first, parse_month_first
from ..operators.clean import usable_fixes
from ..operators.deployments import clean_deployments

# Columns of each input file.
DEPLOYMENT_SCHEMA = (
    "Bird_ID STRING, TagSerialNumber STRING, Project_ID STRING, DeploymentStartDatetime STRING, "
    "Deployment_End_Short STRING, DeploymentEndDatetime_UTC STRING, UTC_offset_deploy DOUBLE, "
    "TagManufacture STRING"
)
GPS_SCHEMA = "id STRING, time STRING, lat DOUBLE, lon DOUBLE"
DIVES_SCHEMA = "tag STRING, time STRING, gps_lat_post DOUBLE, gps_lon_post DOUBLE"
CLASSES_SCHEMA = "TID INT, TID_short STRING, Measurement STRING"
CALIBRATION_SCHEMA = (
    "tag_id STRING, cal_start_datetime_local STRING, cal_end_datetime_local STRING, "
    "utc_offset DOUBLE, calprocessed_yn STRING"
)
LEGACY_SCHEMA = (
    "BirdID STRING, LatDegree DOUBLE, LongDegree DOUBLE, ObsDepth DOUBLE, CalDepth DOUBLE"
)
CELLS_SCHEMA = "x DOUBLE, y DOUBLE, layer INT"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema; a differing header is an error."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("recursiveFileLookup", "true")
        .csv(path)
    )


def read_deployments(
    spark: SparkSession, path: str, manufacturer: str | None = None
) -> DataFrame:
    """The deployment table, cleaned; ``dep_no`` rises in the order of the file."""
    listed = read_csv(spark, path, DEPLOYMENT_SCHEMA).withColumn("dep_no", F.monotonically_increasing_id())
    return clean_deployments(listed, manufacturer)


def unparsed_times(raw: DataFrame, parsed: DataFrame, columns: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Texts of a raw table that are no times: ``keys``, the column and its text.

    ``columns`` maps raw text columns to the parsed ones; ``keys`` name a row in both tables.
    """
    both = raw.join(parsed.select(*keys, *columns.values()), list(keys))
    texts = [F.struct(F.lit(c).alias("column"), F.col(c).alias("text"), F.col(p).isNull().alias("bad")) for c, p in columns.items()]
    found = both.select(*keys, F.explode(F.array(*texts)).alias("t")).select(*keys, "t.*")
    return found.filter(F.col("bad") & (F.trim("text") != "")).drop("bad")


def parse_gps(raw: DataFrame) -> DataFrame:
    """Combined GPS table with its day-first times parsed and bad fixes removed."""
    return usable_fixes(raw.withColumn("datetime", parse_day_first("time")))


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """The combined GPS table."""
    return parse_gps(read_csv(spark, path, GPS_SCHEMA))


def parse_dives(raw: DataFrame) -> DataFrame:
    """Combined dive table with time, year and month."""
    timed = raw.withColumn("datetime", parse_day_first("time"))
    return timed.withColumns({"year": F.year("datetime"), "month": F.month("datetime")})


def read_dives(spark: SparkSession, path: str) -> DataFrame:
    """The combined dive table."""
    return parse_dives(read_csv(spark, path, DIVES_SCHEMA))


def select_dives(
    dives: DataFrame,
    deployments: DataFrame,
    projects: Sequence[str],
    species: str,
    year: int | None = None,
    months: Sequence[int] = (),
    lon_below: float | None = None,
) -> DataFrame:
    """Dives of the tags of some projects, by season and region."""
    tags = deployments.filter(F.col("project_id").isin(*projects))
    kept = dives.join(tags.select(F.col("tag_id").alias("tag")), "tag", "left_semi")
    kept = kept.filter(F.col("gps_lat_post") != 0)
    if year is not None:
        kept = kept.filter(F.col("year") == year)
    if months:
        kept = kept.filter(F.col("month").isin(*months))
    if lon_below is not None:
        kept = kept.filter(F.col("gps_lon_post") < lon_below)
    return kept.withColumn("species", F.lit(species))


def read_raster_classes(spark: SparkSession, path: str) -> DataFrame:
    """Raster class names."""
    return read_csv(spark, path, CLASSES_SCHEMA).toDF("tid", "tid_short", "measurement")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Raster cells: Parquet when the path ends so, CSV otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(CELLS_SCHEMA).parquet(path)
    return read_csv(spark, path, CELLS_SCHEMA)


def grid_cells(grid: DataFrame, west: float, north: float, step_x: float, step_y: float) -> DataFrame:
    """Cell centres of a raster stored as ``(row_no, col_no, layer)``.

    Rows count from the north and columns from the west, both from 0.
    """
    return grid.select(
        (F.lit(west) + (F.col("col_no") + 0.5) * step_x).alias("x"),
        (F.lit(north) - (F.col("row_no") + 0.5) * step_y).alias("y"),
        "layer",
    )


def read_calibration_index(spark: SparkSession, path: str) -> DataFrame:
    """Calibration index with its month-first local times parsed."""
    raw = read_csv(spark, path, CALIBRATION_SCHEMA)
    return raw.select(
        "tag_id",
        parse_month_first("cal_start_datetime_local").alias("cal_start_local"),
        parse_month_first("cal_end_datetime_local").alias("cal_end_local"),
        "utc_offset",
        "calprocessed_yn",
    )


def legacy_species(track: DataFrame, bird: str = "bird_id") -> DataFrame:
    """Add the species coded in the bird id."""
    return track.withColumn("species", species_of(bird))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """A folder of older GPS and depth tables."""
    names = ["bird_id", "lat_degree", "long_degree", "obs_depth", "cal_depth"]
    return legacy_species(read_csv(spark, path, LEGACY_SCHEMA).toDF(*names))
