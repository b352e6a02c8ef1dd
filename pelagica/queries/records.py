"""Queries on single records: cleaning, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths, text, time
from ..operators import clean, deployments, summary
from ..plans import status
from .registry import Tables, query

# Record types of the test views, for the pivot.
TYPES = ("GPS", "GPSD", "SEN_ACC_5Hz", "SEN_TDR")


@query(
    "records_clean",
    """
SELECT foid, tag_id, datetime, datatype, lat, lon, depth_m, ext_temperature_c, u_bat_mv,
  conductivity_ms_cm
FROM {tag_records}
WHERE (lat IS NOT NULL OR depth_m IS NOT NULL)
  AND NOT (lat IS NOT NULL AND lon IS NOT NULL AND lat = 0 AND lon = 0 AND depth_m IS NULL)""",
)
def records_clean(t: Tables) -> DataFrame:
    raw = t.tag_records.withColumnsRenamed({"lat": "Latitude", "lon": "Longitude"})
    missing = F.when(F.col("depth_m").isNull(), F.lit(float("nan"))).otherwise(F.col("depth_m"))
    raw = raw.withColumn("depth_m", missing)
    return clean.clean_records(raw).drop("bat_soc_pct", "solar_i_ma")


@query(
    "gps_clean",
    """
SELECT foid, tag_id, datetime, lat, lon FROM {tag_records}
WHERE lat <> 0 AND lon <> 0 AND lon < 180""",
)
def gps_clean(t: Tables) -> DataFrame:
    return clean.usable_fixes(t.tag_records).select("foid", "tag_id", "datetime", "lat", "lon")


@query(
    "gps_zero_to_null",
    "SELECT foid, tag_id, nullif(lat, 0e0) AS lat, nullif(lon, 0e0) AS lon FROM {tag_records}",
)
def gps_zero_to_null(t: Tables) -> DataFrame:
    return clean.zero_to_null(t.tag_records.select("foid", "tag_id", "lat", "lon"))


@query(
    "exclude_datatypes",
    """
SELECT foid, tag_id, datetime, datatype FROM {tag_records}
WHERE datatype NOT IN ('SEN_ACC_5Hz_START','SEN_ACC_5Hz','SEN_ACC_5Hz_ENDINT','SEN_ACC_5Hz_END')""",
)
def exclude_datatypes(t: Tables) -> DataFrame:
    return clean.exclude_types(t.tag_records.select("foid", "tag_id", "datetime", "datatype"))


@query(
    "split_depth_gps",
    """
SELECT tag_id, CASE WHEN depth_m IS NOT NULL AND lat IS NOT NULL THEN 'both'
    WHEN depth_m IS NOT NULL THEN 'depth' WHEN lat IS NOT NULL THEN 'gps' ELSE 'none' END AS part,
  count(*) AS n_rows, count(depth_m) AS n_depth, count(lat) AS n_fix
FROM {tag_records} GROUP BY 1, 2""",
)
def split_depth_gps(t: Tables) -> DataFrame:
    return clean.record_part(t.tag_records).groupBy("tag_id", "part").agg(
        F.count("*").alias("n_rows"),
        F.count("depth_m").alias("n_depth"),
        F.count("lat").alias("n_fix"),
    )


@query(
    "trailing_window",
    """
SELECT foid, tag_id, datetime, 48 AS hours FROM {tag_records}
WHERE datetime > (SELECT max(datetime) FROM {tag_records}) - INTERVAL 172800 SECOND
UNION ALL
SELECT foid, tag_id, datetime, 168 AS hours FROM {tag_records}
WHERE datetime > (SELECT max(datetime) FROM {tag_records}) - INTERVAL 604800 SECOND""",
)
def trailing_window(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime")
    as_of = clean.latest_time(records)
    parts = [
        clean.trailing(records, as_of, hours).withColumn("hours", F.lit(hours))
        for hours in (48, 168)
    ]
    return clean.union_by_name(parts)


@query(
    "dedupe_fixes",
    """
SELECT foid, tag_id, hour, lat, lon FROM (
  SELECT foid, tag_id, date_trunc('hour', datetime) AS hour, lat, lon,
    row_number() OVER (PARTITION BY tag_id, date_trunc('hour', datetime) ORDER BY foid) AS rn
  FROM {tag_records}) WHERE rn = 1""",
)
def dedupe_fixes(t: Tables) -> DataFrame:
    hourly = t.tag_records.select(
        "foid", "tag_id", F.date_trunc("hour", "datetime").alias("hour"), "lat", "lon"
    )
    return clean.keep_first(hourly, ("tag_id", "hour"))


@query(
    "gps_preview",
    """
SELECT foid, tag_id, datetime, lat, lon FROM {tag_records}
WHERE lat <> 0 AND lon <> 0 AND lon < 180 ORDER BY tag_id, datetime, foid LIMIT 6""",
)
def gps_preview(t: Tables) -> DataFrame:
    fixes = clean.usable_fixes(t.tag_records).select("foid", "tag_id", "datetime", "lat", "lon")
    return clean.preview(fixes, 6, ["tag_id", "datetime", "foid"])


@query(
    "union_records",
    """
SELECT foid, tag_id, datetime, lat, lon, CAST(NULL AS double) AS depth_m FROM {tag_records}
WHERE lat IS NOT NULL
UNION ALL
SELECT foid, tag_id, datetime, CAST(NULL AS double), CAST(NULL AS double), depth_m
FROM {tag_records} WHERE depth_m IS NOT NULL""",
)
def union_records(t: Tables) -> DataFrame:
    fixes = clean.position_rows(t.tag_records).select("foid", "tag_id", "datetime", "lat", "lon")
    depths = clean.depth_rows(t.tag_records).select("depth_m", "datetime", "tag_id", "foid")
    return clean.union_by_name([fixes, depths])


@query(
    "n_distinct_with_null",
    """
SELECT tag_id, count(DISTINCT lat) + max(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) AS n_gps,
  count(DISTINCT lat) AS n_lat
FROM {tag_records} GROUP BY tag_id""",
)
def n_distinct_with_null(t: Tables) -> DataFrame:
    return summary.distinct_positions(t.tag_records)


@query(
    "datatype_counts",
    "SELECT tag_id, datatype, count(*) AS no_rows FROM {tag_records} GROUP BY 1, 2",
)
def datatype_counts(t: Tables) -> DataFrame:
    return summary.datatype_counts(t.tag_records)


@query(
    "datatype_pivot",
    """
SELECT tag_id,
  nullif(count(*) FILTER (WHERE datatype = 'GPS'), 0) AS "GPS",
  nullif(count(*) FILTER (WHERE datatype = 'GPSD'), 0) AS "GPSD",
  nullif(count(*) FILTER (WHERE datatype = 'SEN_ACC_5Hz'), 0) AS "SEN_ACC_5Hz",
  nullif(count(*) FILTER (WHERE datatype = 'SEN_TDR'), 0) AS "SEN_TDR"
FROM {tag_records} GROUP BY tag_id""",
)
def datatype_pivot(t: Tables) -> DataFrame:
    return summary.datatype_pivot(summary.datatype_counts(t.tag_records), TYPES)


@query(
    "wrap360",
    """
SELECT foid, CASE WHEN lon < 0 THEN lon + 360e0 ELSE lon END AS lon360
FROM {tag_records} WHERE lon IS NOT NULL""",
)
def wrap360(t: Tables) -> DataFrame:
    return clean.with_wrap360(clean.position_rows(t.tag_records)).select("foid", "lon360")


@query(
    "vector_sum",
    """
SELECT foid, tag_id, sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) AS vectoral_sum,
  sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) * 0.1e0 AS scaled
FROM {tag_records}""",
)
def vector_sum(t: Tables) -> DataFrame:
    scaled = maths.vector_sum("acc_x", "acc_y", "acc_z", 0.1)
    return clean.with_vector_sum(t.tag_records).select(
        "foid", "tag_id", "vectoral_sum", scaled.alias("scaled")
    )


@query(
    "scalar_time_parse",
    """
SELECT foid, date_trunc('minute', datetime) AS month_first, datetime AS iso,
  date_trunc('second', datetime) AS day_first, date_trunc('minute', datetime) AS either_slash,
  datetime AS either_iso, datetime + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS utc,
  CAST(NULL AS timestamp) AS unparsed, CAST(datetime AS date) AS day,
  CAST(year(datetime) AS int) AS year, CAST(month(datetime) AS int) AS month,
  CAST(day(datetime) AS int) AS day_no,
  (epoch_us(datetime) - epoch_us(date_trunc('day', datetime))) / 1e6 AS secs,
  datetime - INTERVAL 3600 SECOND AS earlier
FROM {tag_records}""",
)
def scalar_time_parse(t: Tables) -> DataFrame:
    at = F.col("datetime")
    slash, iso = F.date_format(at, "M/d/yyyy H:mm"), at.cast("string")
    day_first = F.date_format(at, "dd/MM/yyyy HH:mm:ss")
    return t.tag_records.select(
        "foid",
        time.parse_month_first(slash).alias("month_first"),
        time.parse_iso(iso).alias("iso"),
        time.parse_day_first(day_first).alias("day_first"),
        time.parse_either(slash).alias("either_slash"),
        time.parse_either(iso).alias("either_iso"),
        time.to_utc(at, F.lit(-5.5)).alias("utc"),
        time.parse_iso(F.concat(F.lit("x"), iso)).alias("unparsed"),
        F.to_date(at).alias("day"),
        F.year(at).alias("year"),
        F.month(at).alias("month"),
        F.day(at).alias("day_no"),
        time.seconds_between(F.date_trunc("day", at), at).alias("secs"),
        time.shift_seconds(at, -3600).alias("earlier"),
    )


@query(
    "scalar_strings",
    """
SELECT file_name, split_part(split_part(file_name, '_', 1), '.', 1) AS tag,
  split_part(file_name, '_', 3) AS rest, strpos(file_name, '_') AS place,
  contains(file_name, 'GPRS') AS transmitted, lpad(CAST(tag_id AS string), 6, '0') AS padded,
  'P_' || CAST(tag_id AS string) AS uni_id, regexp_replace(file_name, '[12]', '', 'g') AS stripped,
  regexp_matches(file_name, '_2024010[1-9]') AS early,
  CAST(tag_id AS string) || '_GPRS_' || strftime(last_record, '%Y%m%d') AS token
FROM {files}""",
)
def scalar_strings(t: Tables) -> DataFrame:
    name, tag = F.col("file_name"), F.col("tag_id").cast("string")
    return t.files.select(
        "file_name",
        text.tag_of_file(name).alias("tag"),
        F.split_part(name, F.lit("_"), F.lit(3)).alias("rest"),
        F.locate("_", name).cast("long").alias("place"),
        name.contains("GPRS").alias("transmitted"),
        F.lpad(tag, 6, "0").alias("padded"),
        text.uni_id(F.lit("P"), tag).alias("uni_id"),
        F.regexp_replace(name, "[12]", "").alias("stripped"),
        name.rlike("_2024010[1-9]").alias("early"),
        text.file_token(tag, F.col("last_record")).alias("token"),
    )


@query(
    "scalar_math",
    """
SELECT foid, abs(lon) AS abs_lon, CAST(floor(u_bat_mv / 7e0) AS bigint) AS floored,
  round_even(acc_x * 25e0, 0) AS rounded, round_even(acc_x * 25e0 * 10e0, 0) / 10e0 AS rounded1,
  acc_y * acc_y AS squared, sqrt(abs(acc_z)) AS rooted,
  CASE WHEN depth_m IS NULL OR depth_m < 1e0 THEN 0 ELSE 1 END AS under,
  datatype IN ('GPS', 'GPSD') AS located, TRY_CAST(datatype AS double) AS as_number
FROM {tag_records}""",
)
def scalar_math(t: Tables) -> DataFrame:
    return t.tag_records.select(
        "foid",
        F.abs("lon").alias("abs_lon"),
        F.floor(F.col("u_bat_mv") / 7.0).alias("floored"),
        maths.half_even(F.col("acc_x") * 25.0, 0).alias("rounded"),
        maths.half_even(F.col("acc_x") * 25.0, 1).alias("rounded1"),
        (F.col("acc_y") * F.col("acc_y")).alias("squared"),
        F.sqrt(F.abs("acc_z")).alias("rooted"),
        F.when(F.col("depth_m").isNull() | (F.col("depth_m") < 1), 0).otherwise(1).alias("under"),
        F.col("datatype").isin("GPS", "GPSD").alias("located"),
        F.col("datatype").try_cast("double").alias("as_number"),
    )


STATUS_COLUMNS = """
  min(datetime) AS min_dt, max(datetime) AS max_dt, max(depth_m) AS max_depth,
  round_even(round(avg(depth_m), 8) * 100e0, 0) / 100e0 AS u_depth,
  count(DISTINCT lat) + max(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) AS n_gps,
  round_even(round(avg(u_bat_mv), 8), 0) AS u_bat,
  round_even(round(avg(ext_temperature_c), 8) * 100e0, 0) / 100e0 AS u_temp,
  round_even(round(avg(conductivity_ms_cm), 8) * 100e0, 0) / 100e0 AS u_cond,
  round_even(round((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 1e6, 8) * 100e0, 0) / 100e0
    AS dur_s,
  round_even(round((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 1e6 / 3600e0, 8) * 100e0, 0)
    / 100e0 AS dur_hr"""

LATEST = """
latest AS (SELECT tag_id, project_id, bird_id, dep_no FROM (
  SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY dep_no DESC) AS rn
  FROM {deployments}) WHERE rn = 1)"""


@query(
    "tag_status_24h",
    "WITH "
    + LATEST
    + """,
recent AS (SELECT * FROM (
  SELECT r.*, l.project_id,
    row_number() OVER (PARTITION BY r.tag_id, r.datetime ORDER BY r.foid) AS rn
  FROM {tag_records} r JOIN latest l ON l.tag_id = r.tag_id
  WHERE r.datetime > (SELECT max(datetime) FROM {tag_records}) - INTERVAL 48 HOUR) WHERE rn = 1)
SELECT project_id, tag_id, """
    + STATUS_COLUMNS
    + """,
  nullif(count(*) FILTER (WHERE datatype = 'GPS'), 0) AS "GPS",
  nullif(count(*) FILTER (WHERE datatype = 'GPSD'), 0) AS "GPSD",
  nullif(count(*) FILTER (WHERE datatype = 'SEN_ACC_5Hz'), 0) AS "SEN_ACC_5Hz",
  nullif(count(*) FILTER (WHERE datatype = 'SEN_TDR'), 0) AS "SEN_TDR"
FROM recent GROUP BY project_id, tag_id""",
)
def tag_status_24h(t: Tables) -> DataFrame:
    return status.daily_status(t.tag_records, t.deployments, TYPES)


@query(
    "gps_extent",
    """
SELECT project_id, min(lat) - 0.25e0 AS y_min, max(lat) + 0.25e0 AS y_max,
  min(lon) - 0.25e0 AS x_min, max(lon) + 0.25e0 AS x_max
FROM {tag_records} r JOIN {deployments} d ON d.tag_id = r.tag_id
  AND r.datetime > d.dep_start AND (d.dep_end IS NULL OR r.datetime < d.dep_end)
WHERE lat <> 0 AND lon <> 0 AND lon < 180
GROUP BY project_id""",
)
def gps_extent(t: Tables) -> DataFrame:
    fixes = clean.usable_fixes(t.tag_records)
    return summary.extent(deployments.assign_deployment(fixes, t.deployments))


@query(
    "positions_of_week",
    """
SELECT tag_id, count(*) AS n_rows, count(DISTINCT lat) AS n_lat, true AS near FROM {tag_records}
WHERE CAST(datetime AS date) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY tag_id""",
)
def positions_of_week(t: Tables) -> DataFrame:
    """Distinct latitudes of a week exactly, and whether the merged daily sketches come within four standard errors and one."""
    first, last = (F.lit(d).cast("date") for d in ("2024-01-08", "2024-01-14"))
    sketches = summary.daily_position_sketches(t.tag_records, ["tag_id"])
    about = summary.positions_of_days(sketches, first, last, ["tag_id"])
    week = t.tag_records.filter(F.to_date("datetime").between(first, last))
    exact = week.groupBy("tag_id").agg(F.countDistinct("lat").alias("n_lat"))
    error = 4 * 1.04 / 2 ** (summary.SKETCH_BITS / 2)
    near = F.abs(F.col("n_lat_about") - F.col("n_lat")) <= F.col("n_lat") * error + 1
    return about.join(exact, "tag_id").select("tag_id", "n_rows", "n_lat", near.alias("near"))
