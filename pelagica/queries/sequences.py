"""Queries on ordered series: gaps, runs, dives, drift, speed, nearest fix.

The test events lie hours apart, so the thresholds are hours where a logger's
are seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, deployments, drift, match, segments, sensors, speed
from ..plans import dives, one_study, status, studies, tracks
from ..session import scratch_path
from ..sources import timelines
from .files import file_tag, write_tag_files
from .records import LATEST, STATUS_COLUMNS, TYPES
from .registry import CHECKS, Tables, query

DIVE = {"depth_cutoff": 20, "dive_depth": 60, "max_gap_s": 172_800, "min_points": 2}
CHUNK = {"dive_depth": 60, "max_gap_s": 172_800, "min_points": 2}
DRIFT = {"max_step_s": 43_200, "min_steps": 3}


def seconds(earlier: str, later: str) -> str:
    """SQL for the seconds between two times."""
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6)"


def chunk_ctes(source: str) -> str:
    """CTEs that number the chunks of ``source``: ``d1``."""
    return f"""
d0 AS (SELECT foid, tag_id, datetime, depth_m, depth_m >= 20e0 AS sub,
    CASE WHEN {seconds("lag(datetime) OVER w", "datetime")} > 172800 THEN 1 ELSE 0 END AS gap
  FROM {source} WHERE depth_m IS NOT NULL
  WINDOW w AS (PARTITION BY tag_id ORDER BY datetime, foid)),
d1 AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY tag_id ORDER BY datetime, foid
    ROWS UNBOUNDED PRECEDING) AS bigint) AS chunk FROM d0)"""


def dive_ctes(source: str) -> str:
    """CTEs that label the depth rows of ``source``: ``dives``."""
    return (
        chunk_ctes(source)
        + """,
d2 AS (SELECT *, count(*) OVER (PARTITION BY tag_id, chunk) AS n,
    max(depth_m) OVER (PARTITION BY tag_id, chunk) AS deepest,
    row_number() OVER (PARTITION BY tag_id, chunk ORDER BY datetime, foid) AS i FROM d1),
d3 AS (SELECT *, i - row_number() OVER (PARTITION BY tag_id, chunk, sub ORDER BY i) AS island
  FROM d2),
bouts AS (SELECT tag_id, chunk, island, n, min(i) AS s, max(i) AS e FROM d3
  WHERE sub AND deepest >= 60 AND n >= 2 GROUP BY tag_id, chunk, island, n),
kept AS (SELECT *, row_number() OVER (PARTITION BY tag_id, chunk ORDER BY s) AS number
  FROM bouts WHERE least(e + 1, n) - greatest(s - 1, 1) > 2),
own AS (SELECT d3.*, k.number FROM d3 LEFT JOIN kept k ON k.tag_id = d3.tag_id
  AND k.chunk = d3.chunk AND d3.sub AND d3.i BETWEEN k.s AND k.e),
dives AS (SELECT tag_id, datetime, foid, depth_m, chunk,
    CASE WHEN deepest >= 60 AND n >= 2 THEN chunk END AS dive_chunk,
    CASE WHEN sub THEN number ELSE coalesce(
      lead(number) OVER (PARTITION BY tag_id, chunk ORDER BY i),
      lag(number) OVER (PARTITION BY tag_id, chunk ORDER BY i)) END AS dive_no
  FROM own)"""
    )


def drift_ctes(source: str) -> str:
    """CTEs that find the bursts of ``source``: ``spans``."""
    return f"""
g0 AS (SELECT tag_id, datetime, foid, lead(datetime) OVER w AS nxt,
    coalesce({seconds("datetime", "lead(datetime) OVER w")} <= 43200, false) AS quick,
    row_number() OVER w AS i
  FROM {source} WHERE lat IS NOT NULL
  WINDOW w AS (PARTITION BY tag_id ORDER BY datetime, foid)),
g1 AS (SELECT *, i - row_number() OVER (PARTITION BY tag_id, quick ORDER BY i) AS island FROM g0),
spans AS (SELECT tag_id, min(datetime) AS s, max(nxt) AS e FROM g1 WHERE quick
  GROUP BY tag_id, island HAVING count(*) >= 3)"""


def drift_flag(row: str) -> str:
    """SQL for the drift flag of a row."""
    return f"""CASE WHEN EXISTS (SELECT 1 FROM spans WHERE spans.tag_id = {row}.tag_id
  AND {row}.datetime BETWEEN spans.s AND spans.e) THEN 1 ELSE 0 END"""


DAILY = """daily AS (SELECT tag_id, CAST(datetime AS date) AS date,
    count(DISTINCT dive_chunk) AS n, min(datetime) AS min_dt, max(datetime) AS max_dt,
    max(depth_m) AS max_depth,
    round_even(round(avg(depth_m), 8) * 100e0, 0) / 100e0 AS u_depth
  FROM dives GROUP BY 1, 2)"""
SUMMARY = f"""dive_sum AS (SELECT tag_id, dive_chunk, min(datetime) AS min_dt,
    max(datetime) AS max_dt, max(depth_m) AS max_depth,
    round_even(round(avg(depth_m), 8) * 100e0, 0) / 100e0 AS u_depth,
    {seconds("min(datetime)", "max(datetime)")} AS dur_s, CAST(min(datetime) AS date) AS date
  FROM dives WHERE dive_chunk IS NOT NULL GROUP BY tag_id, dive_chunk)"""


def _dives(t: Tables) -> DataFrame:
    return segments.dive_segments(clean.depth_rows(t.tag_records), **DIVE, slice_s=t.slice_s)


@query(
    "time_delta",
    f"""
SELECT foid, tag_id, datetime, {seconds("lag(datetime) OVER w", "datetime")} AS tdiff_sec,
  abs({seconds("datetime", "lead(datetime) OVER w")}) AS next_sec
FROM {{tag_records}} WHERE depth_m IS NOT NULL
WINDOW w AS (PARTITION BY tag_id ORDER BY datetime, foid)""",
)
def time_delta(t: Tables) -> DataFrame:
    rows = clean.depth_rows(t.tag_records).select("foid", "tag_id", "datetime")
    return segments.time_delta(rows, slice_s=t.slice_s)


@query(
    "run_lengths",
    """
WITH a AS (SELECT tag_id, datetime, foid, coalesce(depth_m >= 20e0, false) AS value,
    row_number() OVER (PARTITION BY tag_id ORDER BY datetime, foid) AS i FROM {tag_records}),
b AS (SELECT *, i - row_number() OVER (PARTITION BY tag_id, value ORDER BY i) AS island FROM a),
c AS (SELECT tag_id, value, island, count(*) AS length, min(datetime) AS run_start,
    arg_min(foid, i) AS start_foid, max(datetime) AS run_end, arg_max(foid, i) AS end_foid,
    min(i) AS s FROM b GROUP BY 1, 2, 3)
SELECT tag_id, row_number() OVER (PARTITION BY tag_id ORDER BY s) AS run, value, length,
  run_start, start_foid, run_end, end_foid FROM c""",
)
def run_lengths(t: Tables) -> DataFrame:
    return segments.run_lengths(t.tag_records, F.col("depth_m") >= 20, slice_s=t.slice_s)


@query(
    "dive_chunks",
    "WITH "
    + chunk_ctes("{tag_records}")
    + """
SELECT tag_id, chunk, count(*) AS n, max(depth_m) AS max_depth, min(foid) AS min_foid,
  max(foid) AS max_foid, min(datetime) AS min_dt, max(datetime) AS max_dt,
  arg_min(depth_m, datetime) AS first_depth, arg_max(depth_m, datetime) AS last_depth
FROM d1 GROUP BY tag_id, chunk HAVING max(depth_m) >= 60 AND count(*) >= 2""",
)
def dive_chunks(t: Tables) -> DataFrame:
    return segments.dive_chunks(clean.depth_rows(t.tag_records), **CHUNK, slice_s=t.slice_s)


@query("dive_segments", "WITH " + dive_ctes("{tag_records}") + "\nSELECT * FROM dives")
def dive_segments(t: Tables) -> DataFrame:
    return _dives(t)


@query("stored_timeline_dives", "WITH " + dive_ctes("{tag_records}") + "\nSELECT * FROM dives")
def stored_timeline_dives(t: Tables) -> DataFrame:
    """Dives of records that were stored by tag and slice, read back without a shuffle of rows."""
    path = scratch_path(t.spark, "timeline")
    records = clean.depth_rows(t.tag_records).select("tag_id", "datetime", "foid", "depth_m")
    timelines.write_timeline(records, path, int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.slice_s)
    return segments.dive_segments(timelines.read_timeline(t.spark, path), **DIVE)


@query(
    "dive_summary",
    "WITH " + dive_ctes("{tag_records}") + ",\n" + SUMMARY + "\nSELECT * FROM dive_sum",
)
def dive_summary(t: Tables) -> DataFrame:
    return segments.dive_summary(_dives(t))


@query(
    "daily_dives",
    "WITH "
    + dive_ctes("{tag_records}")
    + ",\n"
    + DAILY
    + """,
more AS (SELECT tag_id, CAST(datetime AS date) AS date, count(DISTINCT dive_chunk)
    + max(CASE WHEN dive_chunk IS NULL THEN 1 ELSE 0 END) AS n_with_null
  FROM dives GROUP BY 1, 2)
SELECT daily.*, more.n_with_null FROM daily JOIN more USING (tag_id, date)""",
)
def daily_dives(t: Tables) -> DataFrame:
    return segments.daily_dives(_dives(t), both=True)


@query(
    "mean_daily_dives",
    "WITH "
    + dive_ctes("{tag_records}")
    + ",\n"
    + DAILY
    + """
SELECT tag_id, CAST(floor(sum(n) / count(*)) AS bigint) AS udives_day FROM daily GROUP BY tag_id""",
)
def mean_daily_dives(t: Tables) -> DataFrame:
    return segments.mean_daily_dives(segments.daily_dives(_dives(t)))


@query(
    "surface_intervals",
    "WITH "
    + dive_ctes("{tag_records}")
    + f""",
spells AS (SELECT tag_id, dive_chunk, dive_no, min(datetime) AS dive_start,
    max(datetime) AS dive_end FROM dives WHERE dive_no IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, lead(dive_start) OVER w AS next_start,
  {seconds("dive_end", "lead(dive_start) OVER w")} AS surface_s
FROM spells WINDOW w AS (PARTITION BY tag_id ORDER BY dive_start, dive_chunk, dive_no)""",
)
def surface_intervals(t: Tables) -> DataFrame:
    return segments.surface_intervals(_dives(t), slice_s=t.slice_s)


@query(
    "surface_drift",
    "WITH "
    + drift_ctes("{tag_records}")
    + "\nSELECT foid, tag_id, datetime, lat, "
    + drift_flag("r")
    + " AS gps_surfacedrifts FROM {tag_records} r",
)
def surface_drift(t: Tables) -> DataFrame:
    rows = t.tag_records.select("foid", "tag_id", "datetime", "lat")
    return drift.flag_surface_drift(rows, **DRIFT, slice_s=t.slice_s)


WEEK = (
    "WITH "
    + LATEST
    + ",\n"
    + drift_ctes("{tag_records}")
    + """,
recent AS (SELECT * FROM (
  SELECT r.*, l.project_id, """
    + drift_flag("r")
    + """ AS gps_surfacedrifts,
    row_number() OVER (PARTITION BY r.tag_id, r.datetime ORDER BY r.foid) AS rn
  FROM {tag_records} r JOIN latest l ON l.tag_id = r.tag_id
  WHERE r.datetime > (SELECT max(datetime) FROM {tag_records}) - INTERVAL 168 HOUR) WHERE rn = 1),
"""
    + dive_ctes("recent")
    + ",\n"
    + DAILY
    + """,
rate AS (SELECT tag_id, CAST(floor(sum(n) / count(*)) AS bigint) AS udives_day
  FROM daily GROUP BY tag_id),
report AS (SELECT project_id, tag_id, """
    + STATUS_COLUMNS
    + """,
  CAST(sum(gps_surfacedrifts) AS bigint) AS gps_surfacedrift_pts,
  nullif(count(*) FILTER (WHERE datatype = 'GPS'), 0) AS "GPS",
  nullif(count(*) FILTER (WHERE datatype = 'GPSD'), 0) AS "GPSD",
  nullif(count(*) FILTER (WHERE datatype = 'SEN_ACC_5Hz'), 0) AS "SEN_ACC_5Hz",
  nullif(count(*) FILTER (WHERE datatype = 'SEN_TDR'), 0) AS "SEN_TDR"
FROM recent GROUP BY project_id, tag_id)
SELECT report.*, rate.udives_day, CAST(tag_id AS string) AS device_id,
  coalesce(strftime(d.dep_end, '%Y%m%d'), 'open') AS deploy_end_short
FROM report LEFT JOIN rate USING (tag_id) JOIN latest USING (tag_id) JOIN {deployments} d USING (tag_id, dep_no)"""
)


@query("tag_status_week", WEEK)
def tag_status_week(t: Tables) -> DataFrame:
    """Records sent twice, in overlapping files, by a third of the tags."""
    own = t.tag_records.withColumns({"device_id": F.col("tag_id").cast("string"), "file_name": F.lit("a")})
    again = own.filter("tag_id % 3 = 0").withColumns({"file_name": F.lit("b"), "foid": F.col("foid") + 10_000_000_000})
    ends = t.deployments.withColumn("deploy_end_short", F.coalesce(F.date_format("dep_end", "yyyyMMdd"), F.lit("open")))
    return status.weekly_status(
        own.unionByName(again),
        ends,
        TYPES,
        drift_step_s=DRIFT["max_step_s"],
        drift_steps=DRIFT["min_steps"],
        **DIVE,
        slice_s=t.slice_s,
    )


@query("tag_status_week_of_files", f"SELECT * REPLACE (CAST(tag_id AS string) AS tag_id) FROM ({WEEK})")
def tag_status_week_of_files(t: Tables) -> DataFrame:
    """The same report from a folder of logger files, one a tag."""
    last = t.tag_records.agg(F.max("datetime")).first()[0]
    ends = t.deployments.withColumn("deploy_end_short", F.coalesce(F.date_format("dep_end", "yyyyMMdd"), F.lit("open")))
    return status.weekly_status_of_files(
        t.spark,
        write_tag_files(t),
        ends.withColumn("tag_id", F.col("tag_id").cast("string")),
        TYPES,
        last,
        min_bytes=0,
        name_column=file_tag(),
        drift_step_s=DRIFT["max_step_s"],
        drift_steps=DRIFT["min_steps"],
        **DIVE,
        slice_s=t.slice_s,
    )


# Cleaned records with drift, dives and deployment.
STUDY = (
    """used AS (SELECT * FROM {tag_records} WHERE (lat IS NOT NULL OR depth_m IS NOT NULL)
  AND NOT (coalesce(lat = 0 AND lon = 0, false) AND depth_m IS NULL)),
"""
    + drift_ctes("used")
    + ",\n"
    + dive_ctes("used")
    + """,
known AS (SELECT r.*, a.project_id, a.bird_id, v.dive_chunk, """
    + drift_flag("r")
    + """ AS gps_surfacedrifts
  FROM used r
  JOIN (SELECT q.foid, d.project_id, d.bird_id FROM used q
        ASOF JOIN {deployments} d ON q.tag_id = d.tag_id AND q.datetime > d.dep_start) a
    ON a.foid = r.foid
  LEFT JOIN dives v ON v.foid = r.foid)"""
)


def _annotated(t: Tables) -> DataFrame:
    return studies.annotate_records(
        t.tag_records,
        t.deployments,
        drift_step_s=DRIFT["max_step_s"],
        drift_steps=DRIFT["min_steps"],
        **DIVE,
        slice_s=t.slice_s,
    )


@query(
    "deployment_summary",
    "WITH "
    + STUDY
    + """
SELECT report.*, rate.udives_day FROM (
SELECT project_id, tag_id, bird_id, """
    + STATUS_COLUMNS
    + """,
  CAST(sum(gps_surfacedrifts) AS bigint) AS gps_surfacedrift_pts,
  count(DISTINCT dive_chunk) AS n_depth
FROM known GROUP BY project_id, tag_id, bird_id) report
LEFT JOIN (SELECT tag_id, CAST(floor(sum(n) / count(*)) AS bigint) AS udives_day
  FROM (SELECT tag_id, CAST(datetime AS date) AS date, count(DISTINCT dive_chunk) AS n
    FROM known WHERE depth_m IS NOT NULL GROUP BY 1, 2) GROUP BY 1) rate USING (tag_id)""",
)
def deployment_summary(t: Tables) -> DataFrame:
    return studies.report_deployments(
        t.tag_records,
        t.deployments,
        drift_step_s=DRIFT["max_step_s"],
        drift_steps=DRIFT["min_steps"],
        **DIVE,
        slice_s=t.slice_s,
    )


@query(
    "project_dive_chunks",
    "WITH "
    + STUDY
    + "\nSELECT project_id, tag_id, count(DISTINCT dive_chunk) AS n_depth FROM known GROUP BY 1, 2",
)
def project_dive_chunks(t: Tables) -> DataFrame:
    return studies.chunks_by_project(_annotated(t))


@query(
    "nearest_fix_same_day",
    "WITH "
    + dive_ctes("{tag_records}")
    + ",\n"
    + SUMMARY
    + f""",
pairs AS (SELECT s.*, r.lat, r.lon, r.datatype AS gps_datatype, r.foid AS gps_oid,
    r.datetime AS gps_time, {seconds("s.max_dt", "r.datetime")} AS gps_tdiff,
    row_number() OVER (PARTITION BY s.tag_id, s.dive_chunk
      ORDER BY abs({seconds("s.max_dt", "r.datetime")}), r.datetime, r.foid) AS rn
  FROM dive_sum s LEFT JOIN {{tag_records}} r ON r.tag_id = s.tag_id
    AND CAST(r.datetime AS date) = s.date AND r.lat <> 0 AND r.lon <> 0 AND r.lon < 180)
SELECT * EXCLUDE (rn) FROM pairs WHERE rn = 1""",
)
def nearest_fix_same_day(t: Tables) -> DataFrame:
    fixes = clean.usable_fixes(t.tag_records)
    return match.nearest_fix_same_day(
        segments.dive_summary(_dives(t)), fixes, slice_s=t.slice_s
    )


# Great-circle distance and RMS speed, with the same formula on both sides.
SPEED_MACROS = "6371000e0"


def distance(a: str, b: str) -> str:
    """SQL for the haversine distance between two ``lat``/``lon`` pairs."""
    dlat, dlon = f"(radians({b}lat - {a}lat) / 2e0)", f"(radians({b}lon - {a}lon) / 2e0)"
    h = (
        f"(sin({dlat}) * sin({dlat}) + cos(radians({a}lat)) * cos(radians({b}lat))"
        f" * sin({dlon}) * sin({dlon}))"
    )
    return f"(2e0 * {SPEED_MACROS} * asin(least(1e0, sqrt{h})))"


def squared_speed(k: int) -> str:
    """SQL for the squared speed to the row ``k`` places away."""
    where = f"lead({{c}}, {k}) OVER w" if k > 0 else f"lag({{c}}, {-k}) OVER w"
    lat, lon, at = (f"({where.format(c=c)})" for c in ("lat", "lon", "datetime"))
    dlat, dlon = f"(radians({lat} - lat) / 2e0)", f"(radians({lon} - lon) / 2e0)"
    h = (
        f"(sin({dlat}) * sin({dlat}) + cos(radians(lat)) * cos(radians({lat}))"
        f" * sin({dlon}) * sin({dlon}))"
    )
    metres = f"(2e0 * {SPEED_MACROS} * asin(least(1e0, sqrt{h})))"
    return f"pow({metres} / nullif(abs({seconds('datetime', at)}), 0e0), 2)"


RMS = "sqrt((" + " + ".join(squared_speed(k) for k in (-1, 1, -2, 2)) + ") / 4e0)"

TRACKS = """tracks AS (SELECT r.foid, r.datetime, r.lat, r.lon, r.tag_id,
    d.project_id || '_' || d.bird_id AS uni_id
  FROM {tag_records} r JOIN {deployments} d ON r.tag_id = d.tag_id AND r.datetime > d.dep_start
    AND (d.dep_end IS NULL OR r.datetime < d.dep_end)
  WHERE lat <> 0 AND lon <> 0 AND lon < 180)"""


def _tracks(t: Tables) -> DataFrame:
    fixes = clean.usable_fixes(t.tag_records).select("foid", "tag_id", "datetime", "lat", "lon")
    known = deployments.assign_deployment(fixes, t.deployments, ("project_id", "bird_id"))
    return clean.keep_first(known, ("uni_id", "datetime")).drop("project_id", "bird_id")


@query(
    "rms_speed",
    "WITH "
    + TRACKS
    + f"""
SELECT foid, uni_id, datetime, round({RMS}, 6) AS rms_speed FROM tracks
WINDOW w AS (PARTITION BY uni_id ORDER BY datetime, foid)""",
)
def rms_speed(t: Tables) -> DataFrame:
    rated = speed.rms_speed(_tracks(t), slice_s=t.slice_s)
    return rated.select(
        "foid", "uni_id", "datetime", F.round("rms_speed", 6).alias("rms_speed")
    )


# One step takes the peak out of every run above 25 m/s; a track that has no
# such run leaves the recursion, and its last state is the result.
STEPS = f"""steps AS (
  SELECT 0 AS step, foid, uni_id, datetime, lat, lon FROM tracks
  UNION ALL
  SELECT step + 1, foid, uni_id, datetime, lat, lon FROM (
    SELECT *, max(CASE WHEN is_peak THEN 1 ELSE 0 END) OVER (PARTITION BY uni_id) AS changes FROM (
      SELECT *, over_limit AND row_number() OVER (PARTITION BY uni_id, over_limit, run
          ORDER BY v DESC, datetime, foid) = 1 AS is_peak FROM (
        SELECT *, i - row_number() OVER (PARTITION BY uni_id, over_limit ORDER BY i) AS run FROM (
          SELECT *, coalesce(v > 25e0, false) AS over_limit FROM (
            SELECT step, foid, uni_id, datetime, lat, lon, {RMS} AS v, row_number() OVER w AS i
            FROM steps WINDOW w AS (PARTITION BY uni_id ORDER BY datetime, foid))))))
  WHERE changes = 1 AND NOT is_peak)"""


@query(
    "speed_filter",
    "WITH RECURSIVE "
    + TRACKS
    + ",\n"
    + STEPS
    + """
SELECT s.foid, s.uni_id, s.datetime, s.lat, s.lon FROM steps s
JOIN (SELECT uni_id, max(step) AS last FROM steps GROUP BY uni_id) e
  ON e.uni_id = s.uni_id AND e.last = s.step""",
)
def speed_filter(t: Tables) -> DataFrame:
    kept = speed.speed_filter(_tracks(t), slice_s=t.slice_s)
    return kept.select("foid", "uni_id", "datetime", "lat", "lon")


@query(
    "sensor_long",
    "WITH "
    + drift_ctes("{tag_records}")
    + ",\n"
    + dive_ctes("{tag_records}")
    + ",\n"
    + DAILY
    + """
SELECT tag_id, datetime, foid, 'depth' AS series, -depth_m AS y FROM {tag_records}
WHERE depth_m <> 0
UNION ALL SELECT tag_id, datetime, foid, 'lat', abs(lat) FROM {tag_records} WHERE lat IS NOT NULL
UNION ALL SELECT tag_id, datetime, foid, 'temperature', ext_temperature_c FROM {tag_records}
  WHERE ext_temperature_c < 100 AND ext_temperature_c > 0
UNION ALL SELECT tag_id, datetime, foid, 'conductivity', conductivity_ms_cm FROM {tag_records}
  WHERE conductivity_ms_cm IS NOT NULL
UNION ALL SELECT tag_id, datetime, foid, 'battery', bat_soc_pct FROM {tag_records}
  WHERE lat IS NOT NULL
UNION ALL SELECT tag_id, datetime, foid, 'solar', solar_i_ma + 101e0 FROM {tag_records}
  WHERE lat IS NOT NULL
UNION ALL SELECT tag_id, datetime, foid, 'vector_sum',
  sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) * 0.1e0 FROM {tag_records} WHERE lat IS NOT NULL
UNION ALL SELECT r.tag_id, r.datetime, r.foid, 'drift', abs(r.lat) + 5e0 FROM {tag_records} r
  WHERE r.lat IS NOT NULL AND """
    + drift_flag("r")
    + """ = 1
UNION ALL SELECT tag_id, CAST(date AS timestamp) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE, NULL,
  'daily_dives', CAST(n AS double) FROM daily""",
)
def sensor_long(t: Tables) -> DataFrame:
    records = drift.flag_surface_drift(t.tag_records, **DRIFT, slice_s=t.slice_s)
    daily = sensors.daily_series(segments.daily_dives(_dives(t)))
    return clean.union_by_name([sensors.sensor_long(records), daily])


@query(
    "track_assembly",
    CHECKS["speed_filter"].replace(
        "SELECT s.foid, s.uni_id, s.datetime, s.lat, s.lon FROM steps s",
        "SELECT split_part(s.uni_id, '_', 1) AS project_id, min(s.lat) - 0.25e0 AS y_min, "
        "max(s.lat) + 0.25e0 AS y_max, min(s.lon) - 0.25e0 AS x_min, max(s.lon) + 0.25e0 AS x_max, "
        "count(*) AS n_rows, count(DISTINCT s.uni_id) AS n_birds FROM steps s",
    )
    + " GROUP BY 1",
)
def track_assembly(t: Tables) -> DataFrame:
    """All fixes to speed-filtered tracks, with extent and animals per project."""
    return tracks.project_extents(
        tracks.assemble_tracks(t.tag_records, t.deployments, slice_s=t.slice_s)
    )


TRIMMED = """trimmed AS (SELECT * FROM {tag_records} r WHERE datatype <> 'SEN_ACC_5Hz' AND EXISTS (
SELECT 1 FROM {deployments} d WHERE r.tag_id = d.tag_id AND r.datetime > d.dep_start
 AND (d.dep_end IS NULL OR r.datetime < d.dep_end)))"""


@query(
    "dive_gps_match",
    "WITH "
    + TRIMMED
    + ","
    + dive_ctes("trimmed")
    + ",\n"
    + SUMMARY
    + f""",
pairs AS (SELECT s.*, r.lat, r.lon, r.datatype AS gps_datatype, r.foid AS gps_oid,
    r.datetime AS gps_time, {seconds("s.max_dt", "r.datetime")} AS gps_tdiff,
    row_number() OVER (PARTITION BY s.tag_id, s.dive_chunk
      ORDER BY abs({seconds("s.max_dt", "r.datetime")}), r.datetime, r.foid) AS rn
  FROM dive_sum s LEFT JOIN trimmed r ON r.tag_id = s.tag_id
    AND CAST(r.datetime AS date) = s.date AND r.lat <> 0 AND r.lon <> 0 AND r.lon < 180)
SELECT * EXCLUDE (rn) FROM pairs WHERE rn = 1""",
)
def dive_gps_match(t: Tables) -> DataFrame:
    """One study: trim, leave out surface accelerometry, find dives, place them."""
    return dives.place_dives(t.tag_records, t.deployments, **DIVE, slice_s=t.slice_s)


STUDY_RECORDS = (
    "WITH RECURSIVE "
    + TRIMMED
    + ","
    + drift_ctes("trimmed")
    + """,
tracks AS (SELECT foid, datetime, lat, lon, tag_id AS uni_id FROM trimmed
  WHERE lat <> 0 AND lon <> 0 AND lon < 180),
"""
    + STEPS
    + """,
kept AS (SELECT s.foid FROM steps s JOIN (SELECT uni_id, max(step) AS last FROM steps GROUP BY uni_id) e
  ON e.uni_id = s.uni_id AND e.last = s.step),
rated AS (SELECT foid, CASE WHEN foid NOT IN (SELECT foid FROM kept) THEN 'removed'
    WHEN least(row_number() OVER (PARTITION BY uni_id ORDER BY datetime, foid),
      row_number() OVER (PARTITION BY uni_id ORDER BY datetime DESC, foid DESC)) <= 2 THEN 'end_location'
    ELSE 'not' END AS mfilter FROM tracks),
study AS (SELECT r.*, rated.mfilter, """
    + drift_flag("r")
    + """ AS gps_surfacedrifts FROM trimmed r LEFT JOIN rated ON rated.foid = r.foid)"""
)


def _study(t: Tables) -> DataFrame:
    return one_study.study_records(
        t.tag_records,
        t.deployments,
        drift_step_s=DRIFT["max_step_s"],
        drift_steps=DRIFT["min_steps"],
        slice_s=t.slice_s,
    )


@query("study_records", STUDY_RECORDS + "\nSELECT * FROM study")
def study_records(t: Tables) -> DataFrame:
    """One study's records with drift flags and speed labels."""
    return _study(t)


@query(
    "study_summary",
    STUDY_RECORDS
    + "\nSELECT tag_id, "
    + STATUS_COLUMNS
    + ", CAST(sum(gps_surfacedrifts) AS bigint) AS gps_surfacedrift_pts FROM study GROUP BY tag_id",
)
def study_summary(t: Tables) -> DataFrame:
    """Whole-deployment summary of every tag of one study."""
    return one_study.study_summary(_study(t))


@query(
    "study_track_speeds",
    STUDY_RECORDS
    + "\nSELECT tag_id, mfilter, count(*) AS n_fixes FROM study WHERE mfilter IS NOT NULL GROUP BY 1, 2",
)
def study_track_speeds(t: Tables) -> DataFrame:
    """Fixes of every tag of one study by speed label."""
    return one_study.track_speeds(_study(t))


@query(
    "study_daily_dives",
    "WITH "
    + TRIMMED
    + ","
    + dive_ctes("trimmed")
    + ",\n"
    + DAILY.replace(
        "count(DISTINCT dive_chunk) AS n", "count(DISTINCT dive_chunk) + max(CASE WHEN dive_chunk IS NULL THEN 1 ELSE 0 END) AS n"
    )
    + "\nSELECT * FROM daily",
)
def study_daily_dives(t: Tables) -> DataFrame:
    """Daily dives of one study, rows outside any dive counted as one more."""
    return one_study.study_days(_study(t), **DIVE, slice_s=t.slice_s)
