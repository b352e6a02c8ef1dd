"""Logger-shaped views of the star-schema test tables.

The SQL is valid in Spark and in DuckDB alike, so a query and its check read
the same input.  ``{name}`` stands for a table or for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    # Mixed record stream of all tags.
    "tag_records": """
SELECT event_id AS foid, user_id AS tag_id, CAST(ts AS timestamp) AS datetime,
  CASE event_type WHEN 'click' THEN 'GPS' WHEN 'view' THEN 'GPS' WHEN 'signup' THEN 'GPSD'
       WHEN 'error' THEN 'SEN_TDR' ELSE 'SEN_ACC_5Hz' END AS datatype,
  CASE WHEN event_type IN ('click','view','signup') THEN
    CASE WHEN event_id % 97 = 0 THEN 0e0
         ELSE 40e0 + CAST((event_id*37) % 1000 AS double)/1000e0
              + CASE WHEN event_id % 89 = 0 THEN 8e0 ELSE 0e0 END END END AS lat,
  CASE WHEN event_type IN ('click','view','signup') THEN
    CASE WHEN event_id % 97 = 0 THEN 0e0
         ELSE -125e0 + CAST((event_id*53) % 1000 AS double)/1000e0 END END AS lon,
  CASE WHEN event_type IN ('error','purchase') THEN value END AS depth_m,
  value AS ext_temperature_c,
  3500e0 + CAST(event_id % 700 AS double) AS u_bat_mv,
  CAST(event_id % 101 AS double) AS bat_soc_pct,
  CAST(event_id % 43 AS double)/4e0 AS solar_i_ma,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 60 AS double) END AS conductivity_ms_cm,
  CAST(event_id % 21 - 10 AS double)/10e0 AS acc_x,
  CAST(event_id % 13 - 6 AS double)/10e0 AS acc_y,
  CAST(event_id % 17 - 8 AS double)/10e0 AS acc_z
FROM {events}""",
    # Field table of deployments: one to three per tag, the last often open.
    "deployments": """
SELECT tag_id, dep_no,
  'B' || CAST(tag_id AS string) || '_' || CAST(dep_no AS string) AS bird_id,
  'P' || CAST((region_no + CASE WHEN dep_no = 1 THEN 0 ELSE 1 END) % 5 AS string) AS project_id,
  dep_start, CASE WHEN dep_no = n_deps AND region_no < 12 THEN NULL ELSE dep_end END AS dep_end,
  region_no - 12 AS utc_offset
FROM (
  SELECT s_suppkey AS tag_id, s_nationkey AS region_no, 1 AS dep_no,
    CASE WHEN s_acctbal >= 6000 THEN 3 WHEN s_acctbal >= 3000 THEN 2 ELSE 1 END AS n_deps,
    timestamp '2024-01-02 00:00:00' AS dep_start, timestamp '2024-01-11 00:00:00' AS dep_end
  FROM {supplier}
  UNION ALL
  SELECT s_suppkey, s_nationkey, 2, CASE WHEN s_acctbal >= 6000 THEN 3 ELSE 2 END,
    timestamp '2024-01-12 00:00:00', timestamp '2024-01-21 00:00:00'
  FROM {supplier} WHERE s_acctbal >= 3000
  UNION ALL
  SELECT s_suppkey, s_nationkey, 3, 3,
    timestamp '2024-01-22 00:00:00', timestamp '2024-01-31 00:00:00'
  FROM {supplier} WHERE s_acctbal >= 6000
) d""",
    # One transmitted file per tag and day.
    "files": """
SELECT CAST(user_id AS string) || '_GPRS_' || replace(CAST(CAST(ts AS date) AS string), '-', '')
    || '.csv' AS file_name,
  user_id AS tag_id, 75 * count(*) + 159 AS size_bytes, max(CAST(ts AS timestamp)) AS last_record
FROM {events} GROUP BY user_id, CAST(ts AS date)""",
    # Files loaded by an earlier run.
    "manifest": """
SELECT file_name FROM {files} WHERE last_record < timestamp '2024-01-16 00:00:00'""",
    # Positions at dives, with the dive table's column names.
    "dive_positions": """
SELECT foid, tag_id AS tag, datetime, lat AS gps_lat_post, lon AS gps_lon_post
FROM {tag_records} WHERE datatype = 'GPSD'""",
    # Raster flattened to cell centres.
    "raster_cells": """
SELECT -125e0 + CAST(p_partkey % 50 AS double)*0.02e0 + 0.01e0 AS x,
  40e0 + floor(CAST(p_partkey AS double)/50e0)*0.025e0 + 0.0125e0 AS y,
  p_size % 30 AS layer
FROM {part}""",
    "raster_lookup": """
SELECT n_nationkey AS tid, n_name AS tid_short, r_name AS measurement
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "legacy_track": """
SELECT 'SP' || CAST(c_nationkey % 5 AS string) || '_' || CAST(c_custkey AS string) AS bird_id,
  CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal/200e0 END AS lat_degree,
  CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal/100e0 END AS long_degree,
  CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal/250e0 END AS obs_depth,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal/300e0 END AS cal_depth
FROM {customer}""",
    "calib_index": """
SELECT s_suppkey AS tag_id, timestamp '2024-01-15 08:00:00' AS cal_start_local,
  timestamp '2024-01-16 20:00:00' AS cal_end_local, s_nationkey - 12 AS utc_offset,
  CASE WHEN s_acctbal < 5000 THEN 'n' ELSE 'y' END AS calprocessed_yn
FROM {supplier}
UNION ALL
SELECT s_suppkey, timestamp '2024-01-20 08:00:00', timestamp '2024-01-21 20:00:00', s_nationkey - 12,
  CASE WHEN s_acctbal < 2500 THEN 'n' ELSE 'y' END
FROM {supplier} WHERE s_acctbal < 4000""",
    # Row ranges picked by hand: the chunk of a calibration, for some one that is too long ...
    "calib_chunks": """
SELECT tag_id, cal_start_local - utc_offset * INTERVAL '1' HOUR AS start_utc, 3 AS beg_pt,
  CASE WHEN tag_id % 9 = 0 THEN 303 ELSE 36 END AS end_pt
FROM {calib_index} WHERE calprocessed_yn = 'n'""",
    # ... and the six positions inside it.
    "calib_segments": """
SELECT tag_id, start_utc, 'X1' AS seg, 1 AS beg, 4 AS fin FROM {calib_chunks}
UNION ALL SELECT tag_id, start_utc, 'X2', 6, 9 FROM {calib_chunks}
UNION ALL SELECT tag_id, start_utc, 'Z1', 11, 14 FROM {calib_chunks}
UNION ALL SELECT tag_id, start_utc, 'Z2', 16, 19 FROM {calib_chunks}
UNION ALL SELECT tag_id, start_utc, 'Y1', 21, 24 FROM {calib_chunks}
UNION ALL SELECT tag_id, start_utc, 'Y2', 26, 29 FROM {calib_chunks}""",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or one of the views above, as a Spark DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _names(text)})


def check_sql(body: str) -> str:
    """Turn ``{name}`` placeholders into a standalone DuckDB statement."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    plain = {name: name for name in [*TABLES, *VIEWS]}
    common = [f"{name} AS ({VIEWS[name].format(**plain)})" for name in needed]
    body = body.format(**plain).strip()
    if not common:
        return body
    head, rest = ("WITH ", ",\n" + body[5:]) if body.startswith("WITH ") else ("WITH ", "\n" + body)
    if body.startswith("WITH RECURSIVE "):
        head, rest = "WITH RECURSIVE ", ",\n" + body[15:]
    return head + ",\n".join(common) + rest
