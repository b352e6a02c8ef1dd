"""Streaming queries: run over all events, result read from the sink.

The sinks hold what the watermark has closed, and the checks state the same
condition on the batch data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import dives, jobs
from . import views
from .files import write_logs
from .records import LATEST
from .registry import Tables, query
from .sequences import DIVE, dive_ctes

LAST = "(SELECT max(datetime) FROM {tag_records})"


def _stream(t: Tables) -> DataFrame:
    """All events as a stream of tag records."""
    schema = views.table(t.spark, t.sf_dir, "events").schema
    events = jobs.stream_files(t.spark, t.sf_dir, schema, glob="events.parquet")
    return t.spark.sql(views.VIEWS["tag_records"], events=events)


def _result(t: Tables, df: DataFrame, name: str) -> DataFrame:
    out = scratch_path(t.spark, name)
    jobs.run_available(df, out, scratch_path(t.spark, f"{name}-checkpoint"))
    return t.spark.read.schema(df.schema).parquet(out)


@query(
    "stream_ingest",
    "SELECT foid, tag_id, datetime, datatype, lat, lon, depth_m FROM {tag_records}",
)
def stream_ingest(t: Tables) -> DataFrame:
    """Started twice on one checkpoint; the second run finds nothing new."""
    records = _stream(t).select("foid", "tag_id", "datetime", "datatype", "lat", "lon", "depth_m")
    out, state = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "ingest-checkpoint")
    jobs.run_available(records, out, state)
    jobs.run_available(records, out, state)
    return t.spark.read.schema(records.schema).parquet(out)


@query(
    "stream_logs",
    "WITH "
    + LATEST
    + """
SELECT CAST(r.tag_id AS string) AS tag_id, r.datetime, r.datatype, r.lat, r.lon, r.depth_m,
  coalesce(l.project_id, 'none') AS project_id
FROM {tag_records} r LEFT JOIN latest l ON l.tag_id = r.tag_id""",
)
def stream_logs(t: Tables) -> DataFrame:
    """Logger files of three layouts, arriving in two lots; a third start finds nothing new."""
    arrived, out, checkpoint, journal = (scratch_path(t.spark, n) for n in ("logs", "ingested", "logs-checkpoint", "logs-journal"))
    folder = F.regexp_extract("file_path", r"/file=([^/]+)/", 1)
    each = jobs.log_batches(
        out,
        min_bytes=0,
        name_column=F.split_part(folder, F.lit("_"), F.lit(1)),
        project=F.regexp_extract("file_path", r"/project=([^/]+)/", 1),
    )
    for part in ("tag_id % 2 = 0", "tag_id % 2 = 1", "false"):
        write_logs(t, arrived, part)
        jobs.run_batches(jobs.stream_log_files(t.spark, arrived, 100_000, journal), each, checkpoint)
    read = t.spark.read.parquet(out)
    return read.select("tag_id", "datetime", "datatype", "lat", "lon", "depth_m", "project_id")


@query(
    "stream_dedupe",
    """
WITH hourly AS (SELECT * REPLACE (date_trunc('hour', datetime) AS datetime) FROM {tag_records})
SELECT foid, tag_id, datetime, datatype, lat, lon, depth_m, u_bat_mv
FROM (SELECT *, row_number() OVER (PARTITION BY tag_id, datetime ORDER BY foid) AS rn FROM hourly)
WHERE rn = 1 AND datetime <= (SELECT max(datetime) FROM hourly) - INTERVAL 2 HOUR""",
)
def stream_dedupe(t: Tables) -> DataFrame:
    """Whole first rows of every tag and hour; the last hours are still open."""
    columns = ("foid", "tag_id", "datatype", "lat", "lon", "depth_m", "u_bat_mv")
    hourly = _stream(t).select(*columns, F.date_trunc("hour", "datetime").alias("datetime"))
    return _result(t, jobs.dedupe(hourly, "2 hours"), "dedupe")


@query(
    "stream_sessions",
    f"""
WITH steps AS (SELECT *, CASE WHEN (epoch_us(datetime) - epoch_us(lag(datetime) OVER w)) / 1e6
    > 43200 THEN 1 ELSE 0 END AS gap FROM {{tag_records}}
  WINDOW w AS (PARTITION BY tag_id ORDER BY datetime, foid)),
numbered AS (SELECT *, sum(gap) OVER (PARTITION BY tag_id ORDER BY datetime, foid
  ROWS UNBOUNDED PRECEDING) AS segment FROM steps)
SELECT tag_id, min(datetime) AS session_start, max(datetime) + INTERVAL 12 HOUR AS session_end,
  count(*) AS n, max(depth_m) AS max_depth
FROM numbered GROUP BY tag_id, segment
HAVING max(datetime) + INTERVAL 12 HOUR <= {LAST} - INTERVAL 1 HOUR""",
)
def stream_sessions(t: Tables) -> DataFrame:
    return _result(t, jobs.sessions(_stream(t), "12 hours", "1 hour"), "sessions")


WINDOW_COLUMNS = """count(*) AS n, min(datetime) AS min_dt, max(datetime) AS max_dt,
  max(depth_m) AS max_depth, round(avg(u_bat_mv), 4) AS u_bat,
  round(avg(ext_temperature_c), 9) AS u_temp, round(avg(conductivity_ms_cm), 9) AS u_cond"""


@query(
    "stream_status",
    f"""
SELECT tag_id, window_start, window_start + INTERVAL 7 DAY AS window_end, {WINDOW_COLUMNS}
FROM (SELECT *, date_trunc('day', datetime) - unnest(range(7)) * INTERVAL 1 DAY AS window_start
  FROM {{tag_records}})
GROUP BY 1, 2 HAVING window_start + INTERVAL 7 DAY <= {LAST} - INTERVAL 1 HOUR""",
)
def stream_status(t: Tables) -> DataFrame:
    status = jobs.trailing_status(_stream(t), "7 days", "1 day", "1 hour")
    return _result(t, status, "status").drop("n_lat_about")  # an estimate, which SQL has no equal of


@query(
    "stream_daily",
    f"""
SELECT tag_id, date_trunc('day', datetime) AS window_start,
  date_trunc('day', datetime) + INTERVAL 1 DAY AS window_end, {WINDOW_COLUMNS}
FROM {{tag_records}} GROUP BY 1, 2
HAVING date_trunc('day', datetime) + INTERVAL 1 DAY <= {LAST} - INTERVAL 1 HOUR""",
)
def stream_daily(t: Tables) -> DataFrame:
    return _result(t, jobs.daily_counts(_stream(t), "1 hour"), "daily").drop("n_lat_about")


@query(
    "stream_dives",
    "WITH "
    + dive_ctes("{tag_records}")
    + """,
ends AS (SELECT *, min(datetime) OVER c AS chunk_start, max(datetime) OVER c AS chunk_end,
  max(datetime) OVER (PARTITION BY tag_id) AS latest
  FROM dives WINDOW c AS (PARTITION BY tag_id, chunk))
SELECT tag_id, datetime, foid, depth_m, chunk_start, dive_chunk IS NOT NULL AS is_dive_chunk, dive_no
FROM ends
WHERE chunk_end < latest - INTERVAL 172800 SECOND""",
)
def stream_dives(t: Tables) -> DataFrame:
    out, state = scratch_path(t.spark, "dives"), scratch_path(t.spark, "dives-state")
    each = dives.dive_batches(out, state, **DIVE, slice_s=t.slice_s)
    arrived, checkpoint = scratch_path(t.spark, "arrived"), scratch_path(t.spark, "dives-checkpoint")
    records = t.tag_records.select(*dives.COLUMNS)
    # Tags send in turns: the early rows of some come long after the late rows of others.
    for tags, times in ((0, "<"), (0, ">="), (1, "<"), (2, "<"), (2, ">="), (1, ">=")):
        sent = records.filter(f"tag_id % 3 = {tags} AND datetime {times} timestamp '2024-01-16'")
        sent.write.mode("append").parquet(arrived)
        jobs.run_batches(jobs.stream_files(t.spark, arrived, records.schema, glob="*.parquet"), each, checkpoint)
    return t.spark.read.parquet(out).drop("batch")
