"""Queries on files, readers and writers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean, deployments, summary
from ..session import scratch_path
from ..functions.time import shift_seconds
from ..sources import commits, inventory, store, tag_logs
from .records import LATEST
from .registry import Tables, query

LAST = "(SELECT max(last_record) FROM {files})"


@query(
    "file_inventory",
    f"""
SELECT file_name, tag_id, size_bytes, last_record FROM {{files}}
WHERE size_bytes > 309 AND last_record > {LAST} - INTERVAL 14 DAY""",
)
def file_inventory(t: Tables) -> DataFrame:
    files = t.files
    as_of = clean.latest_time(files, "last_record")
    return inventory.changed_since(inventory.with_data(files), as_of, 14, "last_record")


@query(
    "files_recent_last_record",
    f"""
SELECT file_name, last_record FROM {{files}} WHERE last_record > {LAST} - INTERVAL 7 DAY""",
)
def files_recent_last_record(t: Tables) -> DataFrame:
    day = F.date_format("datetime", "yyyyMMdd")
    name = F.concat(F.col("tag_id").cast("string"), F.lit("_GPRS_"), day, F.lit(".csv"))
    records = t.tag_records.select("foid", "datetime", name.alias("file_name"))
    return inventory.with_recent_last_record(records, clean.latest_time(records))


@query(
    "new_files",
    """
SELECT file_name, tag_id, size_bytes FROM {files}
WHERE size_bytes > 309 AND file_name NOT IN (SELECT file_name FROM {manifest})""",
)
def new_files(t: Tables) -> DataFrame:
    files = inventory.with_data(t.files).drop("last_record")
    return inventory.new_files(files, t.manifest)


@query(
    "known_files",
    """
SELECT file_name, tag_id, size_bytes FROM {files}
WHERE size_bytes > 309 AND file_name IN (SELECT file_name FROM {manifest})""",
)
def known_files(t: Tables) -> DataFrame:
    files = inventory.with_data(t.files).drop("last_record")
    return inventory.known_files(files, t.manifest)


@query(
    "files_for_project",
    """
SELECT CAST(f.tag_id AS string) AS tag_id, f.file_name, f.size_bytes, d.bird_id, d.dep_start,
  d.dep_end
FROM {files} f JOIN {deployments} d ON d.tag_id = f.tag_id WHERE d.project_id = 'P1'""",
)
def files_for_project(t: Tables) -> DataFrame:
    project = t.deployments.filter("project_id = 'P1'")
    files = t.files.select("file_name", "size_bytes")
    return inventory.files_of_tags(files, project, ["bird_id", "dep_start", "dep_end"])


# Header layouts found side by side: the three forms of the time, other orders.
LAYOUTS = {
    "P0": ["device_id", "UTC_datetime", "datatype", "Latitude", "Longitude", "depth_m"],
    "P1": ["device_id", "UTC_date", "UTC_time", "datatype", "depth_m", "Longitude", "Latitude"],
    "P2": ["depth_m", "Latitude", "Longitude", "UTC_timestamp", "device_id", "datatype"],
}


def write_logs(t: Tables, path: str | None = None, part: str = "true") -> str:
    """Write records as logger files: a folder per project, a name per tag."""
    path = path or scratch_path(t.spark, "logs")
    known = t.tag_records.filter(part).join(
        deployments.latest_deployment(t.deployments).select("tag_id", "project_id"),
        "tag_id",
        "left",
    ).withColumn("project", F.coalesce("project_id", F.lit("none")))
    raw = known.select(
        "project",
        F.concat(F.col("tag_id").cast("string"), F.lit("_GPRS_2024")).alias("file"),
        F.col("tag_id").alias("device_id"),
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UTC_datetime"),
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UTC_timestamp"),
        F.date_format("datetime", "yyyy-MM-dd").alias("UTC_date"),
        F.date_format("datetime", "HH:mm:ss.SSSSSS").alias("UTC_time"),
        "datatype",
        F.col("lat").alias("Latitude"),
        F.col("lon").alias("Longitude"),
        "depth_m",
    )
    layout = F.when(F.col("project").isin("P1", "P2"), F.col("project")).otherwise("P0")
    # a tag's rows meet in one task, or in a few if it has very many, so that files grow with tags and not with tags times tasks
    dealt = raw.hint("rebalance", "project", "file").sortWithinPartitions("project", "file")
    tag_logs.write_files(dealt, path, ["project", "file"], [(layout == name, columns) for name, columns in LAYOUTS.items()])
    return path


@query(
    "read_tags",
    "WITH "
    + LATEST
    + """
SELECT CAST(r.tag_id AS string) AS tag_id, r.datetime, CAST(r.tag_id AS string) AS device_id,
  r.datatype, r.lat, r.lon, r.depth_m, coalesce(l.project_id, 'none') AS project_id
FROM {tag_records} r LEFT JOIN latest l ON l.tag_id = r.tag_id""",
)
def read_tags(t: Tables) -> DataFrame:
    """All records written as CSV files of three layouts and read back by name."""
    folder = F.regexp_extract("file_path", r"/file=([^/]+)/", 1)
    records = tag_logs.read_tags(
        t.spark,
        write_logs(t),
        min_bytes=0,
        name_column=F.split_part(folder, F.lit("_"), F.lit(1)),
        project=F.regexp_extract("file_path", r"/project=([^/]+)/", 1),
    )
    return records.select(
        "tag_id", "datetime", "device_id", "datatype", "lat", "lon", "depth_m", "project_id"
    )


@query(
    "store_roundtrip",
    """
SELECT tag_id, datatype, count(*) AS no_rows, 'parquet' AS kind FROM {tag_records}
GROUP BY 1, 2
UNION ALL
SELECT tag_id, datatype, count(*), 'csv' FROM {tag_records} GROUP BY 1, 2""",
)
def store_roundtrip(t: Tables) -> DataFrame:
    """Records through Parquet, and counts appended to a CSV table in two steps."""
    table, running = scratch_path(t.spark, "records"), scratch_path(t.spark, "counts")
    store.write_table(t.tag_records, table)
    counts = summary.datatype_counts(store.read_table(t.spark, table))
    located = F.col("datatype").startswith("GPS")
    store.append_csv(counts.filter(located), running)
    store.append_csv(counts.filter(~located), running)
    stored = t.spark.read.schema(counts.schema).csv(running, header=True)
    return clean.union_by_name(
        [counts.withColumn("kind", F.lit("parquet")), stored.withColumn("kind", F.lit("csv"))]
    )


@query(
    "summary_roundtrip",
    "SELECT tag_id, datatype, count(*) AS no_rows FROM {tag_records} GROUP BY 1, 2",
)
def summary_roundtrip(t: Tables) -> DataFrame:
    """Counts through a dated summary file; the second write of a day replaces the first."""
    folder = scratch_path(t.spark, "summaries")
    counts = summary.datatype_counts(t.tag_records)
    store.write_summary(counts.limit(0), folder, "counts", date(2024, 1, 31))
    path = store.write_summary(counts, folder, "counts", date(2024, 1, 31))
    return t.spark.read.schema(counts.schema).csv(path, header=True)


@query(
    "store_by_project",
    """
SELECT d.project_id, d.bird_id, count(*) AS n_rows, min(r.datetime) AS min_dt,
  max(r.datetime) AS max_dt
FROM {tag_records} r JOIN {deployments} d ON r.tag_id = d.tag_id AND r.datetime > d.dep_start
  AND (d.dep_end IS NULL OR r.datetime < d.dep_end)
GROUP BY 1, 2""",
)
def store_by_project(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "projects")
    records = t.tag_records.select("foid", "tag_id", "datetime")
    store.write_by(deployments.assign_deployment(records, t.deployments), path)
    return store.read_table(t.spark, path).groupBy("project_id", "bird_id").agg(
        F.count("*").alias("n_rows"),
        F.min("datetime").alias("min_dt"),
        F.max("datetime").alias("max_dt"),
    )


FOLDER = r"/file=([^/]+)/"


def write_tag_files(t: Tables, path: str | None = None) -> str:
    """All columns of the records as one file a tag, in order of time."""
    path = path or scratch_path(t.spark, "tag-files")
    names = {v: k for k, v in {**tag_logs.TEXT_COLUMNS, **tag_logs.NUMBER_COLUMNS}.items()}
    known = [F.col(c).alias(names[c]) for c in t.tag_records.columns if c in names]
    raw = t.tag_records.select(
        F.concat(F.col("tag_id").cast("string"), F.lit("_GPRS_2024")).alias("file"), "datetime", "foid",
        F.col("tag_id").alias("device_id"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UTC_datetime"), *known,
    )
    ordered = raw.repartition("file").sortWithinPartitions("file", "datetime", "foid").drop("datetime", "foid")
    columns = [c for c in ordered.columns if c != "file"]
    tag_logs.write_files(ordered, path, ["file"], [(F.lit(True), columns)])
    return path


def file_tag() -> Column:
    return F.split_part(F.regexp_extract("file_path", FOLDER, 1), F.lit("_"), F.lit(1))


@query(
    "last_records_of_files",
    f"""
SELECT CAST(tag_id AS string) AS tag_id, max(datetime) AS last_record FROM {{tag_records}} GROUP BY tag_id
HAVING max(datetime) > (SELECT max(datetime) FROM {{tag_records}}) - INTERVAL 1 DAY""",
)
def last_records_of_files(t: Tables) -> DataFrame:
    """Files whose last record is less than a day old, from the files' ends."""
    last = tag_logs.last_records(t.spark, write_tag_files(t), min_bytes=0)
    recent = last.filter(F.col("last_record") > shift_seconds(clean.latest_time(last, "last_record"), -86_400))
    return recent.select(file_tag().alias("tag_id"), "last_record")


@query(
    "ingest_runs",
    """
SELECT CAST(tag_id AS string) AS tag_id, CASE WHEN tag_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, count(*) AS n,
  min(datetime) AS min_dt, max(datetime) AS max_dt, max(depth_m) AS max_depth
FROM {tag_records} GROUP BY tag_id""",
)
def ingest_runs(t: Tables) -> DataFrame:
    """Files that arrive in two lots, each read by one run; a run that is repeated and one without new files change nothing."""
    logs, kept = scratch_path(t.spark, "logs"), scratch_path(t.spark, "runs")
    for part, run in (("tag_id % 2 = 0", "even"), ("tag_id % 2 = 1", "odd"), ("false", "odd"), ("false", "none")):
        write_logs(t, logs, part)
        commits.ingest_new(t.spark, logs, kept, run, 0, name_column=file_tag())
    schema = "tag_id STRING, datetime TIMESTAMP, depth_m DOUBLE, run STRING"
    rows = commits.stored_rows(t.spark, kept, schema)
    return rows.groupBy("tag_id", "run").agg(
        F.count("*").alias("n"), F.min("datetime").alias("min_dt"), F.max("datetime").alias("max_dt"), F.max("depth_m").alias("max_depth")
    )
