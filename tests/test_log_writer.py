"""The writer of logger files, and what a folder of very many small ones costs."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from brute import at
from pelagica.queries import files
from pelagica.sources import commits, inventory, log_files, tag_logs

RECORDS = "tag_id long, datetime timestamp, foid long, datatype string, lat double, lon double, depth_m double"
DEPLOYMENTS = "tag_id long, project_id string, dep_start timestamp, dep_end timestamp"


def made(spark, tags=40, each=12, parts=8):
    rows = [(t or None, at(60 * t + s), 100 * t + s, "GPS", 40.5, -1e-7, float(s)) for s in range(each) for t in range(tags)]
    table = [(t, f"P{t % 4}", at(0), None) for t in range(0, tags, 2)]
    records = spark.createDataFrame(rows, RECORDS).repartition(parts)
    return SimpleNamespace(spark=spark, tag_records=records, deployments=spark.createDataFrame(table, DEPLOYMENTS)), rows


def found(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".csv"))


def read(spark, path):
    records = tag_logs.read_tags(spark, str(path), 0, name_column=files.file_tag())
    return sorted((r.tag_id, r.datetime, r.datatype, r.lat, r.lon, r.depth_m) for r in records.collect())


def test_a_tag_is_one_file_however_many_tasks_have_its_rows(spark, tmp_path):
    t, rows = made(spark)
    files.write_logs(t, str(tmp_path / "logs"))
    files.write_tag_files(t, str(tmp_path / "tags"))
    want = sorted((str(r[0] or ""), r[1], *r[3:]) for r in rows)
    for name in ("logs", "tags"):
        assert len(found(tmp_path / name)) == 40
        assert read(spark, tmp_path / name) == want
    files.write_logs(t, str(tmp_path / "logs"), "tag_id < 10")  # later files stand beside the earlier ones
    assert len(found(tmp_path / "logs")) == 49
    nothing = files.write_logs(t, str(tmp_path / "none"), "false")
    assert read(spark, nothing) == []


def test_both_writers_agree(spark, tmp_path, monkeypatch):
    rows = [("a b", None, 'x, "y"', 1.0), ("c=d/e", "q", None, None), (None, "", " z ", float("nan")), ("%", "é", "1", 1e-9)]
    df = spark.createDataFrame(rows, "folder string, UTC_datetime string, datatype string, depth_m double").coalesce(1).sortWithinPartitions("folder")
    layouts = [(F.col("folder") == "%", ["depth_m", "datatype", "UTC_datetime"]), (F.lit(True), ["UTC_datetime", "datatype", "depth_m"])]

    def texts(path):
        return {os.path.relpath(os.path.dirname(f), path): open(f, encoding="utf-8").read() for f in found(path)}

    own, sparks = str(tmp_path / "own"), str(tmp_path / "spark")
    tag_logs.write_files(df, own, ["folder"], layouts)
    monkeypatch.setattr(tag_logs, "_can_open", lambda paths: False)
    tag_logs.write_files(df.withColumn("folder", F.col("folder")), sparks, ["folder"], layouts)
    got, want = texts(own), texts(sparks)
    assert len(got) == 4 and got == want


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 5).cast("string").alias("file"), F.when(F.col("id") == 19, F.raise_error(F.lit("no more"))).otherwise("t").alias("UTC_datetime"))
    with pytest.raises(Exception, match="no more"):
        tag_logs.write_files(df.repartition(4), str(tmp_path / "logs"), ["file"], [(F.lit(True), ["UTC_datetime"])])
    assert found(tmp_path / "logs") == []


def test_small_files_share_a_batch(spark, tmp_path):
    t, _ = made(spark)
    files.write_logs(t, str(tmp_path))
    options = {"paths": json.dumps([str(tmp_path)]), "columns": json.dumps([["depth_m"]])}
    for mode, rows in (("rows", 480), ("counts", 40), ("tails", 40)):
        reader = log_files.LoggerReader(options | {"mode": mode})
        assert [b.num_rows for group in reader.partitions() for b in reader.read(group)] == [rows]


def test_a_listing_has_a_bounded_number_of_tasks(spark, tmp_path):
    for k in range(150):
        os.makedirs(tmp_path / "logs" / f"file={k}_GPRS")
        (tmp_path / "logs" / f"file={k}_GPRS" / "part.csv").write_text("UTC_datetime\n2024-01-01 00:00:00\n")
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        assert inventory.list_files(spark, str(tmp_path / "logs")).count() == 150
        commits.ingest_new(spark, str(tmp_path / "logs"), str(tmp_path / "runs"), "one", 0, name_column=files.file_tag())
        tracker = context.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert max(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) <= 100
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert commits.manifest(spark, str(tmp_path / "runs")).count() == 150
    assert len(os.listdir(next((tmp_path / "runs" / "files").iterdir()))) < 60


@pytest.mark.parametrize("path", ["file:/a/b.csv", "file:///a/x=1/b.c-d_e.csv", "s3://bucket/a/b.csv"])
def test_whole_paths_are_taken_as_they_are(path):
    assert tag_logs.WHOLE_PATH.fullmatch(path)


@pytest.mark.parametrize("path", ["/a/b", "file:/a b/c", "file:/a/%20", "hdfs:/a", "file:/a/../b", "a/b", "file:/a/*.csv", "s3://b/a//c"])
def test_other_paths_are_qualified(path):
    assert not tag_logs.WHOLE_PATH.fullmatch(path)
