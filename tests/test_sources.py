import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from brute import at
from pelagica.operators import deployments
from pelagica.plans import status, studies
from pelagica.session import clear_scratch, scratch_path, shared_dir
from pelagica.sources import inventory, store, tables, tag_logs


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    (path / name).write_text(text)


@pytest.fixture()
def logs(tmp_path):
    a = "device_id,UTC_datetime,datatype,Latitude,Longitude,depth_m,conductivity_mS/cm\n"
    write(
        tmp_path / "PA", "11_GPRS_20240101.csv",
        a + "11,2024-01-01 00:00:01,GPS,1.5,2.5,,7\n11,2024-01-01 00:00:02,SEN,,,3.5,8\n11,bad,SEN,NaN,x,1,\n11,1/2/2024 3:04\n",
    )
    b = "datatype,Longitude,Latitude,UTC_date,UTC_time,device_id\n"
    write(tmp_path / "PB", "22.csv", b + '"GPS, fast",20.5,10.5,2024-01-03,04:05:06.250,22\n')
    write(tmp_path / "PB", "33_GPRS_20240101.csv", b)
    write(tmp_path / "PB", "44_GPRS_20240101.csv", "")
    c = "UTC_timestamp,device_id,conductivity_mS.cm\n"
    write(tmp_path / "PB", "55_x.csv", c + "2024-01-04 00:00:00,55,9\n")
    return tmp_path


def test_read_tags_matches_columns_by_name(spark, logs):
    project = F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1)
    df = tag_logs.read_tags(spark, str(logs), min_bytes=0, project=project)
    got = {(r["tag_id"], r["foid"]): r for r in df.collect()}
    assert set(got) == {("11", 1), ("11", 2), ("11", 3), ("11", 4), ("22", 1), ("55", 1)}
    first, second, third, short = (got["11", i] for i in (1, 2, 3, 4))
    assert (first["lat"], first["lon"], first["depth_m"], first["conductivity_ms_cm"]) == (1.5, 2.5, None, 7.0)
    assert (second["lat"], second["depth_m"], second["datetime"]) == (None, 3.5, datetime(2024, 1, 1, 0, 0, 2))
    assert (third["datetime"], third["lat"], third["lon"], third["depth_m"]) == (None, None, None, 1.0)
    assert (short["datetime"], short["datatype"]) == (datetime(2024, 1, 2, 3, 4), None)
    quoted = got["22", 1]
    assert (quoted["datatype"], quoted["lat"], quoted["lon"]) == ("GPS, fast", 10.5, 20.5)
    assert quoted["datetime"] == datetime(2024, 1, 3, 4, 5, 6, 250000)
    assert (quoted["project_id"], first["project_id"], quoted["depth_m"]) == ("PB", "PA", None)
    assert got["55", 1]["conductivity_ms_cm"] == 9.0


def test_read_tags_numbers_rows_over_splits(spark, tmp_path):
    lines = "".join(f"9,2024-01-01 00:00:00,{i}\n" for i in range(3000))
    write(tmp_path, "9_GPRS_20240101.csv", "device_id,UTC_datetime,depth_m\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = tag_logs.read_tags(spark, str(tmp_path))
        assert df.count() == 3000
        assert df.filter(F.col("foid") != F.col("depth_m") + 1).isEmpty()
        assert tag_logs.read_tags(spark, str(tmp_path), number_rows=False).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_first_line_is_the_header(spark, tmp_path):
    """Without ``device_id``, and with a data line that holds the word."""
    write(tmp_path, "7_a.csv", "\ufeffUTC_datetime,datatype,depth_m\n\n2024-01-01 00:00:00,device_id,1\n2024-01-01 00:00:01,x,2\n")
    write(tmp_path, "7_b.csv", "depth_m,UTC_datetime\n3,2024-01-01 00:00:00\n4,1/2/24 10:00\n")
    for numbered in (True, False):
        rows = tag_logs.read_tags(spark, str(tmp_path), min_bytes=0, number_rows=numbered).collect()
        got = {r["depth_m"]: r["datetime"] for r in rows}
        assert got == {1.0: datetime(2024, 1, 1), 2.0: datetime(2024, 1, 1, 0, 0, 1), 3.0: datetime(2024, 1, 1), 4.0: datetime(2024, 1, 2, 10)}
    # rows of a tag are numbered over its files
    assert {r["depth_m"]: r["foid"] for r in tag_logs.read_tags(spark, str(tmp_path), min_bytes=0).collect()} == {1.0: 1, 2.0: 2, 3.0: 3, 4.0: 4}
    write(tmp_path, "8_a.csv", "depth_m,comment\n3,none\n")
    with pytest.raises(Exception, match="no time column in .*8_a.csv"):
        tag_logs.read_tags(spark, str(tmp_path), min_bytes=0).collect()


def test_rows_are_read_without_an_exchange(spark, tmp_path):
    for k in range(5):
        write(tmp_path, f"9_{k}.csv", "device_id,UTC_datetime,depth_m\n" + "9,2024-01-01 00:00:00,1\n" * 50)

    def plan(**options):
        df = tag_logs.read_tags(spark, str(tmp_path), min_bytes=0, **options)
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(number_rows=False) and "Sort" not in plan(number_rows=False)
    numbered = plan()
    # one exchange of the counts by tag, and their broadcast
    assert numbered.count("Exchange hashpartitioning") == 1 and numbered.count("BroadcastExchange") == 1
    assert "BroadcastHashJoin" in numbered and "SortMergeJoin" not in numbered


@pytest.mark.parametrize("size", [1, 2, 7, 40, 100, 1 << 20])
def test_splits_of_any_size_give_the_same_rows(spark, tmp_path, size):
    texts = {
        "1_a.csv": "\ufeff\n\nUTC_datetime, depth_m ,datatype\r\n2024-01-01 00:00:00,1,é\r\n\r\n2024-01-01 00:00:01,2\r\n",
        "1_b.csv": 'datatype,depth_m,UTC_datetime\n"a, ""b""",3,2024-01-01 00:00:02\n\n,4,2024-01-01 00:00:03',
        "1_c.csv": "UTC_datetime\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before, bound = spark.conf.get("spark.sql.files.maxPartitionBytes"), str(size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", bound)
    try:
        rows = tag_logs.read_tags(spark, str(tmp_path), min_bytes=0).orderBy("foid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["foid"], r["depth_m"], r["datatype"]) for r in rows] == [(1, 1.0, "é"), (2, 2.0, None), (3, 3.0, 'a, "b"'), (4, 4.0, None)]
    assert [r["datetime"].second for r in rows] == [0, 1, 2, 3]


def test_both_readers_agree(spark, logs, monkeypatch):
    columns = ["tag_id", "foid", "datetime", "datatype", "lat", "lon", "depth_m", "conductivity_ms_cm", "file_name"]
    own = tag_logs.read_tags(spark, str(logs), min_bytes=0).select(columns).collect()
    ends = tag_logs.last_records(spark, str(logs), min_bytes=0).select("file_name", "last_record").collect()
    monkeypatch.setattr(tag_logs, "_can_open", lambda paths: False)
    assert sorted(map(str, own)) == sorted(map(str, tag_logs.read_tags(spark, str(logs), min_bytes=0).select(columns).collect()))
    assert sorted(map(str, ends)) == sorted(map(str, tag_logs.last_records(spark, str(logs), min_bytes=0).select("file_name", "last_record").collect()))


def test_last_records_read_the_ends_of_files(spark, tmp_path):
    head = "device_id,UTC_datetime,depth_m\n"
    line = "9,2024-01-01 00:00:00,1\n"
    write(tmp_path, "1_long.csv", head + line * 200_000 + "9,2024-01-05 00:00:00,1\n\n \n")
    write(tmp_path, "2_short.csv", head + line)
    write(tmp_path, "3_head.csv", head)
    write(tmp_path, "4_bad.csv", head + line + "9,soon,1")
    write(tmp_path, "5_wide.csv", head + line + f"9,2024-01-06 00:00:00,{'7' * 300_000}\n")
    got = {r["file_name"]: r for r in tag_logs.last_records(spark, str(tmp_path), min_bytes=0).collect()}
    times = {name: r["last_record"] for name, r in got.items()}
    assert times == {"1_long.csv": datetime(2024, 1, 5), "2_short.csv": datetime(2024, 1, 1), "4_bad.csv": None, "5_wide.csv": datetime(2024, 1, 6)}
    assert got["1_long.csv"]["size_bytes"] > 4_000_000 and got["1_long.csv"]["bytes_read"] <= 2 * 65_536


def test_own_readers_feed_own_plans(spark, tmp_path):
    """Deployments and logs from files into the as-of join, the study report and the chunk counts."""
    write(
        tmp_path, "dep.csv",
        "Bird_ID,TagSerialNumber,Project_ID,DeploymentStartDatetime,Deployment_End_Short,DeploymentEndDatetime_UTC,UTC_offset_deploy,TagManufacture\n"
        "a,7,P,1/1/24 0:00,x,1/5/24 0:00,0,M\nb,7,Q,1/10/2024 0:00,x,,0,M\nc,7,R,soon,x,,0,M\n",
    )
    lines = "".join(f"2024-01-{d:02d} 00:00:{s:02d},1.5,2.5,{5 if s in (3, 4, 5, 6) else 0}\n" for d in (2, 11, 12) for s in range(10))
    write(tmp_path / "logs", "7_GPRS_20240101.csv", "UTC_datetime,Latitude,Longitude,depth_m\n" + lines)
    table = tables.read_deployments(spark, str(tmp_path / "dep.csv"))
    raw = spark.read.csv(str(tmp_path / "dep.csv"), header=True).withColumnRenamed("Bird_ID", "bird_id")
    bad = tables.unparsed_times(raw, table, {"DeploymentStartDatetime": "dep_start"}, ["bird_id"]).collect()
    assert [(r["bird_id"], r["text"]) for r in bad] == [("c", "soon")]
    records = tag_logs.read_tags(spark, str(tmp_path / "logs"), min_bytes=0)
    found = deployments.asof_deployment(records, table).groupBy("bird_id").count().collect()
    assert {r["bird_id"]: r["count"] for r in found} == {"a": 10, "b": 20}
    assert deployments.assign_deployment(records, table).count() == 30
    annotated = studies.annotate_records(records, table)
    report = {r["bird_id"]: r for r in studies.deployment_report(annotated).collect()}
    assert {b: (r["n_depth"], r["udives_day"]) for b, r in report.items()} == {"a": (1, 1), "b": (2, 1)}
    assert {(r["project_id"], r["n_depth"]) for r in studies.chunks_by_project(annotated).collect()} == {("P", 1), ("Q", 2)}
    studies.store_studies(annotated, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out"))[-2:] == ["project_id=P", "project_id=Q"]


def test_weekly_report_of_files(spark, tmp_path):
    """Old and stale files and bare headers are left out; a fix sent in two files counts once."""
    head = "device_id,UTC_datetime,datatype,Latitude,Longitude,depth_m\n"

    def rows(day, fixes, start=0):
        return "".join(f"9,2024-01-{day:02d} 00:00:{start + s:02d},GPS,{40 + s / 100},-125,\n" for s in range(fixes))

    write(tmp_path, "9_a.csv", head + rows(20, 7))
    write(tmp_path, "9_b.csv", head + rows(20, 7) + rows(21, 2))
    write(tmp_path, "8_a.csv", head + rows(2, 9))  # nothing for weeks
    write(tmp_path, "7_a.csv", head)
    write(tmp_path, "6_a.csv", head + rows(20, 9))
    os.utime(tmp_path / "6_a.csv", (1_700_000_000, 1_700_000_000))  # not changed since November
    table = spark.createDataFrame(
        [(t, f"b{t}", "P", "20240131", datetime(2024, 1, 1)) for t in "6789"],
        "tag_id string, bird_id string, project_id string, deploy_end_short string, dep_start timestamp",
    )
    report = status.weekly_status_of_files(spark, str(tmp_path), table, ["GPS"], datetime(2024, 1, 22), min_bytes=len(head)).collect()
    assert [(r["tag_id"], r["device_id"], r["deploy_end_short"], r["GPS"], r["gps_surfacedrift_pts"]) for r in report] == [("9", "9", "20240131", 9, 7)]


def test_small_files_are_skipped(spark, logs):
    assert tag_logs.read_tags(spark, str(logs), min_bytes=100).select("tag_id").distinct().count() == 2
    files = inventory.list_files(spark, str(logs))
    sizes = {r["file_name"]: r["size_bytes"] for r in files.collect()}
    # Spark leaves files of no bytes out of a listing.
    assert set(sizes) == {"11_GPRS_20240101.csv", "22.csv", "33_GPRS_20240101.csv", "55_x.csv"}
    assert {r["file_name"] for r in inventory.with_data(files, 100).collect()} == {
        "11_GPRS_20240101.csv", "22.csv",
    }
    assert inventory.changed_since(files, F.current_timestamp()).count() == 4
    assert inventory.changed_since(files, F.lit(datetime(2199, 1, 1))).isEmpty()
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_file_selection(spark):
    files = spark.createDataFrame([("1_a.csv",), ("11_a.csv",), ("2.csv",)], "file_name string")
    seen = spark.createDataFrame([("2.csv",)], "file_name string")
    assert {r[0] for r in inventory.new_files(files, seen).collect()} == {"1_a.csv", "11_a.csv"}
    assert {r[0] for r in inventory.known_files(files, seen).collect()} == {"2.csv"}
    tags = spark.createDataFrame([(1, "b")], "tag_id long, bird_id string")
    assert [r["file_name"] for r in inventory.files_of_tags(files, tags, []).collect()] == ["1_a.csv"]
    assert inventory.files_of_tags(files, tags, ["bird_id"]).first()["bird_id"] == "b"
    records = spark.createDataFrame(
        [("f", at(0), 1), ("f", at(700_000), 2), ("g", at(700_000), 1), ("g", at(5), 2)],
        "file_name string, datetime timestamp, foid long",
    )
    recent = inventory.with_recent_last_record(records, F.lit(at(700_000)))
    assert [r["file_name"] for r in recent.collect()] == ["f"]


def test_tables(spark, tmp_path):
    write(
        tmp_path, "dep.csv",
        "Bird_ID,TagSerialNumber,Project_ID,DeploymentStartDatetime,Deployment_End_Short,DeploymentEndDatetime_UTC,UTC_offset_deploy,TagManufacture\n"
        "a,1,P,1/2/2024 3:04,x,,-7,M\nb,,P,1/2/2024 3:04,x,,0,M\nc,3,P,bad,x,2/3/2024 4:05,,N\n",
    )
    got = {r["bird_id"]: r for r in tables.read_deployments(spark, str(tmp_path / "dep.csv")).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["dep_start"] == datetime(2024, 1, 2, 10, 4) and got["a"]["dep_end"] is None
    assert got["c"]["dep_start"] is None and got["c"]["dep_end"] == datetime(2024, 2, 3, 4, 5)
    only = tables.read_deployments(spark, str(tmp_path / "dep.csv"), "N")
    assert [r["bird_id"] for r in only.collect()] == ["c"]

    write(tmp_path, "gps.csv", "id,time,lat,lon\n1,13/01/2024 1:02:03,5,6\n1,13/01/2024 1:02:03,0,0\n1,x,5,999\n")
    row = tables.read_gps(spark, str(tmp_path / "gps.csv")).collect()
    assert [(r["datetime"], r["lat"]) for r in row] == [(datetime(2024, 1, 13, 1, 2, 3), 5.0)]

    write(tmp_path, "dives.csv", "tag,time,gps_lat_post,gps_lon_post\n1,13/07/2020 1:02:03,5,-140\n1,13/07/2020 1:02:03,5,-130\n2,13/07/2020 1:02:03,5,-140\n")
    dives = tables.read_dives(spark, str(tmp_path / "dives.csv"))
    table = spark.createDataFrame([("1", "P")], "tag_id string, project_id string")
    kept = tables.select_dives(dives, table, ["P"], "S", 2020, (7, 8), -138).collect()
    assert [(r["tag"], r["year"], r["month"], r["species"]) for r in kept] == [("1", 2020, 7, "S")]

    write(tmp_path, "cls.csv", "TID,TID_short,Measurement\n10,a,b\n")
    assert tables.read_raster_classes(spark, str(tmp_path / "cls.csv")).first()["tid"] == 10
    write(tmp_path, "cells.csv", "x,y,layer\n1,2,10\n")
    assert tables.read_cells(spark, str(tmp_path / "cells.csv")).first()["layer"] == 10
    write(tmp_path / "old", "1.csv", "BirdID,LatDegree,LongDegree,ObsDepth,CalDepth\nAAAA_1,1,2,3,-4\n")
    write(tmp_path / "old", "2.csv", "BirdID,LatDegree,LongDegree,ObsDepth,CalDepth\nBBBB_1,,,,\n")
    assert {r["species"] for r in tables.read_legacy(spark, str(tmp_path / "old")).collect()} == {"AAAA", "BBBB"}
    write(tmp_path, "cal.csv", "tag_id,cal_start_datetime_local,cal_end_datetime_local,utc_offset,calprocessed_yn\n1,1/2/2024 3:00,1/2/2024 4:00,1,n\n")
    assert tables.read_calibration_index(spark, str(tmp_path / "cal.csv")).first()["cal_end_local"] == datetime(2024, 1, 2, 4)


def test_swapped_header_is_an_error(spark, tmp_path):
    write(tmp_path, "gps.csv", "id,time,lon,lat\n1,13/01/2024 1:02:03,5,6\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_gps(spark, str(tmp_path / "gps.csv")).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("P", 1), ("Q", 2)], "project_id string, n int")
    path = store.write_summary(df, str(tmp_path), "status", date(2024, 1, 2))
    assert path.endswith("status_2024-01-02")
    assert spark.read.csv(path, header=True).count() == 2
    running = str(tmp_path / "running")
    store.append_csv(df, running)
    store.append_csv(df, running)
    assert spark.read.csv(running, header=True).count() == 4
    store.write_by(df, str(tmp_path / "by"))
    assert sorted(os.listdir(tmp_path / "by"))[-2:] == ["project_id=P", "project_id=Q"]
    store.write_by(spark.createDataFrame([("P", 5), ("P", 6)], df.schema), str(tmp_path / "by"))
    again = spark.read.parquet(str(tmp_path / "by")).collect()
    assert sorted((r["project_id"], r["n"]) for r in again) == [("P", 5), ("P", 6), ("Q", 2)]
    store.write_table(df, str(tmp_path / "t"))
    assert store.read_table(spark, str(tmp_path / "t")).count() == 2


def test_scratch_is_cleared(spark):
    paths = [scratch_path(spark, "a"), scratch_path(spark, "b")]
    for path in paths:
        spark.range(3).write.parquet(path)
    kept = spark.range(5).checkpoint()
    assert kept.count() == 5
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert any(name.startswith("rdd-") for name in os.listdir(folder))
    clear_scratch(spark)
    assert not any(os.path.exists(path) for path in paths)
    assert not any(name.startswith("rdd-") for name in os.listdir(folder))


def test_shared_dir_is_reused(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
