from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brute import at
from pelagica.functions import maths, text, time
from pelagica.operators import calibration, clean, deployments, sensors, summary


def test_clean_records(spark):
    nan = float("nan")
    rows = [
        (1, 0.0, 0.0, None, 1.0),
        (2, 0.0, 0.0, 3.0, 1.0),
        (3, None, None, None, 1.0),
        (4, nan, nan, nan, 1.0),
        (5, 10.0, 20.0, None, 1.0),
        (6, None, None, 2.0, 1.0),
        (7, 0.0, 5.0, None, 1.0),
    ]
    raw = spark.createDataFrame(rows, "id int, Latitude double, Longitude double, depth_m double, acc_x double")
    kept = clean.clean_records(raw)
    assert kept.columns == ["id", "lat", "lon", "depth_m"]
    assert sorted(r["id"] for r in kept.collect()) == [2, 5, 6, 7]
    without_depth = clean.clean_records(raw.drop("depth_m"))
    assert sorted(r["id"] for r in without_depth.collect()) == [5, 7]
    assert without_depth.filter("depth_m is not null").isEmpty()


def test_fix_filters(spark):
    rows = [(1, 0.0, 5.0), (2, 5.0, 0.0), (3, 5.0, 181.0), (4, None, 5.0), (5, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    assert [r["id"] for r in clean.usable_fixes(df).collect()] == [5]
    nulled = {r["id"]: (r["lat"], r["lon"]) for r in clean.zero_to_null(df).collect()}
    assert nulled[1] == (None, 5.0) and nulled[2] == (5.0, None)


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(
        [(1, at(0), 2, "b"), (1, at(0), 1, "a"), (1, at(1), 3, "c")],
        "tag_id int, datetime timestamp, foid int, v string",
    )
    first = clean.keep_first(df)
    plan = first._jdf.queryExecution().executedPlan().toString()
    limits = [plan.index("Final\n", plan.index("WindowGroupLimit")), plan.index("Partial\n")]
    assert limits[0] < plan.index("Exchange hashpartitioning") < limits[1]
    assert sorted(r["v"] for r in first.collect()) == ["a", "c"]


def test_trailing_is_strict(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(1)), (3, at(3600))], "id int, datetime timestamp")
    kept = clean.trailing(df, clean.latest_time(df), 1)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]


def test_times(spark):
    df = spark.createDataFrame(
        [("1/2/2024 3:04", "01/02/2024 03:04", "2/1/2024 3:04:05", "2024-01-02 03:04:05", "", "x")],
        "a string, b string, c string, d string, e string, f string",
    )
    r = df.select(
        time.parse_month_first("a").alias("a"),
        time.parse_month_first("b").alias("b"),
        time.parse_day_first("c").alias("c"),
        time.parse_iso("d").alias("d"),
        time.parse_iso("e").alias("e"),
        time.parse_month_first("e").alias("e2"),
        time.parse_either("f").alias("f"),
        time.to_utc(time.parse_iso("d"), F.lit(5.75)).alias("u"),
    ).first()
    assert r["a"] == r["b"] == datetime(2024, 1, 2, 3, 4)
    assert r["c"] == r["d"] == datetime(2024, 1, 2, 3, 4, 5)
    assert r["e"] is None and r["e2"] is None and r["f"] is None
    assert r["u"] == datetime(2024, 1, 1, 21, 19, 5)


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, -10.0), (3.5, 10.0), (-2.5, None)], "v double, lon double")
    assert [r[0] for r in df.select(maths.half_even("v")).collect()] == [2.0, 4.0, -2.0]
    assert [r[0] for r in df.select(maths.wrap360("lon")).collect()] == [350.0, 10.0, None]
    names = spark.createDataFrame([("123_GPRS_20240101.csv",), ("77.csv",)], "n string")
    assert [r[0] for r in names.select(text.tag_of_file("n")).collect()] == ["123", "77"]
    counts = spark.createDataFrame([(1, None), (1, 2.0), (2, 2.0)], "k int, v double")
    got = counts.groupBy("k").agg(maths.distinct_with_null("v").alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {1: 2, 2: 1}


DEPLOYED = "tag_id long, dep_no int, bird_id string, project_id string, dep_start timestamp, dep_end timestamp"


def test_deployment_joins(spark):
    table = spark.createDataFrame(
        [
            (1, 1, "a", "P", at(0), at(10)),
            (1, 2, "b", "P", at(20), None),
            (2, 1, "c", "Q", at(5), at(8)),
        ],
        DEPLOYED,
    )
    rows = [(1, s) for s in (0, 5, 10, 15, 20, 25, 9999)] + [(2, 6), (2, 8), (3, 6)]
    records = spark.createDataFrame(
        [(t, at(s), i) for i, (t, s) in enumerate(rows)], "tag_id long, datetime timestamp, foid long"
    )

    def times(df, *columns):
        return sorted((r["tag_id"], r["foid"], *[r[c] for c in columns]) for r in df.collect())

    inside = [(1, 1, "a"), (1, 5, "b"), (1, 6, "b"), (2, 7, "c")]
    assert times(deployments.assign_deployment(records, table), "bird_id") == inside
    trimmed = deployments.trim_to_deployment(records, table)
    assert times(trimmed) == [(t, f) for t, f, _ in inside]
    asof = deployments.asof_deployment(records, table)
    assert asof.count() == len(rows)
    got = {r["foid"]: r["bird_id"] for r in asof.collect()}
    assert got == {0: None, 1: "a", 2: "a", 3: "a", 4: "a", 5: "b", 6: "b", 7: "c", 8: "c", 9: None}
    latest = deployments.join_latest_deployment(records, table)
    assert {(r["tag_id"], r["bird_id"]) for r in latest.collect()} == {(1, "b"), (2, "c")}
    assert {r["tag_id"] for r in deployments.undeployed_only(records, table).collect()} == {3}
    assert {r["tag_id"] for r in deployments.deployed_only(records, table).collect()} == {1, 2}


def test_the_latest_deployment_is_the_last_listed(spark):
    table = spark.createDataFrame([(1, 1, "a", "P", at(50), None), (1, 2, "b", "P", at(10), None), (1, 3, "c", "P", None, None)], DEPLOYED)
    assert [r["bird_id"] for r in deployments.latest_deployment(table).collect()] == ["c"]
    assert [r["bird_id"] for r in deployments.latest_deployment(table.filter("dep_no < 3")).collect()] == ["b"]
    assert [r["bird_id"] for r in deployments.latest_deployment(table.drop("dep_no")).collect()] == ["a"]


def test_large_deployment_table_is_not_broadcast(spark):
    table = spark.createDataFrame([(1, 1, "a", "P", at(0), None)], DEPLOYED)
    records = spark.createDataFrame([(1, at(5), 1)], "tag_id long, datetime timestamp, foid long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        joined = deployments.assign_deployment(records, table)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert joined.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("bin_s", [1, 7, 50, 30 * 86_400])
def test_span_joins_are_the_same_for_any_bin(spark, bin_s):
    table = [(1, 1, "a", "P", at(5), at(20)), (1, 2, "b", "P", at(20), at(20)), (1, 3, "c", "Q", at(30), None), (1, 4, "d", "Q", at(60), at(50)), (2, 1, "e", "P", None, None), (2, 2, "f", "P", at(-10**9), at(8))]
    records = [(t, None if s is None else at(s), 100 * t + i) for t in (1, 2, 3) for i, s in enumerate([None, 0, 5, 6, 19, 20, 21, 30, 31, 90, 10**9, -10**9])]
    frame = spark.createDataFrame(records, "tag_id long, datetime timestamp, foid long")
    deployed = spark.createDataFrame(table, DEPLOYED)
    # the far future has few bins even when they are narrow
    narrow = {"bin_s": bin_s} if bin_s > 100 else {"bin_s": bin_s * 10_000_000}
    got = {(r["foid"], r["bird_id"]) for r in deployments.assign_deployment(frame, deployed, **narrow).collect()}
    want = {
        (f, b) for t, when, f in records for tag, _, b, _, lo, hi in table
        if t == tag and when and lo and when > lo and (hi is None or when < hi)
    }
    assert got == want
    inside = {r["foid"] for r in deployments.trim_to_deployment(frame, deployed, **narrow).collect()}
    assert inside == {f for f, _ in want}
    spans = spark.createDataFrame([(1, at(6), at(9)), (1, at(8), at(30)), (2, at(0), None)], "tag_id long, start_utc timestamp, end_utc timestamp")
    moving = frame.select("*", *[F.lit(0.0).alias(c) for c in ("acc_x", "acc_y", "acc_z")])
    rows = calibration.calibration_rows(moving, spans, 1, 1, bin_s=bin_s).collect()
    near = {(f, lo) for t, when, f in records for tag, lo, hi in [(1, 6, 9), (1, 8, 30)] if t == tag and when and at(lo - 1) < when < at(hi + 1)}
    assert {(r["foid"], r["start_utc"]) for r in rows} == {(f, at(lo)) for f, lo in near}


def test_one_tag_spreads_over_tasks(spark):
    """Without a broadcast the records of a single tag meet its deployments in many partitions."""
    records = spark.range(20_000).select(F.lit(1).alias("tag_id"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 3600).alias("datetime"), F.col("id").alias("foid"))
    table = spark.createDataFrame([(1, k, f"b{k}", "P", at(-10**8 + k * 10**6), None) for k in range(3)], DEPLOYED)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = deployments.assign_deployment(records, table)
        assert joined.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sketches_of_days_merge(spark):
    records = spark.range(60_000).select(
        (F.col("id") % 2).alias("tag_id"), F.lit("P").alias("project_id"), (F.col("id") % 21_000 / 1000).alias("lat"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 10).alias("datetime"),
    )
    sketches = summary.daily_position_sketches(records)
    day = lambda d: F.lit(f"2024-01-0{d}").cast("date")
    for first, last in ((1, 1), (1, 7), (3, 5)):
        got = {r["tag_id"]: r for r in summary.positions_of_days(sketches, day(first), day(last)).collect()}
        part = records.filter(F.to_date("datetime").between(day(first), day(last)))
        for r in part.groupBy("tag_id").agg(F.countDistinct("lat").alias("n"), F.count("*").alias("m")).collect():
            assert abs(got[r["tag_id"]]["n_lat_about"] - r["n"]) <= 0.065 * r["n"] and got[r["tag_id"]]["n_rows"] == r["m"]


def test_summary_of_missing_values(spark):
    df = spark.createDataFrame(
        [("P", 1, at(0), None, None, 3.0, None, None, "GPS"), ("P", 1, at(3600), None, 1.0, 4.0, None, None, "SEN")],
        "project_id string, tag_id long, datetime timestamp, depth_m double, lat double, u_bat_mv double,"
        "ext_temperature_c double, conductivity_ms_cm double, datatype string",
    )
    r = summary.tag_summary(df, types=("GPS", "SEN", "GPSD")).first()
    assert r["max_depth"] is None and r["u_depth"] is None
    assert (r["n_gps"], r["u_bat"], r["dur_s"], r["dur_hr"]) == (2, 4.0, 3600.0, 1.0)
    assert (r["GPS"], r["SEN"], r["GPSD"]) == (1, 1, None)


def test_sensor_series(spark):
    df = spark.createDataFrame(
        [(1, at(0), 1, 2.0, -40.0, 100.0, 5.0, 50.0, 3.0, 3.0, 4.0, 0.0, 1)],
        "tag_id long, datetime timestamp, foid long, depth_m double, lat double, ext_temperature_c double,"
        "conductivity_ms_cm double, bat_soc_pct double, solar_i_ma double, acc_x double, acc_y double,"
        "acc_z double, gps_surfacedrifts int",
    )
    got = {r["series"]: r["y"] for r in sensors.sensor_long(df).collect()}
    assert got == {
        "depth": -2.0, "lat": 40.0, "conductivity": 5.0, "battery": 50.0, "solar": 104.0,
        "vector_sum": 0.5, "drift": 45.0,
    }


def test_calibration_steps(spark):
    index = spark.createDataFrame(
        [(1, datetime(2024, 1, 31, 23), datetime(2024, 2, 1, 1), -2, "n"), (2, datetime(2024, 1, 1), datetime(2024, 1, 2), 0, "n"),
         (3, datetime(2024, 1, 1), datetime(2024, 1, 2), 0, "y")],
        "tag_id long, cal_start_local timestamp, cal_end_local timestamp, utc_offset int, calprocessed_yn string",
    )
    todo = calibration.open_calibrations(index)
    assert {r["tag_id"]: r["start_utc"] for r in todo.collect()}[1] == datetime(2024, 2, 1, 1)
    files = spark.createDataFrame(
        [("1_GPRS_20240201_x.csv",), ("1_GPRS_20240202.csv",), ("11_GPRS_20240201.csv",), ("1_GPRS_20240204.csv",)],
        "file_name string",
    )
    got = {(r["tag_id"], r["file_name"]) for r in calibration.match_files(todo, files).collect()}
    assert got == {(1, "1_GPRS_20240201_x.csv"), (1, "1_GPRS_20240202.csv"), (2, None)}
    # a second calibration of a tag has its own files and its own miss
    again = todo.unionByName(todo.filter("tag_id = 1").withColumn("start_utc", F.lit(datetime(2024, 3, 1))))
    got = [(r["tag_id"], r["start_utc"].month, r["file_name"]) for r in calibration.match_files(again, files).collect()]
    assert len(got) == 4 and (1, 3, None) in got

    rows = spark.createDataFrame(
        [(1, at(i), i, float(i), 0.0, 0.0) for i in range(12)],
        "tag_id long, datetime timestamp, foid long, acc_x double, acc_y double, acc_z double",
    )
    todo = spark.createDataFrame(
        [(1, at(5), at(6)), (1, at(100_000), at(100_001))], "tag_id long, start_utc timestamp, end_utc timestamp"
    )
    summed = calibration.calibration_rows(rows, todo, before_s=6, after_s=6)
    assert summed.count() == 12
    assert calibration.calibration_rows(rows, todo).groupBy("start_utc").count().count() == 2
    gate = calibration.calibration_gate(summed).first()
    assert (gate["n_rows"], gate["enough"]) == (11, True)
    chunks = spark.createDataFrame(
        [(1, at(5), 2, 9), (1, at(100_000), 1, 400)], "tag_id long, start_utc timestamp, beg_pt int, end_pt int"
    )
    assert calibration.long_chunks(chunks).first()["end_pt"] == 400
    segs = spark.createDataFrame(
        [(1, at(5), "X1", 1, 3), (1, at(5), "Z2", 5, 6), (1, at(100_000), "Y1", 1, 9)],
        "tag_id long, start_utc timestamp, seg string, beg int, fin int",
    )
    labelled = calibration.label_segments(calibration.passing_rows(summed), chunks, segs, slice_s=4)
    got = {r["foid"]: (r["x"], r["calib_seg"]) for r in labelled.collect()}
    assert got == {
        2: (1, "X1"), 3: (2, "X1"), 4: (3, "X1"), 5: (4, None), 6: (5, "Z2"), 7: (6, "Z2"), 8: (7, None), 9: (8, None)
    }
    fixed = {r["calib_seg"]: r for r in calibration.corrections(labelled).collect()}
    assert (fixed["X1"]["axis"], fixed["X1"]["seg"], fixed["X1"]["min"], fixed["X1"]["max"]) == ("X", "1", 2.0, 4.0)
    assert (fixed["Z2"]["axis_min"], fixed["Z2"]["n_values"]) == (0.0, 2)
    assert calibration.label_segments(summed, chunks, segs, max_chunk=5).isEmpty()
