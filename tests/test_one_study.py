"""One study from records to flags, labels and summaries."""

import random

from pyspark.sql import functions as F

from brute import at
from pelagica.operators import speed
from pelagica.plans import one_study, studies

RECORDS = (
    "tag_id long, datetime timestamp, foid long, datatype string, lat double, lon double, depth_m double,"
    " u_bat_mv double, ext_temperature_c double, conductivity_ms_cm double"
)
DEPLOYMENTS = "tag_id long, dep_no int, project_id string, bird_id string, dep_start timestamp, dep_end timestamp"


def study_rows(seed=2):
    """Two tags with tracks that jump now and then, bursts of quick fixes, and depths."""
    rng, rows = random.Random(seed), []
    for tag in (1, 2):
        clock, lat = 0, 40.0
        for i in range(160):
            clock += rng.choice([1, 1, 1, 30, 60])
            lat += rng.choice([0.0001, 0.0001, 0.0001, 0.3, -0.3])
            depth = rng.choice([None, 0.0, 2.0, 3.0])
            kind = rng.choice(["GPS", "GPS", "GPSD", "SEN_TDR"])
            fix = kind != "SEN_TDR"
            rows.append((tag, at(clock), tag * 1000 + i, kind, lat if fix else None, -125.0 if fix else None, depth, 3500.0, 12.0, 1.0))
    rows += [
        (1, at(5), 1900, "SEN_ACC_5Hz", 40.0, -125.0, None, 1.0, 1.0, 1.0),
        (1, at(7), 1901, "GPS", 0.0, 0.0, None, 3500.0, None, None),
        (3, at(7), 3000, "GPS", 40.0, -125.0, None, 3500.0, None, None),
        (None, at(8), 4000, "GPS", 40.0, -125.0, None, 3500.0, None, None),
        (1, None, 4001, "GPS", 40.0, -125.0, None, 3500.0, None, None),
    ]
    return rows


def deployed(spark):
    rows = [(1, 1, "P", "B1", at(-10), None), (2, 1, "P", "B2", at(-10), at(2000)), (2, 2, "P", "B2b", at(2500), None)]
    return spark.createDataFrame(rows, DEPLOYMENTS)


def test_rows_flags_and_labels(spark):
    rows = study_rows()
    records = spark.createDataFrame(rows, RECORDS).repartition(5)
    study = one_study.study_records(records, deployed(spark), drift_step_s=2, drift_steps=3, slice_s=100)
    got = {r.foid: r for r in study.collect()}
    inside = {
        r[2] for r in rows
        if r[0] in (1, 2) and r[1] is not None and r[3] != "SEN_ACC_5Hz"
        and (r[0] == 1 or not at(2000) <= r[1] <= at(2500))
    }
    assert set(got) == inside and study.count() == len(inside)
    assert set(study.columns) == {*records.columns, "gps_surfacedrifts", "mfilter"}
    for tag in (1, 2):
        own = sorted((r for r in got.values() if r.tag_id == tag), key=lambda r: (r.datetime, r.foid))
        fixes = [r for r in own if r.lat is not None]
        marked, i = set(), 0
        while i < len(fixes):
            j = i
            while j + 1 < len(fixes) and (fixes[j + 1].datetime - fixes[j].datetime).total_seconds() <= 2:
                j += 1
            if j - i >= 3:
                marked |= {r.foid for r in own if (fixes[i].datetime, fixes[i].foid) <= (r.datetime, r.foid) <= (fixes[j].datetime, fixes[j].foid)}
            i = j + 1
        assert marked and {r.foid for r in own if r.gps_surfacedrifts} == marked
    usable = [r for r in rows if r[2] in inside and r[4]]
    assert {f for f, r in got.items() if r.mfilter is not None} == {r[2] for r in usable}
    alone = spark.createDataFrame(usable, RECORDS)
    kept = {r.foid for r in speed.speed_filter(alone, key="tag_id").collect()}
    assert {f for f, r in got.items() if r.mfilter == "removed"} == {r[2] for r in usable} - kept
    assert 0 < len(kept) < len(usable)
    assert sum(r.mfilter == "end_location" for r in got.values()) == 8


def test_summary_days_and_speeds(spark):
    study = one_study.study_records(spark.createDataFrame(study_rows(), RECORDS), deployed(spark), 2, 3, slice_s=100)
    rows = study.collect()
    summary = {r.tag_id: r for r in one_study.study_summary(study).collect()}
    assert set(summary) == {1, 2}
    for tag, r in summary.items():
        own = [x for x in rows if x.tag_id == tag]
        assert r.gps_surfacedrift_pts == sum(x.gps_surfacedrifts for x in own)
        assert (r.min_dt, r.max_dt) == (min(x.datetime for x in own), max(x.datetime for x in own))
        assert r.n_gps == len({x.lat for x in own})
    speeds = one_study.track_speeds(study).collect()
    assert sum(r.n_fixes for r in speeds) == sum(x.mfilter is not None for x in rows)
    days = one_study.study_days(study, max_gap_s=60).collect()
    assert {r.tag_id for r in days} == {1, 2} and all(r.n >= 1 and r.max_depth == 3.0 for r in days)


def test_studies_without_rows(spark):
    empty = spark.createDataFrame([], RECORDS)
    study = one_study.study_records(empty, deployed(spark))
    assert study.count() == 0 and one_study.study_summary(study).count() == 0
    nowhere = one_study.study_records(spark.createDataFrame(study_rows(), RECORDS), deployed(spark).limit(0))
    assert nowhere.count() == 0


def test_report_without_row_labels_is_the_same(spark):
    """Drift and dives summarised apart give what labelled records give, groups without a dive included."""
    records = spark.createDataFrame(study_rows(3), RECORDS).withColumn("device_id", F.lit("d"))
    options = {"drift_steps": 3, "max_gap_s": 60, "slice_s": 200}
    wanted = studies.deployment_report(studies.annotate_records(records, deployed(spark), **options))
    got = studies.report_deployments(records, deployed(spark), **options)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, wanted.select(sorted(got.columns)).collect()))
    assert got.count() == 3
