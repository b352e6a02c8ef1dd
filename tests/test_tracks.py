import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import at, drift_flags, nearest, rms_speeds, speed_filtered
from pelagica.operators.drift import flag_surface_drift
from pelagica.operators.match import nearest_fix_same_day
from pelagica.operators.speed import rms_speed, settle, speed_filter


@pytest.mark.parametrize("width", [4, 100_000])
def test_drift_matches_brute_force(spark, width):
    rng = random.Random(width)
    tracks = {}
    for tag in range(150):
        t, rows = 0, []
        for _ in range(rng.randint(1, 30)):
            t += rng.choice([1, 1, 2, 2, 3])
            rows.append((t, 40.0 if rng.random() < 0.8 else None))
        tracks[tag] = rows
    data = [(k, at(t), i, lat) for k, rows in tracks.items() for i, (t, lat) in enumerate(rows)]
    df = spark.createDataFrame(data, "tag_id long, datetime timestamp, foid long, lat double")
    flagged = flag_surface_drift(df, 2, 5, slice_s=width)
    assert flagged.columns == [*df.columns, "gps_surfacedrifts"]
    got = {(r["tag_id"], r["foid"]): r["gps_surfacedrifts"] for r in flagged.collect()}
    assert len(got) == len(data)
    for tag, rows in tracks.items():
        assert [got[tag, i] for i in range(len(rows))] == drift_flags(rows, 2, 5), (tag, rows)


def test_drift_needs_enough_steps(spark):
    rows = [(1, at(i), i, 40.0) for i in range(5)] + [(2, at(i), i, 40.0) for i in range(6)]
    df = spark.createDataFrame(rows, "tag_id long, datetime timestamp, foid long, lat double")
    sums = flag_surface_drift(df).groupBy("tag_id").agg(F.sum("gps_surfacedrifts").alias("n"))
    assert {r["tag_id"]: r["n"] for r in sums.collect()} == {1: 0, 2: 6}


def random_tracks(seed, tracks=60):
    rng = random.Random(seed)
    out = {}
    for k in range(tracks):
        t, lat, lon, track = 0, 40.0, -125.0, []
        for _ in range(rng.choice([1, 5, 25, 25, 90])):
            t += rng.randint(30, 90)
            lat += rng.uniform(-0.004, 0.004)
            lon += rng.uniform(-0.004, 0.004)
            jump = rng.choice([0, 0, 0, 0, 0.3])
            track.append((t, lat + jump, lon))
        out[f"k{k}"] = track
    return out


def track_frame(spark, tracks):
    rows = [
        (k, at(t), i, lat, lon) for k, track in tracks.items() for i, (t, lat, lon) in enumerate(track)
    ]
    return spark.createDataFrame(
        rows, "uni_id string, datetime timestamp, foid long, lat double, lon double"
    )


@pytest.mark.parametrize("width", [100, 1_000_000])
def test_rms_speed(spark, width):
    tracks = random_tracks(5)
    got = {
        (r["uni_id"], r["foid"]): r["rms_speed"]
        for r in rms_speed(track_frame(spark, tracks), slice_s=width).collect()
    }
    for k, track in tracks.items():
        for i, want in enumerate(rms_speeds(track)):
            assert got[k, i] == (pytest.approx(want, rel=1e-9) if want is not None else None)


def test_speed_filter_runs_until_stable(spark):
    tracks = random_tracks(6, 8)
    df = track_frame(spark, tracks)
    expected = {(k, i) for k, track in tracks.items() for i in speed_filtered(track, 25)}
    assert len(expected) < df.count()
    # Two rounds at a time are not enough here, so all fixes are rated again.
    filtered = speed_filter(df, 25, slice_s=100, rounds=2)
    assert {(r["uni_id"], r["foid"]) for r in filtered.collect()} == expected
    labels = speed_filter(df, 25, slice_s=100, keep_removed=True)
    assert labels.count() == df.count()
    removed = {(r["uni_id"], r["foid"]) for r in labels.filter("mfilter = 'removed'").collect()}
    assert removed == {(k, i) for k, t in tracks.items() for i in range(len(t))} - expected
    ends = labels.filter("mfilter = 'end_location'").groupBy("uni_id").count().collect()
    assert all(r["count"] == min(4, len(tracks[r["uni_id"]])) for r in ends)


@pytest.mark.parametrize("seed", range(4))
def test_settle_matches_brute_force(seed):
    """Whole tracks settled at once, with fast runs of many lengths."""
    rng = random.Random(seed)
    tracks = []
    for k in range(30):
        t, lat, lon, track = 0, 40.0, -125.0, []
        for _ in range(rng.randint(1, 8)):
            fast = rng.random() < 0.4
            for _ in range(rng.randint(1, 30)):
                t += rng.choice([0, 1, 1, 1, 30])
                lat += rng.uniform(0.0004, 0.0008) if fast else rng.uniform(-0.00004, 0.00004)
                track.append((t, lat, lon))
        tracks.append(track)
    group = np.repeat(np.arange(30), [len(x) for x in tracks])
    flat = np.array([fix for track in tracks for fix in track])
    gone, opened = settle(group, flat[:, 0], flat[:, 1], flat[:, 2], np.zeros(len(flat), dtype=bool), 25)
    left = np.setdiff1d(np.arange(len(flat)), gone)
    start = np.concatenate(([0], np.cumsum([len(x) for x in tracks])))
    assert not len(opened) and len(gone) > 100
    assert left.tolist() == [start[k] + i for k, track in enumerate(tracks) for i in speed_filtered(track, 25)]


def test_speed_filter_of_a_long_fast_run(spark):
    """A thousand fixes at one a second from a plane: the effects reach far into the slow fixes around them."""
    lat, track = 40.0, []
    for i in range(3000):
        lat += 0.0006 if 1000 <= i < 2000 else 0.000001
        track.append((i, lat, -125.0))
    tracks = {"plane": track, "slow": [(i, 40 + i * 1e-6, -125.0) for i in range(200)]}
    df = track_frame(spark, tracks)
    arrays = np.array(track).T
    gone, _ = settle(np.zeros(3000, dtype=int), *arrays, np.zeros(3000, dtype=bool), 25)
    assert len(gone) > 1000
    want = {("plane", int(i)) for i in set(range(3000)) - set(gone.tolist())} | {("slow", i) for i in range(200)}
    for rounds in (2, 500):
        got = speed_filter(df, 25, slice_s=300, rounds=rounds)
        assert {(r["uni_id"], r["foid"]) for r in got.collect()} == want


def test_speed_filter_keeps_short_tracks(spark):
    tracks = {f"n{n}": [(i, 40.0 + i, -125.0) for i in range(n)] for n in (1, 2, 3, 4)}
    df = track_frame(spark, tracks)
    assert speed_filter(df).count() == df.count()


def test_antimeridian(spark):
    track = {"a": [(i * 60, 10.0, 179.9999 if i % 2 else -179.9999) for i in range(8)]}
    assert speed_filter(track_frame(spark, track)).count() == 8


@pytest.mark.parametrize("width", [50, 1_000_000])
def test_nearest_fix(spark, width):
    rng = random.Random(width)
    dives, fixes = [], []
    for tag in range(30):
        for day in range(3):
            base = day * 86_400
            dives += [(tag, day * 100 + i, base + rng.randrange(0, 600)) for i in range(6)]
            fixes += [(tag, base + t) for t in rng.sample(range(0, 600), rng.randint(0, 6))]
    dive_df = spark.createDataFrame(
        [(t, c, at(s)) for t, c, s in dives], "tag_id long, dive_chunk long, max_dt timestamp"
    ).withColumn("date", F.to_date("max_dt"))
    fix_df = spark.createDataFrame(
        [(t, at(s), i, float(i), 1.0, "GPS") for i, (t, s) in enumerate(fixes)],
        "tag_id long, datetime timestamp, foid long, lat double, lon double, datatype string",
    )
    got = nearest_fix_same_day(dive_df, fix_df, slice_s=width)
    found = {(r["tag_id"], r["dive_chunk"]): r for r in got.collect()}
    assert len(found) == len(dives)
    for tag, chunk, end in dives:
        own = [s for t, s in fixes if t == tag and s // 86_400 == end // 86_400]
        i, r = nearest(end, own), found[tag, chunk]
        if i is None:
            assert r["gps_time"] is None and r["gps_tdiff"] is None
        else:
            assert r["gps_time"] == at(own[i]) and r["gps_tdiff"] == own[i] - end


def test_nearest_fix_tie_goes_to_the_earlier(spark):
    dive = spark.createDataFrame([(1, 0, at(10))], "tag_id long, dive_chunk long, max_dt timestamp")
    fixes = spark.createDataFrame(
        [(1, at(12), 3, 2.0, 1.0, "GPS"), (1, at(8), 2, 1.0, 1.0, "GPS"), (1, at(8), 1, 0.0, 1.0, "GPS")],
        "tag_id long, datetime timestamp, foid long, lat double, lon double, datatype string",
    )
    row = nearest_fix_same_day(dive.withColumn("date", F.to_date("max_dt")), fixes).first()
    assert (row["gps_oid"], row["gps_tdiff"], row["lat"]) == (1, -2.0, 0.0)


def test_a_day_of_fast_fixes_settles_in_seconds():
    """One fix a second at a steady 30 m/s; a shorter one equals brute force."""
    def track(n):
        return np.arange(n) * 1.0, 40 + np.arange(n) * 30 / 111_195, np.full(n, -125.0)

    seconds, lat, lon = track(150)
    gone, _ = settle(np.zeros(150, dtype=int), seconds, lat, lon, np.zeros(150, dtype=bool), 25)
    left = sorted(set(range(150)) - set(gone.tolist()))
    assert left == list(speed_filtered(list(zip(seconds.tolist(), lat.tolist(), lon.tolist())), 25))
    n, start = 86_400, time.time()
    gone, opened = settle(np.zeros(n, dtype=int), *track(n), np.zeros(n, dtype=bool), 25)
    assert len(gone) == n - 4 and not len(opened) and time.time() - start < 60
