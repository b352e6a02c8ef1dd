import random

import pytest
from pyspark.sql import functions as F

from brute import at, dive_labels
from pelagica.operators import segments

SCHEMA = "tag_id long, datetime timestamp, foid long, depth_m double"


def frame(spark, tracks):
    rows = [
        (tag, at(t), i, d) for tag, track in tracks.items() for i, (t, d) in enumerate(track)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def labels(df):
    return {
        (r["tag_id"], r["foid"]): (r["chunk"], r["dive_chunk"], r["dive_no"]) for r in df.collect()
    }


def check(spark, tracks, cutoff, dive_depth, gap, points, width):
    got = labels(
        segments.dive_segments(frame(spark, tracks), cutoff, dive_depth, gap, points, slice_s=width)
    )
    for tag, track in tracks.items():
        expected = dive_labels(
            [t for t, _ in track], [d for _, d in track], cutoff, dive_depth, gap, points
        )
        for i, want in enumerate(expected):
            assert got[tag, i] == want, (tag, i, track)
    assert len(got) == sum(map(len, tracks.values()))


@pytest.mark.parametrize("width", [3, 100_000])
@pytest.mark.parametrize("points", [0, 2, 3])
def test_random_tracks(spark, width, points):
    rng = random.Random(points * 10 + width)
    tracks = {}
    for tag in range(250):
        t, track = 0, []
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([1, 1, 1, 2, 3])
            track.append((t, rng.choice([None, 0.0, 0.5, 1.0, 2.0, 3.0, 5.0])))
        tracks[tag] = track
    check(spark, tracks, 1, 3, 2, points, width)


def test_edges_of_the_definition(spark):
    def seq(*depths, step=1):
        return [(i * step, float(d)) for i, d in enumerate(depths)]

    tracks = {
        1: seq(0, 4, 4, 4, 0, step=2),  # steps equal to the gap stay together
        2: seq(0, 4, 4, 4, 0, step=3),  # larger steps split
        3: seq(4, 4, 4, 4, 4),  # never at the surface
        4: seq(4, 4, 4, 0, 0),  # starts under water
        5: seq(0, 0, 4, 4, 4),  # ends under water
        6: seq(0, 4, 4, 4, 0, 4, 4, 4, 0),  # one surface row between two dives
        7: seq(0, 4, 4, 0),  # span of exactly min_points steps is no dive
        8: seq(0, 4, 4, 4, 0),  # one step more is
        9: seq(0, 2, 2, 2, 0),  # too shallow
        10: [(0, 0.0), (1, 4.0), (2, None), (3, 4.0), (4, 4.0), (5, 4.0), (6, 0.0)],
        11: [(0, 9.0)],
        12: [(0, None), (1, None), (2, None)],
    }
    for width in (2, 1000):
        check(spark, tracks, 1, 3, 2, 3, width)
    got = labels(segments.dive_segments(frame(spark, tracks), slice_s=1000))
    assert got[6, 4] == (0, 0, 2)
    assert got[7, 1] == (0, 0, None)
    assert got[8, 0] == (0, 0, 1)


def test_one_tag_with_one_endless_chunk(spark):
    depth = (F.col("id") % 20).cast("double")
    df = spark.range(20_000).select(
        F.lit(7).cast("long").alias("tag_id"),
        F.timestamp_seconds("id").alias("datetime"),
        F.col("id").alias("foid"),
        depth.alias("depth_m"),
    )
    narrow = segments.dive_segments(df, slice_s=97)
    wide = segments.dive_segments(df, slice_s=1_000_000)
    assert narrow.exceptAll(wide).isEmpty() and wide.exceptAll(narrow).isEmpty()
    assert narrow.agg(F.max("dive_no")).first()[0] == 1000


def test_chunks_and_summaries(spark):
    df = frame(spark, {1: [(0, 0.0), (1, 4.0), (2, 6.0), (3, 5.0), (4, 0.0), (50, 9.0)]})
    row = segments.dive_chunks(df, slice_s=2).first()
    assert (row["n"], row["max_depth"], row["first_depth"], row["last_depth"]) == (5, 6.0, 0.0, 0.0)
    dives = segments.dive_segments(df, slice_s=2)
    summary = segments.dive_summary(dives).collect()
    assert [(r["dive_chunk"], r["u_depth"], r["dur_s"]) for r in summary] == [(0, 3.0, 4.0)]
    assert segments.daily_dives(dives).first()["n"] == 1
    assert segments.daily_dives(dives, count_null=True).first()["n"] == 2
    assert segments.mean_daily_dives(segments.daily_dives(dives)).first()["udives_day"] == 1


def test_surface_intervals(spark):
    dive = [0.0, 4.0, 4.0, 4.0, 0.0]
    track = [(i, d) for i, d in enumerate(dive)] + [(100 + i, d) for i, d in enumerate(dive)]
    dives = segments.dive_segments(frame(spark, {1: track}), slice_s=3)
    got = [r["surface_s"] for r in segments.surface_intervals(dives, slice_s=3).orderBy("dive_start").collect()]
    assert got == [96.0, None]


def test_time_delta(spark):
    df = frame(spark, {1: [(0, 1.0), (2, 1.0), (7, 1.0)], 2: [(3, 1.0)]}).drop("depth_m")
    got = {
        (r["tag_id"], r["foid"]): (r["tdiff_sec"], r["next_sec"])
        for r in segments.time_delta(df, slice_s=1).collect()
    }
    assert got == {(1, 0): (None, 2.0), (1, 1): (2.0, 5.0), (1, 2): (5.0, None), (2, 0): (None, None)}


@pytest.mark.parametrize("width", [1, 1000])
def test_run_lengths(spark, width):
    df = frame(spark, {1: [(i, float(d)) for i, d in enumerate([0, 5, 5, 0, 0, 0, 5])]})
    runs = segments.run_lengths(df, F.col("depth_m") > 1, slice_s=width).orderBy("run").collect()
    assert [(r["value"], r["length"], r["start_foid"], r["end_foid"]) for r in runs] == [
        (False, 1, 0, 0),
        (True, 2, 1, 2),
        (False, 3, 3, 5),
        (True, 1, 6, 6),
    ]
