import random

import pytest
from pyspark.sql import functions as F

from pelagica.operators import segments
from pelagica.operators.slices import SLICE
from pelagica.session import scratch_path
from pelagica.sources import timelines

SCHEMA = "tag_id int, datetime timestamp, foid long, depth_m double"
HOT = "SELECT * FROM (SELECT 7 AS tag_id, timestamp_seconds(1700000000 + id * 60) AS datetime, id AS foid, double(id % 5) AS depth_m FROM range({n}))"


def records(spark, seed=2):
    rng = random.Random(seed)
    rows, at = [], 1_700_000_000
    for i in range(4000):
        at += rng.choice([1, 1, 1, 2, 3, 4000])
        rows.append((rng.choice([1, 1, 1, 2, None]), float(at), i, rng.choice([0.0, 0.2, 2.0, 5.0, 9.0, None])))
    rows.append((1, None, 9000, 4.0))
    frame = spark.createDataFrame(rows, "tag_id int, at double, foid long, depth_m double")
    return frame.select("tag_id", F.col("at").cast("timestamp").alias("datetime"), "foid", "depth_m")


def plain(df):
    return sorted(map(str, df.collect()))


def test_a_stored_timeline_gives_the_same_dives(spark):
    df = records(spark)
    want = plain(segments.dive_segments(df))
    path = scratch_path(spark, "timeline")
    timelines.write_timeline(df, path, 5, 3600)
    stored = timelines.read_timeline(spark, path)
    assert plain(stored.drop(SLICE)) == plain(df)
    assert plain(segments.dive_segments(stored)) == want
    # a session that didn't write it
    spark.sql(f"DROP TABLE {timelines._table(path)}")
    again = timelines.read_timeline(spark, path)
    assert again.schema == stored.schema and plain(segments.dive_segments(again)) == want
    timelines.write_timeline(df.limit(10), path, 3, 3600)
    assert timelines.read_timeline(spark, path).count() == 10
    timelines.write_timeline(df.limit(0), path, 3)
    assert timelines.read_timeline(spark, path).isEmpty()


def test_an_unfinished_timeline_is_not_read(spark):
    path = scratch_path(spark, "timeline")
    records(spark).write.parquet(f"{path}/rows")
    with pytest.raises(Exception, match="(?i)path"):
        timelines.read_timeline(spark, path)


def exchanges(df):
    """Keys of the exchanges in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_windows_on_a_stored_hot_tag_move_no_rows(spark):
    """Broadcast off: only summaries of slices move, and the one tag fills all buckets alike."""
    path = scratch_path(spark, "timeline")
    timelines.write_timeline(spark.sql(HOT.format(n=40_000)), path, 8, 3600)
    stored = timelines.read_timeline(spark, path)
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = segments._flag_rows(stored, 2, 1, "tag_id", "datetime", "foid", "depth_m")
        by_row = [line for line in exchanges(rows) if "foid" in line or "depth_m" in line]
        # nothing under a window over (tag, slice) is exchanged: the scan feeds it
        moved = [line for line in exchanges(rows) if SLICE in line.split("hashpartitioning")[1].split("), ")[0]]
        assert not by_row and len(moved) <= 1
        assert rows.count() == 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
