import random

import pytest
from pyspark.sql import functions as F

from brute import at
from pelagica.operators.slices import (
    SLICE,
    fill_from_neighbours,
    measure_slice_seconds,
    running_sums,
    with_neighbours,
    with_slice,
)


def timeline(spark, seed=1, tags=40):
    rng = random.Random(seed)
    rows = []
    for tag in range(tags):
        t = 0.0
        for i in range(rng.randint(1, 30)):
            t += rng.choice([0.5, 1, 2, 3, 9, 40])
            rows.append((tag, at(t), tag * 1000 + i, rng.randint(0, 5)))
    return rows, spark.createDataFrame(rows, "tag_id long, datetime timestamp, foid long, v long")


def by_tag(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_neighbours_and_counts_cross_slices(spark, width):
    rows, df = timeline(spark)
    got = {
        r["foid"]: r
        for r in with_neighbours(
            with_slice(df, width),
            ["v"],
            reach=2,
            counts={"rises": lambda prior, row: row["v"] > prior["v"]},
        ).collect()
    }
    for group in by_tag(rows).values():
        rises = 0
        for i, row in enumerate(group):
            if i and row[3] > group[i - 1][3]:
                rises += 1
            r = got[row[2]]
            for name, j in (("before2", i - 2), ("before", i - 1), ("after", i + 1), ("after2", i + 2)):
                expected = group[j][2] if 0 <= j < len(group) else None
                assert (r[name]["foid"] if r[name] else None) == expected, name
            assert r["rises"] == rises


def test_rows_without_a_time_come_first(spark):
    """Before 1970 as well, and in the order of their numbers over many slices."""
    from pelagica.operators import slices

    rows = [(1, None, i, i) for i in range(40)] + [(1, at(-60 * 365 * 86_400 + i), 100 + i, i) for i in range(5)] + [(1, at(5), 200, 1)]
    df = spark.createDataFrame(rows, "tag_id long, datetime timestamp, foid long, v long")
    target, slices.TARGET_ROWS = slices.TARGET_ROWS, 7
    try:
        sliced = with_slice(df, 100)
        assert sliced.filter("datetime IS NULL").select(SLICE).distinct().count() == 6
        got = {r["foid"]: r["n"] for r in running_sums(sliced, {"n": F.lit(1)}).collect()}
    finally:
        slices.TARGET_ROWS = target
    assert got == {row[2]: i + 1 for i, row in enumerate(rows)}


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_sums(spark, width):
    rows, df = timeline(spark, 2)
    summed = running_sums(with_slice(df, width), {"s": F.col("v"), "n": F.lit(1)})
    got = {r["foid"]: (r["s"], r["n"]) for r in summed.collect()}
    for group in by_tag(rows).values():
        total = 0
        for i, row in enumerate(group):
            total += row[3]
            assert got[row[2]] == (total, i + 1)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_fill_both_ways(spark, width):
    rows, df = timeline(spark, 3)
    marked = df.withColumn("m", F.when(F.col("v") == 0, F.struct("datetime", "foid")))
    filled = fill_from_neighbours(with_slice(marked, width), "m", last="l", following="f")
    got = {r["foid"]: r for r in filled.collect()}
    for group in by_tag(rows).values():
        zeros = [i for i, row in enumerate(group) if row[3] == 0]
        for i, row in enumerate(group):
            last = max([z for z in zeros if z <= i], default=None)
            following = min([z for z in zeros if z > i], default=None)
            r = got[row[2]]
            assert (r["l"]["foid"] if r["l"] else None) == (group[last][2] if last is not None else None)
            assert (r["f"]["foid"] if r["f"] else None) == (
                group[following][2] if following is not None else None
            )


def test_hot_tag_is_split(spark):
    hot = spark.range(40_000).select(
        F.lit(1).alias("tag_id"), F.timestamp_seconds(F.col("id") / 4).alias("datetime")
    )
    cold = spark.range(100).select(
        F.lit(2).alias("tag_id"), F.timestamp_seconds(F.col("id") * 60).alias("datetime")
    )
    records = hot.unionByName(cold)
    width = measure_slice_seconds(records, target_rows=1000)
    fullest = (
        with_slice(records, width).groupBy("tag_id", SLICE).count().agg(F.max("count")).first()[0]
    )
    assert fullest <= 1000
    assert measure_slice_seconds(cold, target_rows=1000) > 3600


def test_rows_without_time_stay(spark):
    df = spark.createDataFrame(
        [(1, None, 1), (1, at(5), 2)], "tag_id long, datetime timestamp, foid long"
    )
    got = {r["foid"]: r["before"] for r in with_neighbours(with_slice(df, 10), []).collect()}
    assert got[1] is None and got[2]["foid"] == 1
