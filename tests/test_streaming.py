import os
import random

import pytest
from pyspark.sql import functions as F

from brute import at
from pelagica import session
from pelagica.operators import segments
from pelagica.session import scratch_path
from pelagica.streaming import dives, jobs

SCHEMA = "tag_id long, datetime timestamp, foid long, depth_m double, u_bat_mv double"


@pytest.fixture()
def arrivals(spark, tmp_path):
    """Twelve files in order of time; chunks reach over file ends."""
    rng = random.Random(3)
    rows, clock = [], {tag: 0 for tag in range(8)}
    for i in range(1200):
        tag = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])
        clock[tag] += rng.choice([1, 1, 1, 2, 2, 9])
        rows.append((tag, clock[tag], i))
    rows.sort(key=lambda r: r[1])
    path, size = str(tmp_path / "in"), 100
    for k in range(0, len(rows), size):
        part = [
            (tag, at(t), foid, float(rng.choice([0, 0, 4, 4, 5])), 1.0) for tag, t, foid in rows[k : k + size]
        ]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_dives_equal_batch_on_closed_chunks(spark, arrivals):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    stream = jobs.stream_files(spark, arrivals, SCHEMA, glob="*.parquet", files_per_batch=3)
    each = dives.dive_batches(out, state, max_gap_s=2, slice_s=50)
    checkpoint = scratch_path(spark, "checkpoint")
    jobs.run_batches(stream, each, checkpoint)
    jobs.run_batches(stream, each, checkpoint)  # nothing new: nothing changes
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() > 1

    batch = segments.dive_segments(spark.read.parquet(arrivals), slice_s=50)
    chunks = batch.groupBy("tag_id", "chunk").agg(
        F.min("datetime").alias("chunk_start"), F.max("datetime").alias("_end")
    )
    latest = batch.groupBy("tag_id").agg(F.max("datetime").alias("_latest"))
    expected = (
        batch.join(chunks, ["tag_id", "chunk"])
        .join(latest, "tag_id")
        .filter(F.unix_timestamp("_end") < F.unix_timestamp("_latest") - 2)
        .withColumn("is_dive_chunk", F.col("dive_chunk").isNotNull())
        .select(*got.drop("batch").columns)
    )
    got = got.drop("batch")
    assert expected.count() > 900
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_replayed_batch_writes_the_same(spark, arrivals):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    each = dives.dive_batches(out, state, max_gap_s=2)
    rows = spark.read.parquet(arrivals).orderBy("datetime").limit(600)
    each(rows, 0)
    first = spark.read.parquet(out).count()
    each(rows, 0)
    assert spark.read.parquet(out).count() == first
    assert first + spark.read.parquet(f"{state}/open").count() == 600


def test_a_tag_that_sends_late_keeps_its_chunk(spark):
    """One unbroken series in two parts, the second after much later rows of another tag."""
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    each = dives.dive_batches(out, state, max_gap_s=2)

    def rows(tag, start, n, offset=0):
        return [(tag, at(start + i), offset + i, 5.0, 1.0) for i in range(n)]

    batches = [rows(1, 0, 8), rows(2, 90_000, 5), rows(1, 8, 8, 8) + rows(2, 99_000, 5, 5), rows(1, 500, 1, 16) + [(3, None, 0, 5.0, 1.0), (None, at(1), 0, 5.0, 1.0)]]
    batches.append(rows(1, 3, 1, 99) + rows(1, 16, 1, 98))  # both within the closed chunk's time
    for k, part in enumerate(batches):
        each(spark.createDataFrame(part, SCHEMA), k)
    got = spark.read.parquet(out)
    chunks = {(r["tag_id"], r["chunk_start"]): r["n"] for r in got.groupBy("tag_id", "chunk_start").agg(F.count("*").alias("n")).collect()}
    assert chunks == {(1, at(0)): 16, (2, at(90_000)): 5}
    late = {(r["tag_id"], r["foid"]) for r in spark.read.parquet(f"{out}-late").collect()}
    assert late == {(3, 0), (None, 0), (1, 99), (1, 98)}
    left = spark.read.parquet(f"{state}/open").filter("batch = 4").count()
    assert left == 6 and spark.read.parquet(f"{state}/open").select("batch").distinct().count() == 2


def test_ingest_reads_every_file_once(spark, arrivals):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    stream = jobs.stream_files(spark, arrivals, SCHEMA, glob="*.parquet", files_per_batch=2)
    jobs.run_available(stream, out, checkpoint)
    assert spark.read.parquet(out).count() == 1200
    more = spark.createDataFrame([(1, at(10**6), 5000, 0.0, 1.0)], SCHEMA)
    more.write.mode("append").parquet(arrivals)
    jobs.run_available(stream, out, checkpoint)
    assert spark.read.parquet(out).count() == 1201


def test_windows_and_sessions_close(spark, arrivals):
    spark.createDataFrame([(99, at(10**6), 9999, 0.0, 1.0)], SCHEMA).write.mode("append").parquet(arrivals)
    stream = jobs.stream_files(spark, arrivals, SCHEMA, glob="*.parquet", files_per_batch=100)
    out = scratch_path(spark, "sessions")
    jobs.run_available(jobs.sessions(stream, "3 seconds", "0 seconds"), out, scratch_path(spark, "c"))
    closed = spark.read.parquet(out).filter("tag_id <> 99")
    batch = segments.dive_segments(spark.read.parquet(arrivals), max_gap_s=3).filter("tag_id <> 99")
    assert closed.agg(F.sum("n")).first()[0] == 1200
    assert closed.count() == batch.select("tag_id", "chunk").distinct().count()
    out = scratch_path(spark, "daily")
    jobs.run_available(jobs.daily_counts(stream, "0 seconds"), out, scratch_path(spark, "c"))
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 1200
    out = scratch_path(spark, "status")
    status = jobs.trailing_status(stream, "7 days", "1 day", "0 seconds")
    jobs.run_available(status, out, scratch_path(spark, "c"))
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 7 * 1200


def test_dedupe_keeps_the_first_row_whatever_comes_first(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    stream = jobs.stream_files(spark, path, SCHEMA, glob="*.parquet")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "c")
    # the row that comes first in the file's order arrives last
    for rows in (
        [(1, at(0), 2, 7.0, None), (1, at(5), 3, 0.0, 1.0), (2, at(5), 9, None, 1.0)],
        [(1, at(0), 1, None, 4.0), (1, at(5), 4, 0.0, 1.0), (2, at(5), 5, 2.0, 1.0), (1, at(0), 3, 0.0, 1.0)],
        [(3, at(100), 1, 0.0, 1.0)],
        [(1, at(0), 0, 0.0, 1.0)],  # behind the watermark
    ):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        jobs.run_available(jobs.dedupe(stream, "10 seconds"), out, checkpoint)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {(1, at(0), 1, None, 4.0), (1, at(5), 3, 0.0, 1.0), (2, at(5), 5, 2.0, 1.0)}


def test_row_numbers_of_log_batches_never_meet(spark, tmp_path):
    logs, out = tmp_path / "logs", scratch_path(spark, "out")
    logs.mkdir()
    each = jobs.log_batches(out, min_bytes=0)
    checkpoint = scratch_path(spark, "c")
    for k in range(3):
        (logs / f"7_{k}.csv").write_text("UTC_datetime,depth_m\n" + f"2024-01-01 00:00:0{k},{k}\n" * 3)
        jobs.run_batches(jobs.stream_log_files(spark, str(logs)), each, checkpoint)
    rows = spark.read.parquet(out).orderBy("foid").collect()
    assert len({r["foid"] for r in rows}) == 9 and [r["depth_m"] for r in rows] == [0.0] * 3 + [1.0] * 3 + [2.0] * 3


def _shared_files(spark):
    folder = session.shared_dir(spark).removeprefix("file:")
    return sum(name.startswith("part-") for _, _, names in os.walk(folder) for name in names)


def test_shared_folder_stays_as_it_is_over_many_batches(spark, arrivals, tmp_path):
    """Open rows are all that a batch leaves in the shared folder; output and state lie elsewhere here."""
    out, state, seen = str(tmp_path / "out"), str(tmp_path / "state"), []
    each = dives.dive_batches(out, state, max_gap_s=2, slice_s=50)

    def watched(batch, batch_id):
        before = _shared_files(spark)
        each(batch, batch_id)
        kept = sum(len(os.listdir(f"{state}/{kind}")) for kind in ("open", "ends"))
        seen.append((_shared_files(spark) - before, kept))

    stream = jobs.stream_files(spark, arrivals, SCHEMA, glob="*.parquet", files_per_batch=1)
    jobs.run_batches(stream, watched, str(tmp_path / "checkpoint"))
    assert len(seen) == 12
    assert {more for more, _ in seen} == {0} and max(kept for _, kept in seen) == 4


def test_scopes_delete_their_own_only(spark):
    rows = spark.range(10)
    outside = session.checkpointed(rows)
    with session.scratch_scope(spark):
        before = _shared_files(spark)
        assert session.checkpointed(rows).count() == 10
        inner = session.scratch_path(spark, "inner")
        rows.write.parquet(inner)
        assert _shared_files(spark) > before
    assert _shared_files(spark) == before and outside.count() == 10
