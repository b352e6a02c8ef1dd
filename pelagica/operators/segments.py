"""Gaps, runs and dives on a depth series.

All steps work on time slices (see ``slices``), so neither a hot tag nor a hot
chunk ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import half_even
from ..functions.time import seconds_between
from ..session import checkpointed
from .slices import DAY_S, SLICE, sliced, with_neighbours, with_slice


def time_delta(
    df: DataFrame,
    keys: Sequence[str] = ("tag_id",),
    time: str = "datetime",
    tie: str = "foid",
    slice_s: int = DAY_S,
) -> DataFrame:
    """Seconds to the previous and to the next row of the same key.

    The difference to the next row is absolute, as drift detection wants it.
    """
    near = with_neighbours(with_slice(df, slice_s, time), [], keys, (time, tie))
    return near.withColumns(
        {
            "tdiff_sec": seconds_between(F.col("before")[time], F.col(time)),
            "next_sec": F.abs(seconds_between(F.col(time), F.col("after")[time])),
        }
    ).drop("before", "after", SLICE)


def run_lengths(
    df: DataFrame,
    predicate: Column,
    keys: Sequence[str] = ("tag_id",),
    time: str = "datetime",
    tie: str = "foid",
    slice_s: int = DAY_S,
) -> DataFrame:
    """Run-length encoding of a predicate along each key's timeline.

    One row per run: its number, value, first and last row, and length.  A NULL
    predicate counts as false.
    """
    rows = with_slice(df.select(*keys, time, tie, predicate.alias("_p")), slice_s, time)
    rows = rows.withColumn("value", F.coalesce("_p", F.lit(False)))
    numbered = with_neighbours(
        rows,
        ["value"],
        keys,
        (time, tie),
        counts={"run": lambda prior, row: ~row["value"].eqNullSafe(prior["value"])},
    )
    here = F.struct(time, tie)
    return (
        numbered.groupBy(*keys, "run")
        .agg(
            F.first("value").alias("value"),
            F.count("*").alias("length"),
            F.min(here).alias("_s"),
            F.max(here).alias("_e"),
        )
        .select(
            *keys,
            "run",
            "value",
            "length",
            F.col("_s")[time].alias("run_start"),
            F.col("_s")[tie].alias("start_foid"),
            F.col("_e")[time].alias("run_end"),
            F.col("_e")[tie].alias("end_foid"),
        )
    )


def _longer(prior: Column, later: Column, time: str, seconds: float) -> Column:
    """Whether two rows lie further apart than ``seconds``; false without one."""
    return F.coalesce(seconds_between(prior[time], later[time]) > seconds, F.lit(False))


def _flag_rows(
    rows: DataFrame, max_gap_s: float, depth_cutoff: float, key: str, time: str, tie: str, depth: str
) -> DataFrame:
    """Number the gap chunk and the surface/submerged run of every row."""

    def under(row: Column) -> Column:
        return F.coalesce(row[depth] >= F.lit(depth_cutoff), F.lit(False))

    def gap(prior: Column, row: Column) -> Column:
        return _longer(prior, row, time, max_gap_s)

    def turns(prior: Column, row: Column) -> Column:
        return prior.isNull() | gap(prior, row) | (under(row) != under(prior))

    near = with_neighbours(
        rows, [depth], [key], (time, tie), counts={"chunk": gap, "run": turns}
    )
    here, prior, later = F.struct(time, depth), F.col("before"), F.col("after")
    return near.withColumns(
        {
            "opens": prior.isNull() | gap(prior, here),
            "closes": later.isNull() | gap(here, later),
            "submerged": under(here),
            "under_before": under(prior),
            "under_after": under(later),
        }
    ).drop("before", "after")


def dive_chunks(
    df: DataFrame,
    dive_depth: float = 3,
    max_gap_s: float = 2,
    min_points: int = 3,
    key: str = "tag_id",
    time: str = "datetime",
    tie: str = "foid",
    depth: str = "depth_m",
    slice_s: int = DAY_S,
) -> DataFrame:
    """Continuously recorded chunks that reach the dive depth.

    A new chunk starts where the step from the previous row exceeds
    ``max_gap_s``; kept are chunks of at least ``min_points`` rows with a
    maximum depth of at least ``dive_depth``.
    """
    rows = sliced(df, [key, time, tie, depth], slice_s, time)
    numbered = with_neighbours(
        rows,
        [],
        [key],
        (time, tie),
        counts={"chunk": lambda prior, row: _longer(prior, row, time, max_gap_s)},
    )
    place = F.struct(time, tie, depth)
    return (
        numbered.groupBy(key, "chunk")
        .agg(
            F.count("*").alias("n"),
            F.max(depth).alias("max_depth"),
            F.min(tie).alias("min_foid"),
            F.max(tie).alias("max_foid"),
            F.min(place).alias("_s"),
            F.max(place).alias("_e"),
        )
        .filter((F.col("max_depth") >= dive_depth) & (F.col("n") >= min_points))
        .select(
            key,
            "chunk",
            "n",
            "max_depth",
            "min_foid",
            "max_foid",
            F.col("_s")[time].alias("min_dt"),
            F.col("_e")[time].alias("max_dt"),
            F.col("_s")[depth].alias("first_depth"),
            F.col("_e")[depth].alias("last_depth"),
        )
    )


def dive_segments(
    df: DataFrame,
    depth_cutoff: float = 1,
    dive_depth: float = 3,
    max_gap_s: float = 2,
    min_points: int = 3,
    key: str = "tag_id",
    time: str = "datetime",
    tie: str = "foid",
    depth: str = "depth_m",
    slice_s: int = DAY_S,
) -> DataFrame:
    """Label every depth row with its chunk and its dive.

    ``chunk`` counts the gaps before the row, ``dive_chunk`` is that number for
    chunks that reach ``dive_depth`` with at least ``min_points`` rows, and
    ``dive_no`` numbers the dives of such a chunk from 1.  A dive is a maximal
    run at or below ``depth_cutoff`` plus the surface row on either side where
    the chunk has one; it counts when its last row lies more than
    ``min_points`` rows after its first.  A surface row between two dives
    belongs to the later one.  Other rows carry NULL.
    """
    rows = sliced(df, [key, time, tie, depth], slice_s, time)
    # Read twice below; written once instead of being worked out twice.
    rows = checkpointed(_flag_rows(rows, max_gap_s, depth_cutoff, key, time, tie, depth))

    # One row per run and slice, of which all that follows is made; then per
    # run, and the chunks deep enough.
    pieces = rows.groupBy(key, SLICE, "chunk", "run").agg(
        F.count("*").alias("n"),
        F.max(depth).alias("deepest"),
        F.max("opens").alias("opens"),
        F.max("closes").alias("closes"),
        F.max("submerged").alias("submerged"),
    )
    pieces = checkpointed(pieces)
    runs = pieces.groupBy(key, "chunk", "run").agg(
        F.sum("n").alias("n"),
        F.max("opens").alias("opens"),
        F.max("closes").alias("closes"),
        F.max("submerged").alias("submerged"),
        F.min(SLICE).alias(SLICE),
    )
    deep = (
        pieces.groupBy(key, "chunk")
        .agg(F.sum("n").alias("_n"), F.max("deepest").alias("_deepest"))
        .filter((F.col("_deepest") >= dive_depth) & (F.col("_n") >= min_points))
        .select(key, "chunk")
    )
    steps = F.col("n") - 1 + (~F.col("opens")).cast("int") + (~F.col("closes")).cast("int")
    runs = runs.join(deep, [key, "chunk"]).withColumn(
        "is_dive", F.col("submerged") & (steps > min_points)
    )
    near = with_neighbours(
        runs,
        ["is_dive"],
        [key, "chunk"],
        ("run",),
        counts={"count": lambda prior, run: run["is_dive"]},
    )
    # Dives before a run, itself included, give its own number and those of the
    # runs on either side.
    count, is_dive = F.col("count"), F.col("is_dive")
    numbered = near.select(
        key,
        "chunk",
        "run",
        F.when(is_dive, count).alias("own"),
        F.when(F.col("before")["is_dive"], count - is_dive.cast("long")).alias("own_before"),
        F.when(F.col("after")["is_dive"], count + 1).alias("own_after"),
        F.lit(True).alias("_deep"),
    )
    # The numbers of a slice's runs, which follow each other, as one array: the join back is on the slice, where the rows
    # already are, and never meets a larger key.
    spread = pieces.select(key, SLICE, "chunk", "run").join(numbered, [key, "chunk", "run"], "left")
    numbers = spread.groupBy(key, SLICE).agg(
        F.min("run").alias("_first_run"),
        F.sort_array(F.collect_list(F.struct("run", "own", "own_before", "own_after", "_deep"))).alias("_runs"),
    )
    place = (F.col("run") - F.col("_first_run")).cast("int")
    labelled = rows.join(numbers, [key, SLICE]).withColumn("_n", F.get("_runs", place))
    labelled = labelled.select("*", "_n.own", "_n.own_before", "_n.own_after", "_n._deep")
    surface_number = F.coalesce(
        F.when(~F.col("closes") & F.col("under_after"), F.col("own_after")),
        F.when(~F.col("opens") & F.col("under_before"), F.col("own_before")),
    )
    return labelled.select(
        key,
        time,
        tie,
        depth,
        "chunk",
        F.when(F.col("_deep"), F.col("chunk")).alias("dive_chunk"),
        F.when(F.col("submerged"), F.col("own")).otherwise(surface_number).alias("dive_no"),
    )


def dive_summary(dives: DataFrame, key: str = "tag_id") -> DataFrame:
    """One row per tag and dive chunk."""
    return (
        dives.filter(F.col("dive_chunk").isNotNull())
        .groupBy(key, "dive_chunk")
        .agg(
            F.min("datetime").alias("min_dt"),
            F.max("datetime").alias("max_dt"),
            F.max("depth_m").alias("max_depth"),
            half_even(F.avg("depth_m"), 2).alias("u_depth"),
        )
        .withColumns(
            {
                "dur_s": seconds_between("min_dt", "max_dt"),
                "date": F.to_date("min_dt"),
            }
        )
    )


def daily_dives(
    dives: DataFrame, key: str = "tag_id", count_null: bool = False, both: bool = False
) -> DataFrame:
    """Dive chunks, times and depths per tag and day.

    With ``count_null`` rows outside any dive chunk count as one more; ``both``
    adds that count as ``n_with_null`` beside the plain one.
    """
    chunks = F.countDistinct("dive_chunk")
    with_null = chunks + F.max(F.col("dive_chunk").isNull().cast("int"))
    more = [with_null.alias("n_with_null")] if both else []
    return dives.groupBy(key, F.to_date("datetime").alias("date")).agg(
        (with_null if count_null else chunks).alias("n"),
        *more,
        F.min("datetime").alias("min_dt"),
        F.max("datetime").alias("max_dt"),
        F.max("depth_m").alias("max_depth"),
        half_even(F.avg("depth_m"), 2).alias("u_depth"),
    )


def mean_daily_dives(daily: DataFrame, key: str = "tag_id") -> DataFrame:
    """Mean dives a day, rounded down."""
    return daily.groupBy(key).agg(
        F.floor(F.sum("n") / F.count("n")).cast("long").alias("udives_day")
    )


def dive_bouts(dives: DataFrame, key: str = "tag_id") -> DataFrame:
    """Start, end and depth of every single dive."""
    return (
        dives.filter(F.col("dive_no").isNotNull())
        .groupBy(key, "dive_chunk", "dive_no")
        .agg(
            F.min("datetime").alias("dive_start"),
            F.max("datetime").alias("dive_end"),
            F.count("*").alias("n"),
            F.max("depth_m").alias("max_depth"),
        )
    )


def surface_intervals(
    dives: DataFrame, key: str = "tag_id", slice_s: int = DAY_S
) -> DataFrame:
    """Time from the end of each dive to the start of the tag's next one."""
    # One small row per dive, looked at from both sides: written once.
    bouts = checkpointed(with_slice(dive_bouts(dives, key), slice_s, "dive_start"))
    near = with_neighbours(bouts, [], [key], ("dive_start", "dive_chunk", "dive_no"))
    return near.select(
        key,
        "dive_chunk",
        "dive_no",
        "dive_start",
        "dive_end",
        F.col("after")["dive_start"].alias("next_start"),
        seconds_between(F.col("dive_end"), F.col("after")["dive_start"]).alias("surface_s"),
    )
