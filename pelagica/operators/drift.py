"""Surface drift: bursts of fixes in quick succession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import seconds_between
from .slices import DAY_S, SLICE, fill_from_neighbours, with_neighbours, with_slice


def drift_spans(
    df: DataFrame,
    max_step_s: float = 2,
    min_steps: int = 5,
    keys: Sequence[str] = ("tag_id",),
    slice_s: int = DAY_S,
) -> DataFrame:
    """Bursts of at least ``min_steps`` consecutive quick steps between fixes.

    One row per burst, from its first fix to the fix its last step leads to.
    """
    order = ("datetime", "foid")
    fixes = df.filter(F.col("lat").isNotNull()).select(*keys, *order)
    def quick(prior: Column, row: Column) -> Column:
        step = F.abs(seconds_between(prior["datetime"], row["datetime"]))
        return F.coalesce(step <= max_step_s, F.lit(False))

    # A burst starts at a fix without a quick step before it.
    numbered = with_neighbours(
        with_slice(fixes, slice_s),
        [],
        keys,
        order,
        counts={"burst": lambda prior, row: ~quick(prior, row)},
    ).withColumn("quick", quick(F.struct(*order), F.col("after")))
    return (
        numbered.filter("quick")
        .groupBy(*keys, "burst")
        .agg(
            F.count("*").alias("steps"),
            F.min(F.struct(*order)).alias("span_start"),
            F.max("after").alias("span_end"),
        )
        .filter(F.col("steps") >= min_steps)
        .drop("burst")
    )


def flag_surface_drift(
    df: DataFrame,
    max_step_s: float = 2,
    min_steps: int = 5,
    keys: Sequence[str] = ("tag_id",),
    slice_s: int = DAY_S,
) -> DataFrame:
    """Add ``gps_surfacedrifts``: 1 for all rows inside a burst, else 0.

    Spans never overlap, so a row is inside one exactly when the latest span
    started at or before it has not ended yet.  The spans are merged into the
    timeline as marker rows and filled forward.
    """
    order = ("datetime", "foid")
    spans = drift_spans(df, max_step_s, min_steps, keys, slice_s)
    markers = spans.select(
        *keys,
        F.col("span_start")["datetime"].alias("datetime"),
        F.col("span_start")["foid"].alias("foid"),
        F.struct("span_start", "span_end").alias("_span"),
        F.lit(0).alias("_is_row"),
    )
    rows = df.withColumn("_is_row", F.lit(1)).unionByName(markers, allowMissingColumns=True)
    filled = fill_from_neighbours(
        with_slice(rows, slice_s), "_span", keys, (*order, "_is_row"), last="_open"
    ).filter("_is_row = 1")
    inside = F.struct(*order) <= F.col("_open")["span_end"]
    return filled.withColumn(
        "gps_surfacedrifts", F.coalesce(inside, F.lit(False)).cast("int")
    ).drop("_span", "_open", "_is_row", SLICE)
