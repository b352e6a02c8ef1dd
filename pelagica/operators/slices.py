"""Ordered work on a tag's timeline, split into time slices.

A window over a whole tag puts that tag into one task, and one tag may hold a
third of all rows.  The functions here order rows inside ``(key, slice)``
groups only, reduce every slice to one small row, pass what must cross a slice
boundary along those small rows, and join it back on ``(key, slice)``.  Both
sides of that join already are clustered the same way, so the rows are
shuffled once however many of these steps are chained.

The slice width decides how rows are spread, never what comes out.  Rows whose
key is NULL belong to no timeline and are left out; rows without a time come
first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A condition on the previous and the current row, given as structs.
Flag = Callable[[Column, Column], Column]

SLICE = "slice_no"
DAY_S = 86_400
# Rows of one slice that a single task sorts comfortably.
TARGET_ROWS = 2_000_000
# Rows without a time come before every slice; so many slices share them.
NO_TIME = -(2**62)
NO_TIME_SLICES = 1024


def measure_slice_seconds(
    records: DataFrame,
    keys: Sequence[str] = ("tag_id",),
    time: str = "datetime",
    target_rows: int = TARGET_ROWS,
    longest_s: int = 30 * DAY_S,
) -> int:
    """Widest slice that keeps the fullest (key, slice) near ``target_rows``.

    Runs one job: counts per (key, hour), combined map-side, of which only the
    largest comes back.  Only if a single hour is already too full are seconds
    counted as well.  A deduplicated second holds at most a million
    microseconds, which bounds the result from below.
    """

    def fullest(unit_s: int) -> int:
        bucket = F.floor(F.unix_timestamp(time) / unit_s)
        counts = records.groupBy(*keys, bucket.alias("unit")).count()
        return counts.agg(F.max("count")).first()[0] or 0

    per_hour = fullest(3600)
    if per_hour <= target_rows:
        return min(longest_s, 3600 * max(1, target_rows // max(per_hour, 1)))
    return max(1, min(3600, target_rows // max(fullest(1), 1)))


def with_slice(df: DataFrame, slice_s: int = DAY_S, time: str = "datetime") -> DataFrame:
    """Number the slice every row falls into.

    Rows without a time are spread over slices of their own by ranges of
    ``foid``, where there is one, so that they keep its order.
    """
    number = F.floor(F.unix_timestamp(time) / F.lit(slice_s))
    no_time = F.lit(NO_TIME)
    if "foid" in df.columns and df.schema["foid"].dataType.typeName() in ("long", "integer"):
        part = F.floor(F.greatest(F.col("foid"), F.lit(0)) / F.lit(TARGET_ROWS))
        no_time = no_time + F.coalesce(F.least(part, F.lit(NO_TIME_SLICES - 1)), F.lit(0))
    return df.withColumn(SLICE, F.coalesce(number, no_time))


def sliced(df: DataFrame, columns: Sequence[str], slice_s: int = DAY_S, time: str = "datetime") -> DataFrame:
    """``columns`` with the slice number; rows that carry one already, as those of a stored timeline, keep it."""
    if SLICE in df.columns:
        return df.select(*columns, SLICE)
    return with_slice(df.select(*columns), slice_s, time)


def _carry(
    rows: DataFrame, summary: DataFrame, keys: Sequence[str]
) -> DataFrame:
    # An inner join puts the same filter on both sides, so that rows and summary
    # read one and the same shuffle.  Every row's slice has its summary.
    return rows.join(summary, [*keys, SLICE])


def with_neighbours(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("tag_id",),
    order: Sequence[str] = ("datetime", "foid"),
    reach: int = 1,
    counts: Mapping[str, Flag] | None = None,
) -> DataFrame:
    """Add the rows around each row of the same key, as structs.

    ``before`` and ``after`` hold ``order`` and ``columns`` of the previous and
    next row, NULL at the ends; with a ``reach`` of 2 ``before2`` and
    ``after2`` hold the ones beyond.  ``counts`` adds running counts (current
    row included) of rows for which a flag, a function of the previous and the
    current row, is true; for the very first row the previous one is NULL.

    ``rows`` must carry the slice number, rising with ``order``.
    """
    counts = counts or {}
    here = F.struct(*order, *columns)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    near = {"before": F.lag(here).over(inside), "after": F.lead(here).over(inside)}
    if reach == 2:
        near |= {"before2": F.lag(here, 2).over(inside), "after2": F.lead(here, 2).over(inside)}
    shifted = rows.withColumns(near)

    def as_count(flag: Column) -> Column:
        return F.coalesce(flag.cast("long"), F.lit(0).cast("long"))

    # Inside a slice every row but the first knows its previous row.
    marks = {
        name: F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(
            as_count(flag(F.col("before"), here))
        )
        for name, flag in counts.items()
    }
    # One row of a slice has no previous row in it and one has no next row.
    opening = F.when(
        F.col("before").isNull(), F.struct(here.alias("at"), F.col("after").alias("next"))
    )
    closing = F.when(
        F.col("after").isNull(), F.struct(here.alias("at"), F.col("before").alias("prior"))
    )
    edges = shifted.groupBy(*keys, SLICE).agg(
        F.first(opening, ignorenulls=True).alias("_first"),
        F.first(closing, ignorenulls=True).alias("_last"),
        *[F.sum(mark).alias(f"_in_{name}") for name, mark in marks.items()],
    )
    first, last = F.col("_first"), F.col("_last")
    carried = {
        "_before": F.lag(last["at"]).over(across),
        "_after": F.lead(first["at"]).over(across),
    }
    if reach == 2:
        carried |= {
            "_before2": F.coalesce(
                F.lag(last["prior"]).over(across), F.lag(last["at"], 2).over(across)
            ),
            "_after2": F.coalesce(
                F.lead(first["next"]).over(across), F.lead(first["at"], 2).over(across)
            ),
        }
    edges = edges.withColumns(carried)
    if counts:
        edges = edges.withColumns(
            {f"_at_{n}": as_count(flag(F.col("_before"), first["at"])) for n, flag in counts.items()}
        )
        edges = edges.withColumns(
            {
                f"_off_{n}": F.col(f"_at_{n}")
                + F.coalesce(F.sum(F.col(f"_in_{n}") + F.col(f"_at_{n}")).over(earlier), F.lit(0))
                for n in counts
            }
        )
        shifted = shifted.withColumns({n: F.sum(mark).over(so_far) for n, mark in marks.items()})
    passed = [*carried, *[f"_off_{n}" for n in counts]]
    joined = _carry(shifted, edges.select(*keys, SLICE, *passed), keys)

    whole = {
        "before": F.coalesce("before", "_before"),
        "after": F.coalesce("after", "_after"),
        **{n: F.col(n) + F.col(f"_off_{n}") for n in counts},
    }
    if reach == 2:
        # The second row of a slice has one neighbour inside and one outside.
        for side in ("before", "after"):
            outside = F.when(F.col(side).isNotNull(), F.col(f"_{side}")).otherwise(
                F.col(f"_{side}2")
            )
            whole[f"{side}2"] = F.coalesce(F.col(f"{side}2"), outside)
    return joined.withColumns(whole).drop(*passed)


def running_sums(
    rows: DataFrame,
    sums: Mapping[str, Column],
    keys: Sequence[str] = ("tag_id",),
    order: Sequence[str] = ("datetime", "foid"),
) -> DataFrame:
    """Add running totals (current row included) per key."""
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy(*keys, SLICE).agg(
        *[F.sum(value).alias(f"_in_{name}") for name, value in sums.items()]
    )
    offsets = totals.select(
        *keys, SLICE, *[F.sum(f"_in_{n}").over(earlier).alias(f"_off_{n}") for n in sums]
    )
    counted = rows.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()})
    return (
        _carry(counted, offsets, keys)
        .withColumns({n: F.col(n) + F.coalesce(f"_off_{n}", F.lit(0)) for n in sums})
        .drop(*[f"_off_{n}" for n in sums])
    )


def fill_from_neighbours(
    rows: DataFrame,
    value: str,
    keys: Sequence[str] = ("tag_id",),
    order: Sequence[str] = ("datetime", "foid"),
    last: str | None = None,
    following: str | None = None,
) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row, and first one after it.

    ``value`` is a struct whose leading fields are its place in the order, so
    the latest one of a slice is simply its maximum.
    """
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    filled, carried = {}, []
    if last:
        filled[last] = F.last(value, ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        carried.append(
            F.last("_max", ignorenulls=True)
            .over(across.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry_last")
        )
    if following:
        # Backwards from the end: a frame that grows is linear, one that shrinks
        # (up to unbounded following) is worked out anew for every row.
        backwards = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).desc() for c in order])
        from_end = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc())
        filled[following] = F.last(value, ignorenulls=True).over(
            backwards.rowsBetween(Window.unboundedPreceding, -1)
        )
        carried.append(
            F.last("_min", ignorenulls=True)
            .over(from_end.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry_following")
        )
    # Slices without a value have NULL here and need the carry too.
    extremes = rows.groupBy(*keys, SLICE).agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    edges = extremes.select(*keys, SLICE, *carried)
    joined = _carry(rows.withColumns(filled), edges, keys)
    if last:
        joined = joined.withColumn(last, F.coalesce(last, "_carry_last"))
    if following:
        joined = joined.withColumn(following, F.coalesce(following, "_carry_following"))
    return joined.drop("_carry_last", "_carry_following")
