"""Joins of moments with spans of time, spread over bins of time."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width of a bin, and the first moment with a bin of its own.
BIN_S = 30 * 86_400
FIRST = datetime(2000, 1, 1, tzinfo=timezone.utc).timestamp()


def join_spans(
    records: DataFrame, spans: DataFrame, within: Column, time: str, start: str, end: str, how: str = "inner", bin_s: float = BIN_S, key: str = "tag_id"
) -> DataFrame:
    """Join records with the spans of their ``key`` for which ``within`` holds.

    ``spans`` has the key as ``_tag``; ``within`` may hold only where ``time`` lies from ``start`` to ``end`` (a NULL end is
    open).  A record belongs to one bin of time and a span to every bin it reaches, so the join is an equality on key and bin
    and the records of one tag meet over many tasks; ``within`` then decides.  Bins before ``FIRST`` and after the present moment
    are folded into the outermost ones, which bounds the bins of open spans and changes no result.
    """
    width = round(bin_s * 1e6)
    lowest, highest = (int(moment * 1e6 // width) for moment in (FIRST, datetime.now(timezone.utc).timestamp() + bin_s))

    def bin_of(moment: str) -> Column:
        return F.least(F.greatest(F.floor(F.unix_micros(moment) / width).cast("long"), F.lit(lowest)), F.lit(highest))

    last = F.when(F.col(end).isNull(), F.lit(highest)).otherwise(bin_of(end))
    reach = F.when(bin_of(start) <= last, F.sequence(bin_of(start), last))
    spread = spans.withColumn("_bin", F.explode(reach))
    # a record without a time has no bin, not the first one
    binned = records.withColumn("_at", F.when(F.col(time).isNotNull(), bin_of(time)))
    on = (F.col(key) == F.col("_tag")) & (F.col("_at") == F.col("_bin")) & within
    return binned.join(spread, on, how).drop("_at", "_bin", "_tag")
