"""Dive detection on a stream of depth records.

Each micro-batch runs the batch operator over the new rows and the rows of the
chunks that were still open, writes the chunks that can no longer grow, and
keeps the others for the next batch.  Tags send hours or days apart, so a chunk
ends by its own tag's time only.  What is kept is a table per batch in
shared storage, so a hot tag is spread like in batch and a lost executor or a
repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import shift_seconds
from ..operators.segments import dive_segments
from ..operators.slices import DAY_S
from ..session import checkpointed, remove_path, scratch_scope

COLUMNS = ("tag_id", "datetime", "foid", "depth_m")
STATE_SCHEMA = "tag_id {tag}, datetime TIMESTAMP, foid BIGINT, depth_m DOUBLE"
ENDS_SCHEMA = "tag_id {tag}, closed_until TIMESTAMP"


def dive_batches(
    out: str,
    state: str,
    depth_cutoff: float = 1,
    dive_depth: float = 3,
    max_gap_s: float = 2,
    min_points: int = 3,
    delay_s: float = 0,
    slice_s: int = DAY_S,
    late: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``.

    ``out`` receives ``batch=<id>`` folders of labelled rows of closed chunks,
    keyed by the chunk's start; ``state`` the open rows and, beside them, how
    far each tag is closed.  A chunk is closed once its tag's latest time lies
    more than the gap plus ``delay_s`` after it.  ``late`` (``<out>-late`` unless
    named) receives rows that come for a closed time, and rows without a time or
    tag.  The state of a batch is deleted once two later ones are written, and what the operators wrote for a batch at its
    end, so that the shared folder holds the open rows and no more, however many batches there are.
    """
    late = late or f"{out.rstrip('/')}-late"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*COLUMNS).filter(F.col("depth_m").isNotNull())
        tag = rows.schema["tag_id"].dataType.simpleString()

        def before(kind: str, schema: str) -> DataFrame:
            if batch_id == 0:
                return spark.createDataFrame([], schema.format(tag=tag))
            return spark.read.schema(schema.format(tag=tag)).parquet(f"{state}/{kind}/batch={batch_id - 1}")

        ends = before("ends", ENDS_SCHEMA)
        placed = rows.join(ends, "tag_id", "left")
        too_late = F.col("datetime") <= shift_seconds(F.col("closed_until"), max_gap_s)
        too_late = F.col("tag_id").isNull() | F.col("datetime").isNull() | F.coalesce(too_late, F.lit(False))
        placed.filter(too_late).select(*COLUMNS).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        rows = placed.filter(~too_late).select(*COLUMNS).unionByName(before("open", STATE_SCHEMA))
        labelled = dive_segments(
            rows, depth_cutoff, dive_depth, max_gap_s, min_points, slice_s=slice_s
        )
        chunks = labelled.groupBy("tag_id", "chunk").agg(
            F.min("datetime").alias("chunk_start"), F.max("datetime").alias("chunk_end")
        )
        latest = chunks.groupBy("tag_id").agg(F.max("chunk_end").alias("_latest"))
        limit = shift_seconds(F.col("_latest"), -(max_gap_s + delay_s))
        chunks = chunks.join(latest, "tag_id").withColumn("closed", F.col("chunk_end") < limit).drop("_latest")
        known = checkpointed(labelled.join(chunks, ["tag_id", "chunk"]))
        (
            known.filter("closed")
            .select(
                *COLUMNS,
                "chunk_start",
                F.col("dive_chunk").isNotNull().alias("is_dive_chunk"),
                "dive_no",
            )
            .write.mode("overwrite")
            .parquet(f"{out}/batch={batch_id}")
        )
        still_open = known.filter(~F.col("closed")).select(*COLUMNS)
        still_open.write.mode("overwrite").parquet(f"{state}/open/batch={batch_id}")
        now = known.filter("closed").select("tag_id", F.col("chunk_end").alias("closed_until"))
        reach = ends.unionByName(now).groupBy("tag_id").agg(F.max("closed_until").alias("closed_until"))
        reach.write.mode("overwrite").parquet(f"{state}/ends/batch={batch_id}")
        for kind in ("open", "ends"):
            remove_path(spark, f"{state}/{kind}/batch={batch_id - 2}")

    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            run(batch, batch_id)

    return each
