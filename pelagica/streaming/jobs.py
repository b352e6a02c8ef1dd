"""Streaming forms of ingest, deduplication, sessions and status.

Each function adds the transformation to a streaming DataFrame of records;
``run_available`` drives it over everything that has arrived and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.summary import SKETCH_BITS
from ..session import scratch_scope
from ..sources.inventory import JOURNAL, MIN_FILE_BYTES, journal_files
from ..sources.tag_logs import read_tags

# Sensors whose means windows have besides the battery's, if records have them.
SENSORS = {"ext_temperature_c": "u_temp", "conductivity_ms_cm": "u_cond"}
# Row numbers of a tag in one batch lie below this.
BATCH_ROWS = 1 << 40


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    glob: str = "*",
    files_per_batch: int = 1000,
    **options: str,
) -> DataFrame:
    """Files of a folder as a stream; the checkpoint remembers those seen."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(path)


def run_available(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> None:
    """Process what has arrived, write it as Parquet and stop."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(
    df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Process what has arrived with a function per micro-batch and stop."""
    query = (
        df.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_log_files(spark: SparkSession, path: str, files_per_batch: int = 1000, journal: str | None = None) -> DataFrame:
    """Logger files of a folder as a stream of their paths; contents are not read.

    Spark's file source lists the folder on the driver and keeps every path there.  With a ``journal``, a folder that
    lasts as long as the checkpoint and belongs to ``path`` alone, tasks list the folder when this is called and add to the journal
    what it lacks; the stream follows the journal, of which Spark keeps a name for each ``files_per_batch`` files.
    A file counts as seen by its path, however old it is.
    """
    if journal:
        journal_files(spark, path, journal, files_per_batch)
        return stream_files(spark, journal, JOURNAL, glob="*.parquet", files_per_batch=1)
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    files = stream_files(
        spark, path, schema, "binaryFile", "*.csv", files_per_batch, recursiveFileLookup="true"
    )
    return files.select("path", "length")


def log_batches(out: str, min_bytes: int = MIN_FILE_BYTES, **options) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``: read each batch's files by their own headers.

    ``out`` receives ``batch=<id>`` folders, written over when a batch is
    repeated.  Paths stay in tables; ``options`` go to ``read_tags``.  Row numbers
    count over the tag's files of a batch, from ``batch_id * BATCH_ROWS`` on, so that
    a tag's rows never share one and later batches have higher ones.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        files = batch.filter(F.col("length") > min_bytes).select(F.col("path").alias("file_path"))
        if files.isEmpty():
            return
        with scratch_scope(batch.sparkSession):
            records = read_tags(batch.sparkSession, files, min_bytes=min_bytes, **options)
            if "foid" in records.columns:
                records = records.withColumn("foid", F.col("foid") + batch_id * BATCH_ROWS)
            records.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return each


def dedupe(
    records: DataFrame, delay: str, keys: tuple[str, ...] = ("tag_id", "datetime"), order: tuple[str, ...] = ("foid",)
) -> DataFrame:
    """The first row of every key by ``order``, out of all its rows that arrive before the watermark passes it.

    A running minimum of the whole row is kept for each open key, combined before the shuffle, so that what comes
    first decides nothing.  Rows come out, in append mode, once their time is ``delay`` behind the latest; ``keys`` have ``datetime`` among them.
    """
    rest = [c for c in records.columns if c not in (*keys, *order)]
    least = F.min(F.struct(*order, *rest)).alias("_row")
    first = records.withWatermark("datetime", delay).groupBy(*keys).agg(least)
    return first.select(*keys, "_row.*").select(*records.columns)


def sessions(records: DataFrame, gap: str, delay: str, key: str = "tag_id") -> DataFrame:
    """Gap segments per tag; a step equal to the gap stays inside.

    In append mode a segment comes out once the watermark has passed it.
    """
    span = F.session_window("datetime", gap)
    return (
        records.withWatermark("datetime", delay)
        .groupBy(key, span)
        .agg(F.count("*").alias("n"), F.max("depth_m").alias("max_depth"))
        .select(
            key,
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "n",
            "max_depth",
        )
    )


def trailing_status(
    records: DataFrame, length: str, step: str, delay: str, key: str = "tag_id"
) -> DataFrame:
    """Per tag and sliding window: rows, times, deepest point, mean sensors, and about how many distinct latitudes."""
    return _windowed(records, F.window("datetime", length, step), delay, key)


def daily_counts(records: DataFrame, delay: str, key: str = "tag_id") -> DataFrame:
    """Per tag and day: the same columns over a tumbling window."""
    return _windowed(records, F.window("datetime", "1 day"), delay, key)


def _windowed(records: DataFrame, span: Column, delay: str, key: str) -> DataFrame:
    return (
        records.withWatermark("datetime", delay)
        .groupBy(key, span.alias("span"))
        .agg(
            F.count("*").alias("n"),
            F.min("datetime").alias("min_dt"),
            F.max("datetime").alias("max_dt"),
            F.max("depth_m").alias("max_depth"),
            F.round(F.avg("u_bat_mv"), 4).alias("u_bat"),
            *[F.round(F.avg(c), 9).alias(n) for c, n in SENSORS.items() if c in records.columns],
            *[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS))).alias("n_lat_about") for c in ("lat",) if c in records.columns],
        )
        .select(
            key,
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "n",
            "min_dt",
            "max_dt",
            "max_depth",
            "u_bat",
            *[n for c, n in SENSORS.items() if c in records.columns],
            *["n_lat_about" for c in ("lat",) if c in records.columns],
        )
    )
