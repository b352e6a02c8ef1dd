"""Stored timelines: tables bucketed by key and time slice, so that ordered work on them needs no shuffle of rows."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.slices import DAY_S, SLICE, with_slice
from ..session import remove_path

LAYOUT = "buckets INT, slice_s INT, key STRING, time STRING, tie STRING, columns STRING"


def write_timeline(
    df: DataFrame, path: str, buckets: int, slice_s: int = DAY_S, key: str = "tag_id", time: str = "datetime", tie: str = "foid"
) -> None:
    """Store ``df`` below ``path`` in ``buckets`` files by key and time slice, each in order of time.

    A bucket is a hash of key and slice, so a tag that holds a third of all rows fills every bucket alike.  The layout is written
    last, beside the rows: a folder without it is an unfinished one, and isn't read.
    """
    spark = df.sparkSession
    name = _table(path)
    rows = with_slice(df, slice_s, time).repartition(buckets, key, SLICE)
    remove_path(spark, f"{path}/layout")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    order = [key, SLICE, time, tie]
    writer = rows.write.mode("overwrite").bucketBy(buckets, key, SLICE).sortBy(*order)
    writer.option("path", f"{path}/rows").saveAsTable(name)
    layout = spark.createDataFrame([(buckets, slice_s, key, time, tie, spark.table(name).schema.json())], LAYOUT)
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A stored timeline, with the slice number ordered operators use as it is.

    A session that didn't write it declares the table anew from the stored layout; the rows are not touched.
    """
    name = _table(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema(LAYOUT).json(f"{path}/layout").first()
        spark.sql(
            f"CREATE TABLE {name} ({_columns(layout['columns'])}) USING parquet"
            f" CLUSTERED BY (`{layout['key']}`, `{SLICE}`) SORTED BY (`{layout['key']}`, `{SLICE}`, `{layout['time']}`, `{layout['tie']}`)"
            f" INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'"
        )
    return spark.table(name)


def _columns(schema: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(schema)))


def _table(path: str) -> str:
    """A table's name for a folder; the catalog of a session knows it by this."""
    return f"timeline_{sha256(path.rstrip('/').encode()).hexdigest()[:24]}"
