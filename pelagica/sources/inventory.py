"""File listings, and which files a job should read."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tag_of_file
from ..functions.time import shift_seconds
from ..session import checkpointed, scratch_scope
from . import log_files
from .tag_logs import MIN_FILE_BYTES

# Fixed value: files changed within this many days count as current.
RECENT_DAYS = 14
JOURNAL = "path STRING, length BIGINT"


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Name, path, size and change time of the files below a folder.

    The content column of the source is not selected, so no file is opened.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path").alias("file_path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def walk_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """The rows of ``list_files``, listed by tasks, level by level, so that the driver holds no path: a count a level is all it gets.

    A level is stored at once, and a folder is listed by one task.  Paths that Python's file systems can't open as a folder,
    or that have wildcards, are listed by Spark, on the driver.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    try:
        files, inside = log_files.file_system(log_files.as_uri(root))
        here = files.get_file_info(inside).type == pafs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        here = False
    if not here or any(c in path for c in "*?{[\\") or any(c in glob for c in "{[\\"):
        return list_files(spark, path, glob)
    level, folders, found = spark.createDataFrame([(root,)], "path STRING"), 1, []
    while folders:
        dealt = level.repartition(-(-folders // log_files.GROUP_FILES), "path")
        entries = checkpointed(dealt.mapInArrow(lambda b: log_files.walk(b, glob), log_files.ENTRIES))
        found.append(entries.filter("NOT folder"))
        level = entries.filter("folder").select("path")
        folders = level.count()
    return reduce(DataFrame.unionAll, found).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path").alias("file_path"),
        "size_bytes",
        "modified",
    )


def journal_files(spark: SparkSession, path: str, journal: str, files_per_part: int) -> int:
    """Add the files below ``path`` that the journal lacks to it, oldest first, and return how many they are.

    The journal is a folder of Parquet files of ``path, length``, each of ``files_per_part`` files or fewer, written one after
    the other.  A file whose name did not get into it, as after a failure, is found again by the next call; of calls for one
    journal there may be one at a time.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(journal)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    with scratch_scope(spark):
        found = walk_files(spark, path).select(F.col("file_path").alias("path"), F.col("size_bytes").alias("length"), "modified")
        known = spark.read.schema(JOURNAL).parquet(journal).select("path").hint("merge")
        fresh = checkpointed(found.join(known, "path", "left_anti"))
        count = fresh.count()
        if count:
            # one task, which closes a part before it opens the next, so that their times are in order
            ordered = fresh.repartition(1).sortWithinPartitions("modified", "path").drop("modified")
            ordered.write.mode("append").option("maxRecordsPerFile", files_per_part).parquet(journal)
    return count


def with_data(files: DataFrame, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    """Files larger than a bare header."""
    return files.filter(F.col("size_bytes") > min_bytes)


def changed_since(
    files: DataFrame, as_of: Column, days: float = RECENT_DAYS, column: str = "modified"
) -> DataFrame:
    """Files changed less than ``days`` before ``as_of``."""
    return files.filter(F.col(column) > shift_seconds(as_of, -86_400 * days))


def with_recent_last_record(
    records: DataFrame,
    as_of: Column,
    days: float = 7,
    file: str = "file_name",
    time: str = "datetime",
    order: str = "foid",
) -> DataFrame:
    """Files whose last record is less than ``days`` old."""
    last = records.groupBy(file).agg(F.max_by(time, order).alias("last_record"))
    return last.filter(F.col("last_record") > shift_seconds(as_of, -86_400 * days))


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not loaded yet."""
    return files.join(manifest, "file_name", "left_anti")


def known_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files already loaded."""
    return files.join(manifest, "file_name", "left_semi")


def files_of_tags(files: DataFrame, deployments: DataFrame, columns: list[str]) -> DataFrame:
    """Files of deployed tags, the tag read exactly from the name.

    ``columns`` of the deployment table are attached; without any this is an
    existence test.
    """
    named = files.withColumn("tag_id", tag_of_file("file_name"))
    keyed = deployments.withColumn("tag_id", F.col("tag_id").cast("string"))
    if not columns:
        return named.join(keyed.select("tag_id"), "tag_id", "left_semi")
    return named.join(keyed.select("tag_id", *columns), "tag_id")
