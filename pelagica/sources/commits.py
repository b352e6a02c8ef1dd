"""A store of runs: the rows of a run and the files they came from appear together or not at all.

    <path>/rows/<run>-<attempt>/       rows of a run, Parquet
    <path>/files/<run>-<attempt>/      the files they came from
    <path>/commits/<run>.json          one line that names both folders

A run is committed by renaming one small finished file into ``commits``, where no name may be taken twice.  What an attempt
wrote before it failed is in folders that no commit names, so no reader sees it; a run that is committed already
changes nothing when it is repeated, and of two attempts at once the second rename fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, remove_path, scratch_scope
from .inventory import new_files, walk_files, with_data
from .tag_logs import MIN_FILE_BYTES, read_tags

MANIFEST = "file_name STRING, file_path STRING, size_bytes BIGINT, run STRING"
COMMIT = "run STRING, rows STRING, files STRING"
RUN_NAME = re.compile(r"[A-Za-z0-9_.=-]+")


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def committed_runs(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Commits by run; one small row a run, which is all the driver sees of a store."""
    target, files = _hadoop(spark, f"{path}/commits")
    if not files.exists(target):
        return {}
    rows = spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(f"{path}/commits").collect()
    return {r["run"]: r.asDict() for r in rows}


def _publish(spark: SparkSession, path: str, run: str, commit: dict[str, str]) -> bool:
    """Rename a finished file to the run's commit; False if the run has one."""
    made, files = _hadoop(spark, f"{path}/commits/.{run}-{uuid.uuid4().hex}")
    out = files.create(made, False)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    no_option = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    target, _ = _hadoop(spark, f"{path}/commits/{run}.json")
    try:
        context.rename(files.makeQualified(made), files.makeQualified(target), no_option)
    except Py4JJavaError as error:
        files.delete(made, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def commit_run(path: str, run: str, rows: DataFrame, files: DataFrame, partition_by: Sequence[str] = ()) -> bool:
    """Store ``rows`` and the files they came from (``file_name``, ``file_path``, ``size_bytes``) as one run.

    Returns False, and changes nothing, if the run is committed already.
    """
    if not RUN_NAME.fullmatch(run):
        raise ValueError(f"not a name for a run: {run!r}")
    spark = rows.sparkSession
    if run in committed_runs(spark, path):
        return False
    attempt = f"{run}-{uuid.uuid4().hex}"
    commit = {"run": run, "rows": f"rows/{attempt}", "files": f"files/{attempt}"}
    writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    writer.parquet(f"{path}/{commit['rows']}")
    files.select("file_name", "file_path", "size_bytes", F.lit(run).alias("run")).write.parquet(f"{path}/{commit['files']}")
    if _publish(spark, path, run, commit):
        return True
    for kind in ("rows", "files"):
        remove_path(spark, f"{path}/{commit[kind]}")
    return False


def stored_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all committed runs."""
    folders = [f"{path}/{c['rows']}" for c in committed_runs(spark, path).values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of all committed runs, with the run that read them."""
    folders = [f"{path}/{c['files']}" for c in committed_runs(spark, path).values()]
    return spark.read.schema(MANIFEST).parquet(*folders) if folders else spark.createDataFrame([], MANIFEST)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete what failed attempts left; to be called while no run is being written.  Returns the folders deleted."""
    named = {c[kind] for c in committed_runs(spark, path).values() for kind in ("rows", "files")}
    gone = 0
    for kind in ("rows", "files"):
        target, files = _hadoop(spark, f"{path}/{kind}")
        for found in files.listStatus(target) if files.exists(target) else []:
            if f"{kind}/{found.getPath().getName()}" not in named:
                files.delete(found.getPath(), True)
                gone += 1
    return gone


def fresh_files(spark: SparkSession, folder: str, path: str, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    """Files below ``folder`` larger than ``min_bytes`` that no run has read; ``file_name`` is their path below it."""
    target, files = _hadoop(spark, folder)
    below = len(files.makeQualified(target).toString()) + 1
    listed = with_data(walk_files(spark, folder), min_bytes).withColumn("file_name", F.expr(f"substr(file_path, {below + 1})"))
    # by sorted shuffles: names compress so well that Spark takes very many for a small table and gathers them on the driver
    return new_files(listed, manifest(spark, path).hint("merge"))


def ingest_new(spark: SparkSession, folder: str, path: str, run: str, min_bytes: int = MIN_FILE_BYTES, **options) -> bool:
    """Read the logger files below ``folder`` that no run has read yet, and commit their rows and names as ``run``.

    The files' names stay in tables, from the listing to the manifest, so the driver's memory doesn't grow with them.
    Files count as read by their path below the folder, so one that is sent again under its name is not read twice.  ``options`` go to ``read_tags``, which numbers rows within the run: together with ``run``, which is
    added, ``foid`` tells the rows of a tag apart.  False if the run is committed already; without new files an empty run is committed.
    """
    if run in committed_runs(spark, path):
        return False
    with scratch_scope(spark):
        # a listing has a task for each few hundred folders; its rows are small
        fresh = checkpointed(fresh_files(spark, folder, path, min_bytes).coalesce(spark.sparkContext.defaultParallelism))
        if fresh.isEmpty():
            empty = spark.createDataFrame([], "tag_id STRING, run STRING")
            return commit_run(path, run, empty, fresh)
        rows = read_tags(spark, fresh, min_bytes, **options).withColumn("run", F.lit(run))
        return commit_run(path, run, rows, fresh)


def append_run(df: DataFrame, path: str, run: str) -> bool:
    """Add rows to a running table as one run; repeating the run changes nothing."""
    return commit_run(path, run, df, df.sparkSession.createDataFrame([], MANIFEST))
