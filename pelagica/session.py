"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; all of them can be changed on a live session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tasks of a listing: by default each folder is a task of its own, which for a folder a tag takes far longer than to read the files.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "100",
}

# Scratch paths by application, for clear_scratch.
_made: dict[str, list[str]] = {}
# Paths made in the innermost scope this thread is in.
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Put the runtime settings in place and return the session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary
    folder.  A cluster without it is an error, since a machine-local folder
    would lose the data with the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pelagica-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs a read and not the work before."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    made = _scope.get()
    if made is not None:
        path = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            made.append(path.get())
    return out


def write_once(df: DataFrame) -> DataFrame:
    """Checkpoint rows that come straight from a reader with many parsed columns.

    Spark derives conditions on every column from the parse expressions of the
    others, which for such plans takes more memory than the driver has; the rows
    need none of them, so the rule is off while they are written.
    """
    spark = df.sparkSession
    rule = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(rule, "true")
    spark.conf.set(rule, "false")
    try:
        return checkpointed(df)
    finally:
        spark.conf.set(rule, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's file systems, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _scope.get()
    if made is None:
        made = _made.setdefault(spark.sparkContext.applicationId, [])
    made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, what operators called in it left in the shared folder.

    For work that is done within the block, such as one micro-batch: frames made in it can't be read afterwards.  What
    other threads, or blocks around this one, have written stays.
    """
    made: list[str] = []
    outer = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in made:
            remove_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what finished jobs of this application left in the shared folder.

    To be called once their results are written: frames that are still to be
    read from scratch tables or checkpoints can't be read afterwards.
    """
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove_path(spark, path)
    checkpoints = spark.sparkContext.getCheckpointDir()
    if checkpoints:
        folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoints)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoints}/rdd-*")) or []:
            files.delete(found.getPath(), True)
