"""Writers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession


def write_summary(df: DataFrame, folder: str, name: str, day: date, files: int | None = 1) -> str:
    """Write a dated summary as CSV and return its path.

    Summaries have one row per tag, so one file is the default; pass ``None``
    to leave the partitioning alone.  The rows move to that file in a step of
    their own, so that the work before it keeps its tasks.
    """
    path = f"{folder.rstrip('/')}/{name}_{day:%Y-%m-%d}"
    out = df.repartition(files) if files else df
    out.write.mode("overwrite").csv(path, header=True)
    return path


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a running CSV table; ``commits.append_run`` is the form that may be repeated."""
    df.write.mode("append").csv(path, header=True)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a processed dataset."""
    df.write.mode(mode).parquet(path)


def write_by(df: DataFrame, path: str, column: str = "project_id") -> None:
    """Store one folder per project; the projects of ``df`` are replaced, others stay as they are.

    Rows are not gathered by project first: a project may hold a third of all
    rows, and every task can write its own file into each folder.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored dataset back."""
    return spark.read.parquet(path)
