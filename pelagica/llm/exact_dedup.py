"""Exact duplicates by a tree merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

RUNS = 64
FANOUT = 8


def mark_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    normal: Column | None = None,
    runs: int = RUNS,
    fanout: int = FANOUT,
) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts.

    Rows are dealt into ``runs`` runs by a hash of their id.  A run holds one
    entry for each digest in it: count and smallest (``keep='min'``) or largest
    (``keep='max'``) identifier.  In each round ``fanout`` runs are merged into one,
    digest by digest, until one run per digest is left; the winners then go back
    down to the runs, and from there to the rows.  A text that a third of all rows
    share is thus at most ``runs`` entries in any merge, and its rows are spread
    over ``runs`` keys on the way back.  Every merge is by SHA-256, length in bytes
    and a second hash together, so that texts of different length or second hash
    are never taken as equal.

    ``normal`` is the text to compare (default: the text column as it is).

    Returns the columns of ``docs`` (those with the names below are replaced) and
    ``keep_id, group_size, kept, text_sha256``.  A null text counts as empty.  Of
    rows that repeat both id and text one is kept.  Null ids lose to any other id;
    if a group has only null ids, one of its rows is kept and ``keep_id`` is null.
    An empty table gives an empty table.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in docs.columns if c.lower() not in added]
    own = {k: free_name(docs.columns, k) for k in ("x_sha", "x_len", "x_hash", "x_run", "x_row")}
    sha, size, second, run, row = own.values()
    text = F.coalesce(F.col(text_col) if normal is None else normal, F.lit(""))
    least = F.max if keep == "max" else F.min

    rows = docs.select(
        *names,
        F.sha2(text, 256).alias(sha),
        F.octet_length(text).alias(size),
        F.xxhash64(text).alias(second),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(runs)).cast("int").alias(run),
    )
    digest = [sha, size, second]
    first = rows.groupBy(*digest, run).agg(
        F.count("*").alias("group_size"), least(id_col).alias("keep_id")
    )
    merged, left = first, runs
    while left > 1:
        merged = (
            merged.withColumn(run, F.floor(F.col(run) / fanout).cast("int"))
            .groupBy(*digest, run)
            .agg(F.sum("group_size").alias("group_size"), least("keep_id").alias("keep_id"))
        )
        left = -(-left // fanout)
    shared = merged.where("group_size > 1").drop(run)
    back = first.select(*digest, run).join(shared, digest)

    marked = rows.join(back, [*digest, run], "left")
    same_row = Window.partitionBy(*digest, run, id_col).orderBy(F.lit(1))
    found = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return (
        marked.withColumn(row, F.row_number().over(same_row))
        .withColumn("keep_id", found)
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col)) & (F.col(row) == 1))
        .select(*names, "keep_id", "group_size", "kept", F.col(sha).alias("text_sha256"))
    )


def drop_exact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of every group of equal texts; options as ``mark_exact``."""
    renamed = {c: free_name(docs.columns, f"in_{c.lower()}") for c in docs.columns
               if c.lower() in ("keep_id", "group_size", "kept", "text_sha256")}
    marked = mark_exact(docs.withColumnsRenamed(renamed), **options).where("kept")
    return marked.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
