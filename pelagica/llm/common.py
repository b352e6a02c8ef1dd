"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, remove_path, scratch_path

# Rows per Arrow batch: texts are long, so batches hold few of them.
ARROW_ROWS = 500


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators; all can be changed at run time."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage: a lost executor later costs a read of files, not the work
    that made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are needed only inside a ``with`` block: written like ``stored``, deleted at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove_path(self.spark, path)


def sample_ids(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """``x_id``: at most ``most`` distinct ids, those with the least hashes, stored.

    Only hashes up to twice the share that is wanted are sorted, so that no task and not the driver gets more
    ids for a larger table.
    """
    ids = df.select(F.col(id_col).alias("x_id")).where("x_id is not null").distinct()
    share = min(1.0, 2 * most / max(1, ids.count()))
    low = F.xxhash64("x_id").bitwiseAND(F.lit((1 << 40) - 1)) <= int(share * (1 << 40))
    return stored(ids.where(low).orderBy(F.xxhash64("x_id").bitwiseAND(F.lit((1 << 40) - 1)), "x_id").limit(most), "sample")


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, or ``base`` with a suffix if a column already has that name."""
    taken = {column.lower() for column in columns}
    return base if base not in taken else f"{base}_{uuid.uuid4().hex[:8]}"


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b`` (nulls and loops are ignored).
    Returns ``node, component`` for nodes with an edge.  Alternates the large-star
    and small-star steps until the edges are stars around their smallest node;
    the number of rounds grows with the logarithm of the longest chain.  Each step is
    a minimum by node and a join back, so that no neighbourhood is gathered.
    """
    links = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = stored(links, "links")
    before = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = stored(small, "links")
        now = links.agg(
            F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)
        ).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", "v").distinct()
    )
