"""Collects the registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..operators.slices import measure_slice_seconds
from ..session import prepare
from . import views

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """The input of one query run: views by name and the measured slice width."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return views.table(self.spark, self.sf_dir, name)

    @property
    def slice_s(self) -> int:
        """Slice width for this data, measured once per session and folder."""
        return _slice_seconds(self.spark, self.sf_dir)


@cache
def _slice_seconds(spark: SparkSession, sf_dir: str) -> int:
    records = views.table(spark, sf_dir, "tag_records")
    return measure_slice_seconds(records.select("tag_id", "datetime"))


def forget_slices() -> None:
    """Measure slice widths anew, for files that have changed or timings."""
    _slice_seconds.cache_clear()


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries as ``f(spark, sf_dir)``."""

    def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: function(Tables(spark, sf_dir))

    return {name: bind(function) for name, function in QUERIES.items()}


def checks() -> dict[str, str]:
    """Check SQL of every query that has one, ready for DuckDB."""
    return {name: views.check_sql(body) for name, body in CHECKS.items()}
