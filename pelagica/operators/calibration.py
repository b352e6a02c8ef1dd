"""Accelerometer six-position calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_token
from ..functions.time import shift_seconds, to_utc
from .clean import with_vector_sum
from .slices import DAY_S, SLICE, running_sums, with_slice
from .spans import BIN_S, join_spans

# Seconds read before the start and after the end, the vector sum
# a usable row exceeds, rows a tag needs, and the longest chunk.
BEFORE_S = 860_000
AFTER_S = 36_000
MIN_VECTOR_SUM = 0.8
MIN_ROWS = 10
MAX_CHUNK = 300
# What tells calibrations apart: a tag may have several.
KEY = ("tag_id", "start_utc")


def open_calibrations(index: DataFrame) -> DataFrame:
    """Calibrations still to process, with UTC bounds."""
    todo = index.filter(F.col("calprocessed_yn") == "n").drop("calprocessed_yn")
    return todo.withColumns(
        {
            "start_utc": to_utc("cal_start_local", "utc_offset"),
            "end_utc": to_utc("cal_end_local", "utc_offset"),
        }
    )


def match_files(calibrations: DataFrame, files: DataFrame) -> DataFrame:
    """Files sent on the day of a calibration or the next, misses included.

    The token is cut out of the file name, which makes the match an equality.
    A calibration, known by its tag and start, without any file comes back
    with NULL ``file_name``.
    """
    days = F.array(F.lit(0), F.lit(1))
    tokens = calibrations.select(*KEY, F.explode(days).alias("day_offset")).select(
        *KEY,
        "day_offset",
        file_token("tag_id", F.date_add(F.to_date("start_utc"), F.col("day_offset"))).alias("token"),
    )
    named = files.select(
        "file_name", F.regexp_extract("file_name", r"^([^_]+_GPRS_\d{8})", 1).alias("token")
    )
    found = tokens.join(named, "token").select(*KEY, "token", "day_offset", "file_name")
    first_day = tokens.filter("day_offset = 0")
    missed = first_day.join(found.select(*KEY), list(KEY), "left_anti").select(
        *KEY, "token", "day_offset", F.lit(None).cast("string").alias("file_name")
    )
    return found.unionByName(missed)


def calibration_rows(
    records: DataFrame,
    calibrations: DataFrame,
    before_s: float = BEFORE_S,
    after_s: float = AFTER_S,
    bin_s: float = BIN_S,
) -> DataFrame:
    """Rows around each calibration, with its start and their vector sum.

    A row within two windows of its tag comes once for each.
    """
    spans = calibrations.select(
        F.col("tag_id").alias("_tag"),
        "start_utc",
        shift_seconds(F.col("start_utc"), -before_s).alias("_from"),
        shift_seconds(F.col("end_utc"), after_s).alias("_to"),
    )
    inside = (F.col("datetime") > F.col("_from")) & (F.col("datetime") < F.col("_to"))
    # a calibration without an end has no window, where a deployment's would be open
    joined = join_spans(records, spans.filter(F.col("_to").isNotNull()), inside, "datetime", "_from", "_to", bin_s=bin_s)
    return with_vector_sum(joined.drop("_from", "_to"))


def calibration_gate(
    rows: DataFrame, min_sum: float = MIN_VECTOR_SUM, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Usable rows per calibration and whether there are enough of them."""
    usable = F.count(F.when(F.col("vectoral_sum") > min_sum, 1))
    return rows.groupBy(*KEY).agg(usable.alias("n_rows")).withColumn(
        "enough", F.col("n_rows") >= min_rows
    )


def passing_rows(
    rows: DataFrame, min_sum: float = MIN_VECTOR_SUM, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Usable rows of the calibrations that have enough of them."""
    enough = calibration_gate(rows, min_sum, min_rows).filter("enough")
    usable = rows.filter(F.col("vectoral_sum") > min_sum)
    return usable.join(enough.select(*KEY), list(KEY), "left_semi")


def label_segments(
    rows: DataFrame,
    chunks: DataFrame,
    segments: DataFrame,
    max_chunk: int = MAX_CHUNK,
    slice_s: int = DAY_S,
) -> DataFrame:
    """Number each calibration's rows, cut out its chunk and label the six positions.

    Row numbers count within the calibration (tag and start, which chunks and
    segments carry as well); ``x`` restarts at the chunk.  Chunks of
    ``max_chunk`` rows or more are no calibration and drop out; ``long_chunks``
    lists them.  Rows of the chunk between two positions keep a NULL label.
    """
    chunks = chunks.filter(F.abs(F.col("end_pt") - F.col("beg_pt")) < max_chunk)
    numbered = running_sums(
        with_slice(rows, slice_s), {"row_no": F.lit(1).cast("long")}, list(KEY)
    ).drop(SLICE)
    same = (F.col("tag_id") == F.col("_tag")) & (F.col("start_utc") == F.col("_start"))
    key = [F.col("tag_id").alias("_tag"), F.col("start_utc").alias("_start")]
    cut = chunks.select(*key, "beg_pt", "end_pt")
    within = same & F.col("row_no").between(F.col("beg_pt"), F.col("end_pt"))
    chunk_rows = (
        numbered.join(cut, within)
        .withColumn("x", F.col("row_no") - F.col("beg_pt") + 1)
        .drop("_tag", "_start", "beg_pt", "end_pt")
    )
    ranges = segments.select(*key, F.col("seg").alias("calib_seg"), "beg", "fin")
    in_segment = same & F.col("x").between(F.col("beg"), F.col("fin"))
    return chunk_rows.join(ranges, in_segment, "left").drop("_tag", "_start", "beg", "fin")


def long_chunks(chunks: DataFrame, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Chunks that ``label_segments`` leaves out for their length."""
    return chunks.filter(F.abs(F.col("end_pt") - F.col("beg_pt")) >= max_chunk)


def corrections(labelled: DataFrame) -> DataFrame:
    """Per calibration and position: rows, mean vector sum and range of every axis.

    ``min`` and ``max`` are those of the X axis; ``axis_min`` and ``axis_max``
    those of the axis the position is for.
    """
    axis = F.regexp_replace("calib_seg", "[12]", "")
    own = F.when(axis == "X", F.col("acc_x")).when(axis == "Y", F.col("acc_y")).otherwise(F.col("acc_z"))
    return (
        labelled.filter(F.col("calib_seg").isNotNull())
        .withColumns({"axis": axis, "own": own})
        .groupBy(*KEY, "calib_seg", "axis")
        .agg(
            F.count("*").alias("n_values"),
            F.round(F.avg("vectoral_sum"), 6).alias("u_vec_sum"),
            F.min("acc_x").alias("min"),
            F.max("acc_x").alias("max"),
            F.min("own").alias("axis_min"),
            F.max("own").alias("axis_max"),
        )
        .withColumn("seg", F.regexp_replace("calib_seg", "[XYZ]", ""))
    )
