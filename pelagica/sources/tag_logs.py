"""Reader for logger CSV files whose headers differ from file to file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import nan_to_null
from ..functions.text import tag_of_file
from ..functions.time import parse_either
from ..operators.slices import SLICE
from ..session import checkpointed
from . import log_files

# Columns of a logger file, their names here and their types.
TEXT_COLUMNS = {"device_id": "device_id", "datatype": "datatype"}
NUMBER_COLUMNS = {
    "Latitude": "lat",
    "Longitude": "lon",
    "depth_m": "depth_m",
    "U_bat_mV": "u_bat_mv",
    "bat_soc_pct": "bat_soc_pct",
    "solar_I_mA": "solar_i_ma",
    "ext_temperature_C": "ext_temperature_c",
    "conductivity_mS/cm": "conductivity_ms_cm",
    "acc_x": "acc_x",
    "acc_y": "acc_y",
    "acc_z": "acc_z",
    "mag_x": "mag_x",
    "mag_y": "mag_y",
    "mag_z": "mag_z",
}
# Other spellings of a header found in older files.
ALIASES = {"conductivity_mS/cm": ("conductivity_mS.cm", "conductivity_mS_cm")}
TIME_COLUMNS = ("UTC_datetime", "UTC_timestamp")
DATE_AND_TIME = ("UTC_date", "UTC_time")
ALL_COLUMNS = (*TIME_COLUMNS, *DATE_AND_TIME, *TEXT_COLUMNS, *NUMBER_COLUMNS)
COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Full paths without a character that needs quoting, or a part that could be left out.
WHOLE_PATH = re.compile(r"(?:file:(?://)?|[a-z][a-z0-9+-]*://[\w.:@-]+)(?:/[\w=,+@-][\w.=,+@-]*)+", re.ASCII)
QUOTE_AT_END = r'^\s*"|"\s*$'
# Row counts are broadcast, of about 200 bytes a split, if there are no more splits than this.
BROADCAST_SPLITS = 100_000
# Smallest size, in bytes, of a file that holds more than its header.
MIN_FILE_BYTES = 309


def read_tags(
    spark: SparkSession,
    paths: str | Sequence[str] | DataFrame,
    min_bytes: int = MIN_FILE_BYTES,
    name_column: Column | None = None,
    project: Column | None = None,
    modified_after: str | None = None,
    number_rows: bool = True,
) -> DataFrame:
    """Read logger files into one table with fixed columns, matched by name.

    Each file's own header, its first line, says where a column stands: Spark's
    CSV reader maps columns by position once a schema is given, which swaps columns
    when files differ.  Short rows and absent columns give NULL, as do values that
    do not parse.  A file without any time column is an error.

    ``name_column`` and ``project`` are expressions over the columns ``file_path``,
    ``file_name``; by default the tag is taken from the file name.  ``foid`` counts a
    tag's rows over its files, in the order of their names, so that no two rows of
    a tag share a number: rows are numbered within their split as they are read, and
    the rows of the tag's earlier splits are added up over one small row a split.

    Files that Python's file systems can open come from the source in ``log_files``,
    whose plan exchanges no rows; others through Spark's text reader.

    ``paths`` may be a table with a column ``file_path`` of whole paths, as listings give it: its files are split by tasks,
    and the driver, which holds the paths of any other form, gets two sums.  The splits are stored at once.
    """
    tag = name_column if name_column is not None else tag_of_file("file_name")
    if isinstance(paths, DataFrame):
        rows = _from_table(spark, paths, min_bytes, modified_after, tag, number_rows)
    else:
        chosen = _qualified(spark, paths)
        read = _from_source if _can_open(chosen) else _from_text
        rows = read(spark, chosen, min_bytes, modified_after, tag, number_rows)

    def cell(name: str) -> Column:
        return F.nullif(F.trim(f"`{name}`"), F.lit(""))

    def number(name: str) -> Column:
        return nan_to_null(cell(name).try_cast("double"))

    columns = [
        tag.alias("tag_id"),
        _time(cell).alias("datetime"),
        *[cell(raw).alias(name) for raw, name in TEXT_COLUMNS.items()],
        *[number(raw).alias(name) for raw, name in NUMBER_COLUMNS.items()],
        "file_path",
        "file_name",
    ]
    if project is not None:
        columns.append(project.alias("project_id"))
    if number_rows:
        columns.append("foid")
    return rows.select(*columns)


def write_files(records: DataFrame, path: str, folders: Sequence[str], layouts: Sequence[tuple[Column, Sequence[str]]]) -> None:
    """Add ``records`` to the logger files below ``path``, in a folder for each value of the columns ``folders``.

    ``layouts`` are conditions with the columns, in order, of the rows they hold for; the first that holds counts, and the rows of a folder
    have one.  Every run of rows with the same folder in a task becomes a file, so rows are to come sorted by folder.  Paths that
    Python's file systems don't know go to Spark's own writer, layout by layout.
    """
    spark = records.sparkSession
    (target,) = _qualified(spark, path)
    if not _can_open([target]):
        earlier = F.lit(False)
        for holds, columns in layouts:
            here = F.coalesce(holds, F.lit(False))
            some = records.filter(here & ~earlier).select(*folders, *columns)
            some.write.partitionBy(*folders).mode("append").csv(path, header=True)
            earlier = earlier | here
        return

    def first(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(holds, value) for (holds, _), value in zip(layouts, values)])

    header = first([F.lit(",".join(columns)) for _, columns in layouts])
    line = first([F.to_csv(F.struct(*columns)) for _, columns in layouts])
    text = records.select(*[F.col(c).cast("string").alias(c) for c in folders], header.alias(log_files.HEADER), line.alias(log_files.LINE))
    spark.dataSource.register(log_files.LoggerFiles)
    text.write.format(log_files.NAME).mode("append").save(target)


def _time(cell: Callable[[str], Column]) -> Column:
    """The time of a row, whichever of its three forms the file has."""
    moments = [parse_either(cell(name)) for name in TIME_COLUMNS]
    moments.append(parse_either(F.concat_ws(" ", cell(DATE_AND_TIME[0]), cell(DATE_AND_TIME[1]))))
    return F.coalesce(*moments)


def _qualified(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Paths with the scheme of Spark's file system for them, so that both sides mean the same files."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        if WHOLE_PATH.fullmatch(path):  # as the file system would write it; a list may have very many
            out.append(path)
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out.append(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString())
    return out


def _can_open(paths: Sequence[str]) -> bool:
    """Whether Python's file systems know the paths: a scheme they don't know is left to Spark."""
    try:
        for path in paths[:1]:
            log_files.file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return not any(c in path for path in paths for c in "*?{")


def _source(
    spark: SparkSession, mode: str, paths: Sequence[str], min_bytes: int, modified_after: str | None, columns: Sequence[str]
) -> DataFrame:
    spark.dataSource.register(log_files.LoggerFiles)
    reader = spark.read.format(log_files.NAME).option("mode", mode).option("paths", json.dumps(list(paths)))
    reader = reader.option("minBytes", min_bytes).option("splitBytes", _split_bytes(spark))
    reader = reader.options(**_options(columns))
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load()


def _split_bytes(spark: SparkSession) -> int:
    """A split is held in memory as lines, so it is no larger than the source's own bound."""
    wanted = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return min(log_files.SPLIT_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(wanted))


def _options(columns: Sequence[str]) -> dict[str, str]:
    """Wanted columns with their spellings, and those of which a file must have one."""
    return {
        "columns": json.dumps([(c, *ALIASES.get(c, ())) for c in columns]),
        "required": json.dumps([*TIME_COLUMNS, DATE_AND_TIME[0]]),
    }


def _from_source(
    spark: SparkSession, paths: Sequence[str], min_bytes: int, modified_after: str | None, tag: Column, number_rows: bool
) -> DataFrame:
    """Raw text columns by name, and ``foid`` if rows are numbered."""
    rows = _source(spark, "rows", paths, min_bytes, modified_after, ALL_COLUMNS)
    if not number_rows:
        return rows
    counts = _source(spark, "counts", paths, min_bytes, modified_after, ())
    before = counts.select("file_path", "split_start", _earlier(tag).alias("_earlier"))
    known = log_files.list_splits(list(paths), min_bytes=min_bytes, modified_after=modified_after, split_bytes=_split_bytes(spark))
    if len(known) <= BROADCAST_SPLITS:
        before = F.broadcast(before)
    return rows.join(before, ["file_path", "split_start"]).withColumn("foid", F.col("_earlier") + F.col("split_row"))


def _earlier(tag: Column) -> Column:
    """Records of the tag in the splits before a split, over the counts of all splits."""
    before = Window.partitionBy(tag).orderBy("file_name", "file_path", "split_start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(before), F.lit(0))


def _from_table(
    spark: SparkSession, files: DataFrame, min_bytes: int, modified_after: str | None, tag: Column, number_rows: bool
) -> DataFrame:
    """The same for files in a table; what goes from task to task is a small row a split."""
    known = files.select("file_path").filter("file_path IS NOT NULL").distinct()
    some = known.first()
    try:
        log_files.file_system(log_files.as_uri(some[0]) if some else "/")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        paths = [r["file_path"] for r in known.collect()]
        return _from_text(spark, paths, min_bytes, modified_after, tag, number_rows)
    chosen = {"min_bytes": min_bytes, "modified_after": modified_after, "split_bytes": _split_bytes(spark)}
    dealt = known.repartition(_tasks(known.count()), "file_path")
    splits = checkpointed(dealt.mapInArrow(lambda b: log_files.splits_of(b, **chosen), log_files.SPLITS))
    held = splits.agg(F.count("*"), F.coalesce(F.sum(F.col("split_end") - F.col("split_start")), F.lit(0))).first()
    tasks = _tasks(*held)

    def read(splits: DataFrame, mode: str, columns: Sequence[str]) -> DataFrame:
        options = _options(columns) | {"mode": mode}
        schema = ", ".join([log_files.SCHEMAS[mode], *(f"`{c}` STRING" for c in columns)])
        dealt = splits.repartition(tasks, "file_path", "split_start")
        return dealt.mapInArrow(lambda b: log_files.read_splits(b, options), schema)

    if number_rows:
        splits = read(splits, "counts", ()).select("file_path", "split_start", "split_end", _earlier(tag).alias("earlier"))
    rows = read(splits, "rows", ALL_COLUMNS)
    return rows.withColumnRenamed("split_row", "foid") if number_rows else rows


def _tasks(files: int, size: int = 0) -> int:
    """Tasks for files, or splits, of that many bytes together, as the source groups them."""
    return max(1, -(-files // log_files.GROUP_FILES), -(-size // log_files.GROUP_BYTES))


def last_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    min_bytes: int = MIN_FILE_BYTES,
    modified_after: str | None = None,
) -> DataFrame:
    """``file_path, file_name, size_bytes, bytes_read, last_record``: the time of every file's last record.

    Only the first and the last block of a file are read, so what is read grows with the number of files; files that
    only Spark can open are read whole and have no ``bytes_read``.  A file without records has no row, a last record without a time a NULL.
    """
    chosen = _qualified(spark, paths)
    if not _can_open(chosen):
        rows = read_tags(spark, chosen, min_bytes, modified_after=modified_after)
        whole = rows.groupBy("file_path", "file_name").agg(F.max_by("datetime", "foid").alias("last_record"))
        size = F.lit(None).cast("long")
        return whole.select("file_path", "file_name", size.alias("size_bytes"), size.alias("bytes_read"), "last_record")
    tails = _source(spark, "tails", chosen, min_bytes, modified_after, (*TIME_COLUMNS, *DATE_AND_TIME))
    time = _time(lambda name: F.nullif(F.trim(f"`{name}`"), F.lit("")))
    return tails.select("file_path", "file_name", "size_bytes", "bytes_read", time.alias("last_record"))


def _from_text(
    spark: SparkSession, paths: Sequence[str], min_bytes: int, modified_after: str | None, tag: Column, number_rows: bool
) -> DataFrame:
    """The same through Spark's text reader: every line is split at its commas, headers are joined on by split.

    A split is read by one task in order, which is what its line numbers rest on.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = (
        reader.text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias(SLICE),
        )
        .filter(F.col("file_size") > min_bytes)
    )
    def split(text: str) -> Column:
        quoted = F.transform(
            F.split(text, COMMA_OUTSIDE_QUOTES), lambda c: F.regexp_replace(c, QUOTE_AT_END, "")
        )
        return F.when(F.col(text).contains('"'), quoted).otherwise(F.split(text, ","))

    def place(*spellings: str) -> Column:
        """Position of a column in the header, -1 when it is absent."""
        found = [F.nullif(F.array_position("_names", F.lit(n)), F.lit(0)) for n in spellings]
        return F.coalesce(*found, F.lit(0)).cast("int") - 1

    wanted = {name: (name, *ALIASES.get(name, ())) for name in ALL_COLUMNS}
    lines = lines.filter(F.trim("value") != "").withColumn("_line", F.monotonically_increasing_id())
    starts_file = (F.col(SLICE) == 0).cast("int")
    # One small row per input split: where the file's columns stand, and how
    # many records of the tag come before the split.
    in_file = Window.partitionBy("file_path")
    of_tag = Window.partitionBy("_tag").orderBy("file_name", "file_path", SLICE)
    earlier = of_tag.rowsBetween(Window.unboundedPreceding, -1)
    no_time = F.raise_error(F.concat(F.lit("no time column in "), F.col("file_path")))
    has_time = F.arrays_overlap("_names", F.array(*[F.lit(c) for c in (*TIME_COLUMNS, DATE_AND_TIME[0])]))
    splits = (
        lines.groupBy("file_path", "file_name", SLICE)
        .agg(
            F.min_by("value", "_line").alias("_first"),
            (F.count("*") - F.max(starts_file)).alias("_n"),
        )
        .withColumn("_tag", tag)
        .select(
            "file_path",
            SLICE,
            F.max(F.when(F.col(SLICE) == 0, F.regexp_replace("_first", "^\ufeff", ""))).over(in_file).alias("_header"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"),
        )
        .withColumn("_names", F.transform(split("_header"), F.trim))
        .withColumn("_names", F.when(has_time, F.col("_names")).otherwise(no_time))
        .select(
            "file_path",
            SLICE,
            "_earlier",
            F.struct(*[place(*s).alias(f"p{i}") for i, s in enumerate(wanted.values())]).alias("_at"),
        )
    )
    if number_rows:
        in_split = Window.partitionBy("file_path", SLICE).orderBy("_line")
        records = lines.withColumn("_row", F.row_number().over(in_split) - starts_file).filter("_row > 0")
    else:
        first_line = F.min("_line").over(Window.partitionBy("file_path", SLICE))
        records = lines.withColumn("_first", first_line).filter((F.col(SLICE) > 0) | (F.col("_line") > F.col("_first")))
    rows = records.join(splits, ["file_path", SLICE]).withColumn("_v", split("value"))
    if number_rows:
        rows = rows.withColumn("foid", F.col("_earlier") + F.col("_row"))
    at = {name: F.col("_at")[f"p{i}"] for i, name in enumerate(wanted)}
    return rows.withColumns({name: F.get("_v", at[name]) for name in wanted})
