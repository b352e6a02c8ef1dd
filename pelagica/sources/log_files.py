"""Logger files as a data source of their own: rows by each file's header, counts by split, or only the last record; and a writer of such files.

A partition is a group of splits, made from the listing: small files share one, large files are cut at ``SPLIT_BYTES``, a
line belonging to the split in which it starts.  Every split reads its file's header first, so columns are found by name without a join, and
numbers its rows as it reads them, so no line is shuffled or sorted for its number.

``walk``, ``splits_of`` and ``read_splits`` do the same for files that stand in a table: tasks list the folders, make the splits and
read them, and the driver holds no path.

The writer makes a file for each run of rows with the same folder, so that the cost of a file is that of opening it once: Spark's
CSV writer takes several processes a file on a local disk, and moves each file twice.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "logger_files"
SPLIT_BYTES = 16 << 20
# Bytes and files of a partition, and rows of a batch.
GROUP_BYTES, GROUP_FILES = 64 << 20, 256
BATCH_ROWS = 20_000
# Bytes read at a file's start for its header, and at its end for its last record; doubled while they hold no whole line.
BLOCK = 1 << 16
# What Spark's writers escape in the name of a folder, and the folder of no value.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Columns of the text that is written, after the folders.
HEADER, LINE = "_header", "_line"

FILE = "file_path STRING, file_name STRING"
SCHEMAS = {
    "rows": FILE + ", split_start BIGINT, split_row BIGINT",
    "counts": FILE + ", split_start BIGINT, split_end BIGINT, n BIGINT",
    "tails": FILE + ", size_bytes BIGINT, bytes_read BIGINT",
}
# What a walk finds in a folder, and splits in a table.
ENTRIES = "path STRING, folder BOOLEAN, size_bytes BIGINT, modified TIMESTAMP"
SPLITS = "file_path STRING, split_start BIGINT, split_end BIGINT"


@dataclass(frozen=True)
class Split:
    path: str
    start: int
    end: int
    size: int
    # records of the tag that are numbered before those of the split
    earlier: int = 0

    @property
    def name(self) -> str:
        return unquote(self.path.rsplit("/", 1)[-1])


class Group(InputPartition):
    def __init__(self, splits: list[Split]) -> None:
        super().__init__(0)
        self.splits = splits


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it; an error if only Spark can open it."""
    if path.startswith("file:"):
        path = "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _listed(paths: list[str]) -> Iterator[tuple[str, pafs.FileSystem, str, pafs.FileInfo]]:
    """Every path with its file system, the path in it and what stands there; local ones are looked up together."""
    here = [path for path in paths if "://" not in path or path.startswith("file:")]
    if here:
        files, roots = pafs.LocalFileSystem(), [file_system(path)[1] for path in here]
        for path, root, top in zip(here, roots, files.get_file_info(roots)):
            yield path, files, root, top
    for path in paths:
        if "://" in path and not path.startswith("file:"):
            files, root = file_system(path)
            yield path, files, root, files.get_file_info(root)


def list_splits(
    paths: list[str], glob: str = "*.csv", min_bytes: int = 0, modified_after: str | None = None, split_bytes: int = SPLIT_BYTES
) -> list[Split]:
    """Splits of the files below ``paths`` that are larger than ``min_bytes``, in the order of their paths.

    Like in Spark's readers, names that start with ``_`` or ``.`` are hidden, folders of ``column=value`` names aside.
    """
    since = datetime.fromisoformat(modified_after) if modified_after else None
    if since and since.tzinfo is None:
        since = since.replace(tzinfo=timezone.utc)
    found: dict[str, int] = {}
    for path, files, root, top in _listed(paths):
        local = isinstance(files, pafs.LocalFileSystem)
        # what stands before a path of its file system in its URI, as in hdfs://host or s3://
        before = "file://" if local else path.rstrip("/").removesuffix(root.rstrip("/"))
        if top.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        inside = [top] if top.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(root, recursive=True))
        for info in inside:
            parts = info.path.removeprefix(root).strip("/").split("/")
            hidden = any(p.startswith(".") or p.startswith("_") and "=" not in p for p in parts)
            if info.type != pafs.FileType.File or hidden or not fnmatch.fnmatch(info.base_name, glob):
                continue
            if info.size > min_bytes and (since is None or info.mtime > since):
                found[before + (quote(info.path, safe="/=") if local else info.path)] = info.size
    return [
        Split(path, at, min(at + split_bytes, size), size)
        for path, size in sorted(found.items()) for at in range(0, max(1, size), split_bytes)
    ]


def as_uri(path: str) -> str:
    """A path as Spark's listings write it, nothing escaped, in the form of ``list_splits``."""
    return "file://" + quote("/" + path.removeprefix("file:").lstrip("/"), safe="/=") if path.startswith("file:") else path


def _batched(rows: Iterable[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), types)], names=list(names))


def walk(batches: Iterable[pa.RecordBatch], glob: str = "*.csv") -> Iterator[pa.RecordBatch]:
    """``ENTRIES`` of the folders in the column ``path``: folders, and files with bytes whose name fits, hidden ones aside as in Spark's readers."""

    def found() -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inside = file_system(as_uri(path))
                for info in files.get_file_info(pafs.FileSelector(inside)):
                    name, folder = info.base_name, info.type == pafs.FileType.Directory
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                    if hidden or not folder and (info.type != pafs.FileType.File or not info.size or not fnmatch.fnmatchcase(name, glob)):
                        continue
                    # to the millisecond, as in Spark's listings
                    moment = None if info.mtime_ns is None else info.mtime_ns // 1_000_000 * 1000
                    yield f"{path.rstrip('/')}/{name}", folder, None if folder else info.size, moment

    return _batched(found(), ("path", "folder", "size_bytes", "modified"), (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))


def splits_of(batches: Iterable[pa.RecordBatch], **chosen) -> Iterator[pa.RecordBatch]:
    """``SPLITS`` of the files in the column ``file_path``, as large as they are now; ``chosen`` go to ``list_splits``."""
    found = (
        (s.path, s.start, s.end)
        for batch in batches for s in list_splits([as_uri(p) for p in batch.column("file_path").to_pylist()], **chosen)
    )
    return _batched(found, ("file_path", "split_start", "split_end"), (pa.string(), pa.int64(), pa.int64()))


def read_splits(batches: Iterable[pa.RecordBatch], options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """What the source reads in the mode of ``options``, from ``SPLITS``; rows are numbered on from a column ``earlier``, if there is one."""
    reader = LoggerReader({"paths": "[]"} | options)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file_path", "split_start", "split_end")]
        earlier = batch.column("earlier").to_pylist() if "earlier" in batch.schema.names else [0] * batch.num_rows
        yield from reader.read(Group([Split(path, start, end, end, n) for path, start, end, n in zip(*columns, earlier)]))


def _cells(line: str) -> list[str]:
    return next(csv.reader([line], skipinitialspace=True), []) if '"' in line else line.split(",")


class _File:
    """One open file: its header's names, where its data start, and the bytes read so far."""

    def __init__(self, path: str) -> None:
        files, inside = file_system(path)
        self.path, self.source, self.read = path, files.open_input_file(inside), 0
        self.size = self.source.size()
        block, first = b"", ""
        while True:
            more = self.bytes(len(block), max(BLOCK, len(block)))
            block += more
            at = 0
            while (end := block.find(b"\n", at)) >= 0 or not more:
                end = len(block) if end < 0 else end + 1
                first = block[at:end].decode("utf-8", "replace").removeprefix("﻿").strip()
                at = end
                if first or end == len(block):
                    break
            if first or not more:
                break
        self.data = at
        self.names = [c.strip() for c in _cells(first)]

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def bytes(self, start: int, count: int) -> bytes:
        self.source.seek(start)
        got = self.source.read(count)
        self.read += len(got)
        return got

    def line_end(self, at: int) -> int:
        """Where the line that holds byte ``at`` ends, its newline included."""
        while at < self.size:
            got = self.bytes(at, BLOCK)
            found = got.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(got)
        return self.size

    def lines(self, start: int, end: int) -> list[str]:
        """Lines with text that start in a split, the header aside."""
        begin = self.data if start <= self.data else self.line_end(start - 1)
        if begin >= end:
            return []
        got = self.bytes(begin, end - begin)
        if not got.endswith(b"\n"):
            got += self.bytes(end, self.line_end(end) - end)
        lines = got.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        return [x for x in lines if x and not x.isspace()]

    def last_line(self) -> str | None:
        """The last line with text, from blocks at the file's end."""
        count = BLOCK
        while True:
            start = max(self.data, self.size - count)
            got = self.bytes(start, self.size - start).rstrip(b" \t\r\n")
            at = max(got.rfind(b"\n"), got.rfind(b"\r"))
            if at >= 0 or start == self.data:
                return got[at + 1 :].decode("utf-8", "replace") or None
            count *= 2


def _columns(lines: list[str], names: list[str], wanted: list[tuple[str, ...]]) -> list[pa.Array]:
    """A text column for each wanted one, by its first spelling in the header; NULL where absent or in a short row."""
    if any('"' in x for x in lines):
        cells = pa.array([_cells(x) for x in lines], type=pa.list_(pa.string()))
    else:
        cells = pc.split_pattern(pa.array(lines, type=pa.string()), ",")
    offsets, values = cells.offsets.to_numpy(), cells.values
    out = []
    for spellings in wanted:
        at = next((names.index(s) for s in spellings if s in names), None)
        if at is None:
            out.append(pa.nulls(len(lines), pa.string()))
            continue
        place = offsets[:-1] + at
        out.append(values.take(pa.array(place, mask=place >= offsets[1:])))
    return out


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


class LoggerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.mode = options.get("mode", "rows")
        self.columns = [tuple(c) for c in json.loads(options.get("columns", "[]"))]
        self.required = json.loads(options.get("required", "[]"))
        self.chosen = {
            "paths": json.loads(options["paths"]), "glob": options.get("glob", "*.csv"), "min_bytes": int(options.get("minbytes", 0)),
            "modified_after": options.get("modifiedafter"), "split_bytes": int(options.get("splitbytes", SPLIT_BYTES)),
        }
        if self.mode == "tails":
            self.chosen["split_bytes"] = 1 << 62

    def partitions(self) -> list[InputPartition]:
        groups: list[list[Split]] = [[]]
        held = 0
        for split in list_splits(**self.chosen):
            cost = 2 * BLOCK if self.mode == "tails" else split.end - split.start
            if groups[-1] and (held + cost > GROUP_BYTES or len(groups[-1]) >= GROUP_FILES):
                groups.append([])
                held = 0
            groups[-1].append(split)
            held += cost
        return [Group(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Batches of about ``BATCH_ROWS``, over many small files if need be."""
        held: list[pa.RecordBatch] = []
        for batch in self._batches(partition):
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS or len(held) >= GROUP_FILES:
                yield from _joined(held)
                held = []
        yield from _joined(held)

    def _batches(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            with _File(split.path) as file:
                if self.required and not set(self.required) & set(file.names):
                    raise ValueError(f"no time column in {split.path}")
                yield from getattr(self, f"_{self.mode}")(file, split)

    def _counts(self, file: _File, split: Split) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch(
            [[split.path], [split.name], [split.start], [split.end], [len(file.lines(split.start, split.end))]],
            names=["file_path", "file_name", "split_start", "split_end", "n"],
        )

    def _rows(self, file: _File, split: Split) -> Iterator[pa.RecordBatch]:
        lines = file.lines(split.start, split.end)
        for at in range(0, len(lines), BATCH_ROWS):
            some = lines[at : at + BATCH_ROWS]
            fixed = [np.full(len(some), x, dtype=object) for x in (split.path, split.name)]
            yield pa.record_batch(
                [pa.array(x, type=pa.string()) for x in fixed]
                + [pa.array(np.full(len(some), split.start)), pa.array(split.earlier + np.arange(at + 1, at + 1 + len(some)))]
                + _columns(some, file.names, self.columns),
                names=["file_path", "file_name", "split_start", "split_row", *(c[0] for c in self.columns)],
            )

    def _tails(self, file: _File, split: Split) -> Iterator[pa.RecordBatch]:
        line = file.last_line()
        if line is not None:
            cells = _columns([line], file.names, self.columns)
            yield pa.record_batch(
                [pa.array([split.path]), pa.array([split.name]), pa.array([split.size]), pa.array([file.read]), *cells],
                names=["file_path", "file_name", "size_bytes", "bytes_read", *(c[0] for c in self.columns)],
            )


def _folder(column: str, value: str | None) -> str:
    """``column=value`` as Spark's writers name it."""
    return f"{column}=" + (ESCAPED.sub(lambda found: f"%{ord(found[0]):02X}", value) if value else NO_VALUE)


class LoggerWriter(DataSourceArrowWriter):
    """Lines under their headers as one file for each run of rows with the same folder.

    The schema is the folders' columns, then ``HEADER`` and ``LINE``, all text.  A file gets its name once it is whole, by
    write and task, so a task that runs again replaces its own files; a write that fails deletes what it has written.
    """

    def __init__(self, path: str, folders: list[str]) -> None:
        self.path, self.folders, self.id = path, folders, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = file_system(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.id}.csv"
        now, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                files.move(f"{at}/.{name}", f"{at}/{name}")

        for batch in iterator:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            keys = list(zip(*columns[:-2]))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != now:
                    close()
                    now = keys[lo]
                    at = "/".join([root.rstrip("/"), *map(_folder, self.folders, now)])
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(f"{at}/.{name}")
                    out.write(f"{columns[-2][lo]}\n".encode())
                out.write("".join(f"{x}\n" for x in columns[-1][lo:hi]).encode())
        close()
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)  # a folder of no files can be read as well

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = file_system(self.path)
        for info in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.base_name.endswith(f"-{self.id}.csv"):
                files.delete_file(info.path)


class LoggerFiles(DataSource):
    """``spark.read.format("logger_files")``; see ``tag_logs`` for its options."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        names = [c[0] for c in json.loads(self.options.get("columns", "[]"))]
        mode = self.options.get("mode", "rows")
        return ", ".join([SCHEMAS[mode], *(f"`{n}` STRING" for n in names if mode != "counts")])

    def reader(self, schema) -> DataSourceReader:
        return LoggerReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or schema.names[-2:] != [HEADER, LINE]:
            raise ValueError("logger files are appended, as folders, header and line")
        return LoggerWriter(self.options["path"], schema.names[:-2])
