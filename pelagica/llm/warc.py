"""Deterministic sharded WARC archives: sorted, rolled by size, committed by manifest."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path
from .common import stored

SHARD_BYTES = 32 << 20
MAX_SHARDS = 4096
KEYS_PER_SHARD = 32
ROLL_BYTES = 16 << 20
READ_BYTES = 1 << 20
OUT_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("8d8c5a52-3f0e-4f0c-9c1c-0d6b6b2d7c11")
MANIFEST = "_MANIFEST"
FILES = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string,"
    " refers_to long, file string"
)


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escape(url: str) -> str:
    """A header value must not hold line ends, nor spaces at its ends."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE
) -> bytes:
    """One response record, or a revisit of ``refers_to``, with fresh headers and digests."""

    def name(i: int | None, digest: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{i} {digest}')}>"

    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = http.encode() + (b"" if revisit else payload)
    fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url} {digest} {revisit}')}>" if revisit else name(page_id, digest))]
    fields += [("WARC-Date", date)]
    fields += [("WARC-Target-URI", _escape(url))] if url is not None else []
    fields += [("Page-Url", json.dumps(url))] if url is not None and _escape(url) != url else []
    fields += [("Page-Id", str(page_id))] if page_id is not None else []
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to, digest)), ("Refers-To-Page-Id", str(refers_to))]
    return _record("revisit" if revisit else "response", fields, block)


def _member(record: bytes) -> bytes:
    """The record as a gzip member without time or name, so that bytes depend on content only."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


class _ShardWriter:
    """Files of one shard, each under a temporary name of this attempt."""

    def __init__(self, root: str, shard: int, roll: int, date: str) -> None:
        self.files, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.roll, self.date = shard, roll, date
        self.attempt, self.seq, self.out, self.done = uuid.uuid4().hex, 0, None, []

    def add(self, record: bytes) -> None:
        member = _member(record)
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.files.open_output_stream(f"{self.base}/{self.temporary}", compression=None)
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
            about = b"software: pelagica\r\nformat: WARC File Format 1.1\r\n"
            fields = [
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>"),
                ("WARC-Date", self.date),
                ("WARC-Filename", self.name),
                ("Content-Type", "application/warc-fields"),
            ]
            self._put(_member(_record("warcinfo", fields, about)))
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temporary, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def _rows(rows: list[tuple], names: list[str], schema: pa.Schema | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


FILE_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()),
     ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)
RECORD_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())]
)


def _bounds(rows: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of all shards but the first.

    Taken from ids chosen by their hash, so that the same rows give the same shards
    on any cluster; at most about ``MAX_SHARDS * KEYS_PER_SHARD`` ids reach the driver.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    shards = min(MAX_SHARDS, max(1, -(-(total or 0) // shard_bytes)))
    if shards == 1:
        return []
    every = max(1, n // (shards * KEYS_PER_SHARD))
    picked = rows.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0))
    keys = np.sort([r[0] for r in picked.select("page_id").distinct().collect()])
    return sorted({int(keys[i * len(keys) // shards]) for i in range(1, shards)}) if len(keys) else []


def write_archives(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_from: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a WARC record for every row below the empty folder ``root``; returns the manifest.

    Records are sorted by id over all shards, and each shard is one task that streams
    its sorted rows into gzip members and starts a new file before ``roll_bytes`` of
    compressed size (a larger record has its own file).  Of records with equal
    payloads of at least ``revisit_from`` bytes the smallest id is the response and the
    others revisit it.  Headers, record ids and digests follow from the rows alone:
    the same rows give the same files byte for byte.

    A task writes under temporary names of its own attempt.  When all have ended, the
    files named by their results are renamed, then the manifest is written; readers go by the
    manifest, so that files of lost or repeated attempts are never read.

    Null html is an empty payload, a null url leaves out the target header.  Rows that
    repeat id and payload revisit that id.  Null ids come first; they are responses if no
    row with an id has their payload.  An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumns({"size": F.octet_length("html"), "sha": F.sha1("html")})
    first = (
        rows.where(F.col("size") >= revisit_from)
        .groupBy("sha", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    bounds = _bounds(rows, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(bounds, dtype=np.int64), ids.fillna(-(2**63)).astype("int64"), side="right")
        return pd.Series(np.where(ids.isna(), 0, found))

    marked = (
        rows.join(stored(first, "payloads"), ["sha", "size"], "left")
        .select(
            "page_id", "url", "html", "sha",
            F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
            shard_of("page_id").alias("shard"),
        )
        .repartitionById(len(bounds) + 1, "shard")
        .sortWithinPartitions(F.col("page_id").asc_nulls_first(), "sha", F.col("url").asc_nulls_first())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, before = None, None
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page_id, url, html, sha, refers, shard = (c[i].as_py() for c in columns)
                writer = writer or _ShardWriter(root, shard, roll_bytes, date)
                payload = html.encode()
                if refers is None and page_id is not None and before == (page_id, sha) and len(payload) >= revisit_from:
                    refers = page_id
                writer.add(page_record(page_id, url, payload, refers, date))
                before = (page_id, sha)
        if writer:
            writer.close()
        yield _rows(writer.done if writer else [], FILE_SCHEMA.names, FILE_SCHEMA)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{base}/{row['temporary']}", f"{base}/{row['name']}"
                if files.get_file_info(source).type == fs.FileType.File:
                    files.move(source, target)
                elif files.get_file_info(target).size != row["bytes"]:  # moved by an earlier attempt
                    raise FileNotFoundError(source)
            yield batch

    folders, base = fs.FileSystem.from_uri(root)
    folders.create_dir(f"{base}/_temporary", recursive=True)
    written = stored(marked.mapInArrow(write, FILES), "shards")
    committed = written.mapInArrow(commit, FILES).drop("temporary")
    committed.write.json(f"{root}/{MANIFEST}")
    remove_path(spark, f"{root}/_temporary")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Files of an archive folder: name, records, bytes and SHA-256."""
    schema = FILES.replace("temporary string, ", "")
    return spark.read.schema(schema).json(f"{root}/{MANIFEST}")


class _Bytes:
    """Decompressed bytes of a stream of gzip members, read piece by piece."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.data, self.inflate = stream, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        raw = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        raw = raw or self.stream.read(READ_BYTES)
        if not raw:
            return False
        self.data += self.inflate.decompress(raw)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                if self.data:
                    raise ValueError("an archive ends inside a record")
                return None
        found, self.data = self.data[:at], self.data[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < n:
            self.data = b""
            if not self.more():
                raise ValueError("an archive ends inside a record")
            parts.append(self.data)
            have += len(self.data)
        whole = b"".join(parts)
        self.data = whole[n:]
        return whole[:n]


def records_of(stream: pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a gzip WARC stream."""
    source = _Bytes(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record has no end mark")
        yield fields, block


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The pages of an archive folder, one row for every response and revisit record.

    Files are streamed record by record; block digests are verified, and a response's
    payload digest is computed anew.  With ``payloads`` a binary column ``payload`` holds the
    body (null for revisits).
    """
    schema = RECORD_SCHEMA.append(pa.field("payload", pa.binary())) if payloads else RECORD_SCHEMA

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        if fields["warc-block-digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"a damaged record in {name}")
                        head, _, body = block.partition(b"\r\n\r\n")
                        n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                        stated = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != n or digest32(body) != stated):
                            raise ValueError(f"a damaged payload in {name}")
                        uri, own, other = (fields.get(k) for k in ("warc-target-uri", "page-id", "refers-to-page-id"))
                        uri = json.loads(fields["page-url"]) if "page-url" in fields else uri
                        row = (own and int(own), uri, kind, n, stated, other and int(other), name)
                        rows.append((*row, body if kind == "response" else None) if payloads else row)
                        size += len(body) * payloads + 200
                        if size > OUT_BYTES:
                            yield _rows(rows, schema.names, schema)
                            rows, size = [], 0
        yield _rows(rows, schema.names, schema)

    files = manifest(spark, root).select("name")
    n = files.count()
    names = files.repartition(max(1, n), "name")
    return names.mapInArrow(read, RECORDS + (", payload binary" if payloads else ""))
