"""Token packing by concatenate and cut, with prefix sums over partition totals."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

LENGTH = 2048
END_ID = 1
# The pattern that byte-level BPE vocabularies of this kind split texts by (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Longer runs of one kind are left to the tokenizers library.
LONG_RUN = 20_000
TOKENS = "doc_id long, part int, before long, tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long,"
    " ids_crc32 long, ids binary"
)
OUT_BYTES = 8 << 20


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as the ``tokenizers`` library gives them, without special tokens added.

    For a byte-level BPE whose merges stand in the order of their ids, ``tiktoken`` with
    the same vocabulary gives the same ids several times faster, and is used except for
    texts with very long runs; any other file goes through ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    kind = (model.get("type"), before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True))
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges") or []]
    vocab = model.get("vocab") or {}
    ranks = [vocab.get(m.replace(" ", "")) for m in merges] if kind[0] == "BPE" else []
    if kind != ("BPE", "ByteLevel", False, True) or spec.get("normalizer") or None in ranks or ranks != sorted(ranks):
        return plain
    import tiktoken

    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    usual = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    if len({b for b in usual if len(b) == 1}) < 256:
        return plain
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=usual, special_tokens=special)
    allowed = set(special)
    long_run = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")

    def encode(text: str) -> list[int]:
        if len(text) > LONG_RUN and long_run.search(text):
            return plain(text)
        return fast.encode(text, allowed_special=allowed)

    return encode


def tokenize(
    docs: DataFrame,
    path: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Callable[[str], list[int]] | None = None,
) -> DataFrame:
    """First pass: ``doc_id, part, before, tokens, ids`` of every row.

    ``ids`` are little-endian numbers of two bytes where the vocabulary allows it, else of
    four, the end id last; ``before`` counts the ids of earlier rows in the same partition
    ``part``.  The result must be stored before use, since ``part`` names this run's partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens or encoder(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            names = ["doc_id", "part", "before", "tokens", "ids"]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                rows.append((doc, part, before, len(ids), ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + ids.tobytes()))
                before += len(ids)
                size += 2 * len(ids)
                if size > OUT_BYTES:
                    yield _batch(rows, names, TOKEN_TYPES)
                    rows, size = [], 0
            yield _batch(rows, names, TOKEN_TYPES)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, TOKENS)


TOKEN_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
PIECE_TYPES = [*[pa.int64()] * 7, pa.binary()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


def _ids(data: bytes) -> np.ndarray:
    """Ids as stored: an odd number of bytes marks those of four bytes."""
    return np.frombuffer(data, dtype="<u2").astype("<u4") if len(data) % 2 == 0 else np.frombuffer(data[1:], dtype="<u4")


def cut(tokens: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Second pass: every document's pieces in fixed windows over all tokens.

    ``tokens`` is the stored first pass.  A prefix sum over the partitions' totals (one row
    a partition) gives each partition its first global offset, and with ``before`` each
    document; window ``k`` holds the offsets from ``k * length``.
    """
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("n"))
    # stored, so that Spark knows how small it is and need not shuffle the tokens to join it
    starts = totals.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    placed = tokens.join(stored(starts, "starts"), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = _ids(data.as_py())
                raw, n, start = memoryview(ids.tobytes()), len(ids), 0
                while start < n:
                    window, offset = divmod(at + start, length)
                    step = min(n - start, length - offset)
                    piece = raw[4 * start : 4 * (start + step)]
                    rows.append((doc, start, step, n, window, offset, zlib.crc32(piece), bytes(piece) if with_ids else None))
                    size += 4 * step * with_ids + 60
                    start += step
                if size > OUT_BYTES:
                    yield _batch(rows, names, PIECE_TYPES)
                    rows, size = [], 0
            yield _batch(rows, names, PIECE_TYPES)

    return placed.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids, only the last one padded.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids`` (four
    bytes an id; null without ``with_ids``).  Null and empty texts are the end id alone; null
    ids and repeated rows are packed like any other, each row for itself; an empty table gives no piece.  A text longer than a
    sequence has a piece in each it reaches.  Columns besides id and text are ignored, whatever their names.
    """
    return cut(stored(tokenize(docs, path, end_id, id_col, text_col), "tokens"), length, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the windows put together from their pieces.

    A window has at most its length in pieces, so the lists are bounded.  Windows inside one
    document are a single piece; the others are the boundary records that meet here.
    """
    name = free_name(pieces.columns, "x_pieces")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = pieces.groupBy("sequence_id").agg(ordered.alias(name))
    ids = F.aggregate(name, F.lit(b""), lambda whole, piece: F.concat(whole, piece["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), F.transform(name, lambda p: p["doc_id"]).alias("doc_ids"))
