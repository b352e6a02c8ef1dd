"""SimHash near-duplicates found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, stored

WORDS = 4
SEED = 42
DISTANCE = 4
# First bit and width of each segment.  Four differing bits leave one of three
# segments with at most one of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# Shingles summed at once, and bucket size from which the other bits are used too.
BLOCK = 1 << 15
LARGE = 128
# Rows of one key from which their links are walked through as a tree; smaller groups are compared side by side.
FAMILY = 512
PENDING = 1 << 20


def text_fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    A-Z are lower-cased, words end at ASCII white space, shingles are joined by one
    space and hashed by XXH64.  A text of fewer words is one shingle; a text without
    words (or null) has fingerprint 0.  A bit is 1 if set in over half the hashes.
    """
    # bytes.lower() and bytes.split() know ASCII only, as the definition wants it
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    lo, hi = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(lo[at : at + BLOCK], hi[at : at + BLOCK])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """``doc_id, fp`` (a signed long holding the 64 bits) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(t.as_py(), words) for t in batch.column(1)]
            fp = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), fp], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: for every bit the segment around it with that bit left out.

    ``key`` holds the bit's number and the rest of its segment.
    """

    def key(bit: int, first: int, width: int) -> Column:
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit - first)))
        return segment.cast("int").bitwiseOR(F.lit(bit << 22))

    keys = [key(bit, first, width) for first, width in SEGMENTS for bit in range(first, first + width)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A subset of the edges that connects the same nodes."""
    nodes, ids = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    kept = []
    pairs = zip(ids[: len(a)].tolist(), ids[len(a) :].tolist())
    for i, (x, y) in enumerate(pairs):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return a[kept], b[kept]


class _Edges:
    """Verified pairs, thinned to a forest whenever many have come together."""

    def __init__(self) -> None:
        self.a = self.b = np.zeros(0, dtype=np.uint64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.pending += len(a)
        if self.pending > PENDING:
            self.thin()

    def thin(self) -> None:
        a = np.concatenate([self.a, *(x for x, _ in self.parts)])
        b = np.concatenate([self.b, *(y for _, y in self.parts)])
        self.a, self.b = _forest(a, b)
        self.parts, self.pending = [], 0


def _link_group(fps: np.ndarray, distance: int, edges: _Edges) -> None:
    """A tree over each set of ``fps`` that links connect.

    A fingerprint is compared with those not reached yet, and what it reaches is gone from the rest: a family
    whose members link takes a few passes over it, not all its pairs.
    """
    rest = fps
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            one = reached.pop()
            near = np.bitwise_count(rest ^ one) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                edges.add(np.full(len(found), one), found)
                reached += list(found)


def _link(keys: np.ndarray, fps: np.ndarray, distance: int, edges: _Edges) -> None:
    """Pairs within equal neighbouring ``keys`` that differ in few enough bits, as many as connect them."""
    if not len(keys):
        return
    starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    sizes = np.diff(starts)
    for i in np.flatnonzero(sizes > FAMILY).tolist():
        _link_group(fps[starts[i] : starts[i + 1]], distance, edges)
    usual = np.repeat(sizes <= FAMILY, sizes)
    keys, fps = keys[usual], fps[usual]
    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        edges.add(fps[near], fps[near + step])
        step += 1


def _link_bucket(fps: np.ndarray, distance: int, edges: _Edges) -> None:
    """Pairs within one large bucket: of ``distance + 1`` pieces one is equal."""
    cuts = np.linspace(0, 64, distance + 2).astype(int)
    for first, end in zip(cuts[:-1], cuts[1:]):
        piece = (fps >> np.uint64(first)) & np.uint64((1 << int(end - first)) - 1)
        order = np.argsort(piece, kind="stable")
        _link(piece[order], fps[order], distance, edges)


def link_buckets(
    batches: Iterator[pa.RecordBatch], distance: int = DISTANCE, large: int = LARGE
) -> Iterator[pa.RecordBatch]:
    """Edges that connect all linked fingerprints of each bucket of sorted rows."""
    edges = _Edges()
    rest_k, rest_f = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64)

    def work(keys: np.ndarray, fps: np.ndarray) -> None:
        if not len(keys):
            return
        starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        sizes = np.diff(starts)
        for i in np.flatnonzero(sizes > large).tolist():
            _link_bucket(fps[starts[i] : starts[i + 1]], distance, edges)
        usual = np.repeat((sizes > 1) & (sizes <= large), sizes)
        _link(keys[usual], fps[usual], distance, edges)

    for batch in batches:
        keys = np.concatenate((rest_k, batch.column(0).to_numpy()))
        fps = np.concatenate((rest_f, batch.column(1).to_numpy().view(np.uint64)))
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
        work(keys[:cut], fps[:cut])
        rest_k, rest_f = keys[cut:], fps[cut:]
    work(rest_k, rest_f)
    edges.thin()
    yield pa.record_batch(
        [pa.array(edges.a.view(np.int64)), pa.array(edges.b.view(np.int64))], names=["a", "b"]
    )


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that connect every linked pair.

    Each distinct fingerprint is indexed under its 64 one-wildcard segment variants;
    rows of a variant meet by equality in one sorted partition and are verified by
    their full distance.  Of the pairs a task verifies only a forest leaves it, which
    keeps every connection and never writes all pairs of a group; a family of very many fingerprints that link
    is walked through as a tree (``_link_group``).
    """
    if distance > 2 * len(SEGMENTS) - 2:
        raise ValueError(f"three segments can't guarantee a distance of {distance}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return link_buckets(batches, distance)

    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = variants(fps).repartition(n, "key").sortWithinPartitions("key")
    return index.mapInArrow(run, "a long, b long").distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of at most
    ``distance`` differing bits, the row's own included.  Null and empty texts have
    fingerprint 0 and link like any other; very long texts are read whole.  Rows with a null id take part; a group of
    only null ids has a null component.  Repeated rows each get their row, an empty table gives none.  Columns besides id
    and text are ignored, whatever their names.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = links(distinct.select("fp"), distance)
    # nodes are fingerprints; the smallest id of a component comes from its members
    reach = components(edges)
    grouped = distinct.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = grouped.join(smallest, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def drop_near(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """``docs`` with one row of every group: the one with the smallest id.

    Rows with a null id belong to no other row's group and stay, as do rows that
    repeat the id that stays.
    """
    groups = near_groups(docs, id_col, text_col, words, distance)
    key = free_name(docs.columns, "x_id")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[key], "left_anti")
