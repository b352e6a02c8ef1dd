"""Near copies by the Jaccard similarity of their word shingles, found through SimHash and MinHash bands.

SimHash (``simhash``: one-wildcard variants, links, components) gives a bucket for every set of texts that its links connect.  Texts of
a similarity of 0.8 often differ in more bits than its links span, so MinHash bands give buckets as well.  Then
three passes, whatever the data: inside a bucket sketches choose a spanning forest of the most
similar texts, whose edges are compared exactly; texts that are still apart from a similar one are compared
exactly inside their bucket.  No pass writes the pairs of a bucket: a forest has fewer edges than texts, and the last pass gives links only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, components, free_name, stored

WORDS = 5
SIMILARITY = 0.8
SEED = 42
# Two texts of similarity s meet in a band with chance 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8.
BANDS, ROWS = 24, 5
# Shingles whose minima are taken at once.
BLOCK = 4096
# A sketch has four bits of each minimum.  The similarity it estimates has a standard deviation of 0.038 at 0.8, so texts of that
# similarity come out LESS or more below their limit with a chance of 0.004.
DIGITS, LESS = 16, 0.1
# Texts of a bucket, and code points of texts, that one task compares; larger buckets are cut into blocks, each pair of
# blocks being a task.
TEXTS, CHARS = 4096, 16_000_000
_random = np.random.default_rng(SEED)
MULTIPLIERS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
# A bucket's key and the two blocks of it that a task compares.
TASK = ["key", "i", "j"]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words and shingles are those of ``simhash.text_fingerprint``: A-Z lower-cased, words end at ASCII white space, a
    text of fewer words is one shingle, and a text without words has none.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band, the minima of ``ROWS`` orders of the shingles folded into 64 bits, and a sketch of all minima."""
    least = np.full(len(MULTIPLIERS), ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (MULTIPLIERS[:, None] * found[None, at : at + BLOCK]).min(axis=1), out=least)
    least ^= least >> np.uint64(32)
    digits = (least % np.uint64(DIGITS)).astype(np.uint8)
    keys = (least.reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64) ^ BAND
    return keys ^ (keys >> np.uint64(29)), (digits[::2] * DIGITS + digits[1::2]).tobytes()


def _index(texts: DataFrame, words: int) -> DataFrame:
    """``node, chars, sketch, keys`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [signature(shingles(t.as_py(), words)) for t in batch.column(1)]
            keys = pa.array([k.view(np.int64) for k, _ in known], type=pa.list_(pa.int64()))
            sketches = pa.array([x for _, x in known], type=pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(2), sketches, keys], names=["node", "chars", "sketch", "keys"])

    slim = texts.select("node", "text", F.length("text").cast("long").alias("chars"))
    return slim.mapInArrow(run, "node long, chars long, sketch binary, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of sorted ``key, node`` whose key has several nodes."""
    held = np.zeros((2, 0), dtype=np.int64)  # the last row, which may still get company
    shown = False  # whether its key has come out already
    for batch in batches:
        rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
        if not rows.shape[1]:
            continue
        key, node = rows
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        rows = rows[:, new]
        key = rows[0]
        same = key[1:] == key[:-1]
        several = np.concatenate(([shown], same)) | np.concatenate((same, [False]))
        out = rows[:, :-1][:, several[:-1]]
        shown, held = bool(several[-1]), rows[:, -1:]
        yield pa.record_batch([pa.array(x) for x in out], names=["key", "node"])
    if shown:
        yield pa.record_batch([pa.array(x) for x in held], names=["key", "node"])


def _blocks(rows: DataFrame, weight: str, bound: int) -> DataFrame:
    """Rows of ``key`` with the blocks ``i, j`` that a task compares: 0, 0 in buckets of a weight up to ``bound``.

    Larger buckets are cut into blocks, and a row goes to every pair of blocks with its own, so that any two rows meet.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.sum(F.expr(weight)) / bound).cast("int").alias("blocks")).where("blocks > 1")
    own = F.expr("int(pmod(xxhash64(node), blocks))")
    cut = rows.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cut = cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "own", "other")
    zero = F.lit(0)
    return rows.join(sizes, "key", "left_anti").withColumns({"i": zero, "j": zero}).unionByName(cut)


def _by_task(rows: DataFrame, work: Callable[[pa.Table], tuple[list, ...]], schema: str) -> DataFrame:
    """``work`` on the rows of every task, whose rows are sorted by node."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            out = work(pa.Table.from_batches(held))
            held.clear()
            return pa.record_batch([pa.array(x, type=pa.int64()) for x in out], names=names)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                now = tuple(ids[lo])
                if held and now != last:
                    yield done()
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield done()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*TASK, "node", *(c for c in rows.columns if c not in (*TASK, "node"))]
    dealt = rows.select(columns).repartition(n, *TASK).sortWithinPartitions(*TASK, "node")
    return dealt.mapInArrow(run, schema)


def _sketches(table: pa.Table) -> np.ndarray:
    flat = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
    return np.concatenate((flat // DIGITS, flat % DIGITS), axis=1)


def _alike(sketches: np.ndarray, at: int) -> np.ndarray:
    """Estimated similarity of one text and all."""
    return ((sketches == sketches[at]).mean(axis=1) - 1 / DIGITS) / (1 - 1 / DIGITS)


def _forest(limit: float) -> Callable[[pa.Table], tuple[list, ...]]:
    def work(table: pa.Table) -> tuple[list, ...]:
        """Edges of a spanning forest of the texts of a task, of the most similar pairs above the limit."""
        node, sketches = table.column("node").to_numpy(), _sketches(table)
        best, source = np.full(len(node), -1.0), np.zeros(len(node), dtype=np.int64)
        out: list[tuple[int, int]] = []
        at, rest = 0, np.ones(len(node), dtype=bool)
        for _ in range(len(node) - 1):
            rest[at] = False
            alike = _alike(sketches, at)
            closer = rest & (alike > best)
            best[closer], source[closer] = alike[closer], at
            at = int(np.argmax(np.where(rest, best, -2.0)))
            if best[at] >= limit:
                out.append((node[source[at]], node[at]))
        return [min(e) for e in out], [max(e) for e in out]

    return work


def _apart(limit: float) -> Callable[[pa.Table], tuple[list, ...]]:
    def work(table: pa.Table) -> tuple[list, ...]:
        """Texts of a task that have one above the limit in another group."""
        label = table.column("label").to_numpy()
        if (label == label[0]).all():
            return [], []
        sketches = _sketches(table)
        open_ = [at for at in range(len(label)) if (_alike(sketches, at)[label != label[at]] >= limit).any()]
        return [table.column("key")[at].as_py() for at in open_], [table.column("node")[at].as_py() for at in open_]

    return work


def _exact(words: int, similarity: float) -> Callable[[pa.Table], tuple[list, ...]]:
    def work(table: pa.Table) -> tuple[list, ...]:
        """Links between the groups of a task's texts, by exact comparison; no more than connect them."""
        node, label = table.column("node").to_pylist(), table.column("label").to_numpy()
        sets = [shingles(t.as_py(), words) for t in table.column("text")]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        owner, flat = owner[order], flat[order]
        group = np.unique(label, return_inverse=True)[1]
        a: list[int] = []
        b: list[int] = []
        for at, own in enumerate(sets):
            lo, hi = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            places = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owner[places.astype(np.int64)], minlength=len(sets))
            near = both >= similarity * (sizes + len(own) - both)
            for other in np.flatnonzero(near):
                if group[other] != group[at]:
                    group[group == group[other]] = group[at]
                    a.append(min(node[at], node[other]))
                    b.append(max(node[at], node[other]))
        return a, b

    return work


def _verify(pairs: DataFrame, bodies: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (``a, b``) whose whole texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}

            def of(node: int, text: pa.Scalar) -> np.ndarray:
                if node not in known:
                    known[node] = shingles(text.as_py(), words)
                return known[node]

            a, b = batch.column(0), batch.column(1)
            rows = zip(a.to_pylist(), b.to_pylist(), batch.column(2), batch.column(3))
            near = [jaccard(of(x, s), of(y, t)) >= similarity for x, y, s, t in rows]
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(near, type=pa.bool_()))

    left = bodies.select(F.col("node").alias("a"), F.col("text").alias("s"))
    right = bodies.select(F.col("node").alias("b"), F.col("text").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def links(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified edges ``a, b``, stored, that connect all near texts meeting in a bucket; ``texts`` is ``node, text``.

    Every edge is an exact similarity of whole texts.  Two texts that reach it are connected unless SimHash does not link them and they
    meet in no band, or their sketches differ by far more than their texts do (see ``LESS``).
    """
    spark, limit = texts.sparkSession, similarity - LESS
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as keep:
        index = keep(_index(texts, words), "bands")
        linked = simhash.near_groups(texts, "node", "text", words).select(F.col("component_id").alias("key"), F.col("doc_id").alias("node"))
        keyed = index.select(F.explode("keys").alias("key"), "node").unionByName(linked)
        keyed = keyed.repartition(n, "key").sortWithinPartitions("key", "node")
        rows = keep(keyed.mapInArrow(_shared, "key long, node long"), "shared")
        met = rows.select("node").distinct()
        bodies = keep(texts.join(met, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "bodies")
        slim = index.join(met, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("chars").alias("chars"))
        tasks = keep(_blocks(rows.join(keep(slim, "sketches"), "node"), "1", TEXTS), "tasks")

        pairs = keep(_by_task(tasks.drop("chars"), _forest(limit), "a long, b long").distinct(), "pairs")
        first = keep(_verify(pairs, bodies, words, similarity), "first")

        reach = components(first)
        labelled = tasks.join(reach, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        apart = keep(_by_task(labelled.drop("chars"), _apart(limit), "key long, node long").distinct(), "apart")
        known = apart.join(labelled.select("node", "label", "chars").distinct(), "node")
        whole = _blocks(known, "chars + 1000", CHARS).drop("chars").join(bodies, "node")
        second = _by_task(whole, _exact(words, similarity), "a long, b long")
        return stored(first.union(second), "links")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over texts whose distinct shingles of ``words`` words have a
    Jaccard similarity of at least ``similarity``, the row's own included; equal texts (by a 64-bit hash) count as one.
    Null and empty texts are equal, very long texts are compared whole.  Rows with a null id take part; a group of only null ids has a null
    component.  Repeated rows each get theirs, an empty table gives none, and other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    firsts = stored(texts.groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    reach = components(links(texts.select("node", "text"), words, similarity))
    grouped = firsts.join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = grouped.join(smallest, "component").select("node", "component_id")
    return texts.select("doc_id", "node").join(labels, "node").select("doc_id", "component_id")


def drop_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one row of every group: the one with the smallest id.

    Rows with a null id belong to no other row's group and stay, as do rows that repeat the id that stays.
    """
    groups = near_groups(docs, id_col, text_col, words, similarity)
    key = free_name(docs.columns, "x_id")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[key], "left_anti")
