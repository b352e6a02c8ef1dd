"""Repeated passages by a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Least words of a repeated passage, words hashed for the choice of positions, and positions in a window.
LENGTH = 50
GRAM = 5
WINDOW = 26
# A passage's first chosen position lies before word WINDOW, so that at least this many words follow.
SHARED = LENGTH - WINDOW + 1
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = np.uint64(24)
MEMO = 1 << 20
# Sorted suffixes compared at once.
COMPARED = 8192

_known: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text; words end at ASCII white space."""
    if len(_known) > MEMO:
        _known.clear()
    words = (text or "").encode().split()
    get = _known.get
    out = []
    for word in words:
        h = get(word)
        if h is None:
            h = _known[word] = xxhash.xxh64_intdigest(word)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every position that has as many (built by doubling)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    whole, have, power, size = None, 0, words, 1
    while True:
        if n & size:
            if whole is None:
                whole = power
            else:
                m = min(len(whole), len(power) - have)
                whole = _mixed(whole[:m] + power[have : have + m] * np.uint64(2 * size + 1))
            have += size
        if size * 2 > n:
            return _mixed(whole[: len(words) - n + 1])
        power = _mixed(power[:-size] * np.uint64(3) + power[size:])
        size *= 2


def minimisers(words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Positions with the least gram hash of some window; of equal ones the last.

    Which positions of a window are chosen follows from its words alone, so that copies of a passage
    choose the same ones wherever they stand.
    """
    h = gram_hashes(words, gram)
    if len(h) < window:
        return np.zeros(0, dtype=np.int64)
    top = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (h & ~top) | (top - np.arange(len(h), dtype=np.uint64) % top)
    size = 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if window > size:
        least = np.minimum(least[: -(window - size)], least[window - size :])
    starts = np.arange(len(least), dtype=np.int64)
    place = (top - (least & top)).astype(np.int64)
    period = int(top)
    return np.unique(starts + (place - starts) % period)


def suffixes(docs: DataFrame) -> DataFrame:
    """``text_id, pos, key, doc_id`` of every retained suffix: ``key`` hashes its first ``SHARED`` words.

    A text has one more row, with position -1: its number of words as ``key``, and the document.  ``text_id`` is a
    hash of the text, equal for copies.  Texts of fewer than ``LENGTH`` words have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, keys, ids = [], [], [], []
            for doc, text, name in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = word_hashes(text.as_py())
                if len(words) < LENGTH:
                    continue
                at = minimisers(words)
                at = at[at <= len(words) - SHARED]
                keys += [np.array([len(words)], dtype=np.int64), gram_hashes(words, SHARED)[at].view(np.int64)]
                places += [np.array([-1], dtype=np.int32), at.astype(np.int32)]
                texts.append(np.full(len(at) + 1, name, dtype=np.int64))
                ids.append([doc] + [None] * len(at))
            columns = [np.concatenate([np.zeros(0, t), *x]) for x, t in ((texts, np.int64), (places, np.int32), (keys, np.int64))]
            found = [*map(pa.array, columns), pa.array([i for x in ids for i in x], type=pa.int64())]
            yield pa.record_batch(found, names=["text_id", "pos", "key", "doc_id"])

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    return named.mapInArrow(run, "text_id long, pos int, key long, doc_id long")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words around retained suffixes: ``key, doc_id, pos, r, l``.

    ``wanted`` has one row a document (``doc_id, text_id``) with its positions and keys.  ``r`` holds a number of four bytes for
    each of the ``LENGTH`` words from the position, ``l`` for the ``WINDOW`` words before it, nearest first; fewer
    at a text's ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                short = (word_hashes(text.as_py()) >> np.uint64(32)).astype(">u4")
                back = short[::-1]
                n = len(short)
                for s in found.as_py():
                    p = s["pos"]
                    rows.append((s["key"], doc, p, short[p : p + LENGTH].tobytes(), back[n - p : n - p + WINDOW].tobytes()))
                if len(rows) > 20_000:
                    yield _context_batch(rows)
                    rows = []
            yield _context_batch(rows)

    named = docs.withColumn("text_id", F.xxhash64("text"))
    return named.join(wanted, ["doc_id", "text_id"]).select("doc_id", "text", "found").mapInArrow(run, "key long, doc_id long, pos int, r binary, l binary")


CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, CONTEXT_TYPES)], names=["key", "doc_id", "pos", "r", "l"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Numbers of four bytes as rows of equal width; places beyond a text's end differ in any two rows."""
    n = len(column)
    data = [x.as_py() for x in column]
    lengths = np.array([len(x) // 4 for x in data], dtype=np.int64)
    out = np.zeros((n, width), dtype=np.uint64)
    out[:] = (np.arange(n, dtype=np.uint64) + np.uint64(1 << 32))[:, None]
    flat = np.frombuffer(b"".join(data), dtype=">u4").astype(np.uint64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


def _window_hashes(key: np.ndarray, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row and every ``j`` below ``WINDOW`` a hash of the ``LENGTH`` words from ``j`` words before the
    position, and whether the text has that many; windows of different keys or ``j`` never share a hash by design."""
    n = len(key)
    seed = _mixed(key.view(np.uint64))
    after = [seed]
    for k in range(LENGTH):
        after.append(_mixed(after[-1] ^ right[:, k]))
    before, found = seed * np.uint64(5), np.zeros((n, WINDOW), dtype=np.uint64)
    there = np.zeros((n, WINDOW), dtype=bool)
    has_right, has_left = (right < (1 << 32)).sum(axis=1), (left < (1 << 32)).sum(axis=1)
    for j in range(WINDOW):
        if j:
            before = _mixed(before ^ left[:, j - 1])
        found[:, j] = _mixed(after[LENGTH - j] * np.uint64(3) + before + np.uint64(j))
        there[:, j] = (has_right >= LENGTH - j) & (has_left >= j)
    return found, there


def _shared_windows(doc: np.ndarray, found: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which windows another document has too."""
    row, j = np.nonzero(there)
    hashes, docs = found[row, j], doc[row]
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
    twice = np.minimum.reduceat(docs[order], starts) < np.maximum.reduceat(docs[order], starts)
    out = np.zeros(there.shape, dtype=bool)
    out[row[order], j[order]] = np.repeat(twice, np.diff(np.append(starts, len(order))))
    return out


def _compare(table: pa.Table, open_start: bool, open_end: bool) -> pa.RecordBatch:
    """Passages of sorted suffixes, and windows of the first and last key if these may go on elsewhere."""
    key, doc, pos = (table.column(c).to_numpy() for c in ("key", "doc_id", "pos"))
    right, left = _matrix(table.column("r").combine_chunks(), LENGTH), _matrix(table.column("l").combine_chunks(), WINDOW)
    n = len(key)
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    starts, run = np.flatnonzero(first), np.cumsum(first) - 1
    best_l, best_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for other in (starts[run] - 1, np.append(starts[1:], n)[run]):
        have = np.flatnonzero((other >= 0) & (other < n))
        have = have[key[other[have]] == key[have]]
        l, r = _common(left[have], left[other[have]]), _common(right[have], right[other[have]])
        better = l + r > best_l[have] + best_r[have]
        best_l[have[better]], best_r[have[better]] = l[better], r[better]
    settled = best_l + best_r >= LENGTH
    edge = (open_start & (key == key[0])) | (open_end & (key == key[-1]))

    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    # with two documents the neighbour is the only partner
    unsure = (np.bincount(group, weights=~settled) > 0) | (np.bincount(group, weights=first) > 2)
    looked = np.flatnonzero(unsure[group] | edge)
    begin, end, whose = [pos[settled] - best_l[settled]], [pos[settled] + best_r[settled]], [doc[settled]]
    nothing = np.zeros(0, dtype=np.int64)
    asks, offers = (nothing, nothing, nothing), (nothing, nothing, nothing)
    if len(looked):
        found, there = _window_hashes(key[looked], right[looked], left[looked])
        hit = _shared_windows(doc[looked], found, there) if there.any() else there
        some = np.flatnonzero(hit.any(axis=1))
        least, most = hit[some].argmax(axis=1), WINDOW - 1 - hit[some][:, ::-1].argmax(axis=1)
        begin.append(pos[looked[some]] - most)
        end.append(pos[looked[some]] - least + LENGTH)
        whose.append(doc[looked[some]])
        # what no other document of this task has may be in another one; what this task has is shown to the others once
        cut = edge[looked]
        row, j = np.nonzero(there & ~hit & cut[:, None])
        asks = doc[looked[row]], pos[looked[row]] - j, found[row, j].view(np.int64)
        row, j = np.nonzero(there & cut[:, None])
        if len(row):
            hashes, docs = found[row, j], doc[looked[row]]
            order = np.argsort(hashes, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
            docs = docs[order]
            offers = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts), hashes[order][starts].view(np.int64)
    direct = sum(map(len, whose))
    counts = np.array([direct, len(asks[0]), len(offers[0])])
    part = np.repeat(np.arange(3), counts)
    none = np.zeros(len(offers[0]), dtype=np.int64)
    columns = [
        pa.array(np.concatenate([*whose, asks[0], offers[0]])),
        pa.array(np.concatenate([*begin, asks[1], none]).astype(np.int32)),
        pa.array(np.concatenate([*end, asks[1] + LENGTH, none]).astype(np.int32)),
        pa.array(np.concatenate([np.zeros(direct, dtype=np.int64), asks[2], offers[2]]), mask=part == 0),
        pa.array(np.concatenate([np.zeros(direct + len(asks[0]), dtype=np.int64), offers[1]]), mask=part < 2),
    ]
    return pa.record_batch(columns, names=["doc_id", "s", "e", "window", "most"])


def compare_neighbours(batches: Iterator[pa.RecordBatch], rows: int = COMPARED) -> Iterator[pa.RecordBatch]:
    """``doc_id, s, e, window, most``: passages that sorted suffixes share with other documents.

    Rows come in suffix order (key, words, words before).  A row's neighbours are the last row before and the first
    row after it with the same key and another document; it is extended to both sides as far as the better one
    agrees.  A third document may agree less to the right but more to the left: where a key has more than two, all
    windows of ``LENGTH`` words around its rows are compared by equality as well.  ``window`` is null for passages
    found so.  The first and the last key of a task may go on in other tasks: their windows that no other document of the task has come
    out with their hash, to be looked for in the others; and every window of theirs comes out once,
    with the least (``doc_id``) and the greatest document (``most``) that has it, for the others to find.
    """
    rest: pa.Table | None = None
    open_start = True
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]) if rest is not None else table
        if rest.num_rows < rows:
            continue
        key = rest.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        inside = cut == 0  # one key fills it: its rows so far go on their own
        cut = cut or rest.num_rows
        yield _compare(rest.slice(0, cut), open_start, inside)
        rest, open_start = rest.slice(cut), inside
    if rest is not None and rest.num_rows:
        yield _compare(rest, open_start, True)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compared: int = COMPARED) -> DataFrame:
    """``doc_id, start_word, end_word, n_words`` of passages of ``LENGTH`` or more words that other documents have too.

    Copies of whole texts (by a 64-bit hash) count once: the first takes part, and every copy is a passage from end to
    end.  Suffixes at minimiser positions are retained; those whose first ``SHARED`` words another document has
    are sorted, compared with their neighbours of other documents, and extended to both sides; ``compare_neighbours`` says
    what is done where that isn't enough, so that no word of a repeat is missed.  Sorted ranges cut through a key that many
    documents share: all windows at a cut are compared by equality over all tasks; counts by key are combined before they are shuffled.

    Words end at ASCII white space and are compared as they are.  Ends are exclusive; overlapping passages
    are joined.  ``compared`` is the number of sorted suffixes a task looks at together.  Null, empty and short texts have none; rows with a null id are left out, since passages are between
    ids; repeated rows count as one; an empty table gives none.  Very long texts are read whole.  Columns besides id and
    text are ignored, whatever their names.
    """
    slim = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    retained = stored(suffixes(slim), "suffixes")
    first = retained.where("pos < 0").select("text_id", "doc_id", F.col("key").alias("n_words"))
    texts = stored(first.groupBy("text_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")), "texts")
    copied = first.join(texts.where("a < b"), "text_id")

    placed = retained.where("pos >= 0").select("text_id", "pos", "key")
    spread = placed.groupBy("key").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b"))
    shared = stored(spread.where("a < b").select("key"), "shared")
    found = placed.join(shared, "key").groupBy("text_id").agg(F.collect_set(F.struct("pos", "key")).alias("found"))
    found = found.join(texts, "text_id").select(F.col("a").alias("doc_id"), "text_id", "found")
    rows = stored(contexts(slim, stored(found, "found")), "contexts")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "key", "r", "l", "doc_id", "pos").sortWithinPartitions("key", "r", "l", "doc_id", "pos")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compare_neighbours(batches, compared)

    matched = stored(ordered.mapInArrow(compare, "doc_id long, s int, e int, window long, most long"), "matched")
    direct = matched.where("window is null").select("doc_id", "s", "e")
    ranges = matched.where("most is not null").groupBy("window").agg(F.min("doc_id").alias("a"), F.max("most").alias("b"))
    twice = ranges.where("a < b").select("window")
    late = matched.where("window is not null and most is null").join(twice, "window").select("doc_id", "s", "e")
    whole = copied.select("doc_id", F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e"))
    return _joined(direct.union(late).union(whole).distinct())


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document as one."""
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1))
    numbered = marked.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("doc_id", "k")
        .agg(F.min("s").cast("long").alias("start_word"), F.max("e").cast("long").alias("end_word"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
    )
