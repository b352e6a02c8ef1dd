"""Benchmark decontamination: a BM25 index of test items, searched with block-max pruning.

Block-max WAND moves item by item and asks at each step whether the maxima of the terms that could stand there reach the
threshold.  Here the same bound is asked for all blocks of all passages of a text at once, in arrays, and whole blocks
are passed over; what is retrieved is the same, all items above the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

SHINGLE = 5
OVERLAP = 0.8
# Share of an item's own BM25 score from which a passage is retrieved.
SCORE = 0.5
K1, B = 1.2, 0.75
# Items in a block of the index, least distance of passages in words, passages and block maxima searched at once, and texts in one
# index.
BLOCK = 4
STRIDE = 64
PASSAGES = 512
ENTRIES = 1 << 20
INDEX_BYTES = 1 << 20
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer.

    The question ends at the last question mark; without one, the last sentence is the answer.  An item of one
    sentence is all question.
    """
    text = text.strip()
    cut = text.rfind("?") + 1
    if not cut:
        cut = max([m.end() for m in re.finditer(r"[.!]\s+(?=\S)", text)], default=len(text))
    return words_of(text[:cut]), words_of(text[cut:])


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def overlap(part: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of a part's shingles in ``words``; a part without words is met."""
    if not part:
        return 1.0
    sizes = {len(s) for s in part}
    have = {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}
    return sum(s in have for s in part) / len(part)


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs to know of all items, however many indexes hold them."""

    items: int
    words: int
    longest: int
    frequency: Mapping[str, int]

    @classmethod
    def of(cls, texts: Sequence[list[str]]) -> Statistics:
        return cls(len(texts), sum(map(len, texts)), max(map(len, texts), default=0), Counter(t for w in texts for t in set(w)))


class Index:
    """BM25 postings of items, scores divided by each item's own score, with the maxima of blocks of items.

    ``statistics`` are those of all items; without them, of the items given.  Only blocks in which a term stands have a maximum.
    """

    def __init__(self, items: list[tuple[int | None, str]], block: int = BLOCK, statistics: Statistics | None = None) -> None:
        texts = [(i, words_of(t), question_and_answer(t)) for i, t in items]
        self.items = [(i, w, (_shingles(q), _shingles(a))) for i, w, (q, a) in texts if w]
        self.block = block
        known = statistics or Statistics.of([w for _, w, _ in self.items])
        self.longest = known.longest
        self.stride = max(STRIDE, self.longest)
        mean = known.words / max(1, known.items)
        self.terms = {term: t for t, term in enumerate(sorted({t for _, w, _ in self.items for t in w}))}
        found: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for k, (_, words, _) in enumerate(self.items):
            norm = K1 * (1 - B + B * len(words) / mean)
            scores = {t: self._idf(known.items, known.frequency[t]) * f * (K1 + 1) / (f + norm) for t, f in Counter(words).items()}
            own = sum(scores.values())
            for term, score in scores.items():
                found[self.terms[term]].append((k, score / own))
        # postings of all terms one after another, each in the order of items
        sizes = np.array([len(postings) for postings in found], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.item = np.array([k for postings in found for k, _ in postings], dtype=np.int64)
        self.score = np.array([s for postings in found for _, s in postings], dtype=float)
        # maxima of the blocks of a term, one after another likewise
        term_block = np.repeat(np.arange(len(found)), sizes) * self.blocks + self.item // block
        starts = np.flatnonzero(np.diff(term_block, prepend=-1))
        self.most = np.maximum.reduceat(self.score, starts) if len(starts) else self.score
        self.most_block = term_block[starts] % self.blocks
        self.first_most = np.searchsorted(term_block[starts], np.arange(len(found) + 1) * self.blocks)

    @property
    def blocks(self) -> int:
        return -(-len(self.items) // self.block) or 1

    @staticmethod
    def _idf(n: int, f: int) -> float:
        return math.log(1 + (n - f + 0.5) / (f + 0.5))

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages and items whose score reaches the threshold, with the score.

        ``passage`` is sorted, with its distinct terms.  Block-max pruning, for many passages at once: where the block maxima
        of a passage's terms don't add up to the threshold, no item of the block can reach it, and
        the block's postings are passed over; in the other blocks every posting is added up.
        """
        starts = np.flatnonzero(np.concatenate(([True], np.diff(passage) > 0)))
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(passage))))
        of, at = _ranges(self.first_most, term)
        sums = np.bincount(row[of] * self.blocks + self.most_block[at], self.most[at], len(starts) * self.blocks)
        reach = (sums >= threshold - 1e-4).reshape(len(starts), self.blocks)
        use = reach.any(axis=1)[row]
        row, term = row[use], term[use]
        of, at = _ranges(self.first, term)
        row, item = row[of], self.item[at]
        inside = reach[row, item // self.block]
        keys, place = np.unique(row[inside] * len(self.items) + item[inside], return_inverse=True)
        score = np.bincount(place, weights=self.score[at[inside]], minlength=len(keys))
        hit = score >= threshold - 1e-6
        return passage[starts][keys[hit] // len(self.items)], keys[hit] % len(self.items), score[hit]

    def passages(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Passage numbers, sorted, and the distinct known terms of each.

        A passage is one stride and the longest item, so that an item's words lie whole in one.
        """
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        places = np.flatnonzero(ids >= 0)
        terms, first = ids[places], places // self.stride
        # a word counts for the passage of its stride, and for the one before if that reaches so far
        back = (places - first * self.stride < self.longest) & (first > 0)
        size = len(self.terms)
        both = np.sort(np.concatenate((first * size + terms, (first[back] - 1) * size + terms[back])))
        both = both[np.concatenate(([True], np.diff(both) > 0))] if len(both) else both
        return both // size if size else both, both % size if size else both

    def leaks(self, text: str | None, score: float = SCORE, share: float = OVERLAP) -> list[tuple]:
        """``item, score, question overlap, answer overlap, first word of the passage`` of every verified item."""
        words = words_of(text)
        passage, term = self.passages(words)
        best: dict[int, tuple] = {}
        for part in self._portions(passage, term):
            for p, k, found in zip(*(x.tolist() for x in self.search(passage[part], term[part], score))):
                start = p * self.stride
                own = words[start : start + self.stride + self.longest]
                q, a = self._overlaps(k, own, len(own) == len(words))
                if q >= share and a >= share and (k not in best or (found, -start) > (best[k][1], -best[k][4])):
                    best[k] = (self.items[k][0], found, q, a, start)
        return [best[k] for k in sorted(best)]

    def _portions(self, passage: np.ndarray, term: np.ndarray) -> Iterator[slice]:
        """Cuts between passages: at most ``PASSAGES`` of them, and about ``ENTRIES`` block maxima, are looked at at once."""
        if not len(passage):
            return
        starts = np.flatnonzero(np.concatenate(([True], np.diff(passage) > 0)))
        load = np.cumsum(self.first_most[term + 1] - self.first_most[term])[starts]
        most = max(1, min(PASSAGES, ENTRIES // self.blocks))
        group = np.maximum.accumulate(load // ENTRIES) * len(starts) + np.arange(len(starts)) // most
        cuts = starts[np.flatnonzero(np.diff(group, prepend=-1))].tolist()
        yield from map(slice, cuts, [*cuts[1:], len(passage)])

    def _overlaps(self, k: int, own: list[str], whole: bool) -> tuple[float, float]:
        """Shares of an item's question and answer in a passage; an item shorter than a shingle must stand there as a whole."""
        _, words, (question, answer) = self.items[k]
        if len(words) >= SHINGLE:
            return overlap(question, own), overlap(answer, own)
        met = whole and own == words if len(words) == 1 else overlap({tuple(words)}, own) == 1
        return (1.0, 1.0) if met else (0.0, 0.0)


def _ranges(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from ``first[t]`` to ``first[t + 1]`` for each ``t`` in ``of``, and the place in ``of`` each belongs to."""
    n = first[of + 1] - first[of]
    return np.repeat(np.arange(len(of)), n), np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _tokens(benchmark: DataFrame, part: Column) -> DataFrame:
    """Distinct items with words, their words, and the part they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array(map(words_of, batch.column(1).to_pylist()), type=pa.list_(pa.string()))
            yield pa.record_batch([*batch.columns, words], names=["item_id", "text", "part", "words"])

    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    with_part = slim.select("item_id", "text", part.cast("int").alias("part"))
    return with_part.mapInArrow(run, "item_id long, text string, part int, words array<string>").where("size(words) > 0")


def _index(rows: DataFrame, statistics: Statistics | None = None) -> Index:
    return Index(sorted(((r[0], r[1]) for r in rows.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r)), BLOCK, statistics)


def indexes(benchmark: DataFrame, most: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, one after another, each of at most about ``most`` bytes of text.

    The bytes of the items are checked first.  A benchmark beyond one index is cut by a hash into several; number of items,
    mean and greatest length and frequencies of words are counted over all items by Spark, so that the cut changes no
    score.  The driver holds one index at a time, with the frequencies of its own words.
    """
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most) or 1
    if n == 1:
        yield _index(_tokens(benchmark, F.lit(0)))
        return
    with Scratch(benchmark.sparkSession) as kept:
        items = kept(_tokens(benchmark, F.pmod(F.xxhash64("text"), F.lit(n))), "items")
        size = F.size("words")
        count, words, longest = items.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
        terms = items.select("part", F.explode(F.array_distinct("words")).alias("term"))
        frequency = kept(terms.groupBy("term").agg(F.count("*").alias("f")), "frequency")
        for k in range(n):
            own = terms.where(F.col("part") == k).select("term").distinct()
            rated = dict(map(tuple, frequency.join(own, "term", "left_semi").select("term", "f").collect()))
            yield _index(items.where(F.col("part") == k), Statistics(count, words, longest, rated))


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, share: float = OVERLAP) -> DataFrame:
    """A row for every document and test item whose question and answer it repeats.

    Every passage of every whole text queries the index; items that reach ``score`` of their own BM25 score are
    retrieved with block-max pruning, none is left out, and verified: at least ``share`` of the five-word shingles
    of the question, and of the answer, stand in the passage.  Words are runs of letters, digits and underscores in lower case.
    ``start_word`` is where the best passage starts.

    An item of two to four words is met where they stand in this order side by side, an item of one word by a text that is
    nothing else; both overlaps are 1 then.  Null and empty texts and items, and items without words, match nothing.  Null ids are
    kept, repeated documents give repeated results, repeated items one, equal items of different ids each a row.  Of passages with the same
    score the first is named.  Texts of any length are searched in portions of bounded memory; empty tables give no rows; other
    columns, of whatever name, are ignored.  A benchmark of several indexes is searched with one after the other, each result written
    to the shared folder.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start_word", pa.int64())])

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(d, *leak) for d, t in zip(ids, batch.column(1)) for leak in index.leaks(t.as_py(), score, share)]
                columns = list(zip(*rows)) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        return slim.mapInArrow(run, LEAKS)

    whole = None
    for index, more in _with_more(indexes(benchmark)):
        found = search(index)
        # what is left of a search is written before the next index is made
        found = stored(found, "leaks") if more or whole is not None else found
        whole = found if whole is None else whole.union(found)
    return whole


def _with_more(found: Iterator[Index]) -> Iterator[tuple[Index, bool]]:
    """Indexes, each with whether it is one of several."""
    first = next(found)
    second = next(found, None)
    yield first, second is not None
    if second is not None:
        yield second, True
        for index in found:
            yield index, True


def drop_leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, share: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows that repeat a test item as ``find_leaks`` tells; no shuffle.

    Rows with a null or empty text stay, as do all rows if there are no items; repeated rows stay or go together; all columns are kept.
    """
    text, schema = docs.columns.index("text"), docs.schema
    for index, more in _with_more(indexes(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not index.leaks(t.as_py(), score, share) for t in batch.column(text)]
                yield batch.filter(pa.array(clean, type=pa.bool_()))

        docs = docs.mapInArrow(run, schema)
        docs = stored(docs, "clean") if more else docs
    return docs
