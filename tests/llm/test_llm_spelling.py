"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

from pelagica.llm import spelling
from pelagica.llm.common import ready


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def vocabulary():
    rng = random.Random(3)
    words = {}
    for size in [5] * 60 + [6] * 40 + [7, 8, 9, 12, 13, 20, 60, 200] * 5:
        word = "".join(rng.choice("abé") for _ in range(size))
        for _ in range(6):
            words[word] = rng.choice([3, 4, 6, 8, 12, 20, 50])
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abé") + word[at:], word[:at] + "c" + word[at + 1 :]])
    return {w: n for w, n in words.items() if len(w) >= 5} | {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaab": 3}


def test_groups_equal_all_pairs(spark):
    ready(spark)
    counts = vocabulary()
    rows = [(w, n, "x", 1) for w, n in counts.items()] + [(None, 3, "x", 1)]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long, size string, half long").repartition(3)).collect()
    assert len(got) == len(counts)
    assert set(map(tuple, got)) == brute(counts)


def test_pairs_come_once(spark):
    ready(spark)
    counts = vocabulary()
    pairs = spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    got = sorted(tuple(sorted((r.a, r.b))) for r in pairs)
    assert got == sorted((a, b) for a in counts for b in counts if a < b and one_edit(a, b))


def test_words_of_texts(spark):
    ready(spark)
    texts = ["Naïve NAÏVE naïve; straße-Straße! straße2straße", None, "", "abc " * 9, "x" * 300_000 + " " + "hello " * 50_000, "ÀÖ×÷ÿ Ā hello"] * 3
    rows = [(i if i % 5 else None, t, "a", "b") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string, run string")
    for damaged in (None, 7):
        low = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        want = Counter()
        for i, t, *_ in rows:
            run = ""
            for c in (t or "").translate(low) + " ":
                if c in "abcdefghijklmnopqrstuvwxyz" or "À" <= c <= "ÿ":
                    run += c
                elif run:
                    h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                    at = h % len(run)
                    want[run[:at] + run[at + 1 :] if damaged and h % damaged == 0 else run] += 1
                    run = ""
        got = spelling.count_words(spelling.occurrences(frame, damaged=damaged)).collect()
        assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.spelling_groups(frame.limit(0)).count() == 0
