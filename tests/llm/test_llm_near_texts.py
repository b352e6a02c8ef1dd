"""Near copies of the pipeline against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pelagica.llm import near_texts, simhash
from pelagica.llm.common import ready

DOCS = "doc_id long, text string"


def brute_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(docs):
    sets = {i: brute_shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            whole = len(sets[a] | sets[b])
            if a < b and (not whole or len(sets[a] & sets[b]) / whole >= 0.8):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def made_docs():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    made = []
    for n, copies, edits in ((150, 60, 5), (300, 3, 3), (80, 8, 1), (40, 3, 1), (12, 2, 1), (3, 2, 0)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(n)] = word()
            made.append(" ".join(copy))
    made += [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["", None, " \n", "One two", "one  TWO"]
    rng.shuffle(made)
    return list(enumerate(made))


def test_stage_drops_what_shares_four_fifths_of_five_word_shingles(spark):
    ready(spark)
    docs = made_docs()
    want = brute_groups(docs)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert {r.doc_id: r.component_id for r in near_texts.near_groups(frame).collect()} == want


def test_stage_keeps_null_ids_and_columns(spark):
    ready(spark)
    data = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "A b c d e f", 3), (3, "x", 4), (4, "a b c d e f", 5)]
    docs = spark.createDataFrame(data, DOCS + ", node int")
    kept = near_texts.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r.node for r in kept.collect()) == [1, 2, 3, 4]


def test_bands_reach_the_limit():
    """Pairs at a similarity of 0.8 meet in some band."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        met += bool((near_texts.signature(pool[:90])[0] == near_texts.signature(pool[10:])[0]).any())
    assert met >= 1998


def test_sketches_reach_the_limit():
    """Pairs at a similarity of 0.8 are seldom estimated far below it."""
    rng = np.random.default_rng(5)
    low = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        both = pa.table({"sketch": [near_texts.signature(pool[:90])[1], near_texts.signature(pool[10:])[1]]})
        low += near_texts._alike(near_texts._sketches(both), 0)[1] < near_texts.SIMILARITY - near_texts.LESS
    assert low <= 40


def test_large_buckets_are_cut_and_give_the_same_groups(spark, monkeypatch):
    ready(spark)
    docs = made_docs()
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    monkeypatch.setattr(near_texts, "TEXTS", 7)
    monkeypatch.setattr(near_texts, "CHARS", 9000)
    assert {r.doc_id: r.component_id for r in near_texts.near_groups(frame).collect()} == brute_groups(docs)


def test_texts_left_apart_are_compared_exactly(spark, monkeypatch):
    """Without any edge from the sketches' forest the last pass finds all links."""
    ready(spark)
    docs = made_docs()
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    monkeypatch.setattr(near_texts, "_forest", lambda limit: lambda table: ([], []))
    monkeypatch.setattr(near_texts, "LESS", 0.3)
    assert {r.doc_id: r.component_id for r in near_texts.near_groups(frame).collect()} == brute_groups(docs)


def test_empty_table_and_very_long_texts(spark):
    ready(spark)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[75_000:])), (4, "x" * 1_000_000)]
    frame = spark.createDataFrame(docs, DOCS)
    assert near_texts.near_groups(frame.limit(0)).count() == 0
    assert {r.doc_id: r.component_id for r in near_texts.near_groups(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_buckets_cut_by_batches():
    rng = np.random.default_rng(1)
    key, node = np.sort(rng.integers(0, 90, 200)), rng.integers(0, 9, 200)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    want = []
    for k in range(90):
        have = sorted(set(node[key == k].tolist()))
        want += [(k, x) for x in have] if len(have) > 1 else []
    for size in (1, 2, 7, 200):
        cut = [pa.record_batch([pa.array(key[i : i + size]), pa.array(node[i : i + size])], names=["key", "node"]) for i in range(0, 200, size)]
        assert [tuple(r.values()) for b in near_texts._shared(iter(cut)) for r in b.to_pylist()] == want


def test_simhash_finds_near_copies_and_the_exact_check_decides(spark, monkeypatch):
    """Without any band SimHash's groups are searched; texts of close fingerprints that share few shingles stay apart."""
    ready(spark)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    fresh = lambda n: " ".join(word() for _ in range(n))
    base, often = fresh(600), " ".join([fresh(11)] * 60)
    docs = [(1, base), (2, base + " more"), (3, base + " words here"), (4, often + " " + fresh(30)), (5, often + " " + fresh(30)), (6, fresh(90)), (7, ""), (8, None)]
    bits = {i: simhash.text_fingerprint(t, 5) for i, t in docs}
    assert all((bits[a] ^ bits[b]).bit_count() <= simhash.DISTANCE for a, b in ((1, 2), (2, 3), (4, 5)))
    index = near_texts._index
    monkeypatch.setattr(near_texts, "_index", lambda texts, words: index(texts, words).withColumn("keys", F.array().cast("array<long>")))
    got = near_texts.near_groups(spark.createDataFrame(docs, DOCS).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(docs) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}
