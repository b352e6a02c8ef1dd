"""Exact, near and passage duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pelagica.llm import exact_dedup, simhash, suffix_dedup
from pelagica.llm.common import components, ready

DOCS = "doc_id long, text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    for text in made[:25]:
        parts = text.split()
        for _ in range(rng.randint(1, 3)):
            copy = list(parts)
            if copy:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            made.append(" ".join(copy))
    made += made[:12] + ["", None, "", "One Two", "one two", "one  two\n", "x " * 5000, "é Ä ü ß", "É ä ü ß"]
    order = list(range(len(made)))
    rng.shuffle(order)
    return list(zip(order, made))


# exact duplicates


def brute_exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    return sorted(
        ((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs),
        key=str,
    )


@pytest.mark.parametrize("runs,fanout", [(1, 2), (5, 2), (64, 8)])
def test_exact_groups(spark, texts, runs, fanout):
    got = exact_dedup.mark_exact(spark.createDataFrame(texts, DOCS).repartition(5), runs=runs, fanout=fanout)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(texts)


def test_exact_smallest_repeated_null_and_clashing(spark):
    data = [(1, "a", 10, "x"), (2, "a", 11, "y"), (1, "a", 12, "z"), (None, "a", 13, "n"), (None, "b", 14, "n"), (None, "b", 15, "n"), (7, None, 16, "e"), (8, "", 17, "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, kept int, x_run string")
    kept = exact_dedup.drop_exact(docs, keep="min")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(1, "a"), (7, None)]
    assert [(r.doc_id, r.text) for r in got if r.doc_id is None] == [(None, "b")]
    assert exact_dedup.drop_exact(docs.limit(0)).count() == 0


def test_exact_runs_no_python(spark, texts):
    plan = exact_dedup.mark_exact(spark.createDataFrame(texts, DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SimHash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_fingerprint(texts):
    for _, text in texts:
        assert simhash.text_fingerprint(text) == brute_fingerprint(text)
    long = " ".join(map(str, range(70_000)))
    assert simhash.text_fingerprint(long) == brute_fingerprint(long)


def test_near_groups(spark, texts):
    ready(spark)
    got = simhash.near_groups(spark.createDataFrame(texts, DOCS).repartition(3))
    prints = {i: brute_fingerprint(t) for i, t in texts}
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute_components(ids, linked)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert len(set(want.values())) < len(ids)
    kept = simhash.drop_near(spark.createDataFrame(texts, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_connect_all_close_pairs(spark):
    """Fingerprints with random flips of up to four bits, far more in a group than a bucket is looked at in one go."""
    ready(spark)
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    made = set(seeds)
    for n, seed in zip((400, 30, 3, 2), seeds):
        last = seed
        for k in range(n):
            value = seed if k % 3 else last
            for b in rng.sample(range(64), rng.randint(1, 4)):
                value ^= 1 << b
            made.add(value)
            last = value
    made |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, 2**64 - 1}
    prints = sorted(made)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in edges)
    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 4]
    assert brute_components(signed, edges) == brute_components(signed, close)
    assert len(edges) < len(close)


def test_bucket_cut_by_batches():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 4, 600)).astype(np.int32)
    fps = np.where(rng.random(600) < 0.7, 0, rng.integers(0, 1 << 62, 600)).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))

    def run(size, large):
        batches = [
            pa.record_batch([pa.array(keys[i : i + size]), pa.array(fps[i : i + size].view(np.int64))], names=["key", "fp"])
            for i in range(0, 600, size)
        ]
        out = [b.to_pydict() for b in simhash.link_buckets(iter(batches), large=large)]
        edges = [(a, b) for d in out for a, b in zip(d["a"], d["b"])]
        return brute_components(sorted(set(fps.view(np.int64).tolist())), edges)

    assert run(600, 10_000) == run(7, 10_000) == run(7, 16) == run(100, 0)


def test_near_empty_and_null_ids(spark):
    ready(spark)
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near(none).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (5, None), (3, ""), (5, None), (None, "zz")], DOCS)
    got = rows(simhash.near_groups(docs), "doc_id", "component_id")
    assert got.count((5, 3)) == 2 and got.count((3, 3)) == 1 and got.count((None, None)) == 2
    extra = docs.selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as first", "4 as x_id")
    kept = simhash.drop_near(extra)
    assert kept.columns == extra.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None", "None"]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


# repeated passages


def brute_passages(docs, length):
    """Word spans covered by windows of ``length`` words that another document has too."""
    where = defaultdict(set)
    words = {i: (t or "").split() for i, t in docs}
    for i, w in words.items():
        for p in range(len(w) - length + 1):
            where[tuple(w[p : p + length])].add(i)
    spans = []
    for i, w in words.items():
        covered = set()
        for p in range(len(w) - length + 1):
            if len(where[tuple(w[p : p + length])]) > 1:
                covered.update(range(p, p + length))
        start = None
        for p in range(len(w) + 1):
            if p in covered and start is None:
                start = p
            if p not in covered and start is not None:
                spans.append((i, start, p))
                start = None
    return sorted(spans)


def passage_docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 49, 60, 75, 130, 36)]
    half = fresh(27)
    made = []
    for _ in range(60):
        parts = fresh(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(shared) + fresh(rng.randint(0, 60))
        if rng.random() < 0.3:
            # the same words to the right behind different words to the left
            parts += shared[0][:23] + half + fresh(5) if rng.random() < 0.4 else fresh(23) + half + fresh(30)
        made.append(parts)
    made += [made[0], made[3], made[3], ["same"] * 400, fresh(20) + ["same"] * 300, [], fresh(3), shared[1], fresh(30) + shared[3]]
    return [(i, " ".join(p)) for i, p in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, seed):
    ready(spark)
    docs = passage_docs(seed)
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, DOCS).repartition(4))
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got.collect()) == brute_passages(docs, 50)


@pytest.mark.parametrize("rows", [1, 5, 40])
def test_passages_whatever_the_cuts(spark, rows):
    """Keys cut through by tasks and by what is compared at once."""
    ready(spark)
    docs = passage_docs(4)
    frame = spark.createDataFrame(docs, DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = suffix_dedup.repeated_passages(frame, compared=rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == brute_passages(docs, 50)


def test_passages_of_nulls_and_nothing(spark):
    ready(spark)
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(map(str, range(55)))
    docs = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, None, 0), (None, long, 0), (3, "", 0)], DOCS + ", pos int")
    assert suffix_dedup.repeated_passages(docs).count() == 0
    docs = docs.union(spark.createDataFrame([(4, f"\n {long} x", 0)], DOCS + ", pos int"))
    assert rows(suffix_dedup.repeated_passages(docs), "doc_id", "start_word", "end_word") == [(1, 0, 55), (4, 0, 55)]


def test_minimisers_follow_from_content():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 60, 3000, dtype=np.uint64)
    chosen = suffix_dedup.minimisers(words)
    assert np.diff(chosen).max() <= suffix_dedup.WINDOW
    moved = suffix_dedup.minimisers(np.concatenate((rng.integers(0, 1 << 60, 501, dtype=np.uint64), words[1000:1100])))
    span = suffix_dedup.WINDOW + suffix_dedup.GRAM - 2
    inside = {int(c) - 1000 for c in chosen if 1000 + span <= c < 1100 - span}
    assert inside <= {int(c) - 501 for c in moved}
