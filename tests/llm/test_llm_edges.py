"""Clashing names, repeated rows, empty tables, very long texts and large families."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from pelagica.llm import decontaminate, licenses, near_texts, packing, pii, secrets, simhash, suffix_dedup, toxicity
from pelagica.llm.common import ready

# Names that the operators use for columns of their own.
CLASHES = (
    "node fp key first component component_id text_id pos a b part before tokens ids x_id x_hash severity toxic base added start"
    " label window kept link_id"
).split()
MODEL = toxicity.OrdinalModel({"grobian": 3.0}, (1.0, 2.0))
ITEMS = "item_id long, text string"


def operators(spark):
    benchmark = spark.createDataFrame([(7, "where does the river end and why? it ends in the sea because all water runs down")], ITEMS)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "op3": lambda docs: packing.pack(docs, path),
        "op4": suffix_dedup.repeated_passages,
        "op5": lambda docs: toxicity.rate(docs, MODEL),
        "op5 drop": lambda docs: toxicity.drop_toxic(docs, MODEL).select("doc_id", "text"),
        "op6": lambda docs: secrets.find_secrets(docs, model=secrets.fit_markov(docs)),
        "op7": simhash.near_groups,
        "op7 drop": lambda docs: simhash.drop_near(docs).select("doc_id", "text"),
        "op9": licenses.find_licenses,
        "op10": lambda docs: decontaminate.find_leaks(docs, benchmark),
        "op10 drop": lambda docs: decontaminate.drop_leaks(docs, benchmark).select("doc_id", "text"),
        "op13": pii.find_personal,
        "near": near_texts.near_groups,
        "near drop": lambda docs: near_texts.drop_near(docs).select("doc_id", "text"),
    }


def doc_rows():
    rng = random.Random(11)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    leak = "where does the river end and why? it ends in the sea because all water runs down"
    texts = [passage + " one", "start " + passage, leak, "grobian grobian grobian", "Released under the MIT License.", "", None, "a@b.org token=abcd1234efgh"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (6, None), (None, texts[2]), (None, None)]
    return rows


@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op5 drop", "op6", "op7", "op7 drop", "op9", "op10", "op10 drop", "op13", "near", "near drop"])
def test_other_columns_change_nothing_and_empty_tables_give_nothing(spark, name):
    ready(spark)
    plain = spark.createDataFrame(doc_rows(), "doc_id long, text string").coalesce(1)
    clashing = plain.selectExpr("doc_id", "text", *[f"cast(null as string) as {c}" for c in CLASHES]).coalesce(1)
    apply = operators(spark)[name]
    got, want = apply(clashing), apply(plain)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()
    assert apply(plain.limit(0)).count() == 0


def test_stages_keep_clashing_columns_and_repeated_rows(spark, tmp_path):
    ready(spark)
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.createDataFrame(doc_rows(), "doc_id long, text string").selectExpr("doc_id", "text", *[f"'x' as {c}" for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert {2, 3, 4, 7} <= ids and docs.count() < len(doc_rows())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_megabyte_texts_are_read_to_their_end(spark):
    """What stands at the very end of a long text is found, in seconds."""
    ready(spark)
    rng = random.Random(3)
    filler = " ".join(f"v{rng.randrange(5000)}" for _ in range(200_000))
    ends = ["grobian " * 3, "where does the river end and why? it ends in the sea because all water runs down", "Released under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(f"{filler}. {e}" for e in ends)), "doc_id long, text string")
    assert len(filler) > 1_000_000
    benchmark = spark.createDataFrame([(7, ends[1])], ITEMS)
    began = time.monotonic()
    assert [r.doc_id for r in toxicity.rate(docs, MODEL).where("toxic and severity > 0.9").collect()] == [0]
    assert [r.doc_id for r in decontaminate.find_leaks(docs, benchmark).collect()] == [1]
    assert [r.doc_id for r in licenses.find_licenses(docs).collect()] == [2]
    # three texts that differ in a few of 200,000 words
    assert {r.component_id for r in near_texts.near_groups(docs).collect()} == {0}
    assert time.monotonic() - began < 90


def components_of(nodes, edges):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def linked(fps):
    batch = pa.record_batch([pa.array(np.zeros(len(fps), dtype=np.int32)), pa.array(fps.view(np.int64))], names=["key", "fp"])
    (out,) = simhash.link_buckets(iter([batch]))
    return list(zip(*(c.to_numpy().view(np.uint64).tolist() for c in out.columns)))


def test_families_among_strangers_are_linked_as_by_all_pairs():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for centre in rng.integers(0, 1 << 63, 3, dtype=np.uint64):
        family = np.full(400, centre)
        for _ in range(4):
            family ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
        fps = np.concatenate((fps, family))
    fps = np.unique(fps)
    assert len(fps) > simhash.FAMILY
    pairs = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= simhash.DISTANCE]]
    got = linked(fps)
    assert set(got) <= {(a, b) for p in pairs for a, b in (p, p[::-1])} and len(got) < len(fps) < len(pairs)
    nodes = fps.tolist()
    assert components_of(nodes, got) == components_of(nodes, pairs)


def test_a_family_of_very_many_fingerprints_takes_seconds():
    rng = np.random.default_rng(9)
    fps = np.full(100_000, rng.integers(0, 1 << 63, dtype=np.uint64))
    for _ in range(4):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    fps = np.unique(fps)
    began = time.monotonic()
    assert len(linked(fps)) == len(fps) - 1
    assert time.monotonic() - began < 30
