"""WARC archives, token packing, the pipeline and the registered queries."""

import base64
import gzip
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pelagica.llm import decontaminate, packing, queries, toxicity, warc
from pelagica.llm.common import ready

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
there = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

# WARC


def base32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abc <p>é") for _ in range(rng.randint(0, 3000)))) for i in range(120)]
    rows += [(200 + i, f"http://y/{i}", rows[i % 5][2]) for i in range(30)]
    rows += [(300, None, None), (301, "a\r\nb c%0A", ""), (302, " é ", "WARC/1.1\r\n\r\n" * 3), (7, rows[7][1], rows[7][2]), (None, "n", "only here"), (None, "m", rows[2][2])]
    return rows


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    seen, out = set(), []
    for i, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        h = h or ""
        refers = first.get(h)
        if len(h.encode()) < least or refers == i and i not in seen:
            refers = None
        seen.add(i)
        out.append((i, u, len(h.encode()), base32(h), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def archives(spark, rows, root, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    warc.write_archives(frame.repartition(options.pop("parts", 3)), root, **options)
    return warc.read_archives(spark, root)


def listing(root):
    return {f: open(f"{root}/{f}", "rb").read() for f in sorted(os.listdir(root)) if f.endswith(".warc.gz")}


@pytest.mark.parametrize("least", [0, 1000])
def test_round_trip(spark, tmp_path, page_rows, least):
    ready(spark)
    read = archives(spark, page_rows, f"{tmp_path}/w", revisit_from=least, shard_bytes=40_000, roll_bytes=6_000).collect()
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str)
    assert got == expected(page_rows, least)
    by_id = {i: h or "" for i, _, h in page_rows if i is not None}
    assert all(bytes(r.payload).decode() == by_id[r.page_id] for r in read if r.record_type == "response" and r.page_id is not None)


def test_same_bytes_whatever_the_partitions(spark, tmp_path, page_rows):
    ready(spark)
    archives(spark, page_rows, f"{tmp_path}/a", shard_bytes=40_000, roll_bytes=6_000, parts=2)
    archives(spark, page_rows[::-1], f"{tmp_path}/b", shard_bytes=40_000, roll_bytes=6_000, parts=7)
    a, b = listing(f"{tmp_path}/a"), listing(f"{tmp_path}/b")
    assert a == b and len(a) > 4
    made = {r.name: r for r in warc.manifest(spark, f"{tmp_path}/a").collect()}
    assert set(made) == set(a) and not os.path.exists(f"{tmp_path}/a/_temporary")
    order = []
    for name, data in a.items():
        assert made[name].bytes == len(data) and made[name].sha256 == hashlib.sha256(data).hexdigest()
        assert len(data) <= 6_000 or made[name].records == 1
        heads = gzip.decompress(data).split(b"WARC/1.1\r\nWARC-Type: ")
        assert heads[1].startswith(b"warcinfo")
        order += [r.page_id for r in warc.read_archives(spark, f"{tmp_path}/a").where(F.col("file") == name).collect()]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_files_outside_the_manifest_are_not_read(spark, tmp_path, page_rows):
    ready(spark)
    n = archives(spark, page_rows[:20], f"{tmp_path}/w").count()
    first = next(iter(listing(f"{tmp_path}/w").items()))
    with open(f"{tmp_path}/w/part-99999-00000.warc.gz", "wb") as file:
        file.write(first[1][:100])
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == n == 20


def test_no_pages_and_damage(spark, tmp_path, page_rows):
    ready(spark)
    assert archives(spark, page_rows, f"{tmp_path}/e").count() == len(page_rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
    record = warc.page_record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        list(warc.records_of(__import__("io").BytesIO(gzip.compress(record[:-3]))))


# packing


@pytest.fixture(scope="module")
def doc_rows():
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab cé\n.1'<>|") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "<|endoftext|> a <|endoftext|>"), (103, " " * 50_000), (104, "x" * 60_000), (105, "a\n\n\n  b's 12 🎉"), (None, "null id"), (5, rows[5][1])]
    return rows


def test_fast_ids_equal_the_library(doc_rows):
    slow, fast = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    for _, text in doc_rows:
        assert fast(text or "") == slow.encode(text or "", add_special_tokens=False).ids


@there
def test_fast_ids_of_all_documents():
    slow, fast = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    for (text,) in duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet'").fetchall():
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def test_packing(spark, doc_rows):
    ready(spark)
    slow = Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame([(*r, 0) for r in doc_rows], "doc_id long, text string, part int").repartition(4)
    pieces = packing.pack(docs, TOKENIZER, length=256)
    got = pieces.collect()
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in doc_rows}
    by_doc = {}
    for r in got:
        found = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(found) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert ids[r.doc_id][r.start : r.start + r.length] == found and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, _ in doc_rows:
        twice = 2 if i == 5 else 1
        assert sum(n for _, n in by_doc[i]) == twice * len(ids[i])
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(ids[i]) for i, _ in doc_rows)
    assert sorted(windows) == list(range(-(-total // 256)))
    for k, parts in windows.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == (256 if k < max(windows) else total - 256 * max(windows))
    whole = packing.sequences(pieces).collect()
    assert sum(len(r.ids) // 4 for r in whole) == total and max(len(r.ids) for r in whole) == 1024
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_large_vocabularies_take_four_bytes(spark):
    ready(spark)
    docs = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id long, text string")
    tokens = packing.tokenize(docs, TOKENIZER, tokens=lambda text: [70_000 + ord(c) for c in text])
    got = {r.doc_id: packing._ids(r.ids).tolist() for r in tokens.collect()}
    assert got == {1: [70_097, 70_098, 1], 2: [70_099, 1]}


# pipeline


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return 0
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1


def brute_pipeline(docs, leaks, rejected):
    """Ids that the filtering stages keep, from plain Python."""
    docs = {i: t for i, t in docs if i not in rejected}
    last = {t: max(i for i in docs if docs[i] == t) for t in set(docs.values())}
    docs = {i: t for i, t in docs.items() if last[t] == i}
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in docs}
    near = [(a, b) for a in docs for b in docs if a < b and alike(sets[a], sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    docs = {i: t for i, t in docs.items() if label[i] == i}
    return {i for i, t in docs.items() if not leaks(t)}


@there
def test_pipeline_stages(spark, tmp_path):
    ready(spark)
    docs, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs, labels)
    rejected = {r.doc_id for r in toxicity.rate(docs, model).where("toxic").collect()}
    (index,) = decontaminate.indexes(benchmark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_pipeline(rows, index.leaks, rejected)
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, step, SF).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        assert step.columns == docs.columns
    assert {r.doc_id for r in step.collect()} == want
    assert [len(want) < len(rows), step.count() == len(want)] == [True, True]
    packed = corpus_pipeline.run(spark, SF).collect()
    encode = packing.encoder(TOKENIZER)
    tokens = {i: len(encode(t)) + 1 for i, t in rows if i in want}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens


def test_stages_of_empty_documents(spark, tmp_path):
    ready(spark)
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


# registered queries


@there
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_query_runs_on_the_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    tables = {"page_id": "pages", "conv_id": "conversations", "doc_id": "documents"}
    key = next((k for k in tables if k in df.columns), None)
    table = tables.get(key)
    if key and name not in ("op4_suffix_dedup", "op9_licenses", "op10_decontamination"):
        assert {r[key] for r in got} == {r[0] for r in duckdb.connect().execute(f"SELECT {key} FROM '{SF}/{table}.parquet'").fetchall()}
    if name in queries.checks():
        duck = duckdb.connect()
        for t in tables.values():
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cursor = duck.execute(queries.checks()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        assert sorted(map(str, ([r[i] for i in order] for r in cursor.fetchall()))) == sorted(str(list(r)) for r in got)
