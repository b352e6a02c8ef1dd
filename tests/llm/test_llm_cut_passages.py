"""Passages of keys that are cut over tasks, against brute force."""

import random

import pytest
from test_llm_dedup import DOCS, brute_passages

from pelagica.llm import suffix_dedup
from pelagica.llm.common import ready


@pytest.mark.parametrize("seed", range(3))
def test_settled_rows_have_longer_partners_in_other_tasks(spark, seed):
    """X and Y share the words right of a position, X and Z some on both sides; each row is compared on its own."""
    ready(spark)
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    made = []
    for _ in range(6):
        left, middle, right = fresh(60), fresh(60), fresh(60)
        for _ in range(4):
            made.append(fresh(9) + left + middle + right + fresh(9))
            made.append(fresh(9) + middle + right[: rng.randrange(60)] + fresh(9))
            made.append(fresh(9) + left[rng.randrange(30, 60) :] + middle[: rng.randrange(30, 60)] + fresh(70))
    docs = [(i, " ".join(p)) for i, p in enumerate(made)]
    want = brute_passages(docs, 50)
    frame = spark.createDataFrame(docs, DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for rows in (1, 2, 3):
            got = suffix_dedup.repeated_passages(frame, compared=rows).collect()
            assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
