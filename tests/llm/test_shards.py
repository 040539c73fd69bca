import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foliary.llm import label_shards as L


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts.get(s, 0)))
    text = dict(docs)
    for r in rows:
        data = (text[r["id"]] or "").encode()
        assert (r["size"], r["crc"]) == (len(data) + 1, zlib.crc32(data))
    # Copies that are kept apart, of those that could be together.
    groups = {}
    for r in rows:
        groups.setdefault(text[r["id"]], Counter())[r["shard"]] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


@pytest.mark.parametrize("shards", [8, 3])
def test_even_and_few_groups_are_cut(spark, shards):
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(150) for _ in range(rng.choice([1, 1, 2, 5]))] + [None, None, "", "", "é" * 5000]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, link string")
    rows = L.shard_documents(frame, shards).collect()
    assert check(rows, docs, shards) <= 0.1 * len(docs)


def test_a_group_with_a_third_of_all_rows(spark):
    docs = [(i, "same" if i % 3 == 0 else f"own {i}") for i in range(600)]
    rows = L.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    check(rows, docs, 8)
    assert len({r["shard"] for r in rows if r["id"] % 3 == 0}) < 8


def test_small_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = L.shard_documents(frame, 8).collect()
    assert len(rows) == 3 and max(Counter(r["shard"] for r in rows).values()) == 1
    assert L.shard_documents(frame.limit(0), 8).count() == 0


def test_quotas_keep_capacity():
    rng = np.random.default_rng(0)
    for _ in range(50):
        now = rng.integers(50, 150, 8).astype(float)
        wish = rng.random((8, 8)) * 30
        np.fill_diagonal(wish, 0)
        share = L.quotas(wish, now, max(now.max(), 110))
        after = now + (wish * share).sum(0) - (wish * share).sum(1)
        assert (after <= max(now.max(), 110) * 1.02).all()
