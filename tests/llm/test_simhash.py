import random

import pytest
import xxhash
from pyspark.sql import functions as F

from foliary.llm import simhash_covering as S

SCHEMA = "doc_id long, text string, id string, fp string, component string, least string"


def brute(rows, width, radius):
    prints = {}
    for doc, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
        grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(prints)
    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (prints[d], find(d)) for d in docs}


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200]))] for _ in range(25)]
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, " "), (4, "One"), (5, "x " * 30000)]
    rows = [(i + 100, " ".join(b)) for i, b in enumerate(base)] + [r for r in rows if r[0]]
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i + 200, " ".join(words)))
    rows += [(7, None), (8, None)]
    docs = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in rows], SCHEMA)
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in S.simhash_groups(docs).collect()}
    assert got == brute(rows, 4, 4)


def test_dense_groups_are_dealt_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(40)}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    found = S.group_prints(spark.createDataFrame(rows, "id long, fp long"), 4, S.Workspace(spark, "t"))
    root = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in rows:
            for j, b in rows:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {r["id"]: r["component"] for r in found.collect()} == root


@pytest.mark.parametrize("block", [512, 16])
def test_keys_of_a_large_group_grow_with_it_and_not_with_its_square(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(4)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    base = rng.getrandbits(64)
    prints = [base] * 40 + [base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(200)]
    # Bands are each class's own; the second fingerprint is far from all others.
    rows = [(i, [signed(p), signed(rng.getrandbits(64))], [-1 - i]) for i, p in enumerate(prints)]
    classes = spark.createDataFrame(rows, "class long, prints array<long>, bands array<long>")
    keys = {i: set() for i in range(len(rows))}
    for r in S.shared_keys(classes, 4, S.Workspace(spark, "t")).collect():
        keys[r["class"]].add(r["key"])
    # As many as tables at most: 31 of the one kind of fingerprint that meets others.
    assert max(map(len, keys.values())) <= len(S.covering_masks(4))
    near = [(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints[:i]) if (p ^ q).bit_count() <= 4]
    assert len(near) > 10000 and all(keys[i] & keys[j] for i, j in near)


def test_every_near_pair_meets_in_some_table():
    rng = random.Random(2)
    masks = S.covering_masks(4)
    assert len(masks) == 31 and all(12 <= (m & (2**64 - 1)).bit_count() <= 52 for m in masks)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m & (2**64 - 1) == 0 for m in masks)


def test_empty_table(spark):
    assert S.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (1, "c")], "doc_id long, text string")
    got = S.simhash_groups(docs).select("id", F.col("component")).collect()
    assert sorted((r["id"] or 0, r["component"]) for r in got if r["id"]) == [(1, 1), (3, 3), (3, 3)]
    assert [r["component"] for r in got if r["id"] is None] == [None]
