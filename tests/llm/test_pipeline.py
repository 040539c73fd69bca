import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from foliary.llm import common, pii_weak, simhash_covering
from foliary.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.01"


def sets(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    shingles = {d: sets(t) for d, t in rows}
    root = {d: d for d in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in shingles:
        for b in shingles:
            if a < b:
                both, either = len(shingles[a] & shingles[b]), len(shingles[a] | shingles[b])
                if 5 * both >= 4 * either:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in root}


@pytest.mark.parametrize(("checked", "heavy"), [(512, 1000), (8, 4)])
def test_near_copies_equal_brute_force(spark, monkeypatch, checked, heavy):
    monkeypatch.setattr(simhash_covering, "CHECKED", checked)
    monkeypatch.setattr(simhash_covering, "LEAVES", checked)
    monkeypatch.setattr(common, "HEAVY", heavy)
    rng = random.Random(7)
    word = lambda: f"W{min(int(rng.paretovariate(0.5)), 4000)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 100, len(base) // 60])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "x " * 40000), (1004, "x " * 39999)]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, id int, class string")
    got = {r["id"]: r["component"] for r in simhash_covering.near_copy_groups(docs).collect()}
    want = groups(rows)
    # Candidates come from fingerprints: nothing may be linked wrongly, and hardly a link be missed.
    together = lambda g: {(a, b) for a in g for b in g if a < b and g[a] == g[b]}
    found, true = together(got), together(want)
    assert found <= true and len(found) >= 0.97 * len(true)
    kept = {r["doc_id"] for r in simhash_covering.drop_near_copies(docs).collect()}
    assert kept == {d for d in got if got[d] == d}
    assert simhash_covering.drop_near_copies(docs.limit(0)).count() == 0


def test_copies_that_differ_in_one_block_are_found(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(20000)}"
    edits = {
        "append": lambda w, k: w + [word() for _ in range(k)],
        "cut": lambda w, k: w[: len(w) - k],
        "replace": lambda w, k: w[:40] + [word() for _ in range(k)] + w[40 + k :],
    }
    rows, pairs = [], {}
    for kind, edit in edits.items():
        for n in range(60):
            base = [word() for _ in range(rng.choice([80, 200, 600]))]
            copy = edit(base, len(base) * (5 if kind == "replace" else 15) // 100)
            a, b = sets(" ".join(base)), sets(" ".join(copy))
            if 5 * len(a & b) >= 4 * len(a | b):
                pairs.setdefault(kind, []).append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash_covering.near_copy_groups(docs).collect()}
    want = groups(rows)
    assert all(got[d] >= want[d] for d in got)
    for kind, of in pairs.items():
        assert len(of) > 30 and sum(got[a] == got[b] for a, b in of) >= 0.99 * len(of), kind


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return [*out, docs]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay_until_the_last_stage(stages):
    assert all(df.schema == stages[0].schema for df in stages[:-1])


def test_quality_drops_junk_and_keeps_good_texts(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(stages[1].select("doc_id", "text"), "doc_id", "left").collect()
    assert sum(r["text"] is not None for r in labels if r["quality"] == 1) >= 0.97 * sum(r["quality"] == 1 for r in labels)
    assert sum(r["text"] is None for r in labels if r["quality"] == 0) >= 0.85 * sum(r["quality"] == 0 for r in labels)


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = {d for d, root in groups(before.items()).items() if d == root}
    assert want <= set(after) and len(set(after) - want) <= 0.02 * len(before)


def test_contaminated_documents_go_and_clean_ones_stay(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}

    def holds(text):
        w = (text or "").lower().split()
        return any(tuple(w[i : i + 13]) in windows for i in range(len(w) - 12))

    assert set(before) - set(after) == {d for d, t in before.items() if holds(t)}


def test_personal_data_is_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for d, text in before.items():
        strict = [x for x in pii_weak.candidates(text or "") if x[3]]
        assert not [x for x in pii_weak.candidates(after[d] or "") if x[3]]
        if not strict and "<" not in after[d]:
            assert after[d] == text
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_token_ids_equal_the_library(stages):
    library = Tokenizer.from_file(BYTE_BPE)
    rows, before = stages[5].collect(), texts(stages[4])
    assert len(rows) == len(before)
    for r in rows:
        ids = library.encode(before[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
