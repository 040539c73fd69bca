import random

import numpy as np
import pytest

from foliary.llm import sparse_suffix as S


def brute(rows, length):
    where, spans = {}, {}
    texts = [(d, (t or "").split()) for d, t in rows if d is not None]
    for doc, words in texts:
        for i in range(len(words) - length + 1):
            where.setdefault(tuple(words[i : i + length]), set()).add(doc)
    for doc, words in texts:
        for i in range(len(words) - length + 1):
            if len(where[tuple(words[i : i + length])]) > 1:
                spans.setdefault(doc, []).append((i, i + length))
    return {d: S.merge_spans(s) for d, s in spans.items()}


def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    passages.append((passages[3][:40] + passages[4][100:140]))
    passages.append(["same"] * 60)
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.choice([1, 2, 3])):
            words += [word() for _ in range(rng.randrange(40))]
            words += rng.choice(passages)[rng.choice([0, 0, 5]) :] if rng.random() < 0.6 else []
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([word() for _ in range(5)] + passages[4] + [word() for _ in range(5)])) for i in range(10)]
    rows += [(200, rows[5][1]), (201, None), (202, ""), (None, rows[60][1]), (203, "x y " * 400), (204, "x y " * 400), (60, "z " * 300), (60, "z " * 300)]
    return rows


@pytest.mark.parametrize("group", [64, 3])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, n int")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.repeated_passages(docs).collect()}
    assert got == brute(rows, 50)
    assert 60 not in got and 203 in got


def test_every_window_owns_one_suffix():
    rng = np.random.default_rng(0)
    for words in (rng.integers(0, 5, 300), rng.integers(0, 1 << 60, 300), np.zeros(120)):
        words = words.astype(np.uint64)
        h, place, low, high = S.owned(words, 50)
        runs = S.hashes_of_runs(words, S.RUN)
        got = np.repeat(place, high - low + 1)
        assert got.tolist() == [i + int(np.argmin(runs[i : i + 50 - S.RUN + 1])) for i in range(len(words) - 49)]


def test_empty_table(spark):
    assert S.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from foliary.llm import queries as Q

    folder, name = "/root/testdata/sf0.001", "op4_sparse_suffix_dedup"
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    columns = ["doc_id", "n_spans", "n_words", "spans"]
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted(want) == sorted(map(tuple, Q.QUERIES[name](spark, folder).select(*columns).collect()))
