"""Queries against their SQL on small tables with rows that the given ones lack."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from foliary.functions import geometry as G
from foliary.functions import text as T
from foliary.plans import queries as Q


def equal_to_sql(spark, folder, name, **tables):
    connection = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, folder / f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = connection.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want = sorted(map(tuple, result.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in Q.QUERIES[name](spark, str(folder)).collect()), key=repr) == want
    return want


@pytest.mark.parametrize("name", ["q10_ctc_greedy", "q11_ctc_excluded"])
def test_vectors_without_steps(spark, tmp_path, name):
    blank = ([1.0] + [0.0] * 7) * 8
    rows = pa.table({"vec_id": pa.array([1, 2, 3], pa.int64()), "embedding": pa.array([blank, [0.0] * 4 + [1.0] + [0.0] * 59, None], pa.list_(pa.float32()))})
    want = equal_to_sql(spark, tmp_path, name, embeddings=rows)
    assert [r[1:] for r in want[:2]] == [("?", 0), ("2", 1)]


def documents(texts, ids=None):
    return pa.table({"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


TEXTS = ["", None, "\n\n", " ", "a  b \n\n c", "x\n  \n", "é ñandú\n\nz", "one", "\n \n \n last  word\n"]


@pytest.mark.parametrize("name", ["q04_document_tree", "q37_upright_json"])
def test_documents_of_odd_texts(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(T, "TEXT_BYTES", 8)
    want = equal_to_sql(spark, tmp_path, name, documents=documents([*TEXTS, "no id"], [*range(len(TEXTS)), None]))
    assert len(want) == len(TEXTS) + 1


def test_trees_of_an_id_that_repeats(spark, tmp_path):
    want = equal_to_sql(spark, tmp_path, "q04_document_tree", documents=documents(["\nb c", "\n\nd", "e"], [1, 1, 2]))
    assert [r[:4] for r in want] == [(1, 1, 2, 3), (1, 1, 2, 3), (2, 1, 1, 1)]


def test_lines_of_a_document_are_not_shuffled(spark, tmp_path):
    pq.write_table(documents(TEXTS), tmp_path / "documents.parquet")

    def plan(name):
        return Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan("q37_upright_json")
    assert "collect_list" not in plan("q04_document_tree")


@pytest.mark.parametrize("name", ["q02_char_boxes", "q25_vertices", "q36_rotated_rects"])
def test_lines_of_odd_texts(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(T, "CHARS_BYTES", 8)
    equal_to_sql(spark, tmp_path, name, documents=documents([*TEXTS, "a😀é", "😀"]))


def test_characters_as_columns_have_them(spark, monkeypatch):
    monkeypatch.setattr(T, "CHARS_BYTES", 4)
    lines = ["ab c", "", None, "é😀x", "z", None, ""]
    chars = T.placed_chars(pa.array([x or "" for x in lines])[1:]).to_pylist()
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").coalesce(1)
    rows = df.select("i", T.char_boxes(F.col("line")).alias("c"), T.char_extent("line").alias("x")).orderBy("i").collect()
    assert [[c.asDict(True) for c in r["c"]] for r in rows[1:] if lines[r["i"]] is not None] == [c for c, x in zip(chars, lines[1:], strict=True) if x is not None]
    for line, r in zip(lines, rows, strict=True):
        left = [c["rect"]["left"] for c in r["c"]] if line else []
        want = None if line is None else (len(line), line[:1] or None, line[-1:] or None, (0, 0, 25, 10 * len(line)) if line else None, sum(left))
        assert (r["x"] and tuple(tuple(v) if isinstance(v, tuple) else v for v in r["x"])) == want


def test_upright_boxes_as_the_smallest():
    rng = np.random.default_rng(2)
    low = rng.uniform(-300, 300, (200, 2))
    high = low + rng.uniform(0.01, 90, (200, 2))
    ring = np.stack([high, np.stack([low[:, 0], high[:, 1]], 1), low, np.stack([high[:, 0], low[:, 1]], 1)], 1)
    ring = np.concatenate([np.stack([r[rng.permutation(4)] for r in ring]), ring[:3] + [[[0, 1], [0, 0], [0, 0], [0, 0]]], ring[:2, [0, 0, 2, 2]], np.zeros((1, 4, 2))])
    upright, boxes = G.upright_boxes(ring)
    assert upright.tolist() == [True] * 200 + [False] * 6
    assert np.array_equal(boxes, np.stack([G.smallest_box(r) for r in ring[:200]]))


def test_vertices_are_plain_numbers(spark, tmp_path):
    pq.write_table(documents(TEXTS), tmp_path / "documents.parquet")
    plan = Q.q25_vertices(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "lambda x_" not in plan.split("Generate")[0] and "array(" not in plan.split("Generate")[0]
