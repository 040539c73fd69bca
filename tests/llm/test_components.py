import random

import numpy as np
import pytest

from foliary.llm import components as C
from foliary.llm.common import Workspace, label_components


def roots(edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("chunk", [400_000, 5])
def test_equals_union_find(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(1)
    edges = [(rng.randrange(-50, 150), rng.randrange(-50, 150)) for _ in range(90)]
    edges += [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5)]
    frame = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in C.connected_components(frame, Workspace(spark, "t")).collect()}
    assert got == {k: v for k, v in roots([(a, b) for a, b in edges if a != b]).items()}


def test_edges_that_share_their_larger_end(spark):
    # One edge in each partition, so that none is joined with another before the first round.
    edges = spark.createDataFrame([(3, 1), (3, 2), (9, 7), (8, 7), (9, 6)], "a long, b long").repartition(5, "a", "b")
    got = {r["node"]: r["component"] for r in C.connected_components(edges, Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6}


def test_no_edges(spark):
    assert C.connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_matrix_components():
    rng = np.random.default_rng(0)
    m = rng.random((30, 30)) < 0.04
    m |= m.T
    assert label_components(m).tolist() == [roots([(i, i) for i in range(30)] + list(zip(*np.nonzero(m), strict=True)))[i] for i in range(30)]
