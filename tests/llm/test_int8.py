import math

import numpy as np
import pytest

from foliary.llm import int8_neardup as N


def brute(rows, threshold=0.98):
    good = [
        (i, l, [float(x) for x in v]) for i, l, v in rows
        if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    pairs = []
    for i, l, v in good:
        for j, m, w in good:
            if i != j and l == m and len(v) == len(w):
                cos = sum(a * b for a, b in zip(v, w, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w))
                if cos >= threshold:
                    links[i] += 1
                    pairs.append((i, j))
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {i: (links[i], root[i]) for i in links}


def test_bound_holds_and_spares_most_pairs():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 64))
    near = base + rng.normal(size=base.shape) * rng.choice([0.05, 0.2, 0.5], size=(300, 1))
    linked, full = N.linked_pairs(base, near, 0.98)
    cos = (base / np.linalg.norm(base, axis=1)[:, None]) @ (near / np.linalg.norm(near, axis=1)[:, None]).T
    assert (linked == (cos >= 0.98)).all() and 0 < full < 0.01 * cos.size


@pytest.mark.parametrize("block", [4, 512])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(70):
        v = rng.normal(size=8)
        for _ in range(rng.choice([1, 1, 4])):
            rows.append((len(rows), int(rng.integers(3)), (v + rng.normal(size=8) * 0.06).astype(np.float32).tolist()))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [nan] * 8, [1.0, None] * 4, [inf] + [0.0] * 7, [1.0], [1.0], [1e-38] * 8, [3e38] * 8]
    rows += [(1000 + k, 0, v) for k, v in enumerate(odd)] + [(2000, None, rows[0][2]), (2001, None, rows[0][2])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<float>, id string, n string")
    assert {r["id"]: (r["n_links"], r["component"]) for r in N.near_duplicates(frame).collect()} == brute(rows)
    assert N.near_duplicates(frame.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    v = [1.0, 2.0]
    frame = spark.createDataFrame([(None, 1, v), (1, 1, v), (1, 1, v), (2, 1, v)], "vec_id long, label int, embedding array<double>")
    got = sorted(((r["id"] or 0), r["n_links"], r["component"]) for r in N.near_duplicates(frame).collect())
    assert got == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
