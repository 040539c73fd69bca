"""Layout of many pages at once: the same as of each page alone, with work that doesn't grow by regions met again."""

from itertools import islice

import numpy as np
import pytest

from foliary.operators import layout


def words(rng, n):
    angle = rng.normal(0, 0.05, n)
    columns = [rng.uniform(0, 400, n), rng.uniform(0, 400, n), np.sin(angle), -np.cos(angle), rng.uniform(5, 60, n), rng.uniform(8, 14, n)]
    return np.stack(columns, axis=1).astype(np.float32)


def test_pages_of_a_batch_as_alone():
    rng = np.random.default_rng(3)
    pages = [words(rng, n) for n in (1, 0, 5, 17, 40, layout.FEW_WORDS, layout.FEW_WORDS + 1, 2, 0)]
    got = list(layout.reading_orders(np.concatenate(pages), [len(p) for p in pages]))
    assert got == [layout.reading_order(p) for p in pages]
    assert list(layout.reading_orders(np.zeros((0, 6)), [])) == []


def area(width, height):
    return width * height


def by_cuts(rect, obstacles):
    """All regions that cuts lead to and that are empty, whatever their order."""
    met = [o for o in obstacles if o[0] < rect[2] and o[2] > rect[0] and o[1] < rect[3] and o[3] > rect[1]]
    if not met:
        return {rect}
    t, l, b, r = rect
    p = met[len(met) // 2]
    parts = [(t, l, p[0], r), (t, l, b, p[1]), (p[2], l, b, r), (t, p[3], b, r)]
    return set().union(*[by_cuts(x, met) for x in parts if x[2] > x[0] and x[3] > x[1]])


@pytest.mark.parametrize("n", [3, 9])
def test_empty_rects_come_once(n):
    corner = np.random.default_rng(n).integers(0, 80, (n, 2))
    obstacles = np.concatenate([corner, corner + 9], axis=1)
    found = list(layout.empty_rects(obstacles, (0, 0, 100, 100), area, 0, 0))
    assert len(found) == len(set(found))
    ordered = sorted(map(tuple, obstacles.tolist()), key=lambda o: ((o[1] + o[3]) // 2, (o[0] + o[2]) // 2))
    assert set(found) == by_cuts((0, 0, 100, 100), ordered)
    sizes = [area(r - l, b - t) for t, l, b, r in found]
    assert sizes == sorted(sizes, reverse=True)


def test_few_and_many_obstacles_alike(monkeypatch):
    corner = np.random.default_rng(5).integers(0, 300, (60, 2))
    obstacles = np.concatenate([corner, corner + 12], axis=1)

    def best():
        return list(islice(layout.without_overlaps(layout.empty_rects(obstacles, (0, 0, 320, 320), layout.favour_tall, 5, 5)), 80))

    found = []
    for few in (0, 48, 100):
        monkeypatch.setattr(layout, "FEW_OBSTACLES", few)
        found.append(best())
    assert found[0] == found[1] == found[2]
