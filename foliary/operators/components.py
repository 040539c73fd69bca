"""Words as connected regions of a text mask: outer borders, simplified, to the smallest box around each."""

from __future__ import annotations

import numpy as np

from foliary.functions import geometry as G
from foliary.functions.arrays import MIN_AREA

#: Distance in pixels that a border may be simplified by, and that boxes are larger than regions on each side.
SIMPLIFY, EXPAND = 2.0, 3.0
#: Neighbours of a pixel in clockwise order from the right, as (y, x).
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def label_regions(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Numbers of the connected regions of a mask, from 1 in scan order; 0 elsewhere. Runs of rows are joined."""
    height, width = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = list(range(len(ys)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    row_at = np.searchsorted(ys, np.arange(height + 1))
    for y in range(1, height):
        a, a_end, b, b_end = row_at[y - 1], row_at[y], row_at[y], row_at[y + 1]
        while a < a_end and b < b_end:
            if starts[a] < ends[b] + reach and starts[b] < ends[a] + reach:
                x, z = find(a), find(b)
                parent[max(x, z)] = min(x, z)
            if ends[a] < ends[b]:
                a += 1
            else:
                b += 1
    number: dict[int, int] = {}
    out = np.zeros(mask.shape, np.int32)
    for i, (y, s, e) in enumerate(zip(ys, starts, ends, strict=True)):
        out[y, s:e] = number.setdefault(find(i), len(number) + 1)
    return out


def outer_border(labels: np.ndarray, number: int, y: int, x: int) -> np.ndarray:
    """(x, y) of the pixels around a region, followed from its first pixel in scan order (after Suzuki and Abe)."""
    height, width = labels.shape

    def inside(p):
        return 0 <= p[0] < height and 0 <= p[1] < width and labels[p] == number

    start, out, back = (y, x), [], 4
    here = start
    first = None
    while True:
        for k in range(1, 9):
            way = (back + k) % 8
            there = (here[0] + AROUND[way][0], here[1] + AROUND[way][1])
            if inside(there):
                break
        else:
            return np.array([[x, y]])
        if (here, there) == first:
            return np.array([(q, p) for p, q in out])
        first = first or (here, there)
        out.append(here)
        here, back = there, (way + 4) % 8


def word_boxes(mask: np.ndarray, min_area: float = MIN_AREA, expand: float = EXPAND) -> np.ndarray:
    """[n, 6] boxes of the regions that are in no hole of another one, in scan order, of min_area at least when expanded."""
    labels = label_regions(mask)
    ground = label_regions(np.pad(~mask, 1, constant_values=True), diagonal=False)
    open_ = ground == ground[0, 0]
    beside = open_[:-2, 1:-1] | open_[2:, 1:-1] | open_[1:-1, :-2] | open_[1:-1, 2:]
    boxes = []
    outside = np.unique(labels[beside & mask])
    first = np.unique(labels, return_index=True)
    place = dict(zip(first[0].tolist(), first[1].tolist(), strict=True))
    for number in outside.tolist():
        y, x = divmod(place[number], labels.shape[1])
        box = G.smallest_box(G.simplify(outer_border(labels, number, y, x), SIMPLIFY))
        if box is not None:
            box[4:] += 2 * expand
            if box[4] * box[5] >= min_area:
                boxes.append(box)
    return np.array(boxes, np.float32).reshape(-1, 6)
