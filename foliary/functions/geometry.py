"""Plane geometry of boxes in float32: rows of (cx, cy, ux, uy, w, h), where (ux, uy) is the unit up axis.

y grows downwards; an upright box has the up axis (0, -1). The height runs along the up axis.
"""

from __future__ import annotations

import numpy as np

BOX_FIELDS = ("cx", "cy", "ux", "uy", "w", "h")


def upright(top: float, left: float, bottom: float, right: float) -> np.ndarray:
    return np.array([(left + right) / 2, (top + bottom) / 2, 0, -1, right - left, bottom - top], np.float32)


def corners(boxes: np.ndarray) -> np.ndarray:
    """[..., 4, 2] of (x, y): for an upright box bottom right, bottom left, top left, top right."""
    b = np.asarray(boxes, np.float32)
    centre, up = b[..., 0:2], b[..., 2:4]
    across = np.stack([-up[..., 1], up[..., 0]], axis=-1)
    half_w, half_h = across * (b[..., 4:5] / 2), up * (b[..., 5:6] / 2)
    return np.stack([centre - half_h + half_w, centre - half_h - half_w, centre + half_h - half_w, centre + half_h + half_w], axis=-2)


def bounds(boxes: np.ndarray) -> np.ndarray:
    """[..., 4] of (top, left, bottom, right)."""
    points = corners(boxes)
    low, high = points.min(axis=-2), points.max(axis=-2)
    return np.stack([low[..., 1], low[..., 0], high[..., 1], high[..., 0]], axis=-1)


def union(rects: np.ndarray) -> np.ndarray | None:
    return np.concatenate([rects[:, :2].min(0), rects[:, 2:].max(0)]) if len(rects) else None


def whole(rect: np.ndarray) -> np.ndarray:
    """The smallest rectangle of whole numbers around (top, left, bottom, right)."""
    return np.concatenate([np.floor(rect[..., :2]), np.ceil(rect[..., 2:])], axis=-1).astype(int)


def edges_by_x(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two leftmost and the two rightmost corners, [..., 2, 2] each."""
    points = corners(boxes)
    order = np.argsort(points[..., 0], axis=-1, kind="stable")
    ordered = np.take_along_axis(points, order[..., None], axis=-2)
    return ordered[..., :2, :], ordered[..., 2:, :]


def overlap(a_low, a_high, b_low, b_high):
    """Length that two intervals share, 0 if they are apart."""
    return np.maximum(0, np.minimum(a_high, b_high) - np.maximum(a_low, b_low))


def segments_cross(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do the segments p-q and a-b meet; touching counts. Points are [..., 2]; parallel segments don't cross."""
    r, s, d = q - p, b - a, a - p
    area = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    safe = np.where(area == 0, 1, area)
    t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / safe
    u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / safe
    return (area != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)


def smallest_box(points: np.ndarray) -> np.ndarray | None:
    """The box of least area around (x, y) points, which lies along an edge of their hull; None without an area."""
    ring = hull(points)
    if len(ring) < 3:
        return None
    edge = np.roll(ring, -1, axis=0) - ring
    axis = edge / np.linalg.norm(edge, axis=1, keepdims=True)
    normal = np.stack([-axis[:, 1], axis[:, 0]], axis=1)
    along, across = axis @ ring.T, normal @ ring.T
    size_a, size_n = np.ptp(along, axis=1), np.ptp(across, axis=1)
    k = int(np.argmin(size_a * size_n))
    centre = axis[k] * (along[k].max() + along[k].min()) / 2 + normal[k] * (across[k].max() + across[k].min()) / 2
    return turn(np.array([*centre, *normal[k], size_a[k], size_n[k]], np.float32), (0, -1))


def upright_boxes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of [n, 4, 2] points are the corners of an upright box with an area, and smallest_box of these, [m, 6]."""
    low, high = points.min(axis=1), points.max(axis=1)
    at_high = points == high[:, None]
    sides = (at_high | (points == low[:, None])).all(axis=(1, 2)) & (high > low).all(axis=1) & (np.abs(points) < 1e100).all(axis=(1, 2))
    corner = np.sort(at_high[..., 0] * 2 + at_high[..., 1], axis=1)
    upright = sides & (corner == np.arange(4)).all(axis=1)
    low, high = low[upright], high[upright]
    axis = np.broadcast_to([0.0, -1.0], low.shape)
    return upright, np.concatenate([(high + low) / 2, axis, high - low], axis=1).astype(np.float32)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in order (monotone chain)."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 3:
        return points

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1:
                a, b = out[-1] - out[-2], p - out[-1]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def turn(box: np.ndarray, towards: tuple[float, float]) -> np.ndarray:
    """The same box with that of its four axes as up axis that points most towards a direction."""
    cx, cy, ux, uy, w, h = (float(x) for x in box)
    options = [(ux, uy, w, h), (-uy, ux, h, w), (-ux, -uy, w, h), (uy, -ux, h, w)]
    x, y, width, height = max(options, key=lambda o: o[0] * towards[0] + o[1] * towards[1])
    return np.array([cx, cy, x + 0.0, y + 0.0, width, height], np.float32)


def simplify(ring: np.ndarray, epsilon: float) -> np.ndarray:
    """Points of a closed ring that are needed to stay within epsilon of it (Ramer, Douglas and Peucker)."""
    if len(ring) < 3:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    points = np.concatenate([ring, ring[:1]]).astype(float)
    keep = np.zeros(len(points), bool)
    keep[[0, far, -1]] = True
    todo = [(0, far), (far, len(points) - 1)]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        line, rel = points[e] - points[s], points[s + 1 : e] - points[s]
        norm = np.hypot(*line)
        gap = np.hypot(*rel.T) if norm == 0 else np.abs(line[0] * rel[:, 1] - line[1] * rel[:, 0]) / norm
        k = int(np.argmax(gap))
        if gap[k] > epsilon:
            keep[s + 1 + k] = True
            todo += [(s, s + 1 + k), (s + 1 + k, e)]
    return points[:-1][keep[:-1]]


def polygon_pixels(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the pixels of a polygon of whole (x, y) points: left and top edges belong to it, right and bottom don't."""
    ring = np.asarray(ring, float)
    ys = np.arange(int(ring[:, 1].min()), int(np.ceil(ring[:, 1].max())))
    out_y, out_x = [], []
    a, b = ring, np.roll(ring, -1, axis=0)
    for y in ys:
        spans = (np.minimum(a[:, 1], b[:, 1]) <= y) & (y < np.maximum(a[:, 1], b[:, 1]))
        p, q = a[spans], b[spans]
        xs = np.sort(p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]))
        for left, right in zip(xs[::2], xs[1::2], strict=True):
            row = np.arange(int(np.ceil(left)), int(np.ceil(right)))
            out_x.append(row)
            out_y.append(np.full(len(row), y))
    none = np.zeros(0, int)
    return np.concatenate([none, *out_y]).astype(int), np.concatenate([none, *out_x]).astype(int)


def slice_bounds(ring: np.ndarray, low: float, high: float) -> tuple[int, int, int, int] | None:
    """(top, left, bottom, right) of the part of a ring's edges with x from low to high; None if there is none."""
    a, b = np.asarray(ring, float), np.roll(np.asarray(ring, float), -1, axis=0)
    swap = a[:, 0] > b[:, 0]
    a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    inside = (b[:, 0] >= low) & (a[:, 0] <= high)
    if not inside.any():
        return None
    a, b = a[inside], b[inside]

    def y_at(x):
        width = np.where(b[:, 0] == a[:, 0], 1, b[:, 0] - a[:, 0])
        return a[:, 1] + (x - a[:, 0]) / width * (b[:, 1] - a[:, 1])

    x0, x1 = np.maximum(a[:, 0], low), np.minimum(b[:, 0], high)
    steep = a[:, 0] == b[:, 0]
    y0, y1 = np.where(steep, a[:, 1], y_at(x0)), np.where(steep, b[:, 1], y_at(x1))
    ys = np.concatenate([y0, y1])
    return int(ys.min()), int(x0.min()), int(ys.max()), int(x1.max())
