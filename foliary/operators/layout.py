"""Reading order of the words of one page. A page is one group, which a task holds; pages are what is distributed."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np

from foliary.functions import geometry as G

# Fixed values of the published pipeline.
MIN_SHARED_HEIGHT, MAX_SHARED_WIDTH = 5.0, 5.0
DEFAULT_GAP, DEFAULT_HEIGHT = 10, 10.0
MAX_SEPARATORS, MAX_IOU = 80, 0.5
#: Up to so many, obstacles of a region are a list; up to so many words, all pairs of a page are looked at together.
FEW_OBSTACLES, FEW_WORDS = 48, 64
#: About so many pairs of words are held at once.
PAIRS = 1 << 16


def chains(boxes: np.ndarray, walls: np.ndarray) -> list[list[int]]:
    """Words as lines from left to right; a chain goes on to the nearest word that fits, never across a wall.

    walls: [n, 2, 2] segments of (x, y). Ties go to the word that comes first by its left edge, then in the input.
    """
    if not len(boxes):
        return []
    order = np.argsort(np.trunc(G.bounds(boxes)[:, 1]), kind="stable")
    boxes = boxes[order]
    left, right = G.edges_by_x(boxes)
    left_x, right_x = left[..., 0].mean(1), right[..., 0].mean(1)
    centre = boxes[:, :2]
    free = np.ones(len(boxes), bool)
    out = []
    for seed in range(len(boxes)):
        if not free[seed]:
            continue
        free[seed] = False
        line, last = [seed], seed
        while True:
            shared = G.overlap(right[last, :, 1].min(), right[last, :, 1].max(), left[..., 1].min(1), left[..., 1].max(1))
            fits = free & (centre[:, 0] > centre[last, 0]) & (left_x - right_x[last] >= -MAX_SHARED_WIDTH) & (shared >= MIN_SHARED_HEIGHT)
            some = np.flatnonzero(fits)
            if len(walls) and len(some):
                crossed = G.segments_cross(centre[last][None, None], centre[some][:, None], walls[None, :, 0], walls[None, :, 1]).any(axis=1)
                some = some[~crossed]
            if not len(some):
                break
            last = int(some[np.argmin(np.trunc(centre[some, 0]))])
            free[last] = False
            line.append(last)
        out.append([int(order[i]) for i in line])
    return out


def empty_rects(obstacles: np.ndarray, boundary: tuple[int, int, int, int], score: Callable[[int, int], float], min_width: int, min_height: int) -> Iterator[tuple[int, int, int, int]]:
    """Empty rectangles (top, left, bottom, right) of whole numbers, each once, best first by score(width, height).

    A region with obstacles is cut at one in their middle into what lies above, left, below and right of it. Regions of
    equal score come in the order they were met. Obstacles that only touch a region leave it empty. What a region holds
    depends on its sides alone, so one that is met again has nothing new and is left out.
    """
    obstacles = np.asarray(obstacles, int).reshape(-1, 4)
    if len(obstacles) > FEW_OBSTACLES:
        obstacles = obstacles[np.lexsort(((obstacles[:, 0] + obstacles[:, 2]) // 2, (obstacles[:, 1] + obstacles[:, 3]) // 2))]
    else:
        # As lists: a call of numpy takes longer than they do.
        obstacles = sorted(obstacles.tolist(), key=lambda o: ((o[1] + o[3]) // 2, (o[0] + o[2]) // 2))
    root = tuple(int(x) for x in boundary)
    heap, seen, push, pop = [], {root}, heapq.heappush, heapq.heappop
    if root[2] > root[0] and root[3] > root[1]:
        push(heap, (-score(root[3] - root[1], root[2] - root[0]), 0, root, obstacles))
    while heap:
        _, _, rect, inside = pop(heap)
        if not len(inside):
            yield rect
            continue
        top, left, bottom, right = rect
        p_top, p_left, p_bottom, p_right = inside[len(inside) // 2]
        many = not isinstance(inside, list)
        for side, part in enumerate(((top, left, p_top, right), (top, left, bottom, p_left), (p_bottom, left, bottom, right), (top, p_right, bottom, right))):
            t, l, b, r = part
            width, height = r - l, b - t
            if width <= 0 or height <= 0 or width < min_width or height < min_height or part in seen:
                continue
            # What meets a region meets its part as well, but for the side that was moved. The boundary may have obstacles beyond it.
            if many:
                t, l, b, r = part = (int(t), int(l), int(b), int(r))
                meets = inside[(inside[:, 0] < b) & (inside[:, 2] > t) & (inside[:, 1] < r) & (inside[:, 3] > l)]
                meets = meets if len(meets) > FEW_OBSTACLES else meets.tolist()
            elif rect is root:
                meets = [o for o in inside if o[0] < b and o[2] > t and o[1] < r and o[3] > l]
            elif side == 0:
                meets = [o for o in inside if o[0] < b]
            elif side == 1:
                meets = [o for o in inside if o[1] < r]
            elif side == 2:
                meets = [o for o in inside if o[2] > t]
            else:
                meets = [o for o in inside if o[3] > l]
            seen.add(part)
            push(heap, (-score(r - l, b - t), len(seen), part, meets))


def without_overlaps(rects, limit: float = MAX_IOU):
    """Rectangles that have an IoU under the limit, which is above 0, with each that was let through before."""
    kept: list = []
    for rect in rects:
        top, left, bottom, right = rect
        area = (bottom - top) * (right - left)
        for t, l, b, r, other, least in kept:
            # An IoU isn't above the ratio of the areas.
            if area < least:
                continue
            height = (bottom if bottom < b else b) - (top if top > t else t)
            width = (right if right < r else r) - (left if left > l else l)
            if height > 0 and width > 0 and height * width / (area + other - height * width) >= limit:
                break
        else:
            kept.append((*rect, area, 0.99 * limit * area))
            yield rect


def favour_tall(width: int, height: int) -> float:
    """Score of a separator: the root of its area by a weight that grows with how far it is from a square."""
    low, high = min(width, height), max(width, height)
    # Far from the limits of the weights, so that rounding can't matter, the logarithm isn't needed.
    if low > 0 and high < 7.9 * low:
        return math.sqrt(width * height * 0.5)
    if low > 0 and 8.1 * low < high < 31.9 * low:
        return math.sqrt(width * height * 1.5)
    stretch = abs(float(np.log2(height / width))) if low > 0 else 0.0
    weight = 0.5 if stretch < 3 else 1.5 if stretch < 5 else stretch
    return math.sqrt(width * height * weight)


def separators(boxes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Empty rectangles that part columns and sections, of at least three word gaps by three word heights."""
    if not len(boxes):
        return []
    bounds = G.bounds(boxes)
    gaps = [
        int(np.floor(max(0.0, float(bounds[b, 1] - bounds[a, 3])) + 0.5))
        for line in chains(boxes, np.zeros((0, 2, 2)))
        for a, b in zip(line, line[1:], strict=False)
    ]
    return _separators(G.whole(bounds), tuple(G.whole(G.union(bounds)).tolist()), gaps, float(boxes[len(boxes) // 2, 5]))


def _separators(rects: np.ndarray, page: tuple[int, int, int, int], gaps: list[int], middle: float) -> list[tuple[int, int, int, int]]:
    """middle: the height of the word in the middle of the list as it is given, not of the heights."""
    gap = sorted(gaps)[len(gaps) // 2] if gaps else DEFAULT_GAP
    found = empty_rects(rects, page, favour_tall, 3 * gap, 3 * max(0, math.floor(middle + 0.5)))
    return list(islice(without_overlaps(found), MAX_SEPARATORS))


def reading_order(boxes: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(paragraph, line, words) in reading order; words are rows of boxes."""
    boxes = np.asarray(boxes, np.float32).reshape(-1, 6)
    found = np.array(separators(boxes), float).reshape(-1, 4)
    # The centre of a separator of whole numbers is taken as a whole number too.
    mid_y, mid_x = (found[:, 0] + found[:, 2]) // 2, (found[:, 1] + found[:, 3]) // 2
    upright = np.stack([np.stack([mid_x, found[:, 0]], 1), np.stack([mid_x, found[:, 2]], 1)], 1)
    level = np.stack([np.stack([found[:, 1], mid_y], 1), np.stack([found[:, 3], mid_y], 1)], 1)
    lines = chains(boxes, upright)
    bounds = G.bounds(boxes)
    ends = np.array([
        [[bounds[w[0], 1], (bounds[w[0], 0] + bounds[w[0], 2]) / 2], [bounds[w[-1], 3], (bounds[w[-1], 0] + bounds[w[-1], 2]) / 2]] for w in lines
    ]).reshape(-1, 2, 2)
    centre = ends.mean(axis=1)
    todo = np.argsort(np.trunc(centre[:, 1]), kind="stable").tolist()
    out, paragraph = [], 0
    while todo:
        last = todo.pop(0)
        taken = [last]
        for line in list(todo):
            shared = G.overlap(ends[last, 0, 0], ends[last, 1, 0], ends[line, 0, 0], ends[line, 1, 0])
            if shared > 0 and not (len(level) and G.segments_cross(centre[last], centre[line], level[:, 0], level[:, 1]).any()):
                taken.append(line)
                todo.remove(line)
                last = line
        out += [(paragraph, len(out) + k, lines[line]) for k, line in enumerate(taken)]
        paragraph += 1
    return out


def reading_orders(boxes: np.ndarray, sizes: np.ndarray) -> Iterator[list[tuple[int, int, list[int]]]]:
    """reading_order of each page of a batch: boxes of all pages one after another, and the number of words of each.

    What a line may go on to, and its gap, is found for all pairs of a page's words and all pages of few words at once;
    what is left to each page are the choices. Sums and differences are rounded to float32 where reading_order has them so.
    """
    boxes, sizes = np.asarray(boxes, np.float32).reshape(-1, 6), np.asarray(sizes, int)
    starts = np.cumsum(sizes) - sizes
    few = np.flatnonzero((sizes > 0) & (sizes <= FEW_WORDS))
    groups = np.split(few, np.flatnonzero(np.diff(np.cumsum(sizes[few] ** 2) // PAIRS)) + 1) if len(few) else []
    orders = chain.from_iterable(_small_pages(boxes, starts[g], sizes[g]) for g in groups)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        yield next(orders) if 0 < n <= FEW_WORDS else reading_order(boxes[s : s + n])


def _small_pages(boxes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[list[tuple[int, int, list[int]]]]:
    firsts = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(sizes)), sizes)
    boxes = boxes[np.arange(len(page)) - firsts[page] + starts[page]]
    bounds = G.bounds(boxes)
    # Words of a page by their left edges, and all pairs of them.
    order = np.lexsort((np.trunc(bounds[:, 1]), page))
    left, right = (e[order] for e in G.edges_by_x(boxes))
    left_x, right_x, centre = left[..., 0].mean(1), right[..., 0].mean(1), boxes[order, :2]
    n = sizes[page]
    a = np.repeat(np.arange(len(page)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + firsts[page][a]
    shared = G.overlap(right[..., 1].min(1)[a], right[..., 1].max(1)[a], left[..., 1].min(1)[b], left[..., 1].max(1)[b])
    fits = np.flatnonzero((centre[b, 0] > centre[a, 0]) & (left_x[b] - right_x[a] >= -MAX_SHARED_WIDTH) & (shared >= MIN_SHARED_HEIGHT))
    a, b = a[fits], b[fits]
    near = np.lexsort((b, np.trunc(centre[b, 0]), a))
    a, b = a[near], b[near]
    step = (centre[b] - centre[a]).astype(float)
    gap = np.floor(np.maximum(0.0, (bounds[order[b], 1] - bounds[order[a], 3]).astype(float)) + 0.5).astype(int)
    pairs = list(zip((b - firsts[page[a]]).tolist(), gap.tolist(), step[:, 0].tolist(), step[:, 1].tolist(), strict=True))
    cuts = np.searchsorted(a, np.arange(len(page) + 1)).tolist()
    whole = G.whole(bounds)
    pages = np.concatenate([np.minimum.reduceat(whole[:, :2], firsts), np.maximum.reduceat(whole[:, 2:], firsts)], axis=1).tolist()
    middle = ((bounds[:, 0] + bounds[:, 2]) / 2).tolist()
    sides, centres, order, heights = bounds.tolist(), centre.tolist(), (order - firsts[page]).tolist(), boxes[:, 5].tolist()

    for k, (s, size) in enumerate(zip(firsts.tolist(), sizes.tolist(), strict=True)):
        e = s + size
        follow = [pairs[i:j] for i, j in zip(cuts[s:e], cuts[s + 1 : e + 1], strict=True)]
        at = centres[s:e]
        gaps: list[int] = []
        lines = _follow(follow, at, [], gaps)
        found = _separators(whole[s:e], tuple(pages[k]), gaps, heights[s + size // 2])
        if found:
            # Upright ones from their upper to their lower end, as (x, y, dx, dy).
            lines = _follow(follow, at, [((l + r) // 2, t, 0, b - t) for t, l, b, r in found], None)
        level = [(l, (t + b) // 2, r - l, 0) for t, l, b, r in found]
        lines = [[order[s + i] for i in line] for line in lines]
        ends = [(sides[s + w[0]][1], middle[s + w[0]], sides[s + w[-1]][3], middle[s + w[-1]]) for w in lines]
        mid = [(_single(x0 + x1) / 2, _single(y0 + y1) / 2) for x0, y0, x1, y1 in ends]
        todo = sorted(range(len(lines)), key=lambda i: math.trunc(mid[i][1]))
        out, paragraph = [], 0
        while todo:
            last, *others = todo
            out.append((paragraph, len(out), lines[last]))
            todo = []
            for i in others:
                if min(ends[last][2], ends[i][2]) > max(ends[last][0], ends[i][0]) and not (
                    level and _crosses(*mid[last], _single(mid[i][0] - mid[last][0]), _single(mid[i][1] - mid[last][1]), level)
                ):
                    out.append((paragraph, len(out), lines[i]))
                    last = i
                else:
                    todo.append(i)
            paragraph += 1
        yield out


def _follow(follow: list[list[tuple]], centre: list[list[float]], walls: list[tuple], gaps: list[int] | None) -> list[list[int]]:
    """chains, where the words that each may be followed by are given, nearest first; gaps between words are added to gaps."""
    free, out = [True] * len(follow), []
    for seed in range(len(follow)):
        if not free[seed]:
            continue
        free[seed] = False
        line = [seed]
        last: int | None = seed
        while last is not None:
            x, y = centre[last]
            for i, gap, dx, dy in follow[last]:
                if free[i] and not (walls and _crosses(x, y, dx, dy, walls)):
                    free[i] = False
                    line.append(i)
                    last = i
                    if gaps is not None:
                        gaps.append(gap)
                    break
            else:
                last = None
        out.append(line)
    return out


def _crosses(x: float, y: float, dx: float, dy: float, walls: list[tuple]) -> bool:
    """segments_cross of one segment, (x, y) and its length in both directions, with any of the others."""
    for a_x, a_y, s_x, s_y in walls:
        area = dx * s_y - dy * s_x
        if area and 0 <= ((a_x - x) * s_y - (a_y - y) * s_x) / area <= 1 and 0 <= ((a_x - x) * dy - (a_y - y) * dx) / area <= 1:
            return True
    return False


def _single(x: float) -> float:
    return float(np.float32(x))
