"""CTC decoding of [steps, classes] log probabilities; class 0 is the blank. Results are lists of (label, step)."""

from __future__ import annotations

import math

import numpy as np


def greedy(scores: np.ndarray) -> list[tuple[int, int]]:
    """The best class of each step; of a run its first step."""
    best = scores.argmax(axis=1)
    first = np.append(True, best[1:] != best[:-1]) & (best != 0)
    return [(int(best[i]), int(i)) for i in np.flatnonzero(first)]


def _add(a: float, b: float) -> float:
    """log(e^a + e^b)."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def beam(scores: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The best labelling of a prefix beam search: of all alignments that give a prefix the probabilities are summed."""
    none = -math.inf
    # Prefix -> log probability of alignments that end with a blank, and of the others; and where labels came first.
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, none)}
    where: dict[tuple[int, ...], int] = {}
    for t, array in enumerate(scores):
        row = array.tolist()
        labels = [c for c in np.argsort(-array, kind="stable")[: width + 1].tolist() if c and row[c] > none]
        with_blank: dict[tuple[int, ...], float] = {}
        with_label: dict[tuple[int, ...], float] = {}
        for prefix, (blank, other) in beams.items():
            total = _add(blank, other)
            with_blank[prefix] = total + row[0]
            last = prefix[-1] if prefix else 0
            if last:
                with_label[prefix] = _add(with_label.get(prefix, none), other + row[last])
            for c in labels:
                longer = (*prefix, c)
                with_label[longer] = _add(with_label.get(longer, none), (blank if c == last else total) + row[c])
                where.setdefault(longer, t)
        both = {p: (with_blank.get(p, none), with_label.get(p, none)) for p in with_blank | with_label}
        order = sorted(both, key=lambda p: (-_add(*both[p]), p))[:width]
        beams = {p: both[p] for p in order}
    best = next(iter(beams))
    return [(c, where[best[: i + 1]]) for i, c in enumerate(best)]


def mask(scores: np.ndarray, excluded: list[int]) -> np.ndarray:
    if not excluded:
        return scores
    scores = scores.copy()
    scores[:, excluded] = -np.inf
    return scores
