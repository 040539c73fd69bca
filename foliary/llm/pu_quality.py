"""Text quality by positive-unlabelled learning: the non-negative unbiased risk of a linear model.

Risk: p E+[loss(g)] + max(0, E[loss(-g)] - p E+[loss(-g)]), where E+ is over trusted positives, E over unlabelled
texts, p the estimated share of positives, and loss the logistic one. While the second part is below zero its gradient
is followed upwards, so the model can't gain by overfitting the positives (Kiryo and others, 2017).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliary.llm.common import is_training, rough_sample

#: Rows that the model is fitted on, about: trusted positives, and unlabelled texts. Bounded samples.
FIT_POSITIVES, FIT_UNLABELLED = 6_000, 10_000
#: Buckets of pairs of character classes.
PAIRS = 256
#: Characters looked at together, so that a very long text takes bounded memory.
SLICE = 1 << 20
LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, BREAK, MARK, OTHER = range(8)
ASCII_SIGNS = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
CLASSES = 8 + len(ASCII_SIGNS)
SHAPE = 8
#: Deviations from the mean beyond which a feature counts no more.
CLIP = 8
#: L2 penalty on the weights of chosen features.
RIDGE = 1e-3
#: The least share of either class that the estimate gives.
PRIOR = 0.02
WIDTH = CLASSES + PAIRS + SHAPE


@lru_cache(1)
def _class_table() -> np.ndarray:
    def of(c: str) -> int:
        kind = unicodedata.category(c)
        if c in ASCII_SIGNS:
            return 8 + ASCII_SIGNS.index(c)
        if c == "\n":
            return BREAK
        if c.isspace():
            return SPACE
        return {"Ll": LOWER, "Lu": UPPER}.get(kind, {"L": OTHER_LETTER, "N": DIGIT, "M": MARK}.get(kind[0], OTHER))

    return np.array([of(chr(i)) for i in range(0x10000)], np.uint8)


@lru_cache(1)
def _pair_table() -> np.ndarray:
    return (np.random.default_rng(7).integers(0, PAIRS, CLASSES * CLASSES)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of character classes and of pairs of them, and measures of words and lines."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    table, pairs = _class_table(), _pair_table()
    single, double = np.zeros(CLASSES), np.zeros(PAIRS)
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        kind = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], OTHER_LETTER).astype(np.int64)
        single += np.bincount(kind[:SLICE], minlength=CLASSES)
        double += np.bincount(pairs[kind[:-1] * CLASSES + kind[1:]], minlength=PAIRS)
    out[:CLASSES] = np.sqrt(single / len(text))
    out[CLASSES : CLASSES + PAIRS] = np.sqrt(double / max(1, len(text) - 1))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[-SHAPE:] = [
        np.log1p(len(text)) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(sum(map(len, words)) / n),
        np.log1p(max(map(len, words), default=0)),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
    ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = standard(x, self.mean, self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features by deviations from their mean, at most CLIP of them, alike in training and scoring."""
    out = np.array(x, np.float64)
    out -= mean
    out /= scale
    return np.clip(out, -CLIP, CLIP, out=out)


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights (the last is the bias) and the gradient to follow.

    p and u end in a column of ones. Where the part for negatives is below zero it counts as zero, and the gradient is
    that of raising it, with which the method leaves overfitted weights.
    """
    gp, gu = p @ w, u @ w
    sp, su = 1 / (1 + np.exp(-gp.clip(-30, 30))), 1 / (1 + np.exp(-gu.clip(-30, 30)))
    # The loss of g as a positive is log(1 + e^-g), as a negative log(1 + e^g), with slopes sigmoid(g) - 1 and sigmoid(g).
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    slope = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    if negative < 0:
        return positive, -slope
    return positive + negative, slope + prior * (p.T @ (sp - 1)) / len(p)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400) -> Model:
    """Accelerated proximal steps on the non-negative risk with an L1 penalty, then on the chosen features with a small L2.

    A feature without any bearing moves its part of the gradient by chance, by some (prior^2 / positives + 1 / unlabelled)
    ^ 0.5 / 2; the penalty is the largest of WIDTH such moves to be expected, so that features of no use get no weight
    however many there are. Without positives or unlabelled texts all scores are the prior.
    """
    every = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, WIDTH))
    mean, scale = every.mean(0, np.float64), every.std(0, np.float64)
    del every
    scale = np.where(scale > 1e-6, scale, 1.0)
    bias = float(np.log(prior / (1 - prior)))
    w = np.zeros(WIDTH + 1)
    w[-1] = bias
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, w[:-1], bias, prior)
    p, u = with_ones(standard(positive, mean, scale)), with_ones(standard(unlabelled, mean, scale))
    penalty = 0.5 * np.sqrt(2 * np.log(WIDTH) * (prior**2 / len(p) + 1 / len(u)))
    w = descend(w, p, u, prior, steps, l1=penalty, l2=0.0)
    some = np.append(np.flatnonzero(w[:-1]), WIDTH)
    w[some] = descend(w[some], p[:, some], u[:, some], prior, steps, l1=0.0, l2=RIDGE)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def descend(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, steps: int, l1: float, l2: float) -> np.ndarray:
    """The mean of the last half of the steps' weights; the bias is free of penalties."""
    # The steepest slope of the risk is a quarter of the largest eigenvalue of the unlabelled texts' second moments.
    direction, largest = np.ones(u.shape[1]), 1.0
    for _ in range(50):
        direction = u.T @ (u @ (direction / np.linalg.norm(direction))) / len(u)
        largest = np.linalg.norm(direction)
    rate = 1 / (0.25 * 1.05 * largest + l2)
    at, ahead, momentum = w.copy(), w.copy(), 1.0
    total = np.zeros_like(w)
    for t in range(steps):
        _, slope = risk(ahead, p, u, prior)
        slope[:-1] += l2 * ahead[:-1]
        new = ahead - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, at, momentum = new + (momentum - 1) / after * (new - at), new, after
        if t >= steps // 2:
            total += at
    return np.where(at != 0, total / (steps - steps // 2), 0)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from the two samples alone.

    A model that tells positives from unlabelled texts is fitted on half of each. On the other half, of all cuts of its
    scores the one is taken where the share of unlabelled texts above the cut is least in proportion to that of positives,
    with an allowance for chance (the best bin of Garg and others, 2021): above a good cut nearly all are positives. The
    estimate is between PRIOR and 1 - PRIOR; 0.5 without rows on either side.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    model = minimise(positive[::2], unlabelled[::2], 0.5)
    held_p, held_u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    above_p = 1 - np.arange(len(held_p)) / len(held_p)
    above_u = 1 - np.searchsorted(held_u, held_p, "left") / len(held_u)
    chance = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(held_u)) + 1 / np.sqrt(len(held_p)))
    best = np.argmin((above_u + chance) / above_p)
    return float(np.clip(above_u[best] / above_p[best], PRIOR, 1 - PRIOR))


def judged(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc, good) for each document with a label that may be learned; good if all its labels are 1."""
    rows = labels.where("quality in (0, 1)").where(F.col(id_col).isNotNull()).where(is_training(id_col))
    return rows.groupBy(F.col(id_col).cast("long").alias("doc")).agg((F.min("quality") == 1).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labels of 1 as trusted positives and from texts without their labels; the prior is estimated from both.

    Both are samples of some FIT_POSITIVES and FIT_UNLABELLED rows, and twice as many at most whatever ids and texts
    repeat, so what is collected, WIDTH numbers a row, is bounded. Null texts are empty ones; documents that are labelled
    both ways are not trusted; empty tables give a model whose scores are all alike. Other columns are not read.
    """
    known = judged(labels, id_col).where("good").select("doc")
    trusted = rough_sample(known, ["doc"], FIT_POSITIVES, "trusted")
    texts = docs.where(is_training(id_col)).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    unlabelled = rough_sample(texts, ["doc", "t"], FIT_UNLABELLED, "unlabelled").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())], names=["x"])

    def collected(rows: DataFrame, most: int) -> np.ndarray:
        found = rows.mapInArrow(run, "x binary").limit(2 * most).toArrow()
        # In an order of their own, as tasks end in any: the same tables give the same model.
        return np.frombuffer(b"".join(sorted(found.column("x").to_pylist())), np.float32).reshape(-1, WIDTH)

    # trusted is a sample of some FIT_POSITIVES ids, which judged has once each.
    positive = collected(texts.join(F.broadcast(trusted.limit(2 * FIT_POSITIVES)), "doc").select("t"), FIT_POSITIVES)
    rest = collected(unlabelled, FIT_UNLABELLED)
    return minimise(positive, rest, estimate_prior(positive, rest))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, 0 to 1, higher for better; a null text is scored as an empty one.

    A column of docs that has the name score_col already gives way to the new one; all others stay, whatever their names.
    Repeated rows are scored alike and stay repeated; an empty table gives none. A very long text is looked at in slices.
    """
    image = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = image.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, score_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return docs.mapInArrow(run, schema)
