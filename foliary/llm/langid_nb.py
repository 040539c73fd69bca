"""Language identification by multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log probabilities, a row for each hash bucket and a column for each language: it is
broadcast, and its size is BUCKETS x languages x 4 bytes whatever the corpus holds. A text's score is the sum of the
rows of its n-grams, a sparse product done for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import is_training, rough_sample

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted on, about: a bounded sample. All of them if there are fewer.
FIT_ROWS = 20_000
#: Languages that the model may have; a table with more is refused, as the matrix is broadcast.
MAX_LANGUAGES = 500
#: Code points scored at once.
SLICE = 1 << 19
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def buckets_of(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each code point but the last order - 1."""
    h = np.full(max(0, len(points) - order + 1), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ points[k : len(h) + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(17)) % np.uint32(BUCKETS)


def slices(points: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Parts of a text that together hold each n-gram once."""
    for at in range(0, max(1, len(points)), SLICE):
        yield points[at : at + SLICE + order - 1]


def counts_of(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    points = code_points(text)
    for order in ORDERS:
        for part in slices(points, order):
            total += np.bincount(buckets_of(part, order), minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # BUCKETS x languages, float32


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.1) -> Model:
    """Counts n-grams of each language in labelled; rows with a null text or language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                total[lang] = total.get(lang, 0) + counts_of(text.as_py())
                rows[lang] = rows.get(lang, 0) + 1
                if len(total) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(n[used], rows[lang]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = labelled.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    grid = np.zeros((BUCKETS + 1, len(languages)))
    column = {x: i for i, x in enumerate(languages)}
    grid[found.column("bucket").to_numpy(), [column[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    prior, grid = grid[-1] + 1, grid[:-1] + smoothing
    return Model(languages, np.log(prior / prior.sum()), np.log(grid / grid.sum(axis=0)).astype(np.float32))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Log posterior, but for a constant, of each text and language."""
    total = np.tile(model.log_prior, (len(texts), 1))
    points = [code_points(t) for t in texts]
    for order in ORDERS:
        at = 0
        while at < len(points):
            to, size = at + 1, len(points[at])
            while to < len(points) and size + len(points[to]) <= SLICE:
                size += len(points[to])
                to += 1
            for part in slices(points[at], order) if to == at + 1 else [None]:
                group = [part] if part is not None else points[at:to]
                bucket = np.concatenate([buckets_of(p, order) for p in group])
                length = np.array([max(0, len(p) - order + 1) for p in group])
                some = np.flatnonzero(length)
                if len(some):
                    begin = (np.cumsum(length) - length)[some]
                    total[at + some] += np.add.reduceat(model.log_prob[bucket], begin, axis=0, dtype=np.float64)
            at = to
    return total


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row; the score is the posterior of lang_pred.

    A text that is null or has no letter, and any text if the model knows no language, is `und` with score 0. Equal
    posteriors go to the first language in order of its name.
    """
    image = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = image.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            good = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(good), 256):
                rows = good[at : at + 256]
                log = score_texts(model, [texts[i] for i in rows])
                best = log.argmax(axis=1)
                share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, s in zip(rows, best.tolist(), share, strict=True):
                    lang[i], score[i] = model.languages[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, lang_pred string, score double")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fit_on_training_rows(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    return fit(rough_sample(docs.where(is_training()).where("lang is not null"), ["doc_id", "text"], rows, "langid"))
