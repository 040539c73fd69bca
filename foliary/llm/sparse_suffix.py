"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes of a text only those are kept that begin at a minimiser: every window of LENGTH words owns the leftmost
of its least hashed runs of RUN words. Equal windows own equal runs at equal places, so a passage of LENGTH words that
occurs twice has a kept suffix in both. Suffixes whose run occurs in one document only are dropped. The others are
brought together by run and sorted; each is compared with its neighbours, at every distance within its run's group, and
the matches are extended to the right and to the left. The windows of LENGTH words that both sides give are repeated.

A run with more than GROUP suffixes (a passage that very many documents share) isn't gathered: the windows that its
suffixes own are hashed, and hashes of two documents are found by partial aggregation. Both ways are exact but for
chance equalities of 32-bit word hashes next to a match and of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Workspace, complete_groups, group_starts, join_heavy

#: Words of a window, and of a run.
LENGTH, RUN = 50, 8
#: Suffixes of a run that are compared with each other.
GROUP = 64
#: Words whose hash a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode(), 7)
        if len(word) <= LONGEST:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        words = (text or "").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of_runs(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of `size` words."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    word = mix(words)
    for k in range(size):
        total = total * BASE + word[k : k + n]
    return mix(total)


def owners(runs: np.ndarray, length: int) -> np.ndarray:
    """For each window of length - RUN + 1 runs, the place of its least run, the leftmost of equal ones."""
    width = length - RUN + 1
    value, place, have = runs, np.arange(len(runs)), 1

    def join(step: int) -> tuple[np.ndarray, np.ndarray]:
        left = value[: len(value) - step] <= value[step:]
        return np.where(left, value[: len(value) - step], value[step:]), np.where(left, place[: len(place) - step], place[step:])

    while 2 * have <= width:
        value, place = join(have)
        have *= 2
    if width > have:
        value, place = join(width - have)
    return place


def owned(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the run, place, first and last window that owns it) of each kept suffix."""
    if len(words) < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    runs = hashes_of_runs(words, RUN)
    owner = owners(runs, length)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(first[1:], len(owner)) - 1
    return runs[owner[first]], owner[first], first, last


ANCHORS = "run long, doc long, text_hash long, place int"
SUFFIXES = "run long, doc long, place int, low int, high int, before binary, after binary"


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc, text_hash, text) to a row for each kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h, place, _, _ = owned(known.of(text.as_py()), length)
                out.append((h.view(np.int64), np.full(len(h), doc), np.full(len(h), text_hash), place.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["run", "doc", "text_hash", "place"])

    return docs.mapInArrow(run, ANCHORS)


def fetch_suffixes(length: int):
    """Of (doc, text, found array of (place, run, n)): the suffixes of smaller runs, and the windows of larger ones.

    A window's row has its hash as run, its first word as place, and -1 as low.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["run", "doc", "place", "low", "high", "before", "after"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words, found = known.of(text.as_py()), found.as_py()
                _, place, low, high = owned(words, length)
                at = {p: k for k, p in enumerate(place.tolist())}
                short = (mix(words) >> np.uint64(32)).astype(">u4")
                hashes = hashes_of_runs(words, length).view(np.int64) if any(x["n"] > GROUP for x in found) else None
                for one in found:
                    k = at[one["place"]]
                    p, lo, hi = int(place[k]), int(low[k]), int(high[k])
                    if one["n"] <= GROUP:
                        rows.append((one["run"], doc, p, lo, hi, short[lo:p][::-1].tobytes(), short[p : hi + length].tobytes()))
                    else:
                        rows += [(h, doc, lo + i, -1, -1, None, None) for i, h in enumerate(hashes[lo : hi + 1].tolist())]
                if len(rows) > 20000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return run


def padded(column: pa.ChunkedArray, width: int, fill: int) -> np.ndarray:
    """A row of `width` word hashes for each value; what is missing gets values that equal nothing."""
    values = column.to_pylist()
    data = b"".join(v[: 4 * width].ljust(4 * width, b"\0") for v in values)
    grid = np.frombuffer(data, ">u4").reshape(len(values), width).astype(np.int64)
    size = np.array([len(v) // 4 for v in values])
    missing = np.arange(width) >= size[:, None]
    return np.where(missing, -(fill + 2 * np.arange(len(values)))[:, None], grid)


def compare_neighbours(length: int):
    """Sorted suffixes, in groups of a run, to the repeated words around each: (doc, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, ["run"], rows=8000):
            starts = group_starts(table, ["run"])
            size = np.diff(np.append(starts, table.num_rows))
            group = np.repeat(np.arange(len(starts)), size)
            doc, place, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "place", "low", "high"))
            after, before = padded(table.column("after"), length, 1), padded(table.column("before"), length - RUN, 2)
            start, end = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
            for d in range(1, int(size.max(initial=0))):
                i = np.flatnonzero((group[:-d] == group[d:]) & (doc[:-d] != doc[d:]))
                if not len(i):
                    continue
                j = i + d
                right = np.logical_and.accumulate(after[i] == after[j], axis=1).sum(axis=1)
                left = np.logical_and.accumulate(before[i] == before[j], axis=1).sum(axis=1)
                long = left + right >= length
                for at in (i[long], j[long]):
                    # A row occurs once in i and once in j.
                    start[at] = np.minimum(start[at], np.maximum(place[at] - left[long], low[at]))
                    end[at] = np.maximum(end[at], np.minimum(place[at] + right[long], high[at] + length))
            some = end - start >= length
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[some]), pa.array(start[some].astype(np.int32)), pa.array(end[some].astype(np.int32))], names=["doc", "start", "end"]
            )

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of struct(start int, end int), n_words long) for each document that has any.

    spans are of words, as white space parts them, end exclusive: the union of all runs of `length` words that another
    document holds too. Words are compared as they are written. Repeats within one document alone don't count, so rows
    of one id never repeat each other. Null and short texts and rows with a null id have no spans; very long texts are read
    whole; other columns are not read; an empty table gives no rows.
    """
    if length < 2 * RUN:
        raise ValueError(f"length must be at least {2 * RUN}")
    work = Workspace(docs.sparkSession, "suffix")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = texts.where("doc is not null and text is not null")
    anchors = work.write(find_anchors(texts, length), "anchors")
    runs = anchors.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    runs = work.write(runs.where("a <> b").select("run", "n"), "runs")
    sized = runs.withColumn("size", F.col("n"))
    sized.marks = runs.marks
    kept = join_heavy(anchors, sized, ["run"]).withColumnRenamed("size", "n")
    kept = kept.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("place", "run", "n")).alias("found"))
    kept = work.write(kept, "kept")
    work.drop("anchors")
    # Texts with a kept suffix; a text meets its own suffixes alone.
    with_text = texts.join(kept, ["doc", "text_hash"]).select("doc", "text", "found")
    met = work.write(with_text.mapInArrow(fetch_suffixes(length), SUFFIXES), "met")
    order = ["run", "after", "doc", "place"]
    suffixes = met.where("low >= 0").repartition("run").sortWithinPartitions(*order)
    near = suffixes.mapInArrow(compare_neighbours(length), "doc long, start int, end int")
    windows = met.where("low < 0").select(F.col("run").alias("window"), "doc", F.col("place").alias("start"))
    shared = windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    common = join_heavy(windows, work.write(shared.select("window", "n"), "windows"), ["window"]).select("doc", "start", (F.col("start") + length).alias("end"))
    spans = near.unionByName(common).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            merged = [merge_spans([(x["start"], x["end"]) for x in row]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[{"start": s, "end": e} for s, e in m] for m in merged], kind),
                    pa.array([sum(e - s for s, e in m) for m in merged], pa.int64()),
                ],
                names=["doc_id", "spans", "n_words"],
            )

    return spans.mapInArrow(unite, "doc_id long, spans array<struct<start:int,end:int>>, n_words long")
