"""Token counts as additive totals that signed deltas maintain.

A delta row adds (sign 1) or takes away (sign -1) one document's tokens under one tokenizer version; a revised count is
the old row taken away and the new one added. A batch is summed up by source, language and tokenizer version, which
partial aggregation does before its only shuffle, and committed under its id by one rename, which HDFS and local disks
do at once (an object store does not; give it a folder on one that does): a batch that was committed
before, by this run or one that was thought lost, has no effect. Totals are the sums over committed batches, so they
never need the documents again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import Workspace, join_heavy

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
DELTA = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"


class DeltaStore:
    """Committed batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/batches"))

    def batches(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/batches")))

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Adds a batch of delta rows (DELTA); False if its id was committed before. Rows without a count or sign are refused."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError("a batch id has letters, digits, points and hyphens")
        target = self._path(f"{self.root}/batches/{batch}")
        if self._fs.exists(target):
            return False
        signed = F.when(F.col("sign").isin(-1, 1) & F.col("n_tokens").isNotNull(), F.col("sign")).otherwise(F.raise_error(F.lit("a delta row needs n_tokens, and 1 or -1 as its sign")))
        sums = delta.groupBy(*KEYS).agg(F.sum(signed.cast("long")).alias("n_docs"), F.sum(signed * F.col("n_tokens")).alias("n_tokens"))
        attempt = f"{self.root}/attempts/{uuid.uuid4().hex}"
        # As many rows as there are keys.
        sums.coalesce(1).write.parquet(attempt)
        try:
            # To be safe against a second committer of the same batch: a folder isn't renamed into one that exists.
            if self._fs.exists(target) or not self._fs.rename(self._path(attempt), target):
                return False
            inner = self._path(f"{self.root}/batches/{batch}/{attempt.rpartition('/')[2]}")
            if self._fs.exists(inner):
                self._fs.delete(inner, True)
                return False
        finally:
            self._fs.delete(self._path(attempt), True)
        return True

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches, or of some; keys that came to nothing are left out."""
        paths = [f"{self.root}/batches/{b}" for b in self.batches() if batches is None or b in batches]
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def rollup(self, batches: list[str] | None = None) -> DataFrame:
        """Totals by (tokenizer, lang, source), (tokenizer, lang) and (tokenizer); level counts the keys that are summed over."""
        by = self.totals(batches).groupingSets([["tokenizer", "lang", "source"], ["tokenizer", "lang"], ["tokenizer"]], "tokenizer", "lang", "source")
        level = (F.grouping("source") + F.grouping("lang")).cast("int").alias("level")
        return by.agg(level, F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """counts (doc_id, source, lang, tokenizer, n_tokens) as rows to add."""
    return counts.select("doc_id", *KEYS, "n_tokens", F.lit(1).alias("sign"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", *KEYS, "n_tokens", F.lit(-1).alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old rows taken away and the new ones added."""
    return deletes(old).unionByName(inserts(new))


def measure(docs: DataFrame, counters: Callable[[], dict[str, Callable[[str], int]]], names: list[str]) -> DataFrame:
    """docs (doc_id, source, lang, text) with a column of counts for each counter in place of the text.

    counters is called once for each task and makes the functions there. A null text counts as an empty one; very long
    ones are counted whole. Two hashes of the text, text_a and text_b, tell equal texts; null texts are equal to each other
    alone. Repeated rows give repeated rows, an empty table none; other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counters()
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            columns = [pa.array([made[n](t) for t in texts], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "source", "lang", "text_a", "text_b")] + columns, names=["doc_id", "source", "lang", "text_a", "text_b", *names]
            )

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"),
        F.xxhash64(F.lit(1), text).alias("text_a"), F.xxhash64(F.lit(2), text, F.length(text)).alias("text_b"),
    )
    schema = "doc_id long, source string, lang string, text_a long, text_b long, " + ", ".join(f"{n} long" for n in names)
    return rows.mapInArrow(run, schema)


def later_copies(counts: DataFrame, work: Workspace) -> DataFrame:
    """The rows of counts, a written table, whose text an earlier document, by id, has; a null id is never a copy.

    Of rows with one id and text none is a copy of another. Null texts are copies of each other, not of empty ones. Only
    texts that several rows have are joined, and of these a very frequent one by broadcast. Other columns stay.
    """
    groups = counts.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = work.write(groups, "texts")
    return join_heavy(counts, groups, ["text_a", "text_b"]).where("doc_id > first").drop("first")
