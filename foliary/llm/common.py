"""What the training-data operators share: tables, the shared work folder and grouped Arrow streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, whose executors are threads of the driver, may do without it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="foliary-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Workspace:
    """Tables of one query run in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *marks: Column) -> DataFrame:
        """df as written; its attribute marks has the values of the aggregates marks, by name, made as the rows pass.

        Of a table with a column n, total and most are its sum and largest value. Tasks that run twice may count twice,
        so marks guide how a table is joined, and nothing that is returned.
        """
        path = f"{self.root}/{name}"
        if "n" in df.columns:
            marks += F.sum("n").alias("total"), F.max("n").alias("most")
        seen = Observation()
        (df.observe(seen, *marks) if marks else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.marks = seen.get if marks else {}
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


#: A key that more than one row in HEAVY has is joined by broadcast: there are fewer than HEAVY such keys in any table.
HEAVY = 1000
#: Bits of a sieve: it is broadcast as 2^19 rows of two numbers at most, some 30 MB, whatever the tables hold.
SIEVE_BITS = 1 << 25


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table on keys, without a task that gets all rows of a frequent key.

    table is written, has one row for each key, and in column n how many of rows have the key; n is left out of the
    result. Keys with more than one row in HEAVY, fewer than HEAVY as their numbers add up to that of all rows, are
    broadcast; the others meet in a shuffle.
    """
    marks = getattr(table, "marks", None) or table.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    total, most = marks["total"] or 0, marks["most"] or 0
    if most * HEAVY <= total:
        return rows.join(table.drop("n"), keys, how)
    often = F.col("n") > total / HEAVY
    heavy, light = F.broadcast(table.where(often).drop("n")), table.where(~often).drop("n")
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return rows.join(heavy, keys).unionByName(rest)


def sieve(table: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of table as (_word, _bits): a bit array of fixed size, made and read without any Python."""
    place = F.pmod(F.xxhash64(F.lit("sieve"), *keys), F.lit(SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return table.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def sift(rows: DataFrame, bits: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a column _maybe: false where the keys are surely not in the table that bits (a written sieve) is of.

    What the sieve lets through in vain is a share of some table rows / SIEVE_BITS: it spares a shuffle of the others, and
    all that depends on the rows is found by the join that follows.
    """
    place = F.pmod(F.xxhash64(F.lit("sieve"), *keys), F.lit(SIEVE_BITS))
    met = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(bits), "_word", "left")
    set_ = F.call_function("getbit", F.coalesce("_bits", F.lit(0).cast("long")), F.col("_place").bitwiseAND(F.lit(63)).cast("int")) == 1
    return met.withColumn("_maybe", set_).drop("_place", "_word", "_bits")


def fetch(rows: DataFrame, table: DataFrame, keys: list[str], work: Workspace, tag: str) -> DataFrame:
    """rows joined with table on keys (see join_heavy), where few of rows are expected to have a key of table."""
    bits = work.write(sieve(table, keys), f"{tag}-sieve")
    return join_heavy(sift(rows, bits, keys).where("_maybe").drop("_maybe"), table, keys)


def without(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, work: Workspace) -> DataFrame:
    """docs without the rows whose keys (expressions by name) are in gone, a written table of these names; nulls stay.

    All columns stay, whatever their names. Only rows that a sieve doesn't clear are shuffled.
    """
    # As one column, so that no name of docs can clash.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[e.alias(k) for k, e in keys.items()])
    sifted = sift(rows, work.write(sieve(gone, list(keys)), "gone-sieve"), list(keys))
    left = sifted.where("_maybe").join(gone.select(*keys), list(keys), "left_anti")
    return sifted.where("not _maybe").select("row.*").unionByName(left.select("row.*"))


def small_enough(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it holds max_rows rows at most, else as it is.

    df must be cheap to count: a written table. The rows it is used with must be of bounded width.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def is_training(doc_id: str = "doc_id"):
    """True for rows whose labels may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rough_sample(df: DataFrame, keys: list[str], rows: int, salt: str) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of keys: all of df if it has no more than that.

    Rows that are equal in keys come or stay away together, so with many of them there may be more rows or fewer: a
    caller that collects the sample limits it. df is read twice, the first time without the columns it can do without.
    """
    n = df.count()
    if n <= rows:
        return df
    cut = int((1 << 30) * rows / n)
    return df.where(F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 30)) < cut)


def text_groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Consecutive texts of about `size` characters together, a longer one alone."""
    group: list[str | None] = []
    total = 0
    for x in texts:
        text = x.as_py()
        group.append(text)
        total += len(text or "")
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20000) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream sorted by keys, each of about `rows` rows or one group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = group_starts(table, keys)[-1]
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def label_components(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's smallest reachable row."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = i
        edge = np.array([i])
        while len(edge):
            reach = linked[edge].any(axis=0) & (label < 0)
            edge = np.flatnonzero(reach)
            label[edge] = i
    return label


def deal_tiles(df: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Adds tile_i and tile_j: every two rows of a group meet in exactly one tile, or in their own block's.

    A group of `size` rows is dealt by a hash of `member` into blocks of about `block` rows; a tile holds one block
    (tile_i = tile_j) or two, so no task needs more than two blocks however large the group is. Each row is repeated
    once for each block of its group.
    """
    blocks = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    return (
        df.withColumn("_n", blocks)
        .withColumn("_own", F.pmod(F.xxhash64(F.lit("tile"), F.col(member)), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("tile_i", F.least("_own", "_other"))
        .withColumn("tile_j", F.greatest("_own", "_other"))
        .withColumn("tile_side", (F.col("_own") != F.col("tile_i")).cast("int"))
        .drop("_n", "_own", "_other")
    )
