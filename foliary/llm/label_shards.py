"""Sharding by balanced label propagation.

Documents start in shards by a hash of their id, then move for some rounds: each looks which shard holds most of the
documents it is linked with and asks to go there. Requests are counted by pair of shards, a table of shards x shards;
quotas follow that keep every shard within its capacity, and a request is granted by a hash that all documents of a
link and shard share, so they move together (after Ugander and Backstrom, 2013). At last the few rows beyond a shard's
exact share are moved, those without links first, so that the numbers of rows differ by one at most.

Places within shards come from a range partitioning by (shard, linked, link, id) and the row counts of its partitions:
no window or task holds a whole shard, and a link with a third of all rows is spread like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Workspace, fetch, join_heavy

GRAIN = 1 << 20


def quotas(wish: np.ndarray, now: np.ndarray, capacity: float | np.ndarray) -> np.ndarray:
    """The share of the requests wish[from, to] that is granted, by target: rooms are filled, and what leaves makes room.

    A shard's room counts only departures that are granted themselves, so the shares are lowered until all hold.
    """
    share = np.ones(len(now))
    arriving = wish.sum(axis=0)
    for _ in range(50):
        leaving = (wish * share[None, :]).sum(axis=1)
        room = np.maximum(0, capacity - now + leaving)
        new = np.minimum(share, np.where(arriving > 0, room / np.maximum(arriving, 1), 1))
        if np.allclose(new, share):
            break
        share = new
    return np.clip(share, 0, 1)


def propagate(rows: DataFrame, shards: int, capacity: float | np.ndarray, work: Workspace, rounds: int) -> DataFrame:
    """rows (id, link, shard) of linked documents, with shard after some rounds; the table is written each round.

    capacity: linked rows that a shard, or each of them, may hold. Rows without links make way. It goes on until no request is made or granted, and for `rounds` rounds at most.
    """
    now = rows
    for step in range(rounds):
        # Of a link with rows in many shards, the shard with most; ties go to a shard by hash.
        held = now.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        rank = F.struct("n", F.xxhash64("link", "shard"), "shard")
        best = held.groupBy("link").agg(F.max(rank).alias("best")).select("link", F.col("best.shard").alias("target"))
        # A link has a row in held for each shard at most.
        moves = work.write(held.join(best, "link"), f"moves-{step}")
        counts = moves.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()
        wish = np.zeros((shards, shards))
        for r in counts:
            wish[r["shard"], r["target"]] = r["n"]
        here = wish.sum(axis=1)
        np.fill_diagonal(wish, 0)
        if not wish.any():
            break
        share = quotas(wish, here, capacity)
        cut = F.element_at(F.array(*[F.lit(int(s * GRAIN)) for s in share]), F.col("target") + 1)
        granted = F.pmod(F.xxhash64(F.lit(step), "link"), F.lit(GRAIN)) < cut
        going = work.write(moves.where(F.col("shard") != F.col("target")).where(granted).select("link", "shard", "target", "n"), f"going-{step}")
        stuck = going.isEmpty()
        moved = join_heavy(now, going, ["link", "shard"], "left").select("id", "link", F.coalesce("target", "shard").alias("shard"))
        now = work.write(moved, f"round-{step}") if not stuck else now
        work.drop(f"moves-{step}", f"going-{step}", *[f"round-{step - 1}"] * (not stuck))
        if stuck:
            break
    return now


def ranked(rows: DataFrame, shards: int, work: Workspace) -> tuple[DataFrame, list[int]]:
    """rows with rank, gapless from 0 within each shard, by (linked first, link, id); and the rows of each shard."""
    order = ["shard", F.col("link").isNull(), "link", "id", "tie"]
    names = [f.name for f in rows.schema.fields]
    at = names.index("shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column(at).to_numpy()
            local = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                of = np.flatnonzero(shard == s)
                local[of] = seen[s] + np.arange(len(of))
                seen[s] += len(of)
            extra = [pa.array(np.full(len(shard), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "part", "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part int, local long"
    dealt = work.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranked")
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("shard", "part").collect()
    before, total, known = [], [0] * shards, {}
    for r in counts:
        known[(r["shard"], r["part"])] = total[r["shard"]]
        total[r["shard"]] += r["n"]
    # One number for each partition that a shard touches: partitions + shards at most.
    before = work.spark.createDataFrame([(s, p, n) for (s, p), n in known.items()] or [(-1, -1, 0)], "shard int, part int, before long")
    placed = dealt.join(F.broadcast(before), ["shard", "part"]).withColumn("rank", F.col("local") + F.col("before"))
    return placed.drop("part", "local", "before"), total


def settle(placed: DataFrame, total: list[int]) -> DataFrame:
    """placed with shard and slot: rows beyond a shard's share fill, in order, what others lack."""
    n, shards = sum(total), len(total)
    # The n % shards shards that hold most get the larger shares.
    largest = sorted(range(shards), key=lambda s: (-total[s], s))
    share = [0] * shards
    for k, s in enumerate(largest):
        share[s] = n // shards + (k < n % shards)
    excess = [max(0, t - c) for t, c in zip(total, share, strict=True)]
    offset = np.cumsum([0, *excess])[:-1].tolist()
    goal = F.lit(None).cast("int")
    slot = F.lit(None).cast("long")
    start = 0
    index = F.col("rank") - F.element_at(F.array(*map(F.lit, share)), F.col("shard") + 1) + F.element_at(F.array(*map(F.lit, offset)), F.col("shard") + 1)
    for s in range(shards):
        lack = max(0, share[s] - total[s])
        if lack:
            inside = (F.col("_i") >= start) & (F.col("_i") < start + lack)
            goal = F.when(inside, F.lit(s)).otherwise(goal)
            slot = F.when(inside, F.col("_i") - start + total[s]).otherwise(slot)
            start += lack
    moved = F.col("_i") >= F.lit(0)
    beyond = F.col("rank") >= F.element_at(F.array(*map(F.lit, share)), F.col("shard") + 1)
    return (
        placed.withColumn("_i", F.when(beyond, index))
        .withColumn("slot", F.when(moved, slot).otherwise(F.col("rank")))
        .withColumn("shard", F.when(moved, goal).otherwise(F.col("shard")))
        .drop("_i", "rank")
    )


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot) for each row: equal texts together where room allows, row counts one apart at most.

    size is the text's UTF-8 bytes plus one, crc its CRC-32; a null text has the size 1 and the crc of nothing, and null
    texts are linked with each other, not with empty ones. Slots are gapless from 0 in each shard. Rows with equal ids
    and texts are told apart by nothing, so any of them may have either place. A text with more rows than a shard has
    fills as many shards as it needs. Very long texts count by their size like any other; other columns, whatever their names, are
    not read. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "shards")
    text = F.col(text_col).cast("string")
    # 128 bits and the length tell texts apart; a chance equality would only link two more documents.
    link = F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text, F.length(text))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.concat_ws("-", F.hex(link[0]), F.hex(link[1])).alias("link"),
    )
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id", "link"), F.lit(shards)).cast("int"))
    rows = work.write(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    shared = work.write(rows.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    share = rows.count() / shards
    linked = work.write(fetch(rows, shared, ["link"], work, "linked").select("tie", "link", "shard"), "linked")
    # Texts that no shard can hold whole, fewer than shards of them, fill some shards and don't compete for room.
    spot, taken = F.lit(None).cast("int"), np.zeros(shards)
    large = shared.where(F.col("n") > share).orderBy(F.desc("n"), "link").collect()
    for r in large:
        home = np.argsort(taken, kind="stable")[: int(np.ceil(r["n"] / share))]
        taken[home] += r["n"] / len(home)
        dealt = F.pmod(F.xxhash64(F.lit("large"), "tie"), F.lit(len(home))).cast("int")
        spot = F.when(F.col("link") == r["link"], F.get(F.array(*map(F.lit, home.tolist())), dealt).cast("int")).otherwise(spot)
    placed = linked.withColumn("spot", spot)
    going = placed.where("spot is null").select(F.col("tie").alias("id"), "link", "shard")
    moved = propagate(going, shards, np.maximum(0, share - taken), work, rounds)
    moved = moved.unionByName(placed.where("spot is not null").select(F.col("tie").alias("id"), "link", F.col("spot").alias("shard")))
    moved = moved.select(F.col("id").alias("tie"), F.col("link").alias("of"), F.col("shard").alias("to"))
    joined = rows.drop("link").join(moved, "tie", "left").withColumn("shard", F.coalesce("to", "shard")).withColumnRenamed("of", "link").drop("to")
    placed, total = ranked(joined.select("id", "size", "crc", "link", "shard", "tie"), shards, work)
    return settle(placed, total).select("id", "size", "crc", "shard", "slot")
