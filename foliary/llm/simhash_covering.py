"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 positions are given vectors of radius+1 bits. For each nonzero vector v there is a table whose mask
keeps the positions with an odd inner product with v. Two fingerprints that differ in `radius` positions at most give
at most `radius` vectors, to which some v is orthogonal: in v's table the masked fingerprints are equal. So no pair
within the radius is missed, whatever the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Workspace, complete_groups, deal_tiles, fetch, group_starts, join_heavy, label_components, without
from foliary.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Rows of a block when a bucket is too large for one task.
BLOCK = 512
#: Shingles hashed at once, so that a very long text takes bounded memory.
SLICE = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than space and \\t to \\r, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(LOWER).split() if text else []


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words joined by spaces, of the whole sequence if there are fewer, in slices."""
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    first = starts[: len(last)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), SLICE):
        yield np.array(
            [digest(joined[s:e], SEED) for s, e in zip(first[at : at + SLICE].tolist(), last[at : at + SLICE].tolist(), strict=True)],
            dtype=np.uint64,
        )


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The 64 bits that are set in more than half of all hashes, signed; 0 for none."""
    total = np.zeros(64, np.int64)
    n = 0
    for h in hashes:
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row; a null text is an empty one, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(words_of(x.as_py()), width)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs; every nonzero vector is dealt to about as many positions."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    dealt = np.concatenate([rng.permutation(np.arange(1, size)) for _ in range(64 // (size - 1) + 1)])[:64]
    vector = rng.permutation(dealt).astype(np.uint64)
    masks = []
    for v in range(1, size):
        odd = np.bitwise_count(vector & np.uint64(v)) & 1
        masks.append(int(np.packbits(odd.astype(bool), bitorder="little").view("<i8")[0]))
    return masks


def _bucket_stars(radius: int, block: int):
    """Of each tile of a bucket: edges to the least of each component of its pairs within the radius; bucket if it has several tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "tile_i", "tile_j"]
        for table in complete_groups(batches, keys):
            fp, size, bucket = (table.column(c).to_numpy() for c in ("fp", "size", "bucket"))
            starts = group_starts(table, keys)
            a, b, of = [], [], []
            for s, e in zip(starts, [*starts[1:], len(fp)], strict=True):
                part = np.sort(fp[s:e])
                bits = part.view(np.uint64)
                near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
                root = label_components(near)
                moved = np.flatnonzero(root != np.arange(len(part)))
                a.append(part[moved])
                b.append(part[root[moved]])
                of += [int(bucket[s]) if size[s] > block else None] * len(moved)
            edges = [pa.array(np.concatenate(x), pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*edges, pa.array(of, pa.int64())], names=["a", "b", "bucket"])

    return run


def near_edges(prints: DataFrame, radius: int, work: Workspace, tag: str = "cover") -> DataFrame:
    """Edges (a, b) of fingerprints whose components are those of all pairs within the radius.

    prints: distinct values in column fp, and a column seed if there are fingerprints of several kinds, which are only
    compared with their own kind. A bucket of two is compared as it is summed up, without its rows being
    brought together; of larger ones the rows are fetched, in tiles if a bucket is very large. b is the least fingerprint
    of a's component in a bucket; where a bucket has several tiles, in one of them, and the column bucket, else null, tells
    which it is.
    """
    kind = [F.col("seed")] if "seed" in prints.columns else []
    cells = F.array(*[F.xxhash64(F.lit(i), *kind, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(covering_masks(radius))])
    dealt = prints.select("fp", F.explode(cells).alias("bucket"))
    buckets = (
        dealt.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1")
    )
    buckets = work.write(buckets, f"{tag}-buckets")
    twos = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    twos = twos.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(None).cast("long").alias("bucket"))
    large = buckets.where("n > 2").select("bucket", "n", F.col("n").alias("size"))
    more = deal_tiles(fetch(dealt, large, ["bucket"], work, tag), "bucket", "size", "fp", BLOCK)
    keys = ["bucket", "tile_i", "tile_j"]
    met = (
        more.select(*keys, "size", "fp").repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_bucket_stars(radius, BLOCK), "a long, b long, bucket long")
    )
    return work.write(twos.unionByName(met), tag, F.count("bucket").alias("tiled"))


def near_names(near: DataFrame, work: Workspace) -> DataFrame:
    """(fp, names) of near_edges: fingerprints within the radius share a name, and each has one name a bucket at most.

    The name is the least fingerprint of a component in a bucket, which in most buckets of a group is the same.
    """
    ends = lambda df, *more: df.select(F.explode(F.array(*[F.struct(F.col(c).alias("fp"), F.col("b").alias("name"), *more) for c in "ab"])).alias("e")).select("e.*")
    names = ends(near.where("bucket is null"))
    if near.marks["tiled"]:
        # What the tiles of a bucket have linked is one component there; should two nodes be equal, it is larger.
        tiled = near.where("bucket is not null")
        node = lambda c: F.xxhash64("bucket", c)
        found = connected_components(tiled.select(node("a").alias("a"), node("b").alias("b")), work, "tiled")
        members = ends(tiled, F.col("bucket")).select("fp", node("fp").alias("node")).distinct().join(found, "node")
        members = work.write(members.select("fp", "component"), "tiled-members")
        least = work.write(members.groupBy("component").agg(F.min("fp").alias("name"), F.count(F.lit(1)).alias("n")), "tiled-names")
        names = names.unionByName(join_heavy(members, least, ["component"]).select("fp", "name"))
    return names.groupBy("fp").agg(F.collect_set("name").alias("names"))


def group_prints(prints: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """(id, fp, component) for each row of prints (id, fp): the smallest id reachable over links within the radius.

    Equal fingerprints are one class, so a large group of copies counts once. Rows with a null id get a null
    component of their own and link nothing.
    """
    classes = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = work.write(classes, "classes")
    found = connected_components(near_edges(classes.select("fp"), radius, work), work)
    linked = found.join(classes, found["node"] == classes["fp"]).select("fp", "component", "least")
    linked = work.write(linked, "linked")
    roots = work.write(linked.groupBy("component").agg(F.min("least").alias("root"), F.count(F.lit(1)).alias("n")), "roots")
    named = join_heavy(linked, roots, ["component"]).select("fp", "root")
    named = work.write(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "least").alias("root")), "named")
    joined = join_heavy(prints, named, ["fp"], "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("root")).alias("component"))


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for each row of docs; other columns, whatever their names, are not read.

    Null and empty texts have the fingerprint 0 and link like any other. Repeated ids give repeated rows. Very long texts
    are hashed whole, in slices. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.write(fingerprints(docs, width, id_col, text_col), "prints")
    return group_prints(prints, radius, work)


#: Seeds of the word fingerprints, the first source of candidates. Words change less than shingles do: where few words in
#: a hundred, scattered over the text, differ, word fingerprints are mostly within the radius; where a block was added, cut or
#: replaced, often not. The weight is the root of a word's number: with the number itself, long texts of one language, which
#: share its most frequent words, would all be candidates.
WORD_SEEDS = (11, 12)
#: MinHash bands, the second source of candidates, and rows of a band. The chance that two texts share a band follows from
#: the likeness s of their shingle sets alone, 1 - (1 - s^8)^40: 0.9993 at 0.8, 0.9999993 at 0.85; wherever the texts differ.
BANDS, BAND_ROWS = 40, 8
#: Shingles whose values under all functions are held at once.
HASHED = 1024
#: Documents of a block when all pairs of a group are checked; copies that are checked against one document at once.
CHECKED, LEAVES = 256, 256


def word_fingerprint(counts: dict[bytes, int], seed: int) -> int:
    """SimHash of words weighted by the root of their number, signed."""
    if not counts:
        return 0
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in counts], "<u8")
    n = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    total = np.zeros(64)
    for at in range(0, len(h), SLICE):
        bits = np.unpackbits(h[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += n[at : at + SLICE] @ bits
    return int(np.packbits(2 * total > n.sum(), bitorder="little").view("<i8")[0])


_random = np.random.default_rng(3)
_flip, _times = (_random.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) for _ in range(2))
_times |= np.uint32(1)
_fold = _random.integers(0, 1 << 63, (BAND_ROWS, BANDS), np.uint64) | np.uint64(1)


def band_keys(hashes: Iterator[np.ndarray]) -> np.ndarray:
    """A key, signed, for each of BANDS bands of the set's least values under BAND_ROWS functions each; none has all keys alike."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for h in hashes:
        high = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), HASHED):
            values = high[at : at + HASHED, None] ^ _flip
            values *= _times
            np.minimum(least, values.min(axis=0), out=least)
    # Each band's multipliers are its own, so keys of different bands meet by chance alone.
    key = (least.reshape(BAND_ROWS, BANDS).astype(np.uint64) + np.uint64(1)) * _fold
    key = np.bitwise_xor.reduce(key ^ (key >> np.uint64(29)), axis=0) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def alike(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """For sets of sorted distinct numbers: is intersection / union at least share; empty sets are alike."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_inverse=True, return_counts=True)
    common = times[column] > 1
    row, column = row[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    shared = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        s, e = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[s:e], column[s:e] - at] = 1
        shared += part @ part.T
    union = size[:, None] + size[None, :] - shared
    return share[1] * shared >= share[0] * union


def resembles(one: np.ndarray, others: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """For a set of sorted distinct numbers and others: is intersection / union at least share; empty sets are alike."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate([*others, np.zeros(0, np.uint32)])
    met = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat if len(one) else np.zeros(len(flat), bool)
    total = np.concatenate([[0], np.cumsum(met)])
    end = np.cumsum(size)
    shared = total[end] - total[end - size]
    return share[1] * shared >= share[0] * (len(one) + size - shared)


def _sets(table: pa.Table, s: int, e: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint32) for x in table.column("shingles").slice(s, e - s)]


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def _verified_stars(share: tuple[int, int]):
    """Of cells of a centre and some leaves, with their sets: an edge for each leaf that is alike to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["centre", "cell"]
        for table in complete_groups(batches, keys, rows=LEAVES):
            ids, centre = table.column("class").to_numpy(), table.column("centre").to_numpy()
            starts = group_starts(table, keys)
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                middle = np.flatnonzero(ids[s:e] == centre[s])
                if len(middle):
                    sets = _sets(table, s, e)
                    near = ids[s:e][resembles(sets[middle[0]], sets, share)]
                    near = near[near != centre[s]]
                    a.append(np.full(len(near), centre[s]))
                    b.append(near)
            yield from _edges(a, b)

    return run


def _verified_tiles(share: tuple[int, int]):
    """Of tiles of documents with their sets: edges with the components of all pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["family", "tile_i", "tile_j"]
        for table in complete_groups(batches, keys, rows=CHECKED):
            ids = table.column("class").to_numpy()
            starts = group_starts(table, keys)
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                root = label_components(alike(_sets(table, s, e), share))
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(ids[s:e][moved])
                b.append(ids[s:e][root[moved]])
            yield from _edges(a, b)

    return run


def shared_keys(classes: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """(key, class, n), written: the keys that n classes, two or more, share; classes alike to each other share one.

    A key is that of a MinHash band, or stands for word fingerprints of one seed that are linked within the radius.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.get("prints", F.lit(i)).alias("fp")) for i, s in enumerate(WORD_SEEDS)])).alias("k")
    prints = classes.select("class", kinds).select("class", "k.seed", "k.fp")
    each = work.write(prints.groupBy("seed", "fp").agg(F.count(F.lit(1)).alias("n")), "each")
    near = near_edges(each.select("seed", "fp"), radius, work)
    # Should fingerprints of two seeds be equal, their classes share a key as well and are checked in vain.
    met = each.join(near_names(near, work), "fp", "left").where("n > 1 or names is not null")
    met = work.write(met.select("seed", "fp", "n", F.coalesce("names", F.array("fp")).alias("names")), "met")
    by_print = fetch(prints, met, ["seed", "fp"], work, "met").select("class", "seed", F.explode("names").alias("name"))
    held = by_print.select("class", F.xxhash64("seed", "name").alias("key")).distinct().unionByName(classes.select("class", F.explode("bands").alias("key")))
    keys = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    keys = work.write(keys, "keys")
    pairs = keys.where("n = 2").select("key", F.explode(F.array("a", "b")).alias("class"), F.lit(2).cast("long").alias("n"))
    large = keys.where("n > 2").select("key", "n", F.col("n").alias("size"))
    more = fetch(held, large, ["key"], work, "keys").select("key", "class", F.col("size").alias("n"))
    found = work.write(pairs.unionByName(more), "shared")
    work.drop("each", "met", "cover", "cover-buckets", "keys")
    return found


def star_links(shared: DataFrame, sets: DataFrame, share: tuple[int, int], work: Workspace) -> DataFrame:
    """Edges (a, b) of classes that are alike, of each class with one centre; written.

    shared: (key, class, n). A key's centre is its class of least hash, a class's centre the least of its keys' centres, so
    that those of a large group, which share many keys, have few centres and each is compared once.
    """
    least = shared.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit("centre"), "class").alias("h"), "class")).alias("c"), F.count(F.lit(1)).alias("n"))
    stars = join_heavy(shared.select("key", "class"), work.write(least, "centres"), ["key"])
    stars = stars.groupBy("class").agg(F.min("c")["class"].alias("centre")).where("centre <> class")
    stars = work.write(stars, "stars")
    cells = stars.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).withColumn("cells", F.ceil(F.col("n") / LEAVES).cast("int"))
    cells = work.write(cells, "cells")
    leaves = join_heavy(stars, cells, ["centre"]).select("centre", F.pmod(F.xxhash64(F.lit("cell"), "class"), "cells").cast("int").alias("cell"), "class")
    middles = cells.select("centre", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("centre").alias("class"))
    dealt = leaves.unionByName(middles).join(sets, "class").select("centre", "cell", "class", "shingles")
    dealt = dealt.repartition("centre", "cell").sortWithinPartitions("centre", "cell")
    return work.write(dealt.mapInArrow(_verified_stars(share), "a long, b long"), "star-links")


def main_parts(rows: DataFrame, group: str) -> DataFrame:
    """(group, main, n_main, n_rest): of each group's parts the one with most classes, and how many are in it and not."""
    held = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("c"))
    found = held.groupBy(group).agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("all"))
    return found.select(group, F.col("m.part").alias("main"), F.col("m.c").alias("n_main"), (F.col("all") - F.col("m.c")).alias("n_rest"))


def blocks(n: str):
    return F.ceil(F.col(n) / CHECKED).cast("long")


def tile_cost():
    """Rows of a group's tiles: classes of its main part meet the others alone, the others meet all."""
    return F.col("n_main") * blocks("n_rest") + F.col("n_rest") * (blocks("n_rest") + blocks("n_main"))


def tile_links(open_: DataFrame, sets: DataFrame, share: tuple[int, int], work: Workspace) -> DataFrame:
    """Edges with the components of all pairs of classes that are alike and share a key; open_: (key, class, part), written.

    part tells classes that are known to be in one component. The classes of a group, but for pairs of those in its main
    part, are compared in tiles. A group is a key, or all keys and classes that are linked, whichever takes fewer rows: many
    keys may have nearly the same classes, and many classes may be linked in a chain of keys. Keys with the same classes
    count once.
    """
    sign = open_.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b"),
        F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "class")).alias("y"),
    )
    keys = work.write(sign.groupBy("n", "a", "b", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "open-keys")
    rows = work.write(join_heavy(open_, keys, ["key"]), "open-rows")
    # Nodes are keys and classes; should two of these be equal, a group is larger.
    found = connected_components(rows.select(F.col("key").alias("a"), F.col("class").alias("b")), work, "families")
    family = found.withColumnRenamed("component", "family")
    families = work.write(family.join(rows.select(F.col("class").alias("node"), "part").distinct(), "node").select(F.col("node").alias("class"), "part", "family"), "families-of")
    of_keys = work.write(main_parts(rows, "key").withColumn("cost", tile_cost()), "costs-of-keys")
    by_key = of_keys.join(family.withColumnRenamed("node", "key"), "key").groupBy("family").agg(F.sum("cost").alias("by_key"))
    costs = main_parts(families, "family").join(by_key, "family").withColumn("apart", F.col("by_key") < tile_cost())
    costs = work.write(costs.withColumn("n", F.col("n_main") + F.col("n_rest")).drop("by_key"), "costs")
    placed = work.write(join_heavy(families, costs, ["family"]), "placed")
    whole = placed.where("not apart").select(F.col("family").alias("grp"), "class", "part", "main", "n_main", "n_rest")
    sizes = work.write(of_keys.withColumn("n", F.col("n_main") + F.col("n_rest")).drop("cost"), "sizes-of-keys")
    apart = join_heavy(rows.join(placed.where("apart").select("class"), "class", "left_semi"), sizes, ["key"])
    both = whole.unionByName(apart.select(F.col("key").alias("grp"), "class", "part", "main", "n_main", "n_rest"))
    # Blocks of the rest come first; those of the main part after them.
    hashed = F.xxhash64(F.lit("tile"), "class")
    rest = F.col("part") != F.col("main")
    own = F.when(rest, F.pmod(hashed, blocks("n_rest"))).otherwise(blocks("n_rest") + F.pmod(hashed, blocks("n_main")))
    last = F.when(rest, blocks("n_rest") + blocks("n_main")).otherwise(blocks("n_rest")) - 1
    # A single one in the rest has no pair in its own block.
    first = F.when(rest & (F.col("n_rest") == 1), 1).otherwise(0).cast("long")
    tiles = both.select("grp", "class", own.alias("own"), F.explode(F.sequence(first, last)).alias("other"))
    tiles = tiles.select(F.col("grp").alias("family"), F.least("own", "other").alias("tile_i"), F.greatest("own", "other").alias("tile_j"), "class")
    keys = ["family", "tile_i", "tile_j"]
    tiles = tiles.join(sets, "class").select(*keys, "class", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return work.write(tiles.mapInArrow(_verified_tiles(share), "a long, b long"), "tile-links")


def near_copy_groups(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5), radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_a, text_b, component) for each row of docs with an id: groups of texts alike in their word shingles.

    Texts that are equal are one class; classes are linked if their sets of `width`-word shingles (A-Z lower-cased, a
    shorter text's whole sequence) have at least share[0] / share[1] of their union in common. Compared are all classes
    that share a key: a word fingerprint within the radius for one of WORD_SEEDS, which covering tables find without a
    miss, or one of BANDS MinHash bands of the `width`-word shingles. Each class is first checked against one that it shares a
    key with, exactly, on 32-bit hashes of whole texts' shingles; then, of keys whose classes aren't in one component, all
    pairs but those within the largest part.
    component is the smallest id reachable; text_a and text_b tell equal texts. Null texts are equal, and alike to texts
    without words. Repeated rows give repeated rows; very long texts are hashed in slices; an empty table gives no rows;
    other columns are not read.
    """
    work = Workspace(docs.sparkSession, "copies")
    text = F.col(text_col).cast("string")
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(1), text).alias("text_a"),
        F.xxhash64(F.lit(2), text, F.length(text)).alias("text_b"), text.alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands = [], []
            for x in batch.column(3):
                words = words_of(x.as_py())
                counts = Counter(words)
                prints.append([word_fingerprint(counts, s) for s in WORD_SEEDS])
                bands.append(band_keys(shingle_hashes(words, width)))
            flat = [pa.array(np.array(v, np.int64).reshape(-1), pa.int64()) for v in (prints, bands)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * w, pa.int32()), f) for w, f in zip((len(WORD_SEEDS), BANDS), flat, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["id", "text_a", "text_b", "prints", "bands"])

    schema = "id long, text_a long, text_b long, prints array<long>, bands array<long>"
    prints = work.write(texts.mapInArrow(measure, schema), "prints")
    # Equal texts have equal prints and bands.
    classes = prints.groupBy("text_a", "text_b", "prints", "bands").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = work.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    shared = shared_keys(classes, radius, work)

    needed = shared.select("class").distinct().join(classes.select("class", "id", "text_a", "text_b", "n"), "class")
    needed = work.write(needed, "needed")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for x in batch.column(1):
                parts = [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in shingle_hashes(words_of(x.as_py()), width)]
                sets.append(np.unique(np.concatenate([*parts, np.zeros(0, np.uint32)])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "shingles"])

    fetched = fetch(texts, needed, ["id", "text_a", "text_b"], work, "needed").select("class", "text")
    # A row may be repeated in docs.
    sets = work.write(fetched.mapInArrow(shingles, "class long, shingles binary").dropDuplicates(["class"]), "sets")

    links = star_links(shared, sets, share, work)
    found = connected_components(links, work, "parts")
    part = work.write(needed.select("class").join(found, F.col("class") == F.col("node"), "left").select("class", F.coalesce("component", "class").alias("part")), "part")
    # Keys are left whose classes aren't in one component.
    rows = work.write(shared.select("key", "class").join(part, "class"), "parts-of-keys")
    left = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    open_ = work.write(join_heavy(rows, work.write(left.select("key", "n"), "open-of-keys"), ["key"]), "open", F.count(F.lit(1)).alias("rows"))
    if open_.marks["rows"]:
        links = links.unionByName(tile_links(open_, sets, share, work))
    groups = connected_components(links, work, "groups") if open_.marks["rows"] else found
    linked = work.write(classes.select("class", "text_a", "text_b", "id", "n").join(groups, F.col("class") == F.col("node"), "left").drop("node"), "linked")
    roots = work.write(linked.where("component is not null").groupBy("component").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n")), "roots")
    named = join_heavy(linked.withColumnRenamed("n", "rows"), roots, ["component"], "left")
    named = work.write(named.select("text_a", "text_b", F.col("rows").alias("n"), F.coalesce("root", "id").alias("component")), "named")
    return join_heavy(prints.select("id", "text_a", "text_b"), named, ["text_a", "text_b"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that have a near copy of a smaller id; rows without an id stay.

    Rows of one id and text are one document and stay or go together; so no row is left of a document whose copy has its
    own id but another text. Only rows that a sieve doesn't clear are shuffled with their texts. Null and empty texts are
    texts like any other, very long ones are read whole, an empty table gives no rows, and all columns stay.
    """
    work = Workspace(docs.sparkSession, "drop")
    groups = near_copy_groups(docs, id_col=id_col, text_col=text_col, **options)
    gone = work.write(groups.where("id <> component").select("id", "text_a", "text_b").distinct(), "gone")
    text = F.col(text_col).cast("string")
    keys = {"id": F.col(id_col).cast("long"), "text_a": F.xxhash64(F.lit(1), text), "text_b": F.xxhash64(F.lit(2), text, F.length(text))}
    return without(docs, keys, gone, work)
