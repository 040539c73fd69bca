"""Near-duplicate vectors by int8 tile products with an error bound for each vector.

A unit vector u is rounded to s q, q of int8 with the scale s = max|u| / 127, and e = |u - s q| is kept. For two of
them |<u, v> - s_u s_v <q_u, q_v>| <= e_u + e_v + e_u e_v, so the products of the small integers, which are exact, tell
most pairs apart; only pairs within the bound of the threshold are computed again in double precision.

Vectors are rounded once. Those of one label are dealt into blocks, and each two blocks meet in a tile as small
integers, scales and errors: no task holds more than two blocks, whatever the label's share of the rows, and a part of a
tile's products at a time. A tile returns a row for each linked vector, never the pairs, and marks the vectors that have a
pair within the bound of the threshold; these meet again, in the same tiles, in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Workspace, complete_groups, deal_tiles, group_starts, join_heavy
from foliary.llm.components import connected_components

#: Vectors of a block, and rows of a tile's products that are held at once.
BLOCK, ROWS = 4096, 256
#: Rounding in double precision of what the bound is made of.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and error norm of each row; rows are unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def products(qa: np.ndarray, sa: np.ndarray, qb: np.ndarray, sb: np.ndarray) -> np.ndarray:
    # Sums of products of small integers are whole numbers, exact in a float of enough digits.
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return (qa.astype(exact) @ qb.astype(exact).T).astype(np.float64) * sa[:, None] * sb[None, :]


def judge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(surely linked, undecided) for each row of a and row of b, each (int8 values, scale, error)."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    about = products(qa, sa, qb, sb)
    bound = ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + SLACK
    sure = about - bound >= threshold
    return sure, (about + bound >= threshold) & ~sure


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by their largest value, as squares far from 1 would leave the range of doubles; and their norms then."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.linalg.norm(x, axis=1)


def cosines_reach(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Is the cosine of each row of x with the row of y at the same place at least the threshold, in double precision."""
    (x, nx), (y, ny) = unit_rows(x), unit_rows(y)
    return np.einsum("ij,ij->i", x, y) / (nx * ny) >= threshold


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """(cosine >= threshold for each row of a and row of b, how many were computed in full); rows are not zero."""
    (ua, na), (ub, nb) = unit_rows(a), unit_rows(b)
    sure, open_ = judge(quantise(ua / na[:, None]), quantise(ub / nb[:, None]), threshold)
    x, y = np.nonzero(open_)
    for at in range(0, len(x), 1 << 16):
        i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        sure[i, j] = cosines_reach(a[i], b[j], threshold)
    return sure, len(x)


def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, label, dim, v) with int8 values, scale and error norm of each vector in place of v."""
    for batch in batches:
        dims, flat = batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy().astype(np.float64)
        ends = np.cumsum(dims)
        q, scale, error = [], np.empty(len(dims)), np.empty(len(dims))
        for dim in np.unique(dims):
            of = np.flatnonzero(dims == dim)
            x, n = unit_rows(flat[(ends[of] - dim)[:, None] + np.arange(dim)])
            values, scale[of], error[of] = quantise(x / n[:, None])
            q += zip(of.tolist(), map(bytes, values), strict=True)
        q = [b for _, b in sorted(q)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(q, pa.binary()), pa.array(scale), pa.array(error)], names=["row", "id", "label", "dim", "q", "s", "e"])


KEYS = ["grp", "dim", "tile_i", "tile_j"]
FOUND = "row long, id long, grp long, dim int, tile_i int, tile_j int, tile_side int, n long, root long, undecided boolean"


def _tiles(threshold: float, full: bool):
    """Of each tile of rounded vectors: a row for each that is linked or has an undecided pair; root is an id.

    With full there is a column v as well, and only the undecided pairs count, by their vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, KEYS, rows=BLOCK):
            starts = group_starts(table, KEYS)
            ids, rows, side = (table.column(c).to_numpy() for c in ("id", "row", "tile_side"))
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                part = table.slice(s, e - s)
                dim = part.column("dim")[0].as_py()
                q = np.frombuffer(b"".join(part.column("q").to_pylist()), np.int8).reshape(-1, dim)
                scale, error = part.column("s").to_numpy(), part.column("e").to_numpy()
                v = part.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim) if full else None
                one = side[s:e] == 1
                same = part.column("tile_i")[0] == part.column("tile_j")[0]
                left, right = (np.arange(e - s),) * 2 if same else (np.flatnonzero(~one), np.flatnonzero(one))
                own = ids[s:e]
                count, undecided = np.zeros(e - s, np.int64), np.zeros(e - s, bool)
                near_a, near_b = [], []
                for at in range(0, len(left), ROWS):
                    i = left[at : at + ROWS]
                    sure, open_ = judge((q[i], scale[i], error[i]), (q[right], scale[right], error[right]), threshold)
                    apart = own[i][:, None] != own[right][None, :]
                    open_ &= apart
                    if full:
                        x, y = np.nonzero(open_)
                        sure[:] = False
                        for k in range(0, len(x), 1 << 16):
                            a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                            sure[a, b] = cosines_reach(v[i[a]], v[right[b]], threshold)
                    else:
                        sure &= apart
                        undecided[i] |= open_.any(axis=1)
                        undecided[right] |= open_.any(axis=0)
                    count[i] += sure.sum(axis=1)
                    if not same:
                        count[right] += sure.sum(axis=0)
                    # A star for each row of the part has the same components as its links.
                    for a in np.flatnonzero(sure.any(axis=1)):
                        b = right[sure[a]]
                        near_a.append(np.full(len(b), i[a]))
                        near_b.append(b)
                root = roots_of(near_a, near_b, e - s)
                some = np.flatnonzero((count > 0) | undecided)
                if len(some):
                    keys = [pa.array(np.full(len(some), part.column(c)[0].as_py())).cast(t) for c, t in zip(KEYS, (pa.int64(), *[pa.int32()] * 3), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[s:e][some]), pa.array(own[some]), *keys, pa.array(one[some].astype(np.int32)), pa.array(count[some]), pa.array(own[root[some]]), pa.array(undecided[some])],
                        names=["row", "id", *KEYS, "tile_side", "n", "root", "undecided"],
                    )

    return run


def roots_of(a: list[np.ndarray], b: list[np.ndarray], size: int) -> np.ndarray:
    """The smallest reachable place of each, over links between places; a row of links at a time."""
    parent = np.arange(size)
    for x, y in zip(a, b, strict=True):
        ends = np.append(y, x[0])
        top = parent[ends]
        while (up := parent[top] != top).any():
            top[up] = parent[top[up]]
        low = top.min()
        parent[top] = low
        parent[ends] = low
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, n_links, component) for each row of vectors.

    Rows link if their labels are equal and not null, their vectors of one length, and the cosine is at least the
    threshold. A vector that is null, empty or zero or holds a null or a non-finite number links with nothing, nor does
    a row with a null id; such rows are components of their own. Rows of one id don't link with each other; each of
    them counts the links of all. Very long vectors are vectors like any other; other columns are not read. An empty table
    gives no rows.
    """
    work = Workspace(vectors.sparkSession, "int8")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    good = rows.where("id is not null and label is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))
    numbered = work.write(good.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: x.cast("double")).alias("v")), "vectors")
    kind = numbered.schema["label"].dataType.simpleString()
    small = work.write(numbered.mapInArrow(rounded, f"row long, id long, label {kind}, dim int, q binary, s double, e double"), "rounded")
    groups = small.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    groups = work.write(groups.withColumn("size", F.col("n")).withColumn("grp", F.monotonically_increasing_id()), "groups")
    tiles = deal_tiles(join_heavy(small, groups, ["label", "dim"]), "grp", "size", "row", BLOCK)
    columns = [*KEYS, "tile_side", "row", "id", "q", "s", "e"]
    dealt = tiles.select(*columns).repartition(*KEYS).sortWithinPartitions(*KEYS)
    first = work.write(dealt.mapInArrow(_tiles(threshold, False), FOUND), "first")
    # Vectors with undecided pairs, once for each tile where they have any.
    again = first.where("undecided").select("row", *KEYS, "tile_side")
    again = again.join(small.select("row", "id", "q", "s", "e"), "row").join(numbered.select("row", "v"), "row")
    second = again.select(*columns, "v").repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_tiles(threshold, True), FOUND)
    met = first.where("n > 0").unionByName(work.write(second, "second")).select("id", "n", "root")
    links = met.groupBy("id").agg(F.sum("n").alias("n_links"))
    found = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), work)
    linked = links.join(found, links["id"] == found["node"], "left").select(F.col("id").alias("_id"), "n_links", "component")
    return rows.select("id").join(linked, F.col("id") == F.col("_id"), "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
