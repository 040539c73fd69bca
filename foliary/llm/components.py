"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Workspace, join_heavy

#: Edges held at once when a task joins the edges it reads.
CHUNK = 400_000


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each chunk of edges by stars with the same components."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        nodes = [x for x in parent if find(parent, x) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(parent, x) for x in nodes], pa.int64())], names=["a", "b"]
        )

    def find(parent: dict[int, int], x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    parent: dict[int, int] = {}
    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(parent, a), find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars(parent)
            parent, n = {}, 0
    if parent:
        yield stars(parent)


def connected_components(edges: DataFrame, work: Workspace, tag: str = "cc") -> DataFrame:
    """(node, component) for each node of edges (a long, b long); component is the smallest node reachable.

    Repeated edges and loops do no harm; rows with a null end are left out. Nodes without an edge to another node
    get no row. The least neighbour is a partial aggregate, and hubs are joined by join_heavy, so no task gets all edges
    of a hub.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    now = work.write(clean.mapInArrow(_shrink, "a long, b long").distinct(), f"{tag}-0")
    # The largest number of neighbours of a node that has a smaller one: if it is 1, all are stars around their least nodes.
    tangled = F.max(F.when(F.col("m") < F.col("a"), F.col("n"))).alias("tangled")
    step = 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        least = work.write(least, f"{tag}-least-{step}", tangled)
        if (least.marks["tangled"] or 0) <= 1:
            break
        large = join_heavy(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.write(large, f"{tag}-large-{step}")
        root = work.write(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), f"{tag}-root-{step}")
        small = (
            join_heavy(large, root, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b")))
            .distinct()
        )
        step += 1
        now = work.write(small, f"{tag}-{step}")
        work.drop(*[f"{tag}-{x}{step - 1}" for x in ("", "least-", "large-", "root-")])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
