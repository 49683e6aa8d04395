"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, stored


#: Links that one task may hold: 16 bytes each, and about 200 in its table of nodes.
FEW = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars around its smallest members: the same components from fewer links."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        rows = np.array([(x, r) for x in parent if (r := root(x)) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["u", "v"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of one task -> every node with the smallest node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = np.fromiter(parent, np.int64, len(parent))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([root(x) for x in nodes.tolist()], np.int64))], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root) for every linked node; root is the component's smallest node.

    At most FEW links, counted after each task has reduced its own to stars, are joined in
    one task.  More are joined in rounds: large star and small star in turn: each node points its larger neighbours, then
    its smaller ones, at the least node that it knows.  The rounds needed grow with
    the logarithm of a component's size.  Nodes with very many links are joined by
    broadcast (their number is bounded), so one large star is not one large task.
    A round is written to the shared folder, which cuts its lineage.
    """
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    if edges.count() <= FEW:
        return stored(edges.coalesce(1).mapInArrow(_rooted, "node long, root long"), "components")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_skewed(both.where("v > u"), least, ["u"], "n", 2 * state.n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        # Every link now runs from a node u to a smaller one v.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_skewed(large, least, ["u"], "n", state.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
