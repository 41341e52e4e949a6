"""Connected components by alternating large-star and small-star rounds over written edge tables.

Before the rounds, edges are contracted chunk by chunk: a task joins at most ``CHUNK`` edges at a time and passes on one
edge per node to the smallest node of its part. Chunks are as many as the edges need; if there was only one, it
held every edge and nothing is left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.llm.common import drop_staged, stage

CHUNK = 250_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, smallest node of its part)`` for the nodes of the given edges that are not the smallest."""
    parent: dict[int, int] = {}
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = a = parent[p]
        while (p := parent.setdefault(b, b)) != b:
            parent[b] = b = parent[p]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    nodes, roots = [], []
    for node in parent:
        root = node
        while parent[root] != root:
            root = parent[root]
        parent[node] = root
        if root != node:
            nodes.append(node)
            roots.append(root)
    return np.array(nodes, np.int64), np.array(roots, np.int64)


def _contract(edges: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        node, root = contracted(part.column("u").to_numpy(), part.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(node, root)`` of every node that has a link: root is the smallest node reachable.

    ``edges`` holds ``(u, v)`` in any direction, repeats and loops allowed. A node of many links is only ever
    a join and a minimum, never a gathered list. Rounds grow with the logarithm of the nodes.
    """
    given = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"), "edges")
    parts = max(1, -(-given.count() // chunk))
    # A chunk more than asked would be a second part of one task, so one part is whole only below the chunk.
    current = stage(_contract(given.coalesce(parts), chunk + 1), "contracted")
    drop_staged(given)
    if parts == 1:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = stage(small.filter("u != v").distinct(), "small-star")
        drop_staged(large)
        drop_staged(current)
        current, before = after, mark
        mark = _mark(current)
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
