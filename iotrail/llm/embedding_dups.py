"""Near duplicates among embeddings: a small-world graph per shard, every shard queried, cosines verified.

Equal vectors of a label become one class, so a hot vector is one node with a weight. The classes of a label
are dealt into shards of about ``SHARD`` and query blocks of about ``BLOCK`` by their id; each (shard, block) pair is a group of its own with
one graph and one block of vectors, whatever the size of the label. A group searches its graph, holds a
sample of its queries against all vectors of the shard, and doubles the beam until the audit finds every
link (at the shard's size the beam sees everything). Hits are verified in double precision. A group returns
counts and the edges of a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm.common import stage, table
from iotrail.llm.components import components
from iotrail.llm.hnsw import Graph

SHARD, BLOCK = 8192, 4096
BEAM, AUDIT = 64, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, safe for very small and very large components."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def links_of(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Verified ``(query, node)`` links of a block against a shard, with an audited beam."""
    loose, n = least - 1e-4, len(exact)
    sample = np.random.default_rng(seed).permutation(len(queries))[:AUDIT]
    truth = queries[sample] @ exact.T >= least
    narrow, beam = queries.astype(np.float32), BEAM
    while True:
        q, node = graph.within(narrow[sample], loose, beam)
        hit = np.zeros(truth.shape, bool)
        hit[q, node] = True
        if beam >= n or not (truth & ~hit).any():
            break
        beam *= 2
    q, node = graph.within(narrow, loose, beam)
    real = np.concatenate([np.empty(0, bool), *[np.einsum("kd,kd->k", queries[q[a : a + 65536]], exact[node[a : a + 65536]]) >= least for a in range(0, len(q), 65536)]])
    return q[real], node[real]


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given edges."""
    parent: dict[int, int] = {}
    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = a, b
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent.setdefault(y, y) != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _graphs(classes: DataFrame) -> DataFrame:
    """One row per shard: ids, weights, vectors and the built graph."""

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        exact = unit(matrix(part.column("embedding")))
        graph = Graph(exact)
        row = {
            "label": [part.column("label")[0].as_py()],
            "dim": [part.column("dim")[0].as_py()],
            "shard": [part.column("shard")[0].as_py()],
            "blocks": [part.column("blocks")[0].as_py()],
            "reps": [part.column("rep").to_numpy().tobytes()],
            "weights": [part.column("weight").to_numpy().tobytes()],
            "exact": [exact.tobytes()],
            "graph": [graph.to_bytes()],
        }
        return pa.table(row, schema=pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("shard", pa.int32()), ("blocks", pa.int32()), ("reps", pa.binary()), ("weights", pa.binary()), ("exact", pa.binary()), ("graph", pa.binary())]))

    return classes.groupBy("label", "dim", "shard").applyInArrow(build, "label long, dim int, shard int, blocks int, reps binary, weights binary, exact binary, graph binary")


def _query_blocks(classes: DataFrame) -> DataFrame:
    """One row per block of queries: ids and vectors."""

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        exact = unit(matrix(part.column("embedding")))
        row = {"label": [part.column("label")[0].as_py()], "dim": [part.column("dim")[0].as_py()], "block": [part.column("block")[0].as_py()], "shards": [part.column("shards")[0].as_py()]}
        row |= {"query_reps": [part.column("rep").to_numpy().tobytes()], "queries": [exact.tobytes()]}
        return pa.table(row, schema=pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int32()), ("shards", pa.int32()), ("query_reps", pa.binary()), ("queries", pa.binary())]))

    return classes.groupBy("label", "dim", "block").applyInArrow(pack, "label long, dim int, block int, shards int, query_reps binary, queries binary")


def _search(groups: DataFrame, least: float) -> DataFrame:
    """Rows ``(u, n, v)``: links of ``u`` counted (v null), and forest edges (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, reps, weights, exact, graph, query_reps, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reps, weights, query_reps = (np.frombuffer(x, np.int64) for x in (reps, weights, query_reps))
                exact, queries = (np.frombuffer(x, np.float64).reshape(-1, dim) for x in (exact, queries))
                q, node = links_of(Graph.from_bytes(graph), exact, queries, least)
                other = query_reps[q] != reps[node]
                q, node = q[other], node[other]
                counts = np.bincount(q, weights[node], minlength=len(query_reps)).astype(np.int64)
                some = np.flatnonzero(counts)
                edges = forest(query_reps[q], reps[node])
                u = np.concatenate([query_reps[some], np.array([a for a, _ in edges], np.int64)])
                n = pa.array([*counts[some].tolist(), *[None] * len(edges)], pa.int64())
                v = pa.array([*[None] * len(some), *[b for _, b in edges]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), n, v], ["u", "n", "v"])

    return groups.select("dim", "reps", "weights", "exact", "graph", "query_reps", "queries").mapInArrow(run, "u long, n long, v long")


def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in double precision is
    ``least`` or more. Null, empty and zero vectors and those with null or non-finite components link with
    nothing, as do rows with a null id. Rows that repeat an id count as vectors of their own. An empty
    table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    grouped = rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = stage(grouped.withColumn("dim", F.size("embedding")), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumns(
        {"shard": F.pmod(F.xxhash64("rep", F.lit(1)), "shards").cast("int"), "block": F.pmod(F.xxhash64("rep", F.lit(2)), "blocks").cast("int")}
    )
    graphs = stage(_graphs(dealt), "graphs").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = stage(_query_blocks(dealt), "query-blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    found = stage(_search(graphs.join(queries.hint("shuffle_hash"), ["label", "dim", "shard", "block"]), least), "vector-links")
    counted = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    known = stage(classes.join(counted, "rep", "left").join(roots, "rep", "left").select("label", "embedding", "rep", "weight", "n", F.coalesce("root", "rep").alias("root")), "vector-roots")
    usable = rows.filter("usable").join(known, ["label", "embedding"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
"""
