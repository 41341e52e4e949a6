"""Best-fit packing of documents into bins of fixed size, with conflicts.

Each document has a length (its words and one end mark), a source and a duplicate cluster. A document longer than
a bin is cut into full bins and a rest. Rests are dealt at random into groups of about ``GROUP``, whatever
their source or cluster, so a hot source is spread evenly and a group fits a task. In a group, rests are
placed by falling length: open bins stand in order of residual room, each with a bitmap of its sources and
one of its clusters, and the search goes from the first bin with enough room to its successors until
one shares neither source nor cluster. That bin is the tightest compatible one; without one a bin opens.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm.common import SPACES, stage, table, text_bytes

CAPACITY, GROUP = 2048, 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each item, taken in the given order; a null source or cluster conflicts with nothing."""
    bit_of: tuple[dict, dict] = {}, {}
    bits = lambda value, which: 0 if value is None else 1 << bit_of[which].setdefault(value, len(bit_of[which]))
    open_bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    holds: list[list[int]] = []  # source bitmap, cluster bitmap
    placed = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        source_bit, cluster_bit = bits(source, 0), bits(cluster, 1)
        chosen = None
        for k in range(bisect_left(open_bins, (length, -1)), len(open_bins)):
            held = holds[open_bins[k][1]]
            if not held[0] & source_bit and not held[1] & cluster_bit:
                chosen = k
                break
        if chosen is None:
            residual, own = capacity, len(holds)
            holds.append([0, 0])
        else:
            residual, own = open_bins.pop(chosen)
        placed.append((own, capacity - residual))
        holds[own][0] |= source_bit
        holds[own][1] |= cluster_bit
        if residual > length:
            insort(open_bins, (residual - length, own))
    return placed


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str | None) -> DataFrame:
    """``(doc_id, source, length, cluster)``; the cluster is a digest of the text without white space and case in A-Z."""
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), source.alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = SPACES.encode()
        for batch in batches:
            raw = text_bytes(batch.column(1))
            lengths = [len(x.split()) + 1 for x in raw]
            flat = [x.lower().translate(None, spaces) for x in raw]
            clusters = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) if x else None for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lengths, pa.int64()), pa.array(clusters, pa.int64())], ["doc_id", "source", "length", "cluster"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, length long, cluster long")


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", group: int = GROUP) -> DataFrame:
    """``(doc_id, piece, first_word, length, bin, bin_offset)``: where each piece of each row of ``df`` lies.

    Pieces of a document are numbered from 0 and cover it whole, end mark included; a null or empty text is one
    piece of length 1. In a bin no two pieces share a source or a cluster; null sources and texts without visible
    characters conflict with nothing. Each repeated row is packed by itself. An empty table gives no rows.
    """
    rows = stage(measured(df, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "pack-rows")
    whole = F.col("length").cast("long") / F.lit(capacity)
    full = (
        rows.filter(F.col("length") >= capacity)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(whole).cast("int") - 1)))
        .select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("length"), F.concat(F.lit("whole-"), "row", F.lit("-"), "piece").alias("bin"), F.lit(0).cast("long").alias("bin_offset"))
    )
    rests = rows.withColumn("piece", F.floor(whole).cast("int")).withColumn("rest", F.pmod("length", F.lit(capacity))).filter("rest > 0")
    groups = max(1, -(-rests.count() // group))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, first_word long, length long, bin string, bin_offset long"

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by([("rest", "descending"), ("row", "ascending")])
        number = part.column("group")[0].as_py()
        placed = best_fit(*(part.column(c).to_pylist() for c in ("rest", "source", "cluster")), capacity)
        first = np.array(part.column("piece").to_pylist(), np.int64) * capacity
        columns = [part.column("doc_id"), part.column("piece"), pa.array(first), part.column("rest"), pa.array([f"shared-{number}-{own}" for own, _ in placed]), pa.array([at for _, at in placed], pa.int64())]
        return pa.table(columns, names=["doc_id", "piece", "first_word", "length", "bin", "bin_offset"])

    dealt = rests.select("doc_id", "piece", "rest", "source", "cluster", "row", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    return full.unionByName(dealt.groupBy("group").applyInArrow(place, schema))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
