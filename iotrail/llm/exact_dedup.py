"""Exact deduplication by content-defined chunk recipes.

A text without white space is cut where a hash of the last bytes says so, so equal runs of text give equal
chunks wherever they stand. A task names each chunk by a seeded 64-bit hash and emits it once. The
names are then verified: one grouping by name compares the bytes of the distinct chunks, and if a
name has two contents the next seed is taken. After that, equal names are equal chunks, a
document is its ordered list of names (its recipe), and equal recipes are equal texts. Each distinct
chunk moves once a task; long documents move nowhere.

Of equal texts the row with the most code points stays, then the smallest id. A hot group is pre-aggregated
in each task; the join that hands its keeper back is an ordinary one that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm.common import SPACES, pick, slices, stage, table, text_bytes

WINDOW, MASK_BITS = 32, 10
SHORTEST, LONGEST = 256, 8192

_gear = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one text; none for no bytes. A cut depends on the 32 bytes before it."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    sums = np.cumsum(_gear[np.frombuffer(data, np.uint8)], dtype=np.uint64)
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * np.uint64(0x9E3779B97F4A7C15)
    marks = np.flatnonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0) + WINDOW + 1
    ends, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if mark - last >= SHORTEST or mark == n:
            if mark > last:
                ends.append(mark)
                last = mark
    return ends


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES.encode())


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _names(parts: list[bytes], seed: int, bits: int) -> list[int]:
    shift = 64 - bits
    return [(xxhash.xxh3_64_intdigest(p, seed) >> shift) - (1 << 63 if not shift else 0) for p in parts]


def recipes(df: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """``(doc_id, n_points, text_sha256, recipe)`` of each row of ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = text_bytes(batch.column(1))
            points = [len(x) if x.isascii() else len(x.decode()) for x in raw]
            flat = [normalised(x) for x in raw]
            named = [_names(chunks(x), seed, bits) for x in flat]
            columns = [batch.column(0), pa.array(points, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in flat]), pa.array(named, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_points", "text_sha256", "recipe"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_points long, text_sha256 string, recipe array<long>")


def chunk_table(df: DataFrame, seed: int, bits: int = 64, remember: int = 100_000) -> DataFrame:
    """``(name, content)``: the chunks of each task, once while its memory of names lasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            new: dict[bytes, bytes] = {}
            for text in text_bytes(batch.column(1)):
                for part in chunks(normalised(text)):
                    key = hashlib.blake2b(part, digest_size=12).digest()
                    if key not in seen:
                        seen.add(key)
                        new[key] = part
            parts = list(new.values())
            yield pa.RecordBatch.from_arrays([pa.array(_names(parts, seed, bits), pa.int64()), pa.array(parts, pa.binary())], ["name", "content"])
            if len(seen) > remember:
                seen = set()

    return df.mapInArrow(run, "name long, content binary")


def names_clash(df: DataFrame, seed: int, bits: int = 64) -> bool:
    """Whether two different chunks of the corpus have one name."""
    found = chunk_table(df, seed, bits).groupBy("name").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    return not found.filter(F.col("a") != F.col("b")).isEmpty()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, bits: int = 64) -> DataFrame:
    """One row per row of ``df``: ``(doc_id, keep_id, group_size, kept, text_sha256, n_copies)``.

    Null and empty texts and texts of white space alone are one group. ``kept`` marks rows of the keeper's
    id; ``n_copies`` says how many rows of the group carry that id (1 unless rows repeat). A null id sorts
    after all others. An empty table gives no rows. ``bits`` shortens the names of the first seed, for tests.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    while names_clash(rows, seed, bits):
        seed, bits = seed + 1, 64
    listed = stage(recipes(rows, seed, bits), "recipes")
    best = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    by_id = listed.groupBy("recipe", "doc_id").agg(F.max("n_points").alias("n_points"), F.count(F.lit(1)).alias("copies"))
    groups = stage(by_id.groupBy("recipe").agg(F.min(best).alias("best"), F.sum("copies").alias("group_size"), F.min_by("copies", best).alias("n_copies")), "recipe-groups")
    return listed.join(groups, "recipe").select(
        "doc_id",
        F.col("best.c").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.c")).alias("kept"),
        "text_sha256",
        "n_copies",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("n_copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
),
g AS (
  SELECT *, count(*) OVER (PARTITION BY n) AS group_size,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""
