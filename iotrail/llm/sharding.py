"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

The rows are first written, with their texts, the block they were read in (blocks are scan partitions,
joined to ``max_blocks`` at most), a row number and their place in the shuffled block; from then on
nothing depends on how tasks are run again. A shuffled order of all rows cut into shards of fixed sizes
sends from block b to shard s a multivariate hypergeometric number of rows, so those numbers are drawn
first, exactly, row by row of the matrix, from the counts of the blocks (numbers only: blocks x shards). Each block, permuted
by itself in the task that read it, is cut by its row of the matrix; each shard is permuted again after the
exchange, in segments of its random key, whose counts give the first slot of each.

Law ``rows``: shard sizes differ by one at most, whatever the keys or texts; a hot id, source or
text is spread like any other rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iotrail.llm.common import stage, table

SHARDS = 24
MAX_BLOCKS = 4096
SEGMENTS = 1024


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; columns sum to sizes at most one apart."""
    total = sum(block_rows)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    matrix = []
    for rows in block_rows:
        sent = []
        rest, open_rows = rows, int(left.sum())
        for s in range(shards):  # each count by its conditional law; numpy's own draw is bounded at 10^9 rows
            n = int(left[s])
            k = rest if s == shards - 1 else hypergeometric(rng, n, open_rows - n, rest)
            sent.append(k)
            rest, open_rows = rest - k, open_rows - n
        left -= np.array(sent)
        matrix.append(sent)
    return matrix


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw of any size: large urns are halved until numpy's bound holds."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    if draws > 1:
        first = hypergeometric(rng, good, bad, draws // 2)
        return first + hypergeometric(rng, good - first, bad - (draws // 2 - first), draws - draws // 2)
    return int(rng.integers(good + bad) < good)


def shard(df: DataFrame, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS, segments: int = SEGMENTS) -> DataFrame:
    """``(doc_id, text, size, text_crc32, shard, slot)`` of every row: size is the UTF-8 bytes of the text plus 8.

    Whole texts go with their rows through both permutations, and move once, to their shard; size and crc are those of
    the text that arrives in its place. Each row, repeated or not, gets one place; slots of a shard run from 0
    without gaps. A null text has size 8 and the crc of no bytes; a null id is kept. An empty table gives no
    rows. Only DataFrame operations touch rows. Other columns are not read.
    """
    spark = df.sparkSession
    random = lambda salt: F.xxhash64("row", "doc_id", F.lit(seed * 2 + salt))
    read = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).coalesce(max_blocks)
    permuted = read.withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions(random(0), "row")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    rows = stage(permuted.withColumns({"block": F.spark_partition_id(), "place": place}), "shard-rows")
    counts = sorted((r["block"], r["count"]) for r in rows.groupBy("block").count().collect())  # max_blocks numbers at most
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    bounds = [(b, np.cumsum(sent).tolist()) for (b, _), sent in zip(counts, matrix, strict=True)]
    # Written, so that Spark knows how small it is and does not move texts to join it.
    cuts = stage(spark.createDataFrame(bounds, "block int, ends array<bigint>").coalesce(1), "shard-cuts")
    segment = F.shiftrightunsigned("shard_key", 64 - (segments - 1).bit_length()) % segments
    sent = (
        rows.join(cuts, "block")
        .select("doc_id", "text", "row", F.size(F.filter("ends", lambda end: end < F.col("place"))).alias("shard"), random(1).alias("shard_key"))
        .withColumn("segment", segment)
    )
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # Counted without texts: the places of a row follow from what was written.
    first = sent.groupBy("shard", "segment").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("shard", "segment").orderBy("shard_key", "row")
    placed = sent.withColumn("at", F.row_number().over(within) - 1).join(first, ["shard", "segment"])
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        "text",
        (F.length(bytes_) + 8).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        "shard",
        (F.col("first") + F.col("at")).alias("slot"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, uniformly shuffled."""
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
