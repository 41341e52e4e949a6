"""Top list of a stream in fixed memory, with a proven error per row.

Keys are dealt to ``shards`` states by hash; each holds at most ``capacity`` counters. A micro-batch's sums are added to
the counters; if more than ``capacity`` remain, the next largest count is taken off all of them and those left with
nothing go. What has been taken off so far, ``error``, is the most by which any counter of the shard is too low, and the
most that a key without a counter can have. Each such cut takes the same amount from ``capacity`` + 1 counters at
least, so ``error`` is at most the shard's total weight over ``capacity`` + 1.

A key over that share of the total is therefore always listed; ``above_share`` counts the listed keys once more
and gives exactly the keys above a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHARDS, CAPACITY = 16, 64

_LISTED = "shard int, key string, at_least long, at_most long, shard_total long"
_COUNTERS = "keys array<string>, counts array<long>, error long, total long"


def cut_counters(counts: dict[str, int], capacity: int) -> tuple[dict[str, int], int]:
    """At most ``capacity`` counters, and the amount taken off each."""
    if len(counts) <= capacity:
        return counts, 0
    taken = sorted(counts.values(), reverse=True)[capacity]
    return {k: n - taken for k, n in counts.items() if n > taken}, taken


def top_counters(weights: DataFrame, capacity: int = CAPACITY, shards: int = SHARDS) -> DataFrame:
    """``(shard, key, at_least, at_most, shard_total)`` of a stream of ``(key, weight)``, in update mode.

    Each micro-batch emits the whole list of every shard that it met; a row without a key stands for all keys
    that have no counter. Null keys and weights that are null or not positive do not count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, held, error, total = state.get if state.exists else ([], [], 0, 0)
        counts = dict(zip(keys, held))
        for batch in batches:  # one Arrow batch at a time; what is held between them is bounded
            sums = batch.groupby("key")["weight"].sum()
            total += int(sums.sum())
            for name, weight in sums.items():
                counts[name] = counts.get(name, 0) + int(weight)
            counts, taken = cut_counters(counts, capacity)
            error += taken
        state.update((list(counts), list(counts.values()), error, total))
        rows = [(*key, k, n, n + error, total) for k, n in counts.items()] + [(*key, None, 0, error, total)]
        yield pd.DataFrame(rows, columns=["shard", "key", "at_least", "at_most", "shard_total"])

    dealt = weights.filter("key IS NOT NULL AND weight > 0").select(F.pmod(F.hash("key"), F.lit(shards)).alias("shard"), "key", F.col("weight").cast("long").alias("weight"))
    return dealt.groupBy("shard").applyInPandasWithState(step, _LISTED, _COUNTERS, "update", GroupStateTimeout.NoTimeout)


def latest_lists(table: DataFrame) -> DataFrame:
    """The list that each shard wrote last (batch-numbered output of ``run_to_table``)."""
    newest = table.groupBy("shard").agg(F.max("batch").alias("batch"))
    return table.join(newest, ["shard", "batch"], "left_semi").drop("batch")


def above_share(lists: DataFrame, weights: DataFrame, share: float) -> DataFrame:
    """``(key, weight, at_least, at_most)``: exactly the keys with more than ``share`` of the total weight.

    The lists name the candidates, which are few; one more pass over ``weights`` counts only those. Raises if the
    lists are too coarse to hold every such key.
    """
    totals = lists.filter("key IS NULL").agg(F.sum("shard_total").alias("total"), F.max("at_most").alias("error")).first()
    least = share * (totals["total"] or 0)
    if (totals["error"] or 0) > least:
        raise ValueError(f"a key without a counter may weigh {totals['error']}, above the share asked for ({least}): use more counters or shards")
    listed = lists.filter(F.col("key").isNotNull() & (F.col("at_most") > least)).select("key", "at_least", "at_most")
    exact = weights.filter("key IS NOT NULL AND weight > 0").join(listed.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("weight").cast("long").alias("weight"))
    return exact.filter(F.col("weight") > least).join(listed, "key")
