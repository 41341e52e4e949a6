"""End of sessions, and results of sessions that later evidence changes.

A session ends with its footer, or as partial when it has been silent for the idle time of the stream's own clock.
Results are kept by session; evidence that arrives for a session makes it dirty, and only the results of
dirty sessions are computed again and written over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from iotrail.streaming.live import event_time

_ENDED = "session_id string, ended string, events long, first_ns long, last_ns long"


def session_ends(records: DataFrame, idle_ns: int, watermark: str = "0 seconds") -> DataFrame:
    """One row per session end, from a stream of ``(session_id, ts_ns, footer)``.

    ``ended`` is ``footer`` or ``idle``; an idle session's result is partial. Only three numbers are held per open
    session. Records after an end open the session anew. Sessions still open at the end of the input give no row yet.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, first, last = state.get if state.exists else (0, None, None)
        ended = "idle" if state.hasTimedOut else None
        for batch in batches if ended is None else ():
            if len(batch):
                low, high = int(batch["ts_ns"].min()), int(batch["ts_ns"].max())
                events += len(batch)
                first, last = low if first is None else min(first, low), high if last is None else max(last, high)
                ended = "footer" if ended or bool(batch["footer"].any()) else None
        if ended is None:
            state.update((events, first, last))
            state.setTimeoutTimestamp(max((last + idle_ns) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
            return
        state.remove()
        yield pd.DataFrame([(*key, ended, events, first, last)], columns=["session_id", "ended", "events", "first_ns", "last_ns"])

    timed = records.withColumn("event_time", event_time()).withWatermark("event_time", watermark)
    return timed.groupBy("session_id").applyInPandasWithState(step, _ENDED, "events long, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def dirty_sessions(evidence: DataFrame, arrived_after: int) -> DataFrame:
    """Sessions with evidence of batches after ``arrived_after`` (``batch`` numbers of ``run_to_table``)."""
    return evidence.filter(F.col("batch") > arrived_after).select("session_id").distinct()


def refresh_results(spark: SparkSession, path: str, version: int, dirty: DataFrame | None, compute: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """Results by session as of ``version``: those of ``dirty`` sessions computed again, all others read from the version before.

    ``compute(only)`` builds the results; it passes each of its inputs through ``only``, which keeps the rows of dirty
    sessions, so a refresh reads and computes only those. Without ``dirty`` all sessions are computed. A version holds
    what changed (``version=N``), so earlier versions stay readable and a repeated refresh writes over its own folder.
    """
    only = (lambda df: df) if dirty is None else (lambda df: df.join(dirty, "session_id", "left_semi"))
    fresh = compute(only)
    fresh.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}/version={version}")
    if dirty is not None:
        # A dirty session without results any more must hide its older ones.
        dirty.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}-dirty/version={version}")
    return results_as_of(spark, path, version, fresh.schema)


def results_as_of(spark: SparkSession, path: str, version: int, schema) -> DataFrame:
    """The results that a reader sees at ``version``: of each session those of its newest version."""
    parts = [spark.read.schema(schema).parquet(f"{path}/version=0").withColumn("version", F.lit(0).cast("long"))]
    replaced = []
    for v in range(1, version + 1):
        parts.append(spark.read.schema(schema).parquet(f"{path}/version={v}").withColumn("version", F.lit(v).cast("long")))
        replaced.append(spark.read.schema("session_id string, version long").parquet(f"{path}-dirty/version={v}"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if not replaced:
        return rows
    changed = replaced[0]
    for part in replaced[1:]:
        changed = changed.unionByName(part)
    newest = changed.groupBy("session_id").agg(F.max("version").alias("newest"))
    return rows.join(newest, "session_id", "left").filter(F.col("version") >= F.coalesce("newest", F.lit(0))).drop("newest")
