"""Comparison of two recordings or two cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions.filters import CohortFilter
from iotrail.functions.scalars import relative_delta_percent
from iotrail.operators.stats import on_keys
from iotrail.plans.summary import session_summary


def unpivot_summary(one_row: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")


def compare_long(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Join two (keys.., value) tables; delta and percent need both sides, percent a baseline above zero."""
    a = baseline.select(*keys, F.col("value").alias("baseline"))
    b = current.select(*keys, F.col("value").alias("current"))
    joined = on_keys(a, b, keys, "left").unionByName(
        on_keys(b, a, keys, "left_anti").select(*keys, F.lit(None).cast(dict(a.dtypes)["baseline"]).alias("baseline"), "current")
    )
    return joined.select(
        *keys,
        "baseline",
        "current",
        (F.col("current") - F.col("baseline")).alias("delta"),
        relative_delta_percent("baseline", "current").alias("percent"),
    )


def compare_summaries(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Summary of two request tables side by side."""
    return compare_long(unpivot_summary(session_summary(baseline)), unpivot_summary(session_summary(current)), ["metric"])


def compare_cohorts(
    baseline: DataFrame, current: DataFrame, shared: CohortFilter, local_baseline: CohortFilter, local_current: CohortFilter
) -> DataFrame:
    """The shared filter plus each side's own identities; request keys are never shared."""
    return compare_summaries(
        shared.for_session(local_baseline).apply(baseline), shared.for_session(local_current).apply(current)
    )


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: empty when both selections are equal."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
