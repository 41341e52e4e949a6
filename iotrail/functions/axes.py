"""Numeric axes, group keys and category keys of a completed request.

Every builder is null-propagating: an unmeasured value has no position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalars import at_least_zero, device_label, identity_number, process_label
from iotrail.operators.correlate import mib_per_second
from iotrail.operators.ordered import row_numbers, with_sequence
from iotrail.operators.stats import on_keys
from iotrail.session import stage


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def time_ms(origin_ns: int | Column) -> Column:
    """Completion time in ms since the origin, never negative."""
    return at_least_zero(F.col("complete_ts") - origin_ns).cast("double") / 1e6


def latency_per_kib() -> Column:
    moved = F.col("operation").isin("read", "write") & (F.col("bytes") > 0)
    return F.when(moved, _d("device_ns") / 1e6 / (_d("bytes") / 1024.0))


AXES: dict[str, Callable[[int | Column], Column]] = {
    "time_ms": time_ms,
    "sector": lambda o: _d("sector"),
    "address_kib": lambda o: _d("sector") / 2.0,
    "address_mb": lambda o: _d("sector") * 512.0 / 1e6,
    "chunk_kib": lambda o: _d("bytes") / 1024.0,
    "total_latency_ms": lambda o: _d("total_ns") / 1e6,
    "queue_latency_ms": lambda o: _d("queue_ns") / 1e6,
    "device_latency_ms": lambda o: _d("device_ns") / 1e6,
    "pid": lambda o: _d("pid"),
    "queue_depth": lambda o: _d("queue_depth_after"),
    "queue_depth_at_issue": lambda o: _d("queue_depth_at_issue"),
    "issue_queue_depth": lambda o: _d("issue_depth"),
    "issue_gap_ms": lambda o: _d("issue_gap_ns") / 1e6,
    "completion_gap_ms": lambda o: _d("completion_gap_ns") / 1e6,
    "latency_per_kib": lambda o: latency_per_kib(),
    "issue_cpu": lambda o: _d("cpu"),
    "rolling_c2c_mib_s": lambda o: mib_per_second("completion_rate_payload", "completion_rate_duration"),
    "rolling_d2d_mib_s": lambda o: mib_per_second("issue_rate_payload", "issue_rate_duration"),
    # Present once request metrics are joined (see plans.attribution.with_graph_axes).
    "filesystem_ms": lambda o: _d("filesystem_ns") / 1e6,
    "ufs_ms": lambda o: _d("ufs_ns") / 1e6,
    "critical_path_ms": lambda o: _d("critical_path_ns") / 1e6,
}

GROUPS: dict[str, Callable[[], Column]] = {
    "none": lambda: F.lit("All I/O"),
    "direction": lambda: F.col("operation"),
    "access": lambda: F.col("access_pattern"),
    "size": lambda: F.col("size_class"),
    "process": lambda: F.concat(
        F.col("comm"), F.lit(" ("), F.coalesce(F.col("pid").cast("string"), F.lit("PID unavailable")), F.lit(")")
    ),
    # Present once request file labels are joined (see plans.attribution.file_labels).
    "file": lambda: F.coalesce("file_group", F.lit("Unattributed")),
    "origin": lambda: F.when(F.coalesce("origin_count", F.lit(0)) == 0, "Unknown")
    .when(F.col("origin_count") > 1, "Multiple files")
    .otherwise("File"),
    "confidence": lambda: F.coalesce("path_confidence", F.lit("unresolved")),
}

CATEGORIES: dict[str, Callable[[], Column]] = {
    "command": lambda: F.col("operation"),
    "access": lambda: F.col("access_pattern"),
    "size": lambda: F.col("size_class"),
    "device": lambda: device_label(),
    "process": lambda: process_label(),
    "file": lambda: F.concat(
        device_label(), F.lit(" / "), F.coalesce("file_candidates", F.lit("<path unresolved>"))
    ),
    "confidence": lambda: F.coalesce("path_confidence", F.lit("unresolved")),
}

SHARE_DIMENSIONS: dict[str, Callable[[], Column]] = {
    "command": lambda: F.col("operation"),
    "access_pattern": lambda: F.col("access_pattern"),
    "size_class": lambda: F.col("size_class"),
    "chunk_size": lambda: F.concat(F.col("bytes").cast("string"), F.lit(" B")),
    "command_access_size": lambda: F.concat_ws(" / ", "operation", "access_pattern", "size_class"),
    "device": lambda: device_label(),
    "issue_cpu": lambda: identity_number("cpu"),
    "completion_cpu": lambda: identity_number("complete_cpu"),
    "process": lambda: process_label(),
}


def explore(df: DataFrame, x: str, y: str, group: str, origin_ns: int | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points of any axis pair and group; rows lacking an axis keep a null there."""
    return df.select(
        "request_id",
        *keep,
        AXES[x](origin_ns).alias("x"),
        AXES[y](origin_ns).alias("y"),
        GROUPS[group]().alias("grp"),
    )


def label_positions(labels: DataFrame, first: int = 0) -> DataFrame:
    """Lexical positions of distinct labels, sorted by range so that many labels stay distributed."""
    ordered = stage(with_sequence(labels.select("label").distinct(), ["label"]), "labels")
    numbered = row_numbers(ordered, [], ["seq"], "rn", bucket=F.shiftright("seq", 33))
    return numbered.select("label", (F.col("rn") - 1 + first).alias("position"))


def category_positions(df: DataFrame, category: str) -> DataFrame:
    """Lexical 0-based positions of a category over the whole cohort."""
    return label_positions(df.select(CATEGORIES[category]().alias("label")))


def categorical(df: DataFrame, category: str) -> DataFrame:
    """Attach label and position of a category axis to each row."""
    return on_keys(df.withColumn("label", CATEGORIES[category]()), category_positions(df, category), ["label"])
