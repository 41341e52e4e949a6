"""Device activity, host bandwidth, fixed windows, busy runs, idle gaps and bursts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalars import at_least_zero
from iotrail.operators.intervals import busy_by_window, clip, gaps, locate, merge_intervals
from iotrail.operators.ordered import BUCKET, in_blocks, running
from iotrail.plans.summary import moved
from iotrail.session import stage

MIB = 1048576.0
BURST_GAP_NS = 500_000  # fixed value: a gap of exactly 0.5 ms still joins a burst


def device_activity(requests: DataFrame, devices: Sequence[tuple[int, int]] | None = None, by_device: bool = True) -> DataFrame:
    """Merged issue-to-completion intervals of every request, before any cohort filter."""
    rows = requests.filter(F.col("issue_ts").isNotNull() & F.col("complete_ts").isNotNull())
    if devices is not None:
        pick: Column = F.lit(False)
        for major, minor in devices:
            pick |= (F.col("major") == major) & (F.col("minor") == minor)
        rows = rows.filter(pick)
    keys = ["major", "minor"] if by_device else []
    return merge_intervals(rows, keys, "issue_ts", "complete_ts")


def activity_known(quality: DataFrame) -> DataFrame:
    """Is the busy clock exact, reconstructed or unknown?

    ``quality`` has one row per session and device: ``verified``, ``unfiltered``,
    ``complete``, ``lost`` (null when a counter is missing), ``footer_events``,
    ``stored_events``, ``completions``, ``unresolved`` and ``requeues``.
    Any missing proof leaves the clock unknown.
    """
    proof = (
        F.col("unfiltered")
        & F.col("complete")
        & (F.col("lost") == 0)
        & (F.col("footer_events") == F.col("stored_events"))
        & (F.col("completions") > 0)
        & (F.col("unresolved") == 0)
        & (F.col("requeues") == 0)
    )
    rebuilt = F.coalesce(proof, F.lit(False))
    verified = F.coalesce(F.col("verified"), F.lit(False))
    reason = (
        F.when(verified, "verified")
        .when(rebuilt, "reconstructed")
        .when(F.col("lost").isNull(), "loss counters missing")
        .when(F.col("lost") > 0, "events lost")
        .when(~F.coalesce("unfiltered", F.lit(False)), "capture was filtered")
        .when(~F.coalesce("complete", F.lit(False)), "recording is partial")
        .otherwise("requests unresolved")
    )
    return quality.select(
        "*",
        (verified | rebuilt).alias("activity_known"),
        (rebuilt & ~verified).alias("activity_estimated"),
        reason.alias("reason"),
    )


def host_bandwidth(requests: DataFrame, merged: DataFrame, lower: int, upper: int, known: bool = True) -> DataFrame:
    """Moved bytes over wall time and over busy time of the chosen devices, for total/read/write.

    ``merged`` comes from the whole stream; ``requests`` may be a filtered cohort.
    """
    duration = max(0, upper - lower)
    busy = clip(merged, lower, upper).agg(F.coalesce(F.sum(F.col("end_ns") - F.col("start_ns")), F.lit(0)).alias("observed_busy_ns"))
    volume = requests.filter(F.col("complete_ts").between(lower, upper)).agg(
        *[F.coalesce(F.sum(moved(op)), F.lit(0)).alias(n) for n, op in (("total", None), ("read", "read"), ("write", "write"))]
    )
    rows = volume.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("direction"), F.col(n).alias("bytes")) for n in ("total", "read", "write")])).alias("d")
    ).select("d.*")
    busy_ns = F.col("observed_busy_ns") if known else F.lit(None).cast("long")
    wall = F.lit(float(duration))
    return (
        rows.join(busy, F.lit(True))
        .withColumn("busy_ns", busy_ns)
        .select(
            "direction",
            "bytes",
            F.lit(duration).cast("long").alias("duration_ns"),
            "busy_ns",
            at_least_zero(F.lit(duration) - F.col("busy_ns")).alias("idle_ns"),
            F.when(wall > 0, F.col("bytes").cast("double") * 1e9 / wall / MIB).alias("with_idle_mib_s"),
            F.when(F.col("busy_ns") > 0, F.col("bytes").cast("double") * 1e9 / F.col("busy_ns").cast("double") / MIB).alias(
                "without_idle_mib_s"
            ),
        )
    )


@dataclass(frozen=True)
class Windows:
    """Fixed windows of [lower, upper]; the last one ends at the range end."""

    lower: int
    upper: int
    requested_ns: int

    @property
    def width(self) -> int:
        return max(self.requested_ns, 1)

    @property
    def count(self) -> int:
        return -(-(self.upper - self.lower) // self.width)

    def calendar(self, df: DataFrame) -> DataFrame:
        """Every window, also the empty ones."""
        w = F.col("id")
        start = F.lit(self.lower) + w * self.width
        return df.sparkSession.range(self.count).select(
            w.alias("window"), start.alias("start_ns"), F.least(start + self.width, F.lit(self.upper)).alias("end_ns")
        )

    def index(self, ts: str) -> Column:
        inside = F.col(ts).between(self.lower, self.upper)
        return F.when(inside, F.least(F.expr(f"({ts} - {self.lower}) div {self.width}"), F.lit(self.count - 1)))


def window_series(requests: DataFrame, merged: DataFrame | None, windows: Windows, known: bool = True) -> DataFrame:
    """All fixed-window metrics at once: bandwidth, IOPS, cumulative payload and busy/idle time."""
    counted = (
        requests.select(windows.index("complete_ts").alias("window"), "operation", "bytes")
        .filter(F.col("window").isNotNull())
        .groupBy("window")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("operation") == "read").alias("n_read"),
            F.count_if(F.col("operation") == "write").alias("n_write"),
            F.sum(moved()).alias("b"),
            F.sum(moved("read")).alias("b_read"),
            F.sum(moved("write")).alias("b_write"),
        )
    )
    volumes = ["n", "n_read", "n_write", "b", "b_read", "b_write"]
    frame = windows.calendar(requests).join(counted, "window", "left").fillna(0, volumes)
    out = running(
        frame, [], ["window"], sums={f"c_{c}": F.col(c) for c in ("b", "b_read", "b_write")}, bucket=F.expr("window div 4096")
    ).drop(BUCKET)
    if merged is not None:
        busy = busy_by_window(merged, [], windows.lower, windows.upper, windows.width)
        out = out.join(busy, "window", "left").withColumn("busy_ns", F.coalesce("busy_ns", F.lit(0)))
    else:
        out = out.withColumn("busy_ns", F.lit(None).cast("long"))
    if not known:
        out = out.withColumn("busy_ns", F.lit(None).cast("long"))
    ns = (F.col("end_ns") - F.col("start_ns")).cast("double")

    def rate(c: str) -> Column:
        return F.col(c).cast("double") * 1e9 / ns

    return out.select(
        "window",
        "start_ns",
        "end_ns",
        (rate("b") / MIB).alias("bandwidth_mib_s"),
        (rate("b_read") / MIB).alias("read_mib_s"),
        (rate("b_write") / MIB).alias("write_mib_s"),
        rate("n").alias("iops"),
        rate("n_read").alias("read_iops"),
        rate("n_write").alias("write_iops"),
        (F.col("c_b") / MIB).alias("cumulative_mib"),
        (F.col("c_b_read") / MIB).alias("cumulative_read_mib"),
        (F.col("c_b_write") / MIB).alias("cumulative_write_mib"),
        (F.col("busy_ns").cast("double") * 100.0 / ns).alias("busy_percent"),
        (F.col("busy_ns").cast("double") / 1e6).alias("busy_ms"),
        ((F.col("end_ns") - F.col("start_ns") - F.col("busy_ns")).cast("double") / 1e6).alias("idle_ms"),
    )


def busy_runs(merged: DataFrame, lower: int, upper: int) -> DataFrame:
    return clip(merged, lower, upper).select("start_ns", "end_ns")


def idle_gaps(merged: DataFrame, lower: int, upper: int) -> DataFrame:
    """Idle time including the leading and trailing gap."""
    return gaps(clip(merged, lower, upper).select("start_ns", "end_ns"), [], lower, upper)


def bursts(merged: DataFrame, lower: int, upper: int) -> DataFrame:
    """Busy runs joined across gaps of at most 0.5 ms."""
    return merge_intervals(clip(merged, lower, upper), [], gap_ns=BURST_GAP_NS)


def interval_payload(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Requests and payload per interval, a completion belonging to (start, end]."""
    placed = locate(requests.select("complete_ts", "operation", "bytes"), intervals, [], "complete_ts")
    totals = (
        placed.filter(F.col("interval_start_ns").isNotNull())
        .groupBy(F.col("interval_start_ns").alias("start_ns"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(moved()).alias("total_bytes"),
            F.sum(moved("read")).alias("read_bytes"),
            F.sum(moved("write")).alias("write_bytes"),
        )
    )
    volumes = ["requests", "total_bytes", "read_bytes", "write_bytes"]
    return (
        intervals.join(totals, "start_ns", "left")
        .fillna(0, volumes)
        .withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")).cast("double") / 1e6)
    )


def burst_payload(requests: DataFrame, burst_intervals: DataFrame) -> DataFrame:
    """Cumulative payload at every completion of its burst, ordered by (completion, request)."""
    rows = requests.select("complete_ts", "request_id", moved().alias("moved"))
    placed = locate(rows, burst_intervals, [], "complete_ts").filter(F.col("interval_start_ns").isNotNull())
    order = ["complete_ts", "request_id"]
    blocks = stage(in_blocks(placed, ["interval_start_ns"], order), "burst-blocks")
    return running(blocks, ["interval_start_ns"], order, sums={"cumulative_bytes": F.col("moved")}).drop(BUCKET)
