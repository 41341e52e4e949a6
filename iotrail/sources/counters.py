"""Disk counters, scheduler waits, diagnostics and probe bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalars import at_least_zero, redact_paths
from iotrail.operators.ordered import BUCKET, carry_last
from iotrail.operators.stats import equal_width_histogram, nearest_rank

COUNTERS = ["reads", "read_sectors", "writes", "write_sectors"]


def parse_disk_stats(polls: DataFrame) -> DataFrame:
    """Rows of each raw counter text: device lines of 14 fields or more whose counters are numbers."""
    lines = polls.select("session_id", "elapsed_ms", "boot_id", F.explode(F.split("raw", "\n")).alias("line"))
    f = F.split(F.trim("line"), r"\s+")
    fields = lines.withColumn("f", f).filter(F.size("f") >= 14)
    places = dict(zip(COUNTERS, (3, 5, 7, 9)))
    parsed = fields.select(
        "session_id",
        "elapsed_ms",
        "boot_id",
        F.concat(F.col("f")[0], F.lit(":"), F.col("f")[1], F.lit(" "), F.col("f")[2]).alias("disk"),
        *[F.col("f")[i].try_cast("long").alias(c) for c, i in places.items()],
    )
    return parsed.dropna(subset=COUNTERS)


def disk_deltas(rows: DataFrame, polls: DataFrame) -> DataFrame:
    """Counter growth against the poll before: same boot, later time, the disk present in both.

    A reset is reported, never counted as negative growth.
    """
    order = carry_last(
        polls.select("session_id", "elapsed_ms", "boot_id", "poll"),
        ["session_id"],
        ["poll"],
        {"prev": F.struct("poll", "elapsed_ms", "boot_id")},
        bucket=F.shiftright("poll", 20),
    ).drop(BUCKET)
    now = rows.join(order.select("session_id", "poll", "prev"), ["session_id", "poll"])
    before = rows.select("session_id", "disk", F.col("poll").alias("prev_poll"), *[F.col(c).alias(f"old_{c}") for c in COUNTERS])
    both = now.withColumn("prev_poll", F.col("prev.poll")).join(before, ["session_id", "disk", "prev_poll"])
    usable = (F.col("prev.boot_id") == F.col("boot_id")) & (F.col("elapsed_ms") > F.col("prev.elapsed_ms"))
    grown: Column = F.lit(True)
    for c in COUNTERS:
        grown &= F.col(c) >= F.col(f"old_{c}")
    good = usable & grown
    seconds = (F.col("elapsed_ms") - F.col("prev.elapsed_ms")) / 1000.0
    sectors = (F.col("read_sectors") - F.col("old_read_sectors")) + (F.col("write_sectors") - F.col("old_write_sectors"))
    return both.select(
        "session_id",
        "disk",
        "poll",
        "elapsed_ms",
        *[F.when(good, F.col(c) - F.col(f"old_{c}")).alias(c) for c in COUNTERS],
        F.when(good, sectors.cast("double") * 512.0 / 1048576.0 / seconds).alias("mib_s"),
        (usable & ~grown).alias("reset"),
    )


def disk_totals(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("session_id", "disk").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
        F.count("mib_s").alias("samples"),
        F.count_if("reset").alias("resets"),
    )


# -- scheduler waits -----------------------------------------------------------


def valid_waits(raw: DataFrame) -> DataFrame:
    """Waits without delay or task are dropped, never read as zero."""
    return raw.filter(F.col("delay_ns").isNotNull() & F.col("tid").isNotNull())


def scheduler_view(waits: DataFrame, origin_ns: int, spec) -> DataFrame:
    """Waits a cohort filter selects; request-only predicates make the view incompatible and empty.

    ``spec`` is a :class:`iotrail.functions.filters.CohortFilter`.
    """
    block_only = bool(
        spec.latency_min_ns is not None
        or spec.latency_max_ns is not None
        or spec.device
        or spec.operation
        or spec.min_bytes
        or spec.max_bytes
        or spec.access
        or spec.layer
        or spec.confidence
        or spec.file
    )
    at = at_least_zero(F.col("ts_ns") - origin_ns).cast("double") / 1e6
    c: Column = F.lit(not block_only)
    if spec.start_ms > 0 or spec.end_ms > 0:
        c &= at >= spec.start_ms
        if spec.end_ms > 0:
            c &= at <= spec.end_ms
    if spec.pid:
        c &= F.col("pid") == spec.pid
    if spec.tid:
        c &= F.col("tid") == spec.tid
    if spec.cpu is not None:
        c &= F.col("cpu") == spec.cpu
    if spec.process:
        c &= F.contains(F.lower("comm"), F.lit(spec.process.lower()))
    return (
        waits.filter(c)
        .withColumn("time_ms", at)
        .withColumn("delay_us", F.col("delay_ns").cast("double") / 1000.0)
        .withColumn("incompatible", F.lit(block_only))
    )


def scheduler_distribution(waits: DataFrame, bins: int = 16) -> tuple[DataFrame, DataFrame]:
    """Exact percentiles and equal-width bins of the delay in microseconds."""
    us = waits.select((F.col("delay_ns").cast("double") / 1000.0).alias("delay_us"))
    return nearest_rank(us, [], "delay_us", [50, 90, 95, 99]), equal_width_histogram(us, [], "delay_us", bins)


# -- diagnostics ----------------------------------------------------------------

DIAGNOSTIC = (
    "ts_unix_ms long, level string, component string, event string, session_id string, outcome string, code string, "
    "correlation_id string, duration_ms long, count long, detail string"
)
# Longest kept text of the identifying fields; the detail stays whole.
LIMITS = {"component": 64, "event": 128, "outcome": 64, "code": 64, "correlation_id": 128}
_NEEDED = ("ts_unix_ms", "level", "component", "event", "session_id", "outcome", "code")


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """Diagnostic rows with bounded identifiers and redacted paths in a whole detail; a bad line becomes a warning row."""
    d = F.from_json("value", DIAGNOSTIC)
    good: Column = d.isNotNull()
    for name in _NEEDED:
        good &= d[name].isNotNull()
    rows = lines.withColumn("d", d).withColumn("good", F.coalesce(good, F.lit(False)))
    fallback = {
        "level": F.lit("warn"),
        "component": F.lit("desktop.capture"),
        "event": F.lit("agent.diagnostic.decode"),
        "outcome": F.lit("rejected"),
        "code": F.lit("AGENT_DIAGNOSTIC_INVALID"),
        "detail": F.concat(F.lit("line="), F.col("value")),
    }

    def field(name: str) -> Column:
        raw = F.when(F.col("good"), F.col(f"d.{name}")).otherwise(fallback.get(name, F.lit(None)))
        return F.left(raw, F.lit(LIMITS[name])) if name in LIMITS else raw

    keep = [c for c in lines.columns if c != "value"]
    out = rows.select(
        *keep,
        "good",
        *[field(n).alias(n) for n in ("level", "component", "event", "outcome", "code", "correlation_id")],
        redact_paths(field("detail")).alias("detail"),
    )
    return out


def search_diagnostics(rows: DataFrame, needle: str, fields: Sequence[str] = ("component", "code", "event", "correlation_id")) -> DataFrame:
    hit: Column = F.lit(False)
    for f in fields:
        hit |= F.coalesce(F.contains(F.lower(f), F.lit(needle.lower())), F.lit(False))
    return rows.filter(hit)


# -- capture bookkeeping ----------------------------------------------------------


def merge_cpu_aggregates(per_cpu: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Sum per-CPU counters and histograms of one generation; other generations stay apart."""
    flat = per_cpu.select("generation", *counters, F.posexplode("histogram").alias("bucket", "n"))
    sums = per_cpu.groupBy("generation").agg(*[F.sum(c).alias(c) for c in counters])
    bins = flat.groupBy("generation", "bucket").agg(F.sum("n").alias("n"))
    packed = bins.groupBy("generation").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("histogram"))
    return sums.join(packed, "generation")


def stack_cohorts(samples: DataFrame, tail_ns: int = 5_000_000) -> DataFrame:
    """Per kind and stack: samples, slow samples, cumulative latency and deepest stack."""
    return samples.groupBy("kind", "stack_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("latency_ns") >= tail_ns).alias("tail_samples"),
        F.sum("latency_ns").alias("cumulative_ns"),
        F.max("frames").alias("max_frames"),
    )


def probe_states(plans: DataFrame) -> DataFrame:
    """Number of planned probes per capability state."""
    return plans.select(F.explode("attach_plan").alias("p")).groupBy(F.col("p.state").alias("state")).agg(F.count(F.lit(1)).alias("n"))
