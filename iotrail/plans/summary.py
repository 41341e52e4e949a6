"""Session and cohort summaries over the request table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.functions.axes import AXES, SHARE_DIMENSIONS
from iotrail.functions.scalars import at_least_zero, device_label
from iotrail.operators.intervals import union_duration
from iotrail.operators.stats import (
    LATENCY_BOUNDS,
    by_direction,
    fixed_histogram,
    histogram_percentile,
    nearest_rank,
    on_keys,
    shares,
)

SECOND = 1_000_000_000


def moved(operation: str | None = None) -> Column:
    """Bytes of reads and writes (or of one of them), zero for other commands."""
    wanted = F.col("operation").isin("read", "write") if operation is None else F.col("operation") == operation
    return F.when(wanted, F.col("bytes")).otherwise(F.lit(0))


def start_time() -> Column:
    return F.coalesce("insert_ts", "issue_ts", "complete_ts")


def session_summary(requests: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """One row: volumes, classes, depth, exact latency percentiles and busy/idle time.

    Latency missing from any request leaves the busy clock unknown.
    """
    totals = requests.agg(
        F.count(F.lit(1)).alias("completed"),
        F.sum(moved("read")).alias("read_bytes"),
        F.sum(moved("write")).alias("write_bytes"),
        F.sum(F.when(~F.col("operation").isin("read", "write"), F.col("bytes")).otherwise(F.lit(0))).alias("other_bytes"),
        F.count_if(F.col("access_pattern") == "sequential").alias("sequential"),
        F.count_if(F.col("access_pattern") == "random").alias("random"),
        F.count_if(F.col("size_class") == "small").alias("small"),
        F.count_if(F.col("size_class") == "large").alias("large"),
        F.max("queue_depth_at_issue").alias("max_queue_depth"),
        F.count("queue_depth_at_issue").alias("measured_depth"),
        F.count_if(F.col("total_ns").isNull()).alias("unmeasured_latency"),
        F.count_if(F.col("complete_ts").isNull()).alias("unplaced_time"),
        F.min(start_time()).alias("first_ns"),
        F.max("complete_ts").alias("last_ns"),
    )
    latency = nearest_rank(requests, [], "total_ns", [50, 95, 99])
    busy = union_duration(
        requests.select(start_time().alias("start_ns"), F.col("complete_ts").alias("end_ns")), [], keep_empty=True
    )
    logging = F.when(F.col("unplaced_time") == 0, F.col("last_ns") - F.col("first_ns"))
    out = (
        totals.join(latency, F.lit(True), "left")
        .join(busy, F.lit(True), "left")
        .withColumn("logging_ns", logging)
        .withColumn("busy_ns", F.when(F.col("unmeasured_latency") == 0, F.col("busy_ns")))
        .withColumn("idle_ns", at_least_zero(F.col("logging_ns") - F.col("busy_ns")))
        .drop("first_ns", "last_ns")
    )
    if counters is not None:
        # One row per session; the summary covers all of them.
        out = out.join(counters.agg(F.sum("issued").alias("issued"), F.sum("uncorrelated").alias("uncorrelated")), F.lit(True))
    return out


def category_summary(requests: DataFrame) -> DataFrame:
    """Per operation x access x size: count, bytes, integer mean chunk, exact percentiles."""
    keys = ["operation", "access_pattern", "size_class"]
    base = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("completed"), F.sum("bytes").alias("bytes"))
    base = base.withColumn("average_chunk", F.expr("bytes div completed"))
    return on_keys(base, nearest_rank(requests, keys, "total_ns", [50, 95, 99]), keys, "left")


def second_buckets(requests: DataFrame, issues: DataFrame) -> DataFrame:
    """Per second: completions, bytes and mean latency by completion; peak depth by issue.

    ``issues`` has ``ts_ns`` and ``total_depth`` of every issue event.
    """
    done = requests.groupBy(F.expr(f"complete_ts div {SECOND}").alias("second")).agg(
        F.count(F.lit(1)).alias("completed"), F.sum("bytes").alias("bytes"), F.avg("total_ns").alias("average_latency_ns")
    )
    depth = issues.groupBy(F.expr(f"ts_ns div {SECOND}").alias("second")).agg(F.max("total_depth").alias("max_queue_depth"))
    return done.join(depth, "second", "full").select(
        "second",
        F.coalesce("completed", F.lit(0)).alias("completed"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        "average_latency_ns",
        "max_queue_depth",
    )


def live_percentiles(requests: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Approximate percentiles from the fixed latency histogram: the bucket's upper bound."""
    histogram = fixed_histogram(requests, groups, "total_ns", LATENCY_BOUNDS)
    ranges = histogram_percentile(histogram, groups, [50, 95, 99], LATENCY_BOUNDS)
    return ranges.select(*groups, "percentile", "lower", "upper", F.coalesce("upper", "lower").alias("estimate"))


def direction_summary(requests: DataFrame) -> DataFrame:
    """Reads and writes: count, bytes, five chunk buckets and exact percentiles."""
    rw = requests.filter(F.col("operation").isin("read", "write"))
    size = F.col("bytes")
    chunk = [
        ("le_4k", size <= 4096),
        ("le_16k", (size > 4096) & (size <= 16384)),
        ("le_64k", (size > 16384) & (size <= 65536)),
        ("le_256k", (size > 65536) & (size <= 262144)),
        ("gt_256k", size > 262144),
    ]
    base = rw.groupBy("operation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *[F.count_if(c).alias(n) for n, c in chunk]
    )
    return on_keys(base, nearest_rank(rw, ["operation"], "total_ns", [50, 95, 99]), ["operation"], "left")


def access_counts(requests: DataFrame) -> DataFrame:
    return requests.agg(
        *[F.count_if(F.col("access_pattern") == a).alias(a) for a in ("random", "sequential", "unknown")]
    )


def category_shares(requests: DataFrame, dimensions: Sequence[str] = tuple(SHARE_DIMENSIONS)) -> DataFrame:
    """Count and moved bytes per label of every dimension, in one pass over the cohort."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), SHARE_DIMENSIONS[d]().alias("label")) for d in dimensions]
    )
    return (
        requests.select(F.explode(pairs).alias("s"), moved().alias("moved"))
        .groupBy("s.dimension", "s.label")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("moved").alias("payload"))
    )


def share_table(requests: DataFrame, top: int = 4) -> DataFrame:
    """Top labels of every dimension by count plus the remainder."""
    return shares(category_shares(requests), ["dimension"], "label", "n", top)


def process_targets(requests: DataFrame) -> DataFrame:
    """Per issuer: count, moved bytes and longest latency."""
    return requests.groupBy("pid", "tid", "comm").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(moved("read")).alias("read_bytes"),
        F.sum(moved("write")).alias("write_bytes"),
        F.max("total_ns").alias("max_latency_ns"),
    )


def selection_span(requests: DataFrame) -> DataFrame:
    """Span and throughput of a cohort; unknown when a request cannot be placed or the span is empty."""
    agg = requests.agg(
        F.min(start_time()).alias("lo"),
        F.max("complete_ts").alias("hi"),
        F.count_if(F.col("complete_ts").isNull()).alias("unplaced"),
        F.sum(moved("read")).alias("read_bytes"),
        F.sum(moved("write")).alias("write_bytes"),
    )
    span = F.when(F.col("unplaced") == 0, F.col("hi") - F.col("lo"))

    def rate(b: str) -> Column:
        return F.when(span > 0, F.col(b).cast("double") * 1e9 / span.cast("double") / 1048576.0)

    return agg.select(
        span.alias("duration_ns"),
        "read_bytes",
        "write_bytes",
        rate("read_bytes").alias("read_mib_s"),
        rate("write_bytes").alias("write_mib_s"),
    )


def trend_bins(requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """Per second since the origin: read/write counts and MiB."""
    second = F.call_function("div", F.col("complete_ts") - origin_ns, F.lit(SECOND))
    return requests.groupBy(second.alias("second")).agg(
        F.count_if(F.col("operation") == "read").alias("reads"),
        F.count_if(F.col("operation") == "write").alias("writes"),
        (F.sum(moved("read")) / 1048576.0).alias("read_mib"),
        (F.sum(moved("write")) / 1048576.0).alias("write_mib"),
    )


def trend_highlights(requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """Slowest request (earliest wins), busiest second (latest wins), top issuer (largest pid wins)."""
    slowest = requests.filter(F.col("total_ns").isNotNull()).agg(
        F.max_by(F.struct("request_id", "total_ns"), F.struct("total_ns", -F.col("seq"))).alias("s")
    )
    bins = trend_bins(requests, origin_ns)
    busiest = bins.agg(F.max(F.struct((F.col("read_mib") + F.col("write_mib")).alias("mib"), "second")).alias("b"))
    issuers = requests.groupBy("pid").agg(F.sum(moved()).alias("bytes"), F.count(F.lit(1)).alias("n"))
    top = issuers.agg(F.max(F.struct("bytes", "pid", "n")).alias("t"))
    return slowest.join(busiest, F.lit(True)).join(top, F.lit(True)).select(
        F.col("s.request_id").alias("slowest_request"),
        F.col("s.total_ns").alias("slowest_ns"),
        F.col("b.second").alias("busiest_second"),
        F.col("b.mib").alias("busiest_mib"),
        F.col("t.pid").alias("top_pid"),
        F.col("t.bytes").alias("top_bytes"),
        F.col("t.n").alias("top_requests"),
    )


def issuer_ranking(requests: DataFrame) -> DataFrame:
    """Requests and bytes per issuer label."""
    from iotrail.functions.scalars import issuer_label

    return requests.groupBy(issuer_label("pid", "tid", "comm").alias("issuer")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(moved()).alias("bytes")
    )


def transfer_bytes(requests: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return requests.groupBy(*groups).agg(
        F.sum(moved("read")).alias("read_bytes"),
        F.sum(moved("write")).alias("write_bytes"),
        F.sum(F.when(~F.col("operation").isin("read", "write"), F.col("bytes")).otherwise(F.lit(0))).alias("other_bytes"),
        F.sum(moved()).alias("total_bytes"),
    )


def companions(requests: DataFrame, axes: Sequence[str] = ("chunk_kib", "issue_queue_depth"), origin_ns: int = 0) -> DataFrame:
    """Long table (metric, direction, value) of companion distributions."""
    pairs = F.array(*[F.struct(F.lit(a).alias("metric"), AXES[a](origin_ns).alias("value")) for a in axes])
    long = by_direction(requests).select("direction", F.explode(pairs).alias("m"))
    return long.select("direction", "m.metric", "m.value")


def distribution_summary(long: DataFrame, groups: Sequence[str], value: str, percentiles: Sequence[int]) -> DataFrame:
    """Count, missing and percentiles of a long metric table."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sizes = long.groupBy(*groups).agg(F.count_if(finite).alias("n"), F.count_if(~finite).alias("missing"))
    return on_keys(sizes, nearest_rank(long.filter(finite), groups, value, percentiles), groups, "left")


def address_distributions(requests: DataFrame) -> DataFrame:
    """Address (MB) per device and direction."""
    return by_direction(requests).select(device_label().alias("device"), "direction", AXES["address_mb"](0).alias("value"))


def group_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unplottable")
    )


def heavy_hitters(requests: DataFrame, key: Column, top: int = 20) -> DataFrame:
    """Exact top keys by cumulative latency, with the covered share of the whole."""
    per_key = requests.groupBy(key.alias("target")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("bytes"),
        F.sum("total_ns").alias("cumulative_ns"),
        F.max("total_ns").alias("max_ns"),
    )
    ranked = per_key.orderBy(F.desc("cumulative_ns"), F.asc("target")).limit(top)
    whole = requests.agg(F.sum("total_ns").alias("total_metric"))
    covered = F.sum("cumulative_ns").over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("covered_metric", covered).join(whole, F.lit(True)).withColumn("evicted_keys", F.lit(0))
