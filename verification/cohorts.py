"""Requests: derived columns, filters, groups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from iotrail.functions import axes, filters, scalars
from iotrail.functions.timing import (
    completion_status,
    completion_time,
    issue_time,
    issuer_cpu,
    issuer_pid,
    issuer_tid,
    start_time,
    timing_confidence,
)
from iotrail.operators import stats
from iotrail.operators.correlate import completion_columns, issue_columns, queue_depths
from iotrail.plans import summary
from iotrail.sources import tables as T
from verification.base import EV, IO, Suite

SUITE = Suite()
add = SUITE.add

# The clock origin of the derived recording is its earliest block record.
ORIGIN = "(SELECT min(insert_ts) FROM req)"


def origin(spark, d):
    return T.requests(spark, d).agg(F.min("insert_ts")).first()[0]


@add(
    "latency_summary",
    """, g AS (SELECT operation, access_pattern, size_class, total_ns, bytes,
         row_number() OVER w AS rn, count(*) OVER (PARTITION BY operation, access_pattern, size_class) AS n
       FROM io WINDOW w AS (PARTITION BY operation, access_pattern, size_class ORDER BY total_ns))
    SELECT operation, access_pattern, size_class, count(*) AS completed, cast(sum(bytes) AS bigint) AS bytes,
      cast(sum(bytes) // count(*) AS bigint) AS average_chunk,
      max(CASE WHEN rn = greatest(1, (50 * n + 99) // 100) THEN total_ns END) AS p50,
      max(CASE WHEN rn = greatest(1, (95 * n + 99) // 100) THEN total_ns END) AS p95,
      max(CASE WHEN rn = greatest(1, (99 * n + 99) // 100) THEN total_ns END) AS p99
    FROM g GROUP BY ALL""",
    IO,
)
def latency_summary(spark, d):
    return summary.category_summary(T.requests(spark, d))


@add(
    "session_summary",
    """, iv AS (SELECT insert_ts AS s, complete_ts AS e FROM io),
    m AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
    isl AS (SELECT s, e, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
    busy AS (SELECT cast(sum(e - s) AS bigint) AS busy_ns FROM (SELECT min(s) AS s, max(e) AS e FROM isl GROUP BY g)),
    r AS (SELECT total_ns, row_number() OVER (ORDER BY total_ns) AS rn, count(*) OVER () AS n FROM io)
    SELECT count(*) AS completed, cast(sum(CASE WHEN operation='read' THEN bytes ELSE 0 END) AS bigint) AS read_bytes,
      cast(sum(CASE WHEN operation='write' THEN bytes ELSE 0 END) AS bigint) AS write_bytes,
      cast(sum(CASE WHEN operation NOT IN ('read','write') THEN bytes ELSE 0 END) AS bigint) AS other_bytes,
      count(*) FILTER (access_pattern='sequential') AS sequential, count(*) FILTER (access_pattern='random') AS random,
      count(*) FILTER (size_class='small') AS small, count(*) FILTER (size_class='large') AS large,
      cast(max(queue_depth_at_issue) AS bigint) AS max_queue_depth, count(queue_depth_at_issue) AS measured_depth,
      0 AS unmeasured_latency, 0 AS unplaced_time,
      (SELECT max(total_ns) FROM r WHERE rn = (50*n+99)//100) AS p50,
      (SELECT max(total_ns) FROM r WHERE rn = (95*n+99)//100) AS p95,
      (SELECT max(total_ns) FROM r WHERE rn = (99*n+99)//100) AS p99,
      max(complete_ts) - min(insert_ts) AS logging_ns, (SELECT busy_ns FROM busy) AS busy_ns,
      max(complete_ts) - min(insert_ts) - (SELECT busy_ns FROM busy) AS idle_ns,
      count(*) AS issued, 0 AS uncorrelated
    FROM io""",
    IO,
)
def session_summary(spark, d):
    from iotrail.operators.correlate import correlation_counters

    return summary.session_summary(T.requests(spark, d), correlation_counters(T.block_lifetimes(spark, d)))


@add(
    "retained_summary",
    """, c AS (SELECT * FROM io WHERE operation = 'read' AND bytes >= 32768),
    r AS (SELECT total_ns, row_number() OVER (ORDER BY total_ns) AS rn, count(*) OVER () AS n FROM c)
    SELECT count(*) AS completed, cast(sum(bytes) AS bigint) AS read_bytes,
      count(*) FILTER (access_pattern='sequential') AS sequential, count(*) FILTER (access_pattern='random') AS random,
      (SELECT max(total_ns) FROM r WHERE rn = (50*n+99)//100) AS p50,
      (SELECT max(total_ns) FROM r WHERE rn = (99*n+99)//100) AS p99,
      (SELECT count(*) FROM io) AS issued
    FROM c""",
    IO,
)
def retained_summary(spark, d):
    cohort = filters.CohortFilter(operation="read", min_bytes=32768).apply(T.requests(spark, d))
    issued = T.block_events(spark, d).filter("kind = 'issue'").agg(F.count(F.lit(1)).alias("issued"))
    kept = summary.session_summary(cohort).join(issued, F.lit(True))
    return kept.select("completed", "read_bytes", "sequential", "random", "p50", "p99", "issued")


DERIVED = [
    "request_id", "access_pattern", "size_class", "issue_gap_ns", "completion_gap_ns", "issue_depth",
    "queue_depth_at_issue", "queue_depth_after", "queue_ns", "device_ns", "total_ns",
    "issue_rate_payload", "issue_rate_duration", "completion_rate_payload", "completion_rate_duration",
]


@add(
    "completed_requests",
    """SELECT request_id, access_pattern, size_class, issue_gap_ns, completion_gap_ns,
      cast(issue_depth AS bigint) AS issue_depth, cast(queue_depth_at_issue AS bigint) AS queue_depth_at_issue,
      cast(queue_depth_after AS bigint) AS queue_depth_after, queue_ns, device_ns, total_ns,
      cast(issue_rate_payload AS bigint) AS issue_rate_payload, cast(issue_rate_duration AS bigint) AS issue_rate_duration,
      cast(completion_rate_payload AS bigint) AS completion_rate_payload,
      cast(completion_rate_duration AS bigint) AS completion_rate_duration FROM io""",
    IO,
)
def completed_requests(spark, d):
    return T.requests(spark, d).select(*DERIVED)


@add(
    "access_pattern_by_device",
    """SELECT major || ':' || minor AS device, operation, access_pattern, count(*) AS n FROM io GROUP BY ALL""",
    IO,
)
def access_pattern_by_device(spark, d):
    # Small blocks, so every carried window crosses many borders.
    rows = issue_columns(T.block_lifetimes(spark, d), shift=8)
    return rows.groupBy(scalars.device_label().alias("device"), "operation", "access_pattern").agg(
        F.count(F.lit(1)).alias("n")
    )


@add(
    "issue_gaps",
    "SELECT request_id, issue_gap_ns, cast(issue_rate_payload AS bigint) AS issue_rate_payload, cast(issue_rate_duration AS bigint) AS issue_rate_duration FROM io",
    IO,
)
def issue_gaps(spark, d):
    return issue_columns(T.block_lifetimes(spark, d), shift=8).select(
        "request_id", "issue_gap_ns", "issue_rate_payload", "issue_rate_duration"
    )


@add(
    "completion_gaps",
    "SELECT request_id, completion_gap_ns, cast(completion_rate_payload AS bigint) AS completion_rate_payload, cast(completion_rate_duration AS bigint) AS completion_rate_duration FROM io",
    IO,
)
def completion_gaps(spark, d):
    return completion_columns(T.block_lifetimes(spark, d), shift=8).select(
        "request_id", "completion_gap_ns", "completion_rate_payload", "completion_rate_duration"
    )


@add(
    "queue_depth_sweep",
    """SELECT request_id, cast(issue_depth AS bigint) AS device_depth, cast(queue_depth_at_issue AS bigint) AS total_depth FROM io""",
    IO,
)
def queue_depth_sweep(spark, d):
    life = T.block_lifetimes(spark, d)
    depth = queue_depths(life, shift=8)
    return life.filter("kind = 'issue'").join(depth, ["session_id", "seq"]).select("request_id", "device_depth", "total_depth")


@add(
    "previous_completion_of_id",
    """, c AS (SELECT event_id, event_id % 64 AS id, minor, complete_ts FROM req)
    SELECT event_id % 64 AS request_id, complete_ts,
      lag(complete_ts) OVER (PARTITION BY id ORDER BY complete_ts, event_id) AS previous_completion_ts,
      greatest(insert_ts - 30000000000, coalesce(lag(complete_ts) OVER (PARTITION BY id ORDER BY complete_ts, event_id) + 1, insert_ts - 30000000000)) AS evidence_from
    FROM (SELECT r.*, r.event_id % 64 AS id FROM req r)""",
    EV,
)
def previous_completion_of_id(spark, d):
    """Lifetime lower bound when ids come from a small pool of tags."""
    from iotrail.plans.evidence import evidence_windows

    rows = T.request_rows(spark, d).withColumn("request_id", F.col("event_id") % 64).withColumn("session_id", F.lit("s"))
    return evidence_windows(rows, order="event_id").select(
        "request_id", "complete_ts", "previous_completion_ts", "evidence_from"
    )


# -- timing rules -----------------------------------------------------------


def observed(spark, d):
    """Requests of which every fifth was observed without a kernel id."""
    ev = F.struct(
        F.col("request_id").alias("record_id"),
        F.lit("trace").alias("source"),
        (F.col("request_id") % 2).alias("clock"),
        F.when(F.col("request_id") % 3 != 0, F.col("issue_ts") + 7).alias("issue_ts"),
        F.when(F.col("request_id") % 4 != 0, F.col("pid") + 1).alias("pid"),
        F.lit(None).cast("long").alias("tid"),
        F.lit(None).cast("long").alias("cpu"),
        F.lit(None).cast("int").alias("status"),
        F.lit("probable").alias("timing_confidence"),
    )
    return T.requests(spark, d).withColumn("evidence", F.when(F.col("request_id") % 5 == 0, ev))


@add(
    "timing_rules",
    """SELECT request_id,
      CASE WHEN request_id % 5 <> 0 OR request_id % 2 = 0 THEN complete_ts END AS completion_ns,
      CASE WHEN request_id % 5 <> 0 THEN issue_ts WHEN request_id % 2 = 0 AND request_id % 3 <> 0 THEN issue_ts + 7 END AS issue_ns,
      CASE WHEN request_id % 5 <> 0 OR request_id % 2 = 0 THEN insert_ts END AS start_ns,
      CASE WHEN request_id % 5 <> 0 THEN pid WHEN request_id % 4 <> 0 THEN pid + 1 END AS issuer_pid,
      CASE WHEN request_id % 5 <> 0 THEN tid END AS issuer_tid,
      CASE WHEN request_id % 5 <> 0 THEN cpu END AS issuer_cpu,
      CASE WHEN request_id % 5 <> 0 THEN status END AS result_status,
      CASE WHEN request_id % 5 <> 0 THEN 'exact' ELSE 'probable' END AS timing_confidence
    FROM io""",
    IO,
)
def timing_rules(spark, d):
    return observed(spark, d).select(
        "request_id",
        completion_time().alias("completion_ns"),
        issue_time().alias("issue_ns"),
        start_time().alias("start_ns"),
        issuer_pid().alias("issuer_pid"),
        issuer_tid().alias("issuer_tid"),
        issuer_cpu().alias("issuer_cpu"),
        completion_status().alias("result_status"),
        timing_confidence().alias("timing_confidence"),
    )


@add(
    "unplaceable_time",
    """SELECT count(*) AS n, cast(sum(bytes) AS bigint) AS bytes,
      count(*) FILTER (request_id % 5 = 0 AND request_id % 2 = 1) AS unplaced FROM io""",
    IO,
)
def unplaceable_time(spark, d):
    return observed(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(completion_time().isNull()).alias("unplaced")
    )


# -- filters ----------------------------------------------------------------


@add(
    "cohort_filter",
    """SELECT request_id, total_ns, access_pattern FROM io
    WHERE total_ns >= 1048576 AND total_ns < 1073741824 AND operation = 'read' AND access_pattern = 'random'
      AND bytes >= 8192 AND bytes <= 262144 AND lower(comm) LIKE '%ser-3%' AND major || ':' || minor = '8:1'
      AND cpu = 5""",
    IO,
)
def cohort_filter(spark, d):
    f = filters.CohortFilter(
        latency_min_ns=1 << 20,
        latency_max_ns=1 << 30,
        operation="read",
        access="random",
        min_bytes=8192,
        max_bytes=262144,
        process="SER-3",
        device="8:1",
        cpu=5,
    )
    return f.apply(T.requests(spark, d)).select("request_id", "total_ns", "access_pattern")


@add(
    "cohort_filter_time_and_issuer",
    f"""SELECT request_id FROM io WHERE pid = 42 AND
      greatest(complete_ts - {ORIGIN}, 0) / 1e6 BETWEEN 100000.0 AND 2000000.0""",
    IO,
)
def cohort_filter_time_and_issuer(spark, d):
    f = filters.CohortFilter(pid=42, start_ms=100_000.0, end_ms=2_000_000.0)
    return f.apply(T.requests(spark, d), origin_ns=origin(spark, d)).select("request_id")


@add(
    "cohort_by_request_keys",
    """SELECT io.request_id, io.total_ns FROM io WHERE total_ns >= 1000000000""",
    IO,
)
def cohort_by_request_keys(spark, d):
    io = T.requests(spark, d)
    keys = io.filter(F.col("total_ns") >= 1_000_000_000).select(*filters.REQUEST_KEY)
    return filters.CohortFilter().apply(io, keys=keys).select("request_id", "total_ns")


@add(
    "filter_keeps_derived_columns",
    """SELECT request_id, issue_gap_ns, cast(issue_depth AS bigint) AS issue_depth, access_pattern FROM io WHERE operation = 'write'""",
    IO,
)
def filter_keeps_derived_columns(spark, d):
    return T.requests(spark, d).filter("operation = 'write'").select("request_id", "issue_gap_ns", "issue_depth", "access_pattern")


@add(
    "completion_window",
    """SELECT request_id FROM io WHERE complete_ts BETWEEN (SELECT min(complete_ts) FROM io) + 100000000000
      AND (SELECT min(complete_ts) FROM io) + 900000000000""",
    IO,
)
def completion_window(spark, d):
    io = T.requests(spark, d)
    first = io.agg(F.min("complete_ts")).first()[0]
    return io.filter(F.col("complete_ts").between(first + 100_000_000_000, first + 900_000_000_000)).select("request_id")


@add(
    "latency_bucket_drag",
    """, b AS (SELECT request_id, length(bin(greatest(total_ns, 1))) - 1 AS bucket, total_ns FROM io WHERE operation = 'write'),
    r AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b WHERE bucket - 0.4 <= 28.2 AND bucket + 0.4 >= 24.7)
    SELECT request_id, total_ns FROM b, r WHERE total_ns >= (1::bigint << lo) AND total_ns < (1::bigint << (hi + 1))""",
    IO,
)
def latency_bucket_drag(spark, d):
    """Buckets under a dragged range of the latency histogram become a half-open latency range."""
    io = T.requests(spark, d).filter("operation = 'write'")
    bucket = stats.log2_bucket("total_ns")
    hit = io.filter((bucket - 0.4 <= 28.2) & (bucket + 0.4 >= 24.7)).agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    lo, hi = hit.first()
    low, high = filters.latency_bucket_range(lo, hi)
    return filters.CohortFilter(latency_min_ns=low, latency_max_ns=high).apply(io).select("request_id", "total_ns")


@add(
    "second_drilldown",
    """SELECT request_id, complete_ts FROM io WHERE complete_ts >= (SELECT min(complete_ts) // 1000000000 + 1800 FROM io) * 1000000000
      AND complete_ts < (SELECT min(complete_ts) // 1000000000 + 1801 FROM io) * 1000000000""",
    IO,
)
def second_drilldown(spark, d):
    io = T.requests(spark, d)
    second = io.agg(F.min("complete_ts")).first()[0] // 1_000_000_000 + 1800
    return io.filter(filters.second_range(second)).select("request_id", "complete_ts")


@add(
    "rectangle_selection",
    """SELECT count(*) AS source_rows, count(*) FILTER (completion_gap_ns IS NULL) AS unplottable,
      count(*) FILTER (bytes / 1024.0 BETWEEN 40.0 AND 200.0 AND completion_gap_ns / 1e6 BETWEEN 10.0 AND 500.0) AS selected
    FROM io""",
    IO,
)
def rectangle_selection(spark, d):
    x, y = axes.AXES["chunk_kib"](0), axes.AXES["completion_gap_ms"](0)
    return T.requests(spark, d).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(filters.unplottable(x, y)).alias("unplottable"),
        F.count_if(filters.rectangle(x, y, (40.0, 10.0), (200.0, 500.0))).alias("selected"),
    )


@add(
    "capture_filter",
    """SELECT count(*) AS n, cast(sum(bytes) AS bigint) AS bytes FROM req
      WHERE pid IN (1,2,3,5,8,13,21,34) AND operation IN ('read','write') AND major || ':' || minor IN ('8:1','8:2')
        AND bytes >= 4096 AND bytes <= 300000 AND pid <> 13""",
    EV,
)
def capture_filter(spark, d):
    keep = filters.capture_filter(
        pids=[1, 2, 3, 5, 8, 13, 21, 34],
        operations=["read", "write"],
        devices=["8:1", "8:2"],
        min_bytes=4096,
        max_bytes=300_000,
        collector_pid=13,
    )
    return T.requests(spark, d).filter(keep).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@add(
    "detail_policy",
    """SELECT CASE WHEN status <> 0 THEN 'error'
           WHEN total_ns >= 5000000 OR queue_ns >= 1000000 OR device_ns >= 3000000 THEN 'slow'
           WHEN request_id % 10000 < 100 THEN 'sampled' ELSE 'suppressed' END AS reason,
      count(*) AS n, cast(sum(bytes) AS bigint) AS bytes FROM io GROUP BY 1""",
    IO,
)
def detail_policy(spark, d):
    return (
        T.requests(spark, d)
        .groupBy(F.coalesce(filters.detail_reason(100), F.lit("suppressed")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    )


@add(
    "capture_counters",
    """SELECT count(*) AS observed, cast(sum(bytes) AS bigint) AS bytes, count(*) FILTER (status <> 0) AS failed,
      count(*) FILTER (operation <> 'discard') AS filter_passed, count(*) FILTER (operation = 'discard') AS filter_suppressed,
      count(*) FILTER (operation <> 'discard' AND (total_ns >= 5000000 OR queue_ns >= 1000000 OR device_ns >= 3000000 OR request_id % 10000 < 100 OR status <> 0)) AS detail,
      count(*) FILTER (operation <> 'discard' AND NOT (total_ns >= 5000000 OR queue_ns >= 1000000 OR device_ns >= 3000000 OR request_id % 10000 < 100 OR status <> 0)) AS suppressed_fast,
      count(*) FILTER (operation <> 'discard' AND request_id % 10000 < 100) AS sampled,
      count(*) FILTER (operation <> 'discard' AND status <> 0) AS forced_error,
      count(*) FILTER (operation <> 'discard' AND NOT (total_ns >= 5000000 OR queue_ns >= 1000000 OR device_ns >= 3000000 OR request_id % 10000 < 100 OR status <> 0)) * 100.0
        / count(*) FILTER (operation <> 'discard') AS suppressed_percent
    FROM io""",
    IO,
)
def capture_counters(spark, d):
    passed = filters.capture_filter(operations=["read", "write"])
    kept = filters.detail_reason(100).isNotNull()
    out = T.requests(spark, d).agg(
        F.count(F.lit(1)).alias("observed"),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("status") != 0).alias("failed"),
        F.count_if(passed).alias("filter_passed"),
        F.count_if(~passed).alias("filter_suppressed"),
        F.count_if(passed & kept).alias("detail"),
        F.count_if(passed & ~kept).alias("suppressed_fast"),
        F.count_if(passed & (F.col("request_id") % 10000 < 100)).alias("sampled"),
        F.count_if(passed & (F.col("status") != 0)).alias("forced_error"),
    )
    total = F.col("detail") + F.col("suppressed_fast")
    return out.withColumn("suppressed_percent", scalars.ratio_percent(F.col("suppressed_fast"), total))


# -- axes, groups, categories -------------------------------------------------


@add(
    "numeric_axes",
    f"""SELECT request_id, greatest(complete_ts - {ORIGIN}, 0) / 1e6 AS time_ms, cast(sector AS double) AS sector, sector / 2.0::double AS address_kib,
      sector * 512.0::double / 1e6 AS address_mb, bytes / 1024.0::double AS chunk_kib, total_ns / 1e6 AS total_latency_ms,
      queue_ns / 1e6 AS queue_latency_ms, device_ns / 1e6 AS device_latency_ms, cast(pid AS double) AS pid,
      cast(queue_depth_after AS double) AS queue_depth, cast(queue_depth_at_issue AS double) AS queue_depth_at_issue,
      cast(issue_depth AS double) AS issue_queue_depth, issue_gap_ns / 1e6 AS issue_gap_ms,
      completion_gap_ns / 1e6 AS completion_gap_ms,
      CASE WHEN operation IN ('read','write') AND bytes > 0 THEN device_ns / 1e6 / (bytes / 1024.0::double) END AS latency_per_kib,
      cast(cpu AS double) AS issue_cpu,
      cast(completion_rate_payload AS double) * 1e9 / cast(completion_rate_duration AS double) / 1048576.0::double AS rolling_c2c_mib_s,
      cast(issue_rate_payload AS double) * 1e9 / cast(issue_rate_duration AS double) / 1048576.0::double AS rolling_d2d_mib_s
    FROM io""",
    IO,
)
def numeric_axes(spark, d):
    start = origin(spark, d)
    graph = {"filesystem_ms", "ufs_ms", "critical_path_ms"}
    return T.requests(spark, d).select(
        "request_id", *[f(start).alias(n) for n, f in axes.AXES.items() if n not in graph]
    )


@add(
    "request_groups",
    """SELECT request_id, 'All I/O' AS none, operation AS direction, access_pattern AS access, size_class AS size,
      comm || ' (' || pid || ')' AS process FROM io""",
    IO,
)
def request_groups(spark, d):
    plain = ("none", "direction", "access", "size", "process")
    return T.requests(spark, d).select("request_id", *[axes.GROUPS[g]().alias(g) for g in plain])


@add(
    "category_axis_positions",
    """, l AS (SELECT request_id, major || ':' || minor || ' / ' || comm || ' · PID ' || pid AS label FROM io)
    SELECT request_id, label, dense_rank() OVER (ORDER BY label) - 1 AS position FROM l""",
    IO,
)
def category_axis_positions(spark, d):
    return axes.categorical(T.requests(spark, d), "process").select("request_id", "label", "position")


@add(
    "custom_exploration",
    """SELECT request_id, bytes / 1024.0::double AS x, device_ns / 1e6 AS y, size_class AS grp FROM io""",
    IO,
)
def custom_exploration(spark, d):
    return axes.explore(T.requests(spark, d), "chunk_kib", "device_latency_ms", "size", 0)


# -- aggregations --------------------------------------------------------------


@add(
    "second_buckets",
    """, a AS (SELECT complete_ts // 1000000000 AS second, count(*) AS completed, cast(sum(bytes) AS bigint) AS bytes,
        cast(sum(total_ns) AS double) / count(*) AS average_latency_ns FROM io GROUP BY 1),
    b AS (SELECT issue_ts // 1000000000 AS second, cast(max(queue_depth_at_issue) AS bigint) AS max_queue_depth FROM io GROUP BY 1)
    SELECT coalesce(a.second, b.second) AS second, coalesce(completed, 0) AS completed, coalesce(bytes, 0) AS bytes,
      average_latency_ns, max_queue_depth FROM a FULL JOIN b ON a.second = b.second""",
    IO,
)
def second_buckets(spark, d):
    io = T.requests(spark, d)
    issues = io.select(F.col("issue_ts").alias("ts_ns"), F.col("queue_depth_at_issue").alias("total_depth"))
    return summary.second_buckets(io, issues)


@add(
    "exact_percentiles",
    """, g AS (SELECT operation, device_ns AS v, row_number() OVER (PARTITION BY operation ORDER BY device_ns) AS rn,
        count(*) OVER (PARTITION BY operation) AS n FROM io)
    SELECT operation, """
    + ", ".join(f"max(CASE WHEN rn = greatest(1, ({p} * n + 99) // 100) THEN v END) AS p{p}" for p in stats.PERCENTILES)
    + " FROM g GROUP BY 1",
    IO,
)
def exact_percentiles(spark, d):
    return stats.nearest_rank(T.requests(spark, d), ["operation"], "device_ns", stats.PERCENTILES)


@add(
    "exact_percentiles_large",
    """WITH g AS (SELECT l_returnflag, l_extendedprice AS v,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn,
        count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, """
    + ", ".join(f"max(CASE WHEN rn = greatest(1, ({p} * n + 99) // 100) THEN v END) AS p{p}" for p in stats.PERCENTILES)
    + " FROM g GROUP BY 1",
)
def exact_percentiles_large(spark, d):
    return stats.nearest_rank(T.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", stats.PERCENTILES)


BOUNDS_SQL = "[" + ",".join(str(b) for b in stats.LATENCY_BOUNDS) + "]"


@add(
    "latency_histogram",
    f""", h AS (SELECT operation, (SELECT count(*) FROM (SELECT unnest({BOUNDS_SQL}) AS b) WHERE b < total_ns) AS bucket FROM io)
    SELECT operation, bucket, count(*) AS n, ({BOUNDS_SQL})[bucket + 1] AS upper FROM h GROUP BY ALL""",
    IO,
)
def latency_histogram(spark, d):
    return stats.fixed_histogram(T.requests(spark, d), ["operation"], "total_ns", stats.LATENCY_BOUNDS)


@add(
    "live_percentiles",
    f""", h AS (SELECT operation, bucket, count(*) AS n FROM
      (SELECT operation, (SELECT count(*) FROM (SELECT unnest({BOUNDS_SQL}) AS b) WHERE b < total_ns) AS bucket FROM io) GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY operation ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY operation) AS total FROM h),
    p AS (SELECT * FROM c, (SELECT unnest([50, 95, 99]) AS percentile))
    SELECT operation, percentile, CASE WHEN bucket = 0 THEN 0 ELSE ({BOUNDS_SQL})[bucket] + 1 END AS lower,
      ({BOUNDS_SQL})[bucket + 1] AS upper,
      coalesce(({BOUNDS_SQL})[bucket + 1], ({BOUNDS_SQL})[bucket] + 1) AS estimate
    FROM p WHERE upto >= (total * percentile + 99) // 100 AND upto - n < (total * percentile + 99) // 100""",
    IO,
)
def live_percentiles(spark, d):
    return summary.live_percentiles(T.requests(spark, d), ["operation"])


@add(
    "log2_latency_histogram",
    "SELECT operation, length(bin(greatest(total_ns, 1))) - 1 AS bucket, count(*) AS n FROM io GROUP BY ALL",
    IO,
)
def log2_latency_histogram(spark, d):
    return (
        T.requests(spark, d)
        .groupBy("operation", stats.log2_bucket("total_ns").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@add(
    "clamped_log2_histogram",
    """SELECT least(length(bin(greatest(device_ns, 1))) - 1, 31) AS bucket, count(*) AS n,
      (2::bigint << least(length(bin(greatest(device_ns, 1))) - 1, 31)) - 1 AS upper FROM io GROUP BY ALL""",
    IO,
)
def clamped_log2_histogram(spark, d):
    bucket = F.least(stats.log2_bucket("device_ns"), F.lit(31))
    return (
        T.requests(spark, d)
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upper", F.expr("shiftleft(2L, bucket) - 1"))
    )


def equal_width_sql(src: str, groups: str, value: str, bins: int) -> str:
    g = f"{groups}, " if groups else ""
    using = f"USING ({groups})" if groups else "ON true"
    return f""", src AS ({src}),
    st AS (SELECT {g}min(v) AS lo, max(v) AS hi, count(v) AS n, count(*) - count(v) AS missing FROM (SELECT {g}{value} AS v FROM src) GROUP BY ALL),
    ed AS (SELECT *, CASE WHEN lo = hi THEN 1 ELSE least({bins}, n) END AS bins FROM st WHERE n > 0),
    wd AS (SELECT *, (hi - lo) / bins AS width FROM ed),
    fr AS (SELECT {g}missing, lo, hi, width, bins, unnest(generate_series(0, bins - 1)) AS bin FROM wd),
    fx AS (SELECT {g}missing, bin, lo + cast(bin AS double) * width AS lower,
        CASE WHEN bin + 1 = bins THEN hi ELSE lo + cast(bin + 1 AS double) * width END AS upper, bin + 1 = bins AS last FROM fr)
    SELECT {", ".join("fx." + x.strip() for x in groups.split(",")) + ", " if groups else ""}missing, bin, lower, upper,
      (SELECT count(*) FROM src WHERE {value} >= lower AND ({value} < upper OR last)
        {"".join(f" AND src.{x.strip()} = fx.{x.strip()}" for x in groups.split(",")) if groups else ""}) AS n FROM fx"""


@add(
    "equal_width_histogram",
    equal_width_sql("SELECT operation, total_ns / 1e6 AS value FROM io", "operation", "value", 24),
    IO,
)
def equal_width_histogram(spark, d):
    io = T.requests(spark, d).select("operation", axes.AXES["total_latency_ms"](0).alias("value"))
    return stats.equal_width_histogram(io, ["operation"], "value", 24)


@add(
    "violin_shape",
    equal_width_sql("SELECT operation, bytes / 1024.0::double AS value FROM io", "operation", "value", 24).replace(
        "SELECT fx.operation", ", res AS (SELECT fx.operation"
    )
    + """) SELECT operation, bin, n, cast(n AS double) / max(n) OVER (PARTITION BY operation) AS half_width FROM res""",
    IO,
)
def violin_shape(spark, d):
    from pyspark.sql.window import Window

    io = T.requests(spark, d).select("operation", axes.AXES["chunk_kib"](0).alias("value"))
    peak = F.max("n").over(Window.partitionBy("operation"))
    return stats.equal_width_histogram(io, ["operation"], "value", 24).select(
        "operation", "bin", "n", (F.col("n").cast("double") / peak).alias("half_width")
    )


DIRECTIONS = """(SELECT *, 'total' AS direction FROM io UNION ALL
    SELECT *, CASE WHEN operation IN ('read','write') THEN operation ELSE 'other' END AS direction FROM io)"""


@add(
    "distribution_by_direction",
    f""", g AS (SELECT direction, issue_gap_ns AS v, row_number() OVER (PARTITION BY direction ORDER BY issue_gap_ns NULLS LAST) AS rn,
        count(issue_gap_ns) OVER (PARTITION BY direction) AS n FROM {DIRECTIONS})
    SELECT direction, max(n) AS n, count(*) - max(n) AS missing, """
    + ", ".join(f"max(CASE WHEN rn = greatest(1, ({p} * n + 99) // 100) THEN v / 1e6 END) AS p{p}" for p in (0, 50, 95, 100))
    + " FROM g GROUP BY 1",
    IO,
)
def distribution_by_direction(spark, d):
    long = stats.by_direction(T.requests(spark, d)).select("direction", axes.AXES["issue_gap_ms"](0).alias("value"))
    return summary.distribution_summary(long, ["direction"], "value", [0, 50, 95, 100])


@add(
    "companion_distributions",
    f""", m AS (SELECT direction, 'chunk_kib' AS metric, bytes / 1024.0::double AS v FROM {DIRECTIONS}
        UNION ALL SELECT direction, 'issue_queue_depth', cast(issue_depth AS double) FROM {DIRECTIONS}),
    g AS (SELECT *, row_number() OVER (PARTITION BY direction, metric ORDER BY v) AS rn, count(*) OVER (PARTITION BY direction, metric) AS n FROM m)
    SELECT direction, metric, max(n) AS n, 0 AS missing, """
    + ", ".join(f"max(CASE WHEN rn = (({p} * n + 99) // 100) THEN v END) AS p{p}" for p in (50, 99))
    + " FROM g GROUP BY ALL",
    IO,
)
def companion_distributions(spark, d):
    return summary.distribution_summary(
        summary.companions(T.requests(spark, d)), ["direction", "metric"], "value", [50, 99]
    )


@add(
    "address_distributions",
    f""", g AS (SELECT major || ':' || minor AS device, direction, sector * 512.0::double / 1e6 AS v FROM {DIRECTIONS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY device, direction ORDER BY v) AS rn, count(*) OVER (PARTITION BY device, direction) AS n FROM g)
    SELECT device, direction, max(n) AS n, 0 AS missing, max(CASE WHEN rn = ((50 * n + 99) // 100) THEN v END) AS p50,
      max(CASE WHEN rn = ((90 * n + 99) // 100) THEN v END) AS p90 FROM r GROUP BY ALL""",
    IO,
)
def address_distributions(spark, d):
    return summary.distribution_summary(
        summary.address_distributions(T.requests(spark, d)), ["device", "direction"], "value", [50, 90]
    )


@add(
    "cumulative_distribution",
    """, c AS (SELECT operation, bytes AS value, count(*) AS n FROM io GROUP BY ALL)
    SELECT operation, value, sum(n) OVER (PARTITION BY operation ORDER BY value) * 100.0::double / sum(n) OVER (PARTITION BY operation) AS percent FROM c""",
    IO,
)
def cumulative_distribution(spark, d):
    return stats.ecdf(T.requests(spark, d), ["operation"], "bytes")


@add(
    "direction_summary",
    """, g AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY total_ns) AS rn, count(*) OVER (PARTITION BY operation) AS c FROM io
        WHERE operation IN ('read','write'))
    SELECT operation, count(*) AS n, cast(sum(bytes) AS bigint) AS bytes, count(*) FILTER (bytes <= 4096) AS le_4k,
      count(*) FILTER (bytes > 4096 AND bytes <= 16384) AS le_16k, count(*) FILTER (bytes > 16384 AND bytes <= 65536) AS le_64k,
      count(*) FILTER (bytes > 65536 AND bytes <= 262144) AS le_256k, count(*) FILTER (bytes > 262144) AS gt_256k,
      max(CASE WHEN rn = (50 * c + 99) // 100 THEN total_ns END) AS p50, max(CASE WHEN rn = (95 * c + 99) // 100 THEN total_ns END) AS p95,
      max(CASE WHEN rn = (99 * c + 99) // 100 THEN total_ns END) AS p99 FROM g GROUP BY 1""",
    IO,
)
def direction_summary(spark, d):
    return summary.direction_summary(T.requests(spark, d))


@add(
    "access_counts",
    """SELECT count(*) FILTER (access_pattern='random') AS random, count(*) FILTER (access_pattern='sequential') AS sequential,
      count(*) FILTER (access_pattern='unknown') AS "unknown" FROM io""",
    IO,
)
def access_counts(spark, d):
    return summary.access_counts(T.requests(spark, d))


SHARES = """, s AS (
      SELECT 'command' AS dimension, operation AS label, operation, bytes FROM io
      UNION ALL SELECT 'access_pattern', access_pattern, operation, bytes FROM io
      UNION ALL SELECT 'size_class', size_class, operation, bytes FROM io
      UNION ALL SELECT 'chunk_size', bytes || ' B', operation, bytes FROM io
      UNION ALL SELECT 'command_access_size', operation || ' / ' || access_pattern || ' / ' || size_class, operation, bytes FROM io
      UNION ALL SELECT 'device', major || ':' || minor, operation, bytes FROM io
      UNION ALL SELECT 'issue_cpu', cpu::varchar, operation, bytes FROM io
      UNION ALL SELECT 'completion_cpu', complete_cpu::varchar, operation, bytes FROM io
      UNION ALL SELECT 'process', major || ':' || minor || ' / ' || comm || ' · PID ' || pid, operation, bytes FROM io),
    sh AS (SELECT dimension, label, count(*) AS n, cast(sum(CASE WHEN operation IN ('read','write') THEN bytes ELSE 0 END) AS bigint) AS payload FROM s GROUP BY ALL)"""


@add("category_shares", SHARES + " SELECT * FROM sh", IO)
def category_shares(spark, d):
    return summary.category_shares(T.requests(spark, d))


@add(
    "share_table",
    SHARES
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label) AS rn FROM sh),
    m AS (SELECT dimension, CASE WHEN rn <= 4 THEN label ELSE 'remainder' END AS label, rn > 4 AS is_remainder, cast(sum(n) AS bigint) AS n FROM r GROUP BY ALL)
    SELECT *, n * 100.0::double / sum(n) OVER (PARTITION BY dimension) AS percent FROM m""",
    IO,
)
def share_table(spark, d):
    return summary.share_table(T.requests(spark, d))


@add(
    "process_targets",
    """SELECT pid, tid, comm, count(*) AS n, cast(sum(CASE WHEN operation='read' THEN bytes ELSE 0 END) AS bigint) AS read_bytes,
      cast(sum(CASE WHEN operation='write' THEN bytes ELSE 0 END) AS bigint) AS write_bytes, max(total_ns) AS max_latency_ns FROM io GROUP BY ALL""",
    IO,
)
def process_targets(spark, d):
    return summary.process_targets(T.requests(spark, d))


@add(
    "selection_span",
    """, c AS (SELECT max(complete_ts) - min(insert_ts) AS duration_ns, cast(sum(CASE WHEN operation='read' THEN bytes ELSE 0 END) AS bigint) AS read_bytes,
      cast(sum(CASE WHEN operation='write' THEN bytes ELSE 0 END) AS bigint) AS write_bytes FROM io WHERE pid < 20)
    SELECT *, cast(read_bytes AS double) * 1e9 / cast(duration_ns AS double) / 1048576.0::double AS read_mib_s,
      cast(write_bytes AS double) * 1e9 / cast(duration_ns AS double) / 1048576.0::double AS write_mib_s FROM c""",
    IO,
)
def selection_span(spark, d):
    return summary.selection_span(T.requests(spark, d).filter("pid < 20"))


TREND = f""", t AS (SELECT (complete_ts - {ORIGIN}) // 1000000000 AS second, count(*) FILTER (operation='read') AS reads,
      count(*) FILTER (operation='write') AS writes,
      sum(CASE WHEN operation='read' THEN bytes ELSE 0 END)::double / 1048576.0::double AS read_mib,
      sum(CASE WHEN operation='write' THEN bytes ELSE 0 END)::double / 1048576.0::double AS write_mib FROM io GROUP BY 1)"""


@add("trend_bins", TREND + " SELECT * FROM t", IO)
def trend_bins(spark, d):
    return summary.trend_bins(T.requests(spark, d), origin(spark, d))


@add(
    "trend_highlights",
    TREND
    + """, i AS (SELECT pid, cast(sum(CASE WHEN operation IN ('read','write') THEN bytes ELSE 0 END) AS bigint) AS b, count(*) AS n FROM io GROUP BY 1)
    SELECT (SELECT request_id FROM io ORDER BY total_ns DESC, complete_ts LIMIT 1) AS slowest_request, (SELECT max(total_ns) FROM io) AS slowest_ns,
      (SELECT second FROM t ORDER BY read_mib + write_mib DESC, second DESC LIMIT 1) AS busiest_second,
      (SELECT max(read_mib + write_mib) FROM t) AS busiest_mib,
      (SELECT pid FROM i ORDER BY b DESC, pid DESC LIMIT 1) AS top_pid, (SELECT max(b) FROM i) AS top_bytes,
      (SELECT n FROM i ORDER BY b DESC, pid DESC LIMIT 1) AS top_requests""",
    IO,
)
def trend_highlights(spark, d):
    return summary.trend_highlights(T.requests(spark, d), origin(spark, d))


@add(
    "issuer_ranking",
    """SELECT comm || ' · PID ' || pid || ' / TID ' || tid AS issuer, count(*) AS n,
      cast(sum(CASE WHEN operation IN ('read','write') THEN bytes ELSE 0 END) AS bigint) AS bytes FROM io GROUP BY 1""",
    IO,
)
def issuer_ranking(spark, d):
    return summary.issuer_ranking(T.requests(spark, d))


@add(
    "transfer_bytes",
    """SELECT minor, cast(sum(CASE WHEN operation='read' THEN bytes ELSE 0 END) AS bigint) AS read_bytes,
      cast(sum(CASE WHEN operation='write' THEN bytes ELSE 0 END) AS bigint) AS write_bytes,
      cast(sum(CASE WHEN operation NOT IN ('read','write') THEN bytes ELSE 0 END) AS bigint) AS other_bytes,
      cast(sum(CASE WHEN operation IN ('read','write') THEN bytes ELSE 0 END) AS bigint) AS total_bytes FROM io GROUP BY 1""",
    IO,
)
def transfer_bytes(spark, d):
    return summary.transfer_bytes(T.requests(spark, d), ["minor"])


@add(
    "heavy_hitters_by_process",
    """, k AS (SELECT comm || ' (' || pid || ')' AS target, count(*) AS n, cast(sum(bytes) AS bigint) AS bytes,
        cast(sum(total_ns) AS bigint) AS cumulative_ns, max(total_ns) AS max_ns FROM io GROUP BY 1),
    t AS (SELECT * FROM k ORDER BY cumulative_ns DESC, target LIMIT 20)
    SELECT *, cast(sum(cumulative_ns) OVER () AS bigint) AS covered_metric, (SELECT cast(sum(total_ns) AS bigint) FROM io) AS total_metric,
      0 AS evicted_keys FROM t""",
    IO,
)
def heavy_hitters_by_process(spark, d):
    return summary.heavy_hitters(T.requests(spark, d), axes.GROUPS["process"]())


@add(
    "operation_cube_shares",
    """SELECT coalesce(operation, 'total') AS direction, count(*) AS n, cast(sum(bytes) AS bigint) AS bytes FROM io GROUP BY GROUPING SETS ((), (operation))""",
    IO,
)
def operation_cube_shares(spark, d):
    io = T.requests(spark, d)
    return io.rollup("operation").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(
        F.coalesce("operation", F.lit("total")).alias("direction"), "n", "bytes"
    )

