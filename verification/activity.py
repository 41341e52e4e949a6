"""Correlation, intervals, windows, bandwidth and address locality."""

from __future__ import annotations

from pyspark.sql import functions as F

from iotrail.operators import addresses, intervals, stats
from iotrail.operators.correlate import correlation_counters
from iotrail.plans import activity, summary
from iotrail.sources import tables as T
from verification.base import EV, IO, Suite

SUITE = Suite()
add = SUITE.add


# -- correlation with reused ids ---------------------------------------------
# The rules as plain windows: lifetimes end at completions, an issue opens the key only
# when nothing of its lifetime is alive, insert collisions poison the key.

TTL = 1_800_000_000


def correlation_sql(modulus: int, ttl: int) -> str:
    return f""", raw AS (
      SELECT event_id, event_id % {modulus} AS id, minor, 0 AS phase, insert_ts AS ts, operation, bytes FROM req
      UNION ALL SELECT event_id, event_id % {modulus}, minor, 1, issue_ts, operation, bytes FROM req
      UNION ALL SELECT event_id, event_id % {modulus}, minor, 2, complete_ts, operation, bytes FROM req),
    s AS (SELECT *, row_number() OVER (ORDER BY ts, phase, event_id) AS seq FROM raw),
    q AS (SELECT *, lag(CASE WHEN phase < 2 THEN phase END IGNORE NULLS) OVER k AS pq_phase,
                 lag(CASE WHEN phase < 2 THEN ts END IGNORE NULLS) OVER k AS pq_ts,
                 coalesce(lag(CASE WHEN phase = 2 THEN seq END IGNORE NULLS) OVER k, -1) AS pc
          FROM s WINDOW k AS (PARTITION BY id, minor ORDER BY seq)),
    a AS (SELECT *, phase = 0 AND coalesce(pq_phase = 0 AND ts - pq_ts <= {ttl}, false) AS dup FROM q),
    e AS (SELECT *, lag(CASE WHEN phase = 1 OR dup THEN seq END IGNORE NULLS) OVER k AS pe_seq,
                 lag(CASE WHEN phase = 1 OR dup THEN ts END IGNORE NULLS) OVER k AS pe_ts,
                 lag(CASE WHEN phase = 1 OR dup THEN phase END IGNORE NULLS) OVER k AS pe_phase
          FROM a WINDOW k AS (PARTITION BY id, minor ORDER BY seq)),
    t AS (SELECT *, coalesce(pe_seq > pc AND ts - pe_ts <= {ttl}, false) AS touched FROM e),
    f AS (SELECT *, phase = 1 AND touched AS rejected, phase = 2 AND touched AND pe_phase = 0 AS swallowed FROM t),
    g AS (SELECT *, lag(CASE WHEN phase = 1 THEN seq END IGNORE NULLS) OVER k AS pi_seq,
                 lag(CASE WHEN phase = 1 THEN ts END IGNORE NULLS) OVER k AS pi_ts,
                 coalesce(lag(CASE WHEN phase = 2 AND NOT swallowed THEN seq END IGNORE NULLS) OVER k, -1) AS px
          FROM f WINDOW k AS (PARTITION BY id, minor ORDER BY seq)),
    h AS (SELECT *, coalesce(pi_seq > px AND ts - pi_ts <= {ttl}, false) AS open_alive FROM g),
    l AS (SELECT *, phase = 1 AND NOT rejected AND open_alive AS linked FROM h),
    b AS (SELECT *, max(CASE WHEN phase = 1 AND NOT linked THEN seq END) OVER (PARTITION BY id, minor ORDER BY seq ROWS UNBOUNDED PRECEDING) AS base FROM l),
    c AS (SELECT *, sum(CASE WHEN linked THEN 1 ELSE 0 END) OVER (PARTITION BY id, minor, base ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hops,
                 bool_or(phase = 1 AND NOT linked AND rejected) OVER (PARTITION BY id, minor, base) AS base_rejected FROM b),
    acc AS (SELECT seq, event_id, ts, minor, id, CASE WHEN linked THEN base_rejected = (hops % 2 = 1) ELSE NOT rejected END AS accepted
            FROM c WHERE phase = 1),
    m AS (SELECT h.event_id AS complete_event, acc.event_id AS issue_event, acc.ts AS issue_ts, h.ts AS complete_ts
          FROM h JOIN acc ON acc.seq = h.pi_seq AND acc.accepted
          WHERE h.phase = 2 AND NOT h.swallowed AND h.open_alive AND h.ts >= acc.ts)"""


@add(
    "correlate_reused_ids",
    correlation_sql(8, TTL)
    + " SELECT complete_event % 8 AS request_id, complete_ts, issue_ts, complete_ts - issue_ts AS device_ns FROM m",
    EV,
)
def correlate_reused_ids(spark, d):
    life = T.block_lifetimes(spark, d, 8, TTL)
    return life.filter("matched").select(
        "request_id",
        F.col("ts_ns").alias("complete_ts"),
        F.col("source.ts_ns").alias("issue_ts"),
        (F.col("ts_ns") - F.col("source.ts_ns")).alias("device_ns"),
    )


@add(
    "correlate_two_ids",
    correlation_sql(2, TTL) + " SELECT complete_ts, issue_ts FROM m",
    EV,
)
def correlate_two_ids(spark, d):
    """Two ids for the whole trace: every key is hot and most lifetimes collide."""
    life = T.block_lifetimes(spark, d, 2, TTL)
    return life.filter("matched").select(F.col("ts_ns").alias("complete_ts"), F.col("source.ts_ns").alias("issue_ts"))


@add(
    "correlation_counts",
    correlation_sql(8, TTL)
    + """ SELECT (SELECT count(*) FROM raw WHERE phase = 1) AS issued, (SELECT count(*) FROM m) AS completed,
      (SELECT count(*) FROM raw WHERE phase = 2) - (SELECT count(*) FROM m) AS uncorrelated,
      (SELECT count(*) FROM h WHERE dup) + (SELECT count(*) FROM acc WHERE NOT accepted) AS replaced""",
    EV,
)
def correlation_counts(spark, d):
    life = T.block_lifetimes(spark, d, 8, TTL)
    return correlation_counters(life, TTL).select("issued", "completed", "uncorrelated", "replaced")


@add("correlation_expiry_counts")
def correlation_expiry_counts(spark, d):
    life = T.block_lifetimes(spark, d, 8, TTL)
    return correlation_counters(life, TTL)


@add(
    "issues_without_completion",
    correlation_sql(8, TTL)
    + """ SELECT id AS request_id, minor, ts AS issue_ts FROM s WHERE phase = 1 AND event_id NOT IN (SELECT issue_event FROM m)""",
    EV,
)
def issues_without_completion(spark, d):
    life = T.block_lifetimes(spark, d, 8, TTL)
    done = life.filter("matched").select("session_id", F.col("source.seq").alias("seq"))
    return (
        life.filter("kind = 'issue'")
        .join(done, ["session_id", "seq"], "left_anti")
        .select("request_id", "minor", F.col("ts_ns").alias("issue_ts"))
    )


# -- intervals ---------------------------------------------------------------


def islands_sql(src: str, keys: str, gap: int = 0, name: str = "isl") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f""", {name}_m AS (SELECT {k}s, e, max(e) OVER ({part} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ({src}) WHERE e > s),
    {name}_g AS (SELECT {k}s, e, sum(CASE WHEN pm IS NULL OR s - pm > {gap} THEN 1 ELSE 0 END) OVER ({part} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m),
    {name} AS (SELECT {k}min(s) AS start_ns, max(e) AS end_ns FROM {name}_g GROUP BY {k}g)"""


DEV_BUSY = islands_sql("SELECT minor, issue_ts AS s, complete_ts AS e FROM req", "minor")
ALL_BUSY = islands_sql("SELECT issue_ts AS s, complete_ts AS e FROM req", "")


@add("device_activity", DEV_BUSY + " SELECT 8 AS major, minor, start_ns, end_ns FROM isl", EV)
def device_activity(spark, d):
    return T.device_activity(spark, d)


@add(
    "device_busy_time",
    DEV_BUSY
    + " SELECT 8 AS major, minor, count(*) AS islands, cast(sum(end_ns - start_ns) AS bigint) AS busy_ns FROM isl GROUP BY ALL",
    EV,
)
def device_busy_time(spark, d):
    merged = T.device_activity(spark, d)
    return merged.groupBy("major", "minor").agg(
        F.count(F.lit(1)).alias("islands"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("busy_ns")
    )


@add(
    "busy_outside_one_request",
    islands_sql("SELECT insert_ts AS s, complete_ts AS e FROM req", "")
    + """ SELECT start_ns, end_ns FROM (SELECT end_ns AS start_ns, lead(start_ns) OVER (ORDER BY start_ns) AS end_ns FROM isl) WHERE end_ns IS NOT NULL""",
    EV,
)
def busy_outside_one_request(spark, d):
    """Uncovered intervals between the first request start and the last completion."""
    io = T.requests(spark, d)
    lo, hi = io.agg(F.min("insert_ts"), F.max("complete_ts")).first()
    merged = intervals.merge_intervals(io, [], "insert_ts", "complete_ts")
    return intervals.gaps(merged, [], lo, hi)


def full_range(spark, d):
    lo, hi = T.requests(spark, d).agg(F.min("insert_ts"), F.max("complete_ts")).first()
    return lo, hi


RANGE = ", rg AS (SELECT min(insert_ts) AS lo, max(complete_ts) AS hi FROM req)"


@add(
    "host_bandwidth",
    RANGE
    + islands_sql("SELECT issue_ts AS s, complete_ts AS e FROM req WHERE minor IN (0, 1)", "")
    + """, bz AS (SELECT cast(sum(least(end_ns, hi) - greatest(start_ns, lo)) AS bigint) AS busy FROM isl, rg WHERE end_ns > lo AND start_ns < hi),
    v AS (SELECT unnest(['total', 'read', 'write']) AS direction),
    y AS (SELECT direction, cast(coalesce(sum(bytes), 0) AS bigint) AS bytes FROM v LEFT JOIN (SELECT req.* FROM req, rg WHERE complete_ts BETWEEN lo AND hi AND operation <> 'discard' AND minor IN (0, 1)) r
          ON direction = 'total' OR r.operation = direction GROUP BY 1)
    SELECT direction, bytes, hi - lo AS duration_ns, busy AS busy_ns, hi - lo - busy AS idle_ns,
      cast(bytes AS double) * 1e9 / (hi - lo) / 1048576.0::double AS with_idle_mib_s,
      cast(bytes AS double) * 1e9 / busy / 1048576.0::double AS without_idle_mib_s FROM y, bz, rg""",
    EV,
)
def host_bandwidth(spark, d):
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    devices = [(8, 0), (8, 1)]
    merged = activity.device_activity(io, devices, by_device=False)
    return activity.host_bandwidth(io.filter("minor in (0, 1)"), merged, lo, hi)


@add(
    "host_bandwidth_filtered_payload",
    RANGE
    + ALL_BUSY
    + """, bz AS (SELECT cast(sum(end_ns - start_ns) AS bigint) AS busy FROM isl),
    y AS (SELECT cast(sum(bytes) AS bigint) AS bytes FROM req WHERE pid < 10 AND operation = 'read')
    SELECT bytes, busy AS busy_ns, cast(bytes AS double) * 1e9 / busy / 1048576.0::double AS without_idle_mib_s FROM y, bz""",
    EV,
)
def host_bandwidth_filtered_payload(spark, d):
    """A process filter changes the payload but never the busy clock."""
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    merged = T.busy_union(spark, d)
    out = activity.host_bandwidth(io.filter("pid < 10"), merged, lo, hi)
    return out.filter("direction = 'read'").select("bytes", "busy_ns", "without_idle_mib_s")


WINDOW_NS = 1_000_000_000


def windows_sql(width: int) -> str:
    return (
        RANGE
        + ALL_BUSY
        + f""", p AS (SELECT lo, hi, greatest({width}, 1) AS w FROM rg),
    n AS (SELECT *, (hi - lo + w - 1) // w AS n FROM p),
    cal AS (SELECT i AS win, lo + i * w AS start_ns, least(lo + (i + 1) * w, hi) AS end_ns FROM n, unnest(generate_series(0, n - 1)) AS u(i)),
    ct AS (SELECT least((complete_ts - lo) // w, n - 1) AS win, count(*) AS n, count(*) FILTER (operation='read') AS n_read,
        count(*) FILTER (operation='write') AS n_write, sum(CASE WHEN operation IN ('read','write') THEN bytes ELSE 0 END) AS b,
        sum(CASE WHEN operation='read' THEN bytes ELSE 0 END) AS b_read, sum(CASE WHEN operation='write' THEN bytes ELSE 0 END) AS b_write
        FROM req, n GROUP BY 1),
    bw AS (SELECT win, sum(least(isl.end_ns, cal.end_ns) - greatest(isl.start_ns, cal.start_ns)) AS busy FROM cal JOIN isl
        ON isl.end_ns > cal.start_ns AND isl.start_ns < cal.end_ns GROUP BY 1),
    fr AS (SELECT win, start_ns, end_ns, cast(end_ns - start_ns AS double) AS ns, coalesce(ct.n, 0)::double AS n, coalesce(n_read, 0)::double AS n_read, coalesce(n_write, 0)::double AS n_write,
        coalesce(b, 0)::double AS b, coalesce(b_read, 0)::double AS b_read, coalesce(b_write, 0)::double AS b_write, coalesce(busy, 0)::double AS busy
        FROM cal LEFT JOIN ct USING (win) LEFT JOIN bw USING (win))"""
    )


@add(
    "window_bandwidth",
    windows_sql(WINDOW_NS)
    + """ SELECT win AS "window", start_ns, end_ns, b * 1e9 / ns / 1048576.0::double AS bandwidth_mib_s,
      b_read * 1e9 / ns / 1048576.0::double AS read_mib_s, b_write * 1e9 / ns / 1048576.0::double AS write_mib_s FROM fr""",
    EV,
)
def window_bandwidth(spark, d):
    return _series(spark, d, "bandwidth_mib_s", "read_mib_s", "write_mib_s", busy=False)


@add(
    "window_iops",
    windows_sql(WINDOW_NS)
    + """ SELECT win AS "window", start_ns, end_ns, n * 1e9 / ns AS iops, n_read * 1e9 / ns AS read_iops, n_write * 1e9 / ns AS write_iops FROM fr""",
    EV,
)
def window_iops(spark, d):
    return _series(spark, d, "iops", "read_iops", "write_iops", busy=False)


@add(
    "cumulative_payload",
    windows_sql(WINDOW_NS)
    + """ SELECT win AS "window", start_ns, end_ns, sum(b) OVER o / 1048576.0::double AS cumulative_mib, sum(b_read) OVER o / 1048576.0::double AS cumulative_read_mib,
      sum(b_write) OVER o / 1048576.0::double AS cumulative_write_mib FROM fr WINDOW o AS (ORDER BY win ROWS UNBOUNDED PRECEDING)""",
    EV,
)
def cumulative_payload(spark, d):
    return _series(spark, d, "cumulative_mib", "cumulative_read_mib", "cumulative_write_mib", busy=False)


@add(
    "window_busy_percent",
    windows_sql(WINDOW_NS) + """ SELECT win AS "window", start_ns, end_ns, busy * 100.0::double / ns AS busy_percent FROM fr""",
    EV,
)
def window_busy_percent(spark, d):
    return _series(spark, d, "busy_percent")


@add(
    "window_busy_ms",
    windows_sql(WINDOW_NS) + """ SELECT win AS "window", start_ns, end_ns, busy / 1e6 AS busy_ms FROM fr""",
    EV,
)
def window_busy_ms(spark, d):
    return _series(spark, d, "busy_ms")


@add(
    "window_idle_ms",
    windows_sql(WINDOW_NS) + """ SELECT win AS "window", start_ns, end_ns, (ns - busy) / 1e6 AS idle_ms FROM fr""",
    EV,
)
def window_idle_ms(spark, d):
    return _series(spark, d, "idle_ms")


def _series(spark, d, *columns, busy=True):
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    merged = T.busy_union(spark, d) if busy else None
    series = activity.window_series(io, merged, activity.Windows(lo, hi, WINDOW_NS))
    return series.select("window", "start_ns", "end_ns", *columns)


@add(
    "window_series_selection",
    windows_sql(WINDOW_NS)
    + """ SELECT count(*) AS samples, min(b * 1e9 / ns / 1048576.0::double) AS lowest, max(b * 1e9 / ns / 1048576.0::double) AS highest FROM fr, rg
      WHERE (start_ns + end_ns) / 2.0::double BETWEEN lo + 1e11 AND lo + 9e11 AND b * 1e9 / ns / 1048576.0::double BETWEEN 0.1 AND 0.5""",
    EV,
)
def window_series_selection(spark, d):
    """Windows picked by centre and value; the summary has one sample per window."""
    lo = full_range(spark, d)[0]
    series = _series(spark, d, "bandwidth_mib_s", busy=False)
    centre = (F.col("start_ns") + F.col("end_ns")) / 2.0
    picked = series.filter(centre.between(lo + 1e11, lo + 9e11) & F.col("bandwidth_mib_s").between(0.1, 0.5))
    return picked.agg(
        F.count(F.lit(1)).alias("samples"), F.min("bandwidth_mib_s").alias("lowest"), F.max("bandwidth_mib_s").alias("highest")
    )


@add("busy_intervals", ALL_BUSY + " SELECT start_ns, end_ns, (end_ns - start_ns) / 1e6 AS duration_ms FROM isl", EV)
def busy_intervals(spark, d):
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    runs = activity.busy_runs(T.busy_union(spark, d), lo, hi)
    return runs.withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1e6)


@add(
    "idle_intervals",
    RANGE
    + ALL_BUSY
    + """, g AS (SELECT coalesce(lag(end_ns) OVER (ORDER BY start_ns), lo) AS start_ns, start_ns AS end_ns FROM isl, rg
        UNION ALL SELECT max(end_ns), max(hi) FROM isl, rg)
    SELECT start_ns, end_ns, (end_ns - start_ns) / 1e6 AS duration_ms FROM g WHERE end_ns > start_ns""",
    EV,
)
def idle_intervals(spark, d):
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    idle = activity.idle_gaps(T.busy_union(spark, d), lo, hi)
    return idle.withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1e6)


BURSTS = islands_sql("SELECT issue_ts AS s, complete_ts AS e FROM req", "", 500_000)


@add(
    "bursts",
    BURSTS
    + """ SELECT start_ns, end_ns, count(event_id) AS requests, cast(coalesce(sum(CASE WHEN operation <> 'discard' THEN bytes END), 0) AS bigint) AS total_bytes,
      cast(coalesce(sum(CASE WHEN operation = 'read' THEN bytes END), 0) AS bigint) AS read_bytes, cast(coalesce(sum(CASE WHEN operation = 'write' THEN bytes END), 0) AS bigint) AS write_bytes,
      (end_ns - start_ns) / 1e6 AS duration_ms
    FROM isl LEFT JOIN req ON complete_ts > start_ns AND complete_ts <= end_ns GROUP BY start_ns, end_ns""",
    EV,
)
def bursts(spark, d):
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    found = activity.bursts(T.busy_union(spark, d), lo, hi)
    return activity.interval_payload(io, found)


@add(
    "burst_payload",
    BURSTS
    + """ SELECT start_ns AS interval_start_ns, complete_ts, request_id,
      cast(sum(CASE WHEN operation <> 'discard' THEN bytes ELSE 0 END) OVER (PARTITION BY start_ns ORDER BY complete_ts, request_id ROWS UNBOUNDED PRECEDING) AS bigint) AS cumulative_bytes
    FROM isl JOIN req ON complete_ts > start_ns AND complete_ts <= end_ns""",
    EV,
)
def burst_payload(spark, d):
    io = T.requests(spark, d)
    lo, hi = full_range(spark, d)
    found = activity.bursts(T.busy_union(spark, d), lo, hi)
    return activity.burst_payload(io, found).select("interval_start_ns", "complete_ts", "request_id", "cumulative_bytes")


@add(
    "overlapping_requests",
    """ SELECT a.request_id AS left_id, b.request_id AS right_id FROM req a JOIN req b ON a.minor = b.minor AND a.issue_ts <= b.complete_ts AND a.complete_ts >= b.issue_ts
      WHERE a.operation = 'read' AND b.operation = 'write'""",
    EV,
)
def overlapping_requests(spark, d):
    """Reads in flight together with writes of the same device, by the bucketed interval join."""
    io = T.requests(spark, d)
    left = io.filter("operation = 'read'").select("minor", F.col("request_id").alias("left_id"), F.col("issue_ts").alias("ls"), F.col("complete_ts").alias("le"))
    right = io.filter("operation = 'write'").select("minor", F.col("request_id").alias("right_id"), F.col("issue_ts").alias("rs"), F.col("complete_ts").alias("re"))
    pairs = intervals.interval_join(left, right, ["minor"], ("ls", "le"), ("rs", "re"), 10_000_000, long_buckets=20)
    return pairs.select("left_id", "right_id")


@add(
    "activity_provenance",
    """SELECT 8 AS major, minor, CASE WHEN minor = 0 THEN 'verified' WHEN minor = 1 THEN 'reconstructed' WHEN minor = 2 THEN 'events lost' ELSE 'loss counters missing' END AS reason,
      minor <= 1 AS activity_known, minor = 1 AS activity_estimated FROM (SELECT DISTINCT minor FROM req)""",
    EV,
)
def activity_provenance(spark, d):
    quality = (
        T.requests(spark, d)
        .groupBy("major", "minor")
        .agg(F.count(F.lit(1)).alias("completions"))
        .select(
            "major",
            "minor",
            "completions",
            (F.col("minor") == 0).alias("verified"),
            F.lit(True).alias("unfiltered"),
            F.lit(True).alias("complete"),
            F.when(F.col("minor") == 2, 5).when(F.col("minor") < 2, 0).alias("lost"),
            F.col("completions").alias("footer_events"),
            F.col("completions").alias("stored_events"),
            F.lit(0).alias("unresolved"),
            F.lit(0).alias("requeues"),
        )
    )
    return activity.activity_known(quality).select("major", "minor", "reason", "activity_known", "activity_estimated")


# -- addresses ---------------------------------------------------------------


@add(
    "address_counts",
    """, ed AS (SELECT minor, pos, cast(sum(r) AS bigint) AS r, cast(sum(w) AS bigint) AS w FROM (
        SELECT minor, sector AS pos, CASE WHEN operation='read' THEN 1 ELSE 0 END AS r, CASE WHEN operation='write' THEN 1 ELSE 0 END AS w FROM req WHERE operation <> 'discard'
        UNION ALL SELECT minor, sector + sectors, CASE WHEN operation='read' THEN -1 ELSE 0 END, CASE WHEN operation='write' THEN -1 ELSE 0 END FROM req WHERE operation <> 'discard') GROUP BY 1, 2),
    sw AS (SELECT minor, pos AS s, lead(pos) OVER o AS e, sum(r) OVER o AS reads, sum(w) OVER o AS writes FROM ed WINDOW o AS (PARTITION BY minor ORDER BY pos)),
    cv AS (SELECT * FROM sw WHERE e IS NOT NULL AND (reads > 0 OR writes > 0)),
    mk AS (SELECT *, CASE WHEN lag(e) OVER o = s AND lag(reads) OVER o = reads AND lag(writes) OVER o = writes THEN 0 ELSE 1 END AS opens FROM cv WINDOW o AS (PARTITION BY minor ORDER BY s)),
    gr AS (SELECT *, sum(opens) OVER (PARTITION BY minor ORDER BY s) AS g FROM mk)
    SELECT 8 AS major, minor, min(s) AS start_sector, max(e) AS end_sector, cast(max(reads) AS bigint) AS reads, cast(max(writes) AS bigint) AS writes, max(reads) + max(writes) > 1 AS repeated FROM gr GROUP BY minor, g""",
    EV,
)
def address_counts(spark, d):
    return addresses.address_counts(T.requests(spark, d), block=64)


@add(
    "spatial_payload",
    """, ed AS (SELECT minor, min(sector)::double AS lo, max(sector)::double AS hi, least(16, count(*)) AS bins FROM req WHERE operation <> 'discard' GROUP BY 1),
    fr AS (SELECT minor, hi, bins, unnest(generate_series(0, bins - 1)) AS bin, lo, (hi - lo) / bins AS width FROM ed),
    fx AS (SELECT minor, bin, lo + bin * width AS lower, CASE WHEN bin + 1 = bins THEN hi ELSE lo + (bin + 1) * width END AS upper, bin + 1 = bins AS last FROM fr)
    SELECT 8 AS major, fx.minor, bin, lower, upper, cast(coalesce(sum(CASE WHEN operation='read' THEN bytes END), 0) AS bigint) AS read_bytes,
      cast(coalesce(sum(CASE WHEN operation='write' THEN bytes END), 0) AS bigint) AS write_bytes
    FROM fx LEFT JOIN req ON req.minor = fx.minor AND operation <> 'discard' AND sector >= lower AND (sector < upper OR last) GROUP BY ALL""",
    EV,
)
def spatial_payload(spark, d):
    return addresses.spatial_payload(T.requests(spark, d))


@add(
    "address_reuse_gaps",
    """ SELECT 8 AS major, minor, sector, operation, request_id, issue_ts,
      (issue_ts - lag(issue_ts) OVER (PARTITION BY minor, sector, operation ORDER BY issue_ts, event_id)) / 1e6 AS gap_ms FROM req WHERE operation <> 'discard'""",
    EV,
)
def address_reuse_gaps(spark, d):
    return addresses.reuse_gaps(T.requests(spark, d), order="issue_seq")


@add(
    "address_reuse_distribution",
    """, g AS (SELECT minor, operation, (issue_ts - lag(issue_ts) OVER (PARTITION BY minor, sector, operation ORDER BY issue_ts, event_id)) / 1e6 AS v FROM req WHERE operation <> 'discard'),
    dd AS (SELECT minor, 'total' AS direction, v FROM g UNION ALL SELECT minor, operation, v FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY minor, direction ORDER BY v NULLS LAST) AS rn, count(v) OVER (PARTITION BY minor, direction) AS n FROM dd)
    SELECT 8 AS major, minor, direction, max(n) AS n, count(*) - max(n) AS missing, max(CASE WHEN rn = (50 * n + 99) // 100 THEN v END) AS p50,
      max(CASE WHEN rn = (95 * n + 99) // 100 THEN v END) AS p95 FROM r GROUP BY minor, direction""",
    EV,
)
def address_reuse_distribution(spark, d):
    rows = stats.by_direction(addresses.reuse_gaps(T.requests(spark, d), order="issue_seq"))
    return summary.distribution_summary(rows, ["major", "minor", "direction"], "gap_ms", [50, 95])


@add(
    "unknown_address_length",
    "SELECT count(*) FILTER (sectors <= 0) AS unknown_or_empty FROM req WHERE operation <> 'discard'",
    EV,
)
def unknown_address_length(spark, d):
    return addresses.unknown_length(T.requests(spark, d))


__all__ = ["IO", "SUITE"]
