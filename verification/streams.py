"""Structured Streaming queries drained over the recording in several micro-batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from iotrail.sources import tables as T
from iotrail.session import workspace
from iotrail.streaming import live, sessions, toplist
from verification.activity import TTL, correlation_sql
from verification.base import EV, IO, Suite
from verification.cohorts import BOUNDS_SQL
from verification.graphs import SUITE as GRAPHS
from verification.graphs import stage_rows
from verification.recordings import SUITE as RECORDINGS
from verification.recordings import disk_polls, recording_path

SUITE = Suite()
add = SUITE.add

CHUNKS = 3
FILES = 4


def folder(spark, name):
    return os.path.join(workspace(spark), f"{name}-{uuid.uuid4().hex}")


def chunked(spark, df, order, name):
    """Write a table as consecutive chunks of FILES files, so each micro-batch is the next stretch of the stream."""
    path = folder(spark, name)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    step = (hi - lo) // CHUNKS + 1
    for i in range(CHUNKS):
        part = df.filter(F.col(order).between(lo + i * step, lo + (i + 1) * step - 1))
        part.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def drain(spark, stream, name, mode="append"):
    return live.run_to_table(stream, folder(spark, name), folder(spark, f"{name}-checkpoint"), mode)


@add(
    "stream_correlation",
    correlation_sql(8, TTL) + " SELECT complete_event % 8 AS request_id, complete_ts, issue_ts FROM m",
    EV,
)
def stream_correlation(spark, d):
    events = chunked(spark, T.block_events(spark, d, 8), "ts_ns", "blocks")
    out = drain(spark, live.live_correlation(events, TTL), "correlated")
    return out.filter("outcome = 'matched'").select("request_id", "complete_ts", "issue_ts")


@add(
    "stream_correlation_outcomes",
    correlation_sql(8, TTL)
    + """ SELECT 'matched' AS outcome, count(*) AS n FROM m UNION ALL SELECT 'uncorrelated', (SELECT count(*) FROM raw WHERE phase = 2) - (SELECT count(*) FROM m)
      UNION ALL SELECT 'replaced', (SELECT count(*) FROM h WHERE dup) + (SELECT count(*) FROM acc WHERE NOT accepted)""",
    EV,
)
def stream_correlation_outcomes(spark, d):
    events = chunked(spark, T.block_events(spark, d, 8), "ts_ns", "blocks")
    out = drain(spark, live.live_correlation(events, TTL), "outcomes")
    return out.filter("outcome <> 'expired'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@add("stream_stage_pairing", GRAPHS.sql["stage_pairing"])
def stream_stage_pairing(spark, d):
    from iotrail.operators.ordered import BUCKET, carry_last, seq_bucket

    rows = stage_rows(spark, d)
    clocked = carry_last(rows, ["session_id"], ["seq"], {"clock": F.col("ts_ns")}, bucket=seq_bucket()).drop(BUCKET)
    out = drain(spark, live.live_stage_pairing(chunked(spark, clocked, "seq", "stages"), watermark="1 hour"), "spans")
    return out.select("layer", F.col("pair_id").alias("stage_key"), "start_ns", "end_ns")


@add(
    "stream_second_aggregates",
    """ SELECT complete_ts // 1000000000 AS second, count(*) AS completed, cast(sum(bytes) AS bigint) AS bytes FROM io GROUP BY 1""",
    IO,
)
def stream_second_aggregates(spark, d):
    """Every second, the open ones too: each batch writes a complete snapshot and the last one counts."""
    io = T.requests(spark, d)
    out = drain(spark, live.second_aggregates(chunked(spark, io, "complete_ts", "io")), "seconds", mode="complete")
    return live.latest_snapshot(out).select("second", "completed", "bytes")


@add(
    "stream_percentiles",
    f""", h AS (SELECT operation, (SELECT count(*) FROM (SELECT unnest({BOUNDS_SQL}) AS b) WHERE b < total_ns) AS bucket FROM io),
    g AS (SELECT operation, bucket, count(*) AS n FROM h GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY operation ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY operation) AS total FROM g),
    p AS (SELECT * FROM c, (SELECT unnest([50, 95, 99]) AS percentile))
    SELECT operation, percentile, CASE WHEN bucket = 0 THEN 0 ELSE ({BOUNDS_SQL})[bucket] + 1 END AS lower, ({BOUNDS_SQL})[bucket + 1] AS upper
    FROM p WHERE upto >= (total * percentile + 99) // 100 AND upto - n < (total * percentile + 99) // 100""",
    IO,
)
def stream_percentiles(spark, d):
    stream = chunked(spark, T.requests(spark, d), "complete_ts", "io")
    snapshots = drain(spark, live.latency_counts(stream), "histogram", "complete")
    return live.percentiles_of(live.latest_snapshot(snapshots))


@add(
    "stream_heavy_hitters",
    """ SELECT comm, pid, count(*) AS n, cast(sum(total_ns) AS bigint) AS cumulative_ns, cast(sum(CASE WHEN operation <> 'discard' THEN bytes ELSE 0 END) AS bigint) AS moved_bytes
      FROM io GROUP BY ALL ORDER BY cumulative_ns DESC, pid LIMIT 20""",
    IO,
)
def stream_heavy_hitters(spark, d):
    read = T.requests(spark, d).select("comm", "pid", "total_ns", "operation", "bytes", "complete_ts")
    stream = chunked(spark, read, "complete_ts", "io")
    totals = live.latest_snapshot(drain(spark, live.heavy_hitter_counts(stream), "hitters", "complete"))
    return totals.orderBy(F.desc("cumulative_ns"), F.asc("pid")).limit(20)


@add(
    "stream_snapshot_reads",
    """, c AS (SELECT *, (complete_ts - (SELECT min(complete_ts) FROM io)) // ((max(complete_ts) OVER () - min(complete_ts) OVER ()) // 3 + 1) AS batch FROM io)
    SELECT count(*) FILTER (batch = 0) AS first_view, count(*) FILTER (batch <= 1) AS second_view, count(*) AS last_view FROM c""",
    IO,
)
def stream_snapshot_reads(spark, d):
    """A selection pinned to a batch does not change while the table grows."""
    stream = chunked(spark, T.requests(spark, d).select("request_id", "complete_ts"), "complete_ts", "io")
    table = drain(spark, stream, "growing")
    views = [live.as_of_batch(table, b).agg(F.count(F.lit(1)).alias(n)) for b, n in ((0, "first_view"), (1, "second_view"), (2, "last_view"))]
    return views[0].join(views[1], F.lit(True)).join(views[2], F.lit(True))


@add(
    "stream_line_guard",
    f"SELECT status, cast(sum(n) AS bigint) AS n FROM ({RECORDINGS.sql['recording_line_status']}) GROUP BY 1",
)
def stream_line_guard(spark, d):
    out = drain(spark, live.stream_lines(spark, recording_path(spark, d)).select("status"), "lines")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add(
    "stream_disk_deltas",
    """WITH o AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::date) AS poll, count(*) AS n FROM orders GROUP BY 1),
    k AS (SELECT poll, CASE WHEN poll % 500 < 250 THEN 'a' ELSE 'b' END AS boot, i, poll * 1000 + n * i AS reads, CASE WHEN poll % 97 = i THEN 0 ELSE poll * 1000 * 3 + n * i END AS rs, poll * 1000 * 5 + n * i AS writes, poll * 1000 * 7 + n * i AS ws
      FROM o, (SELECT unnest([0, 1, 2, 3]) AS i)),
    l AS (SELECT *, lag(poll) OVER w AS pp, lag(boot) OVER w AS pb, lag(reads) OVER w AS r0, lag(rs) OVER w AS rs0, lag(writes) OVER w AS w0, lag(ws) OVER w AS ws0 FROM k WINDOW w AS (PARTITION BY i ORDER BY poll))
    SELECT '8:' || i || ' sd' || i AS disk, poll, CASE WHEN pb = boot AND reads >= r0 AND rs >= rs0 AND writes >= w0 AND ws >= ws0 THEN rs - rs0 END AS read_sectors,
      pb = boot AND NOT (reads >= r0 AND rs >= rs0 AND writes >= w0 AND ws >= ws0) AS reset FROM l WHERE pp IS NOT NULL""",
)
def stream_disk_deltas(spark, d):
    from iotrail.sources.counters import parse_disk_stats

    polls = disk_polls(spark, d)
    rows = parse_disk_stats(polls).join(polls.select("session_id", "elapsed_ms", "poll"), ["session_id", "elapsed_ms"])
    out = drain(spark, live.live_disk_deltas(chunked(spark, rows, "poll", "polls")), "deltas")
    return out.select("disk", "poll", "read_sectors", "reset")


# -- trigger machine ------------------------------------------------------------------

POLICY = live.TriggerPolicy("requests per second", 6, 2, 20_000_000_000, 30_000_000_000, 5_000_000_000)


def trigger_windows(spark, d):
    """Requests per ten seconds as the observed metric."""
    io = T.requests(spark, d)
    return io.groupBy("session_id", F.expr("complete_ts div 10000000000").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "session_id", ((F.col("w") + 1) * 10_000_000_000).alias("ts_ns"), F.expr("n div 6").alias("observed")
    )


TRIGGER = """, w0 AS (SELECT (complete_ts // 10000000000 + 1) * 10000000000 AS ts, count(*) // 6 AS observed FROM req GROUP BY 1),
    w AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM w0),
    st(rn, state, entered, streak, ts, frm, too, observed, reason) AS (
      SELECT 0::bigint, 'basic', 0::bigint, 0::bigint, NULL::bigint, NULL::varchar, NULL::varchar, NULL::bigint, NULL::varchar
      UNION ALL SELECT n.rn, coalesce(t.too, s.state), CASE WHEN t.too IS NULL THEN s.entered ELSE n.ts END, t.streak, n.ts, s.state, t.too, n.observed, t.reason
      FROM st s JOIN w n ON n.rn = s.rn + 1, LATERAL (SELECT
        CASE WHEN s.state = 'basic' AND n.observed > 6 THEN 1 WHEN s.state = 'armed' AND n.observed <= 6 THEN 0 WHEN s.state = 'armed' THEN s.streak + 1 ELSE s.streak END AS streak,
        CASE WHEN s.state = 'basic' AND n.observed > 6 THEN 'armed' WHEN s.state = 'armed' AND n.observed <= 6 THEN 'basic' WHEN s.state = 'armed' AND s.streak + 1 >= 2 THEN 'deep'
          WHEN s.state = 'deep' AND n.ts - s.entered >= 20000000000 THEN 'cooldown' WHEN s.state = 'cooldown' AND n.ts - s.entered >= 30000000000 THEN 'basic' END AS too,
        CASE WHEN s.state = 'basic' AND n.observed > 6 THEN 'threshold_observed' WHEN s.state = 'armed' AND n.observed <= 6 THEN 'signal_recovered' WHEN s.state = 'armed' AND s.streak + 1 >= 2 THEN 'consecutive_threshold_exceeded'
          WHEN s.state = 'deep' AND n.ts - s.entered >= 20000000000 THEN 'deep_budget_elapsed' WHEN s.state = 'cooldown' AND n.ts - s.entered >= 30000000000 THEN 'cooldown_elapsed' END AS reason) t),
    tx AS (SELECT ts AS ts_ns, frm AS from_state, too AS to_state, observed, streak AS consecutive, reason FROM st WHERE too IS NOT NULL)"""

REC = "RECURSIVE " + EV.lstrip()


@add("trigger_transitions", TRIGGER + " SELECT * FROM tx", REC)
def trigger_transitions(spark, d):
    return live.trigger_transitions(trigger_windows(spark, d), POLICY).drop("session_id")


@add("stream_trigger", TRIGGER + " SELECT * FROM tx", REC)
def stream_trigger(spark, d):
    out = drain(spark, live.live_trigger(chunked(spark, trigger_windows(spark, d), "ts_ns", "windows"), POLICY), "transitions")
    return out.select("ts_ns", "from_state", "to_state", "observed", "consecutive", "reason")


@add(
    "flight_recorder_segments",
    TRIGGER
    + """, ev2 AS (SELECT event_id AS seq, complete_ts AS ts, 100 + bytes // 100 AS size FROM req),
    dp AS (SELECT ts_ns AS t FROM tx WHERE to_state = 'deep'),
    nr AS (SELECT t, seq, ts, size, sum(size) OVER (PARTITION BY t ORDER BY t - ts, -seq ROWS UNBOUNDED PRECEDING) AS kept FROM dp JOIN ev2 ON ts BETWEEN t - 5000000000 AND t)
    SELECT t AS trigger_ns, min(ts) FILTER (kept <= 20000) AS retained_from_ns, count(*) FILTER (kept <= 20000) AS retained_events, cast(coalesce(sum(size) FILTER (kept <= 20000), 0) AS bigint) AS retained_bytes,
      count(*) FILTER (kept > 20000) AS evicted_events FROM nr GROUP BY 1""",
    REC,
)
def flight_recorder_segments(spark, d):
    io = T.requests(spark, d)
    events = io.select("session_id", F.col("request_id").alias("seq"), F.col("complete_ts").alias("ts_ns"), (F.expr("bytes div 100") + 100).alias("size"))
    deep = live.trigger_transitions(trigger_windows(spark, d), POLICY).filter("to_state = 'deep'")
    triggers = deep.select("session_id", F.col("ts_ns").alias("trigger_id"), "ts_ns")
    return live.segments(live.retained_before(events, triggers, keep_bytes=20_000)).drop("session_id", "trigger_id")


@add(
    "segment_events",
    TRIGGER
    + """, nx AS (SELECT *, coalesce(lead(ts_ns) OVER (ORDER BY ts_ns), (SELECT max(complete_ts) FROM req)) AS until_ns FROM tx)
    SELECT t.ts_ns AS trigger_ns, event_id AS request_id FROM nx t JOIN req ON complete_ts BETWEEN ts_ns - 3000000000 AND until_ns WHERE to_state = 'deep'""",
    REC,
)
def segment_events(spark, d):
    events = T.requests(spark, d).select("session_id", "request_id", F.col("complete_ts").alias("ts_ns"))
    found = live.segment_events(events, live.trigger_transitions(trigger_windows(spark, d), POLICY))
    return found.select("trigger_ns", "request_id")


# -- bounded top list, session ends, late evidence ----------------------------------------

SHARE = 0.004


@add(
    "stream_top_issuers_bounded",
    f""", t AS (SELECT pid, cast(sum(total_ns) AS bigint) AS cumulative_ns FROM io WHERE total_ns > 0 GROUP BY 1)
    SELECT pid, cumulative_ns FROM t WHERE cumulative_ns > {SHARE} * (SELECT sum(cumulative_ns) FROM t)""",
    IO,
)
def stream_top_issuers_bounded(spark, d):
    """Issuers with more than a share of the waiting time, found with counters of fixed number."""
    weights = T.requests(spark, d).select("complete_ts", F.col("pid").cast("string").alias("key"), F.col("total_ns").alias("weight"))
    lists = drain(spark, toplist.top_counters(chunked(spark, weights, "complete_ts", "issuers")), "counters", "update")
    found = toplist.above_share(toplist.latest_lists(lists), weights, SHARE)
    return found.select(F.col("key").cast("long").alias("pid"), F.col("weight").alias("cumulative_ns"))


STRETCH = 86_400_000_000


def dealt_records(spark, d):
    """A session per day of the clock; every second one ends with a footer, the others fall silent."""
    stretch = F.expr(f"complete_ts div {STRETCH}")
    rows = T.requests(spark, d).select(F.concat(F.lit("s"), stretch).alias("session_id"), F.col("complete_ts").alias("ts_ns"), (stretch % 2 == 0).alias("even"))
    footers = rows.filter("even").groupBy("session_id").agg(F.max("ts_ns").alias("ts_ns")).withColumn("footer", F.lit(True))
    return rows.select("session_id", "ts_ns", F.lit(False).alias("footer")).unionByName(footers)


@add(
    "stream_session_ends",
    f""", s AS (SELECT 's' || complete_ts // {STRETCH} AS session_id, (complete_ts // {STRETCH}) % 2 = 0 AS even, count(*) AS n, min(complete_ts) AS first_ns, max(complete_ts) AS last_ns FROM req GROUP BY ALL)
    SELECT session_id, CASE WHEN even THEN 'footer' ELSE 'idle' END AS ended, n + even::int AS events, first_ns, last_ns FROM s
    WHERE even OR (last_ns + {STRETCH}) // 1000000 + 1 < (SELECT max(complete_ts) FROM req) // 1000000""",
    EV,
)
def stream_session_ends(spark, d):
    stream = chunked(spark, dealt_records(spark, d), "ts_ns", "records")
    return drain(spark, sessions.session_ends(stream, STRETCH), "ends").drop("batch")


@add(
    "late_origin_refresh",
    """, o AS (SELECT event_id, minor, bytes, k % 3 = 0 OR (k % 3 = 1 AND minor = 2) AS named FROM req)
    SELECT 'dev' || minor AS session_id, count(*) FILTER (named) AS named, cast(coalesce(sum(bytes) FILTER (named), 0) AS bigint) AS named_bytes, count(*) AS requests,
      CASE WHEN minor = 2 THEN 1 ELSE 0 END AS version FROM o GROUP BY minor""",
    EV,
)
def late_origin_refresh(spark, d):
    """Origins of one session arrive after its result was written: only that session is computed again."""
    requests = T.requests(spark, d).select(F.concat(F.lit("dev"), "minor").alias("session_id"), "minor", F.expr("sector div 8").alias("k"), "request_id", "bytes")
    path, evidence = folder(spark, "coverage"), folder(spark, "origins")
    origin = requests.select("session_id", "request_id", F.concat(F.lit("/data/f"), "k").alias("path"), "k", "minor")
    origin.filter("k % 3 = 0").drop("k", "minor").write.parquet(f"{evidence}/batch=0")
    origin.filter("k % 3 = 1 AND minor = 2").drop("k", "minor").write.parquet(f"{evidence}/batch=1")
    arrived = spark.read.schema("session_id string, request_id long, path string, batch long").parquet(evidence)

    def coverage(upto):
        def compute(only):
            origins = only(arrived.filter(F.col("batch") <= upto)).groupBy("session_id", "request_id").agg(F.min("path").alias("path"))
            rows = only(requests).join(origins, ["session_id", "request_id"], "left")
            named = F.col("path").isNotNull()
            return rows.groupBy("session_id").agg(
                F.count_if(named).alias("named"), F.coalesce(F.sum(F.when(named, F.col("bytes"))), F.lit(0)).alias("named_bytes"), F.count(F.lit(1)).alias("requests")
            )

        return compute

    sessions.refresh_results(spark, path, 0, None, coverage(0))
    return sessions.refresh_results(spark, path, 1, sessions.dirty_sessions(arrived, 0), coverage(1)).withColumn("version", F.col("version").cast("int"))
