"""Recordings as text, exports, counters, diagnostics, comparison, presets and sampling."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from iotrail.functions import axes, filters, scalars
from iotrail.operators import sampling
from iotrail.operators.correlate import TTL_NS, annotate_lifetimes
from iotrail.plans import compare, presets, summary
from iotrail.sources import counters, exports, recording
from iotrail.sources import tables as T
from iotrail.session import staged_once, workspace
from iotrail.streaming import live
from verification.base import EV, IO, Suite
from verification.cohorts import ORIGIN, origin
from verification.graphs import EVIDENCE, LABELS, labelled

SUITE = Suite()
add = SUITE.add

_paths: dict[tuple[str, str], str] = {}


def recording_path(spark, d):
    """Write the derived recording as text once: block events, syscalls, origins, junk lines and a footer."""
    slot = (spark.sparkContext.applicationId, d)
    if slot in _paths:
        return _paths[slot]
    blocks = T.block_events(spark, d).withColumnsRenamed({"major": "device_major", "minor": "device_minor"})
    base = ["ts_ns", "request_id", "device_major", "device_minor", "sector", "sectors", "bytes", "operation"]
    parts = [
        recording.event_lines(blocks.filter("kind = 'insert'"), "block_insert", base, "seq"),
        recording.event_lines(blocks.filter("kind = 'issue'"), "block_issue", [*base, "pid", "tid", "cpu", "comm"], "seq"),
        recording.event_lines(blocks.filter("kind = 'complete'"), "block_complete", [*base[:4], "status", "cpu"], "seq"),
    ]
    files = T.file_syscalls(spark, d).select(
        F.col("seq"),
        F.col("start_ns").alias("start_ts_ns"),
        F.col("end_ns").alias("end_ts_ns"),
        "operation",
        "fd",
        "requested_bytes",
        "completed_bytes",
        "pid",
        "tid",
        "comm",
        "path",
        F.lit("exact").alias("confidence"),
        F.struct(F.col("fs_major").alias("fs_device_major"), F.col("fs_minor").alias("fs_device_minor"), "inode").alias("file_identity"),
        "io_mode",
    )
    parts.append(recording.event_lines(files, "file_io", files.columns[1:], "seq"))
    waits = T.table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        T.utc_micros("ts").alias("ts_ns"),
        F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long") * 10).alias("delay_ns"),
        (F.col("user_id") * 10).alias("tid"),
        F.col("user_id").alias("pid"),
        F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("comm"),
        (F.col("user_id") % 8).alias("cpu"),
        F.lit("sched").alias("source"),
    )
    # Error events carry no delay: their lines lack a required field and must be rejected.
    parts.append(recording.event_lines(waits, "scheduler_io_wait", waits.columns[1:], "seq"))
    junk = T.table(spark, d, "documents").select(
        F.col("doc_id").alias("__seq"), F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    )
    parts.append(junk)
    blank = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("__seq"), F.lit("   ").alias("value"))
    parts.append(blank)
    path = os.path.join(workspace(spark), f"recording-{uuid.uuid4().hex}")
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    recording.write_lines(body, path, compress=True)
    _paths[slot] = path
    return path


def lines(spark, d):
    return staged_once(spark, f"lines|{d}", lambda: recording.classify_lines(recording.read_lines(spark, recording_path(spark, d))))


FIO_COUNT = "(SELECT count(*) FROM req, (SELECT unnest([0, 1]) AS c) WHERE operation <> 'discard' AND event_id % 13 <> 0 AND (c = 0 OR event_id % 7 = 0))"


@add(
    "recording_line_status",
    f""" SELECT 'ok' AS status, coalesce(kind, '') AS kind, n FROM (SELECT 'block_insert' AS kind, count(*) AS n FROM req UNION ALL SELECT 'block_issue', count(*) FROM req UNION ALL SELECT 'block_complete', count(*) FROM req
      UNION ALL SELECT 'file_io', {FIO_COUNT} UNION ALL SELECT 'scheduler_io_wait', count(*) FROM events WHERE event_type <> 'error')
    UNION ALL SELECT 'rejected', 'scheduler_io_wait', count(*) FROM events WHERE event_type = 'error'
    UNION ALL SELECT CASE WHEN trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) = '' THEN 'blank' ELSE 'rejected' END, '', count(*) FROM documents GROUP BY 1
    UNION ALL SELECT 'blank', '', count(*) FROM nation""".replace("UNION ALL SELECT 'blank', '', count(*) FROM nation", "UNION ALL SELECT 'blank', '', count(*) FROM nation"),
    EV,
)
def recording_line_status(spark, d):
    return lines(spark, d).groupBy("status", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "recording_integrity",
    f""" SELECT (SELECT count(*) FROM req) * 3 + {FIO_COUNT} + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents WHERE trim(text) <> '') AS total_lines,
      (SELECT count(*) FROM events WHERE event_type = 'error') + (SELECT count(*) FROM documents WHERE trim(text) <> '') AS rejected_lines,
      (SELECT count(*) FROM req) * 3 + {FIO_COUNT} + (SELECT count(*) FROM events WHERE event_type <> 'error') AS accepted_events,
      CAST(NULL AS boolean) AS integrity_ok""",
    EV,
)
def recording_integrity(spark, d):
    one = lines(spark, d).withColumn("session_id", F.lit("all"))
    return recording.integrity(one).select("total_lines", "rejected_lines", "accepted_events", "integrity_ok")


@add(
    "recording_integrity_with_footer",
    """ SELECT minor, count(*) AS accepted_events, CASE WHEN minor = 3 THEN NULL ELSE minor <> 1 END AS integrity_ok FROM req GROUP BY 1""",
    EV,
)
def recording_integrity_with_footer(spark, d):
    out = recording.integrity(footed_lines(spark, d))
    return out.select(F.col("session_id").cast("long").alias("minor"), "accepted_events", "integrity_ok")


@add("closed_sessions", " SELECT minor, minor <> 3 AS closed FROM req GROUP BY 1", EV)
def closed_sessions(spark, d):
    """A session is closed by its footer; the one without a footer is still partial."""
    return live.closed_sessions(footed_lines(spark, d)).select(F.col("session_id").cast("long").alias("minor"), "closed")


@add("deleted_paths", f" SELECT event_id, k % 3 = 0 AS deleted FROM req", EV)
def deleted_paths(spark, d):
    """The kernel's mark of an unlinked file at the end of a path."""
    path = F.concat(F.lit("/data/f"), F.col("request_id").cast("string"), F.when(F.col("address") % 3 == 0, F.lit(" (deleted)")).otherwise(F.lit("")))
    io = T.requests(spark, d).withColumn("address", F.expr("sector div 8"))
    return io.select(F.col("request_id").alias("event_id"), scalars.path_deleted(path).alias("deleted"))


@add(
    "sector_overlap",
    """ SELECT a.event_id, CASE WHEN a.k % 7 = 0 OR b.k % 7 = 0 THEN a.sector = b.sector ELSE a.sector < b.sector + b.sectors AND b.sector < a.sector + a.sectors END AS overlaps
      FROM req a JOIN req b ON b.event_id = a.event_id + 1""",
    EV,
)
def sector_overlap(spark, d):
    """Each request against the next one; every seventh address has an unknown length."""
    known = F.when(F.expr("sector div 8") % 7 == 0, F.lit(0)).otherwise(F.col("sectors"))
    io = T.requests(spark, d).select("request_id", "sector", known.alias("sectors"))
    after = io.select((F.col("request_id") - 1).alias("request_id"), F.col("sector").alias("b_sector"), F.col("sectors").alias("b_sectors"))
    return io.join(after, "request_id").select(F.col("request_id").alias("event_id"), scalars.ranges_overlap("sector", "sectors", "b_sector", "b_sectors").alias("overlaps"))


def footed_lines(spark, d):
    """Four sessions, one per device: correct footer, wrong footer, dropped events counted, no footer."""
    blocks = T.block_events(spark, d).filter("kind = 'issue'").withColumnsRenamed({"major": "device_major", "minor": "device_minor"})
    base = ["ts_ns", "request_id", "device_major", "device_minor", "sector", "sectors", "bytes", "operation", "pid", "tid", "cpu", "comm"]
    body = recording.event_lines(blocks, "block_issue", base, "seq").withColumn("minor", F.get_json_object("value", "$.event.data.device_minor").cast("long"))
    counts = blocks.groupBy(F.col("device_minor").alias("minor")).agg(F.count(F.lit(1)).alias("n")).filter("minor <> 3")
    dropped = F.when(F.col("minor") == 2, 5).otherwise(0)
    seen = F.col("n") + dropped + F.when(F.col("minor") == 1, 1).otherwise(0)
    foot = counts.select(
        F.lit(1 << 62).alias("__seq"), recording.footer_line(seen, F.col("n"), dropped, F.lit(0)).alias("value"), "minor"
    )
    raw = body.unionByName(foot).select(
        "value", F.col("minor").cast("string").alias("session_id"), F.col("__seq").alias("line_no")
    )
    return recording.classify_lines(raw)


@add(
    "recording_correlation",
    """ SELECT request_id, issue_ts, complete_ts, insert_ts, operation, bytes, status FROM req""",
    EV,
)
def recording_correlation(spark, d):
    """From text lines to correlated requests."""
    stream = recording.block_stream(lines(spark, d)).withColumn("session_id", F.lit("text"))
    done = annotate_lifetimes(stream, TTL_NS, time_sorted=False).filter("matched")
    return done.select(
        "request_id",
        F.col("source.ts_ns").alias("issue_ts"),
        F.col("ts_ns").alias("complete_ts"),
        F.col("source.insert_ts").alias("insert_ts"),
        F.col("source.operation").alias("operation"),
        F.col("source.bytes").alias("bytes"),
        "status",
    )


@add(
    "event_intervals",
    """, iv AS (SELECT 'block_insert' AS kind, insert_ts AS s, insert_ts AS e FROM req UNION ALL SELECT 'block_issue', issue_ts, issue_ts FROM req UNION ALL SELECT 'block_complete', complete_ts, complete_ts FROM req
      UNION ALL SELECT 'file_io', fs, fe FROM fio UNION ALL SELECT 'scheduler_io_wait', epoch_us(ts), epoch_us(ts) FROM events WHERE event_type <> 'error')
    SELECT kind, count(*) AS n, min(s) AS start_ns, max(e) AS end_ns FROM iv GROUP BY 1""",
    EVIDENCE,
)
def event_intervals(spark, d):
    iv = recording.event_intervals(lines(spark, d))
    return iv.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))


@add(
    "reload_window",
    """, w AS (SELECT min(complete_ts) + 500000000000 AS lo, min(complete_ts) + 700000000000 AS hi FROM io),
    kp AS (SELECT io.* FROM io, w WHERE complete_ts BETWEEN lo AND hi),
    sp AS (SELECT min(insert_ts) AS lo, max(complete_ts) AS hi FROM kp)
    SELECT (SELECT count(*) FROM kp) AS requests, (SELECT cast(sum(issue_depth) AS bigint) FROM kp) AS depth_sum,
      (SELECT count(*) FROM ori, sp WHERE (ori.ts <= sp.hi + 30000000000 AND ori.ts >= sp.lo - 30000000000) OR event_id IN (SELECT event_id FROM kp)) AS evidence""",
    EVIDENCE,
)
def reload_window(spark, d):
    io = T.requests(spark, d)
    first = io.agg(F.min("complete_ts")).first()[0]
    ev = T.request_origins(spark, d).select("session_id", "seq", "request_id", F.col("ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"))
    kept, evidence = recording.reload_window(io, ev, first + 500_000_000_000, first + 700_000_000_000)
    return kept.agg(F.count(F.lit(1)).alias("requests"), F.sum("issue_depth").alias("depth_sum")).join(
        evidence.agg(F.count(F.lit(1)).alias("evidence")), F.lit(True)
    )


@add(
    "raw_line_context",
    """ SELECT count(*) * 3 AS matched, true AS has_context, true AS bounded FROM (SELECT * FROM req ORDER BY complete_ts - insert_ts DESC, event_id DESC LIMIT 1)""",
    EV,
)
def raw_line_context(spark, d):
    text = lines(spark, d)
    io = T.requests(spark, d)
    slowest = io.agg(F.max_by(F.struct("request_id", "major", "minor", "insert_ts", "issue_ts", "complete_ts"), F.struct("total_ns", "request_id")).alias("s")).select("s.*")
    # The recording is a folder of part files, each a session of its own here.
    life = text.select("session_id").distinct().join(slowest, F.lit(True))
    shown = recording.raw_context(text, life)
    return shown.agg(
        F.count_if("matched").alias("matched"),
        (F.count(F.lit(1)) > 3).alias("has_context"),
        (F.count(F.lit(1)) <= 21).alias("bounded"),
    )


# -- exports ---------------------------------------------------------------------


@add(
    "export_events",
    """ SELECT kind, count(*) AS n, count(ts_ns) AS with_time, count(pid) AS with_pid, count(path) AS with_path, cast(sum(bytes) AS bigint) AS bytes FROM (
      SELECT 'block_insert' AS kind, insert_ts AS ts_ns, NULL AS pid, NULL AS path, bytes FROM req UNION ALL SELECT 'block_issue', issue_ts, pid, NULL, bytes FROM req
      UNION ALL SELECT 'block_complete', complete_ts, NULL, NULL, NULL FROM req UNION ALL SELECT 'file_io', fe, pid, path, want FROM fio) GROUP BY 1""",
    EVIDENCE,
)
def export_events(spark, d):
    table = exports.event_csv(T.block_events(spark, d), T.file_syscalls(spark, d))
    path = os.path.join(workspace(spark), f"events-csv-{uuid.uuid4().hex}")
    exports.write_csv(table, path)
    schema = ", ".join(f"{c} string" for c in exports.EVENT_COLUMNS)
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ts_ns").alias("with_time"),
        F.count("pid").alias("with_pid"),
        F.count("path").alias("with_path"),
        F.sum(F.col("bytes").cast("long")).alias("bytes"),
    )


@add(
    "export_cohort",
    """ SELECT io.request_id, io.major || ':' || io.minor AS device, io.sector + io.sectors AS end_sector_exclusive, CASE WHEN io.operation <> 'discard' THEN io.bytes ELSE 0 END AS rw_payload_bytes,
      coalesce(n, 0) AS file_candidates FROM io LEFT JOIN (SELECT event_id, count(*) AS n FROM org GROUP BY 1) o ON o.event_id = io.event_id""",
    EVIDENCE,
)
def export_cohort(spark, d):
    table = exports.cohort_csv(T.requests(spark, d), T.file_origins(spark, d))
    return table.select(
        "request_id",
        "device",
        "end_sector_exclusive",
        "rw_payload_bytes",
        F.coalesce(F.json_array_length("file_candidates_json"), F.lit(0)).alias("file_candidates"),
    )


@add(
    "export_summary",
    """, s AS (SELECT count(*) AS completed, count(*) FILTER (access_pattern = 'random') AS rnd, cast(max(queue_depth_at_issue) AS bigint) AS depth FROM io)
    SELECT unnest(['completed', 'random', 'max_queue_depth']) AS metric, unnest([completed::varchar, rnd::varchar, depth::varchar]) AS value FROM s""",
    IO,
)
def export_summary(spark, d):
    out = exports.long_form(summary.session_summary(T.requests(spark, d)))
    return out.filter("metric in ('completed', 'random', 'max_queue_depth')")


@add(
    "export_analysis_view",
    """ SELECT 'analysis' AS record, 1 AS n, CAST(NULL AS bigint) AS bytes UNION ALL SELECT 'request', count(*), cast(sum(bytes) AS bigint) FROM io""",
    IO,
)
def export_analysis_view(spark, d):
    io = T.requests(spark, d)
    view = exports.analysis_view(io, T.file_origins(spark, d), summary.access_counts(io))
    return view.groupBy(F.get_json_object("value", "$.record").alias("record")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("value", "$.bytes").cast("long")).alias("bytes")
    )


@add(
    "export_graph_summary",
    """, g AS (SELECT operation AS grp, total_ns / 1e6 AS v FROM io),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM g)
    SELECT 'percentile' AS kind, 'p50' AS metric, grp, max(CASE WHEN rn = (50 * n + 99) // 100 THEN v END) AS value, 'ms' AS unit FROM r GROUP BY grp
    UNION ALL SELECT 'category', 'requests', operation, count(*)::double, 'count' FROM io GROUP BY operation""",
    IO,
)
def export_graph_summary(spark, d):
    from iotrail.operators.stats import nearest_rank

    io = T.requests(spark, d)
    points = io.select(F.col("operation").alias("grp"), axes.AXES["total_latency_ms"](0).alias("v"))
    pct = nearest_rank(points, ["grp"], "v", [50]).select("grp", F.lit("p50").alias("metric"), F.col("p50").alias("value"), F.lit("ms").alias("unit"))
    cat = io.groupBy(F.col("operation").alias("grp")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("requests")).withColumn("unit", F.lit("count"))
    return exports.graph_summary_csv({"percentile": pct, "category": cat}).drop("lower", "upper")


# -- counters and diagnostics -------------------------------------------------------


def disk_polls(spark, d):
    """Counter texts of every order day: four disks of growing counters, one short line, one reset and one reboot."""
    o = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("c")
    )
    day = F.datediff("day", F.lit("1990-01-01"))
    base = day.cast("long") * 1000
    line = lambda i: F.concat(F.lit(f"   8   {i} sd{i} "), F.concat_ws(" ", *[
        (F.when(F.lit(f == 2) & (day % 97 == i), F.lit(0)).otherwise(base * (f + 1) + F.col("n") * i)).cast("string") for f in range(11)
    ]))
    raw = F.concat_ws("\n", *[line(i) for i in range(4)], F.lit("   8   9 short 1 2 3"), F.lit("   8   8 bad x x x x x x x x x x x"))
    return o.select(
        F.lit("s").alias("session_id"),
        day.cast("long").alias("poll"),
        (day.cast("long") * 1000).alias("elapsed_ms"),
        F.when(day % 500 < 250, "a").otherwise("b").alias("boot_id"),
        raw.alias("raw"),
    )


DISK = """WITH o AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::date) AS poll, count(*) AS n FROM orders GROUP BY 1),
    k AS (SELECT poll, CASE WHEN poll % 500 < 250 THEN 'a' ELSE 'b' END AS boot, i, poll * 1000 * 1 + n * i AS reads, CASE WHEN poll % 97 = i THEN 0 ELSE poll * 1000 * 3 + n * i END AS rs, poll * 1000 * 5 + n * i AS writes, poll * 1000 * 7 + n * i AS ws
      FROM o, (SELECT unnest([0, 1, 2, 3]) AS i)),
    l AS (SELECT *, lag(poll) OVER w AS pp, lag(boot) OVER w AS pb, lag(reads) OVER w AS r0, lag(rs) OVER w AS rs0, lag(writes) OVER w AS w0, lag(ws) OVER w AS ws0 FROM k WINDOW w AS (PARTITION BY i ORDER BY poll)),
    g AS (SELECT *, pb = boot AS usable, reads >= r0 AND rs >= rs0 AND writes >= w0 AND ws >= ws0 AS grown FROM l WHERE pp IS NOT NULL)"""


@add(
    "disk_counter_totals",
    DISK
    + """ SELECT '8:' || i || ' sd' || i AS disk, cast(coalesce(sum(CASE WHEN usable AND grown THEN reads - r0 END), 0) AS bigint) AS reads, cast(coalesce(sum(CASE WHEN usable AND grown THEN rs - rs0 END), 0) AS bigint) AS read_sectors,
      cast(coalesce(sum(CASE WHEN usable AND grown THEN writes - w0 END), 0) AS bigint) AS writes, cast(coalesce(sum(CASE WHEN usable AND grown THEN ws - ws0 END), 0) AS bigint) AS write_sectors,
      count(*) FILTER (usable AND grown) AS samples, count(*) FILTER (usable AND NOT grown) AS resets FROM g GROUP BY i""",
)
def disk_counter_totals(spark, d):
    polls = disk_polls(spark, d)
    rows = counters.parse_disk_stats(polls).join(polls.select("session_id", "elapsed_ms", "poll"), ["session_id", "elapsed_ms"])
    return counters.disk_totals(counters.disk_deltas(rows, polls)).drop("session_id")


@add(
    "disk_counter_rates",
    DISK
    + """ SELECT '8:' || i || ' sd' || i AS disk, poll, CASE WHEN usable AND grown THEN cast((rs - rs0) + (ws - ws0) AS double) * 512.0 / 1048576.0 / ((poll - pp) * 1000 / 1000.0) END AS mib_s, usable AND NOT grown AS reset FROM g""",
)
def disk_counter_rates(spark, d):
    polls = disk_polls(spark, d)
    rows = counters.parse_disk_stats(polls).join(polls.select("session_id", "elapsed_ms", "poll"), ["session_id", "elapsed_ms"])
    return counters.disk_deltas(rows, polls).select("disk", "poll", "mib_s", "reset")


def waits(spark, d):
    return counters.valid_waits(recording.events(lines(spark, d), "scheduler_io_wait"))


WAITS = """WITH w AS (SELECT epoch_us(ts) AS ts_ns, cast(round(value * 100) AS bigint) * 10 AS delay_ns, user_id * 10 AS tid, user_id AS pid, 'user-' || (user_id % 10) AS comm, user_id % 8 AS cpu FROM events WHERE event_type <> 'error')"""


@add(
    "scheduler_io_wait",
    WAITS
    + """ SELECT greatest(ts_ns - (SELECT min(ts_ns) FROM w), 0) / 1e6 AS time_ms, delay_ns / 1000.0::double AS delay_us, pid, tid FROM w WHERE cpu = 3 AND lower(comm) LIKE '%user-1%'""",
)
def scheduler_io_wait(spark, d):
    w = waits(spark, d)
    start = w.agg(F.min("ts_ns")).first()[0]
    view = counters.scheduler_view(w, start, filters.CohortFilter(cpu=3, process="USER-1"))
    return view.select("time_ms", "delay_us", "pid", "tid")


@add("scheduler_incompatible_filter", WAITS + " SELECT count(*) AS n FROM w WHERE false")
def scheduler_incompatible_filter(spark, d):
    view = counters.scheduler_view(waits(spark, d), 0, filters.CohortFilter(operation="read"))
    return view.agg(F.count(F.lit(1)).alias("n"))


@add(
    "scheduler_distribution",
    WAITS
    + """, r AS (SELECT delay_ns / 1000.0::double AS v, row_number() OVER (ORDER BY delay_ns) AS rn, count(*) OVER () AS n FROM w)
    SELECT """
    + ", ".join(f"max(CASE WHEN rn = ({p} * n + 99) // 100 THEN v END) AS p{p}" for p in (50, 90, 95, 99))
    + " FROM r",
)
def scheduler_distribution(spark, d):
    return counters.scheduler_distribution(waits(spark, d))[0]


@add(
    "time_origin",
    """ SELECT least((SELECT min(insert_ts) FROM req), (SELECT min(epoch_us(ts)) FROM events WHERE event_type <> 'error')) AS origin_ns""",
    EV,
)
def time_origin(spark, d):
    a = T.requests(spark, d).agg(F.min("insert_ts").alias("a"))
    b = waits(spark, d).agg(F.min("ts_ns").alias("b"))
    return a.join(b, F.lit(True)).select(F.least("a", "b").alias("origin_ns"))


def diagnostic_lines(spark, d):
    """One diagnostic per document whose detail is the document text; every seventh line is not JSON."""
    docs = T.table(spark, d, "documents")
    record = F.struct(
        F.col("doc_id").cast("long").alias("ts_unix_ms"),
        F.lit("info").alias("level"),
        F.concat(F.lit("part."), F.col("source")).alias("component"),
        F.lit("text.seen").alias("event"),
        F.lit("s").alias("session_id"),
        F.lit("ok").alias("outcome"),
        F.upper("lang").alias("code"),
        F.col("doc_id").cast("string").alias("correlation_id"),
        F.col("text").alias("detail"),
    )
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("not json "), "text")).otherwise(F.to_json(record)).alias("value"))


@add(
    "diagnostic_rows",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'warn' ELSE 'info' END AS level, CASE WHEN doc_id % 7 = 0 THEN 'AGENT_DIAGNOSTIC_INVALID' ELSE left(upper(lang), 64) END AS code,
      CASE WHEN doc_id % 7 = 0 THEN 'desktop.capture' ELSE left('part.' || source, 64) END AS component,
      len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS detail_words FROM documents""",
)
def diagnostic_rows(spark, d):
    return counters.parse_diagnostics(diagnostic_lines(spark, d)).select(
        "doc_id", "level", "code", "component", F.size(F.split("detail", " ")).cast("long").alias("detail_words")
    )


@add("diagnostic_search", """SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND (upper(lang) LIKE '%EN%' OR lower('part.' || source) LIKE '%en%' OR 'text.seen' LIKE '%en%')
  UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND ('agent.diagnostic.decode' LIKE '%en%' OR 'desktop.capture' LIKE '%en%' OR 'agent_diagnostic_invalid' LIKE '%en%')""")
def diagnostic_search(spark, d):
    return counters.search_diagnostics(counters.parse_diagnostics(diagnostic_lines(spark, d)), "EN").select("doc_id")


@add(
    "path_redaction",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS w, generate_subscripts(string_split_regex(text, '[ \t\n\x0B\f\r]+'), 1) AS i FROM documents)
    SELECT documents.doc_id, coalesce(x.words, 0) AS words, coalesce(x.redacted, 0) AS redacted, coalesce(x.kept, '') AS digest FROM documents LEFT JOIN (
      SELECT doc_id, count(*) AS words, count(*) FILTER (p) AS redacted, md5(string_agg(CASE WHEN p THEN '<redacted-path>' ELSE w END, ' ' ORDER BY i)) AS kept
      FROM (SELECT *, contains(w, '/data/') OR contains(w, '/storage/') OR starts_with(w, '/') OR (substring(w, 2, 1) = ':' AND (contains(w, '\') OR contains(w, '/'))) AS p FROM w WHERE w <> '') GROUP BY 1) x ON x.doc_id = documents.doc_id""",
)
def path_redaction(spark, d):
    """Whole texts; the digest compares the full redacted text."""
    docs = T.table(spark, d, "documents").select("doc_id", scalars.redact_paths("text").alias("clean"))
    words = F.when(F.col("clean") == "", F.lit(0)).otherwise(F.size(F.split("clean", " ")))
    hits = F.when(F.col("clean") == "", F.lit(0)).otherwise(F.size(F.filter(F.split("clean", " "), lambda w: w == "<redacted-path>")))
    return docs.select("doc_id", words.alias("words"), hits.alias("redacted"), F.when(F.col("clean") == "", "").otherwise(F.md5("clean")).alias("digest"))


@add(
    "stack_cohorts",
    """SELECT event_type AS kind, user_id % 16 AS stack_id, count(*) AS samples, count(*) FILTER (round(value * 100) * 1000 >= 5000000) AS tail_samples,
      cast(sum(cast(round(value * 100) AS bigint) * 1000) AS bigint) AS cumulative_ns, max(user_id % 32) AS max_frames FROM events GROUP BY ALL""",
)
def stack_cohorts(spark, d):
    e = T.table(spark, d, "events").select(
        F.col("event_type").alias("kind"),
        (F.col("user_id") % 16).alias("stack_id"),
        (F.round(F.col("value") * 100).cast("long") * 1000).alias("latency_ns"),
        (F.col("user_id") % 32).alias("frames"),
    )
    return counters.stack_cohorts(e)


@add(
    "cpu_aggregate_merge",
    """, b AS (SELECT request_id // 1000 AS generation, cpu, least(length(bin(greatest(device_ns, 1))) - 1, 31) AS bucket, bytes FROM io),
    h AS (SELECT generation, bucket, count(*) AS n FROM b GROUP BY ALL)
    SELECT g.generation, g.observed, g.bytes, (SELECT cast(sum(n * (bucket + 1)) AS bigint) FROM h WHERE h.generation = g.generation) AS weighted
    FROM (SELECT generation, count(*) AS observed, cast(sum(bytes) AS bigint) AS bytes FROM b GROUP BY 1) g""",
    IO,
)
def cpu_aggregate_merge(spark, d):
    """Per-CPU counters and 32-bucket histograms of a generation merge to one."""
    from iotrail.operators.stats import log2_bucket

    bucket = F.least(log2_bucket("device_ns"), F.lit(31))
    cells = T.requests(spark, d).select(F.expr("request_id div 1000").alias("generation"), "cpu", bucket.alias("bucket"), "bytes")
    per_cpu = cells.groupBy("generation", "cpu").agg(
        F.count(F.lit(1)).alias("observed"),
        F.sum("bytes").alias("bytes"),
        F.array(*[F.count_if(F.col("bucket") == i) for i in range(32)]).alias("histogram"),
    )
    merged = counters.merge_cpu_aggregates(per_cpu, ["observed", "bytes"])
    weighted = F.aggregate(F.zip_with("histogram", F.sequence(F.lit(1), F.lit(32)), lambda n, w: n * w), F.lit(0).cast("long"), lambda a, b: a + b)
    return merged.select("generation", "observed", "bytes", weighted.alias("weighted"))


@add(
    "probe_states",
    """SELECT CASE WHEN user_id % 3 = 0 THEN 'attached' WHEN user_id % 3 = 1 THEN 'missing' ELSE 'failed' END AS state, count(*) * 1 AS n FROM events GROUP BY 1""",
)
def probe_states(spark, d):
    state = F.when(F.col("user_id") % 3 == 0, "attached").when(F.col("user_id") % 3 == 1, "missing").otherwise("failed")
    plans = T.table(spark, d, "events").select(F.array(F.struct(F.col("event_type").alias("probe"), state.alias("state"))).alias("attach_plan"))
    return counters.probe_states(plans)


@add(
    "opaque_keys",
    "SELECT count(DISTINCT user_id) AS keys, true AS stable FROM events",
)
def opaque_keys(spark, d):
    e = T.table(spark, d, "events").select("user_id", scalars.opaque_key("salt", "user_id").alias("k"), scalars.opaque_key("salt", "user_id").alias("again"))
    return e.agg(F.countDistinct("k").alias("keys"), F.bool_and(F.col("k") == F.col("again")).alias("stable"))


@add(
    "id_round_trip",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id - 1 END AS signed_id, CASE WHEN event_id % 2 = 0 THEN event_id::varchar ELSE (18446744073709551615::hugeint - event_id)::varchar END AS unsigned_id FROM events",
)
def id_round_trip(spark, d):
    signed = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id") - 1)
    e = T.table(spark, d, "events").select("event_id", scalars.unsigned_id(signed).alias("u"))
    return e.select("event_id", scalars.signed_id("u").alias("signed_id"), F.col("u").cast("string").alias("unsigned_id"))


# -- comparison ---------------------------------------------------------------------


def halves(spark, d):
    io = T.requests(spark, d)
    lo, hi = io.agg(F.min("complete_ts"), F.max("complete_ts")).first()
    middle = (lo + hi) // 2
    return io.filter(F.col("complete_ts") < middle), io.filter(F.col("complete_ts") >= middle)


HALVES = """, md AS (SELECT (min(complete_ts) + max(complete_ts)) // 2 AS m FROM io), sd AS (SELECT io.*, complete_ts >= m AS cur FROM io, md)"""


@add(
    "compare_sessions",
    HALVES
    + """, pv AS (SELECT cur, count(*) AS completed, cast(sum(CASE WHEN operation = 'read' THEN bytes ELSE 0 END) AS bigint) AS read_bytes, cast(sum(CASE WHEN operation = 'write' THEN bytes ELSE 0 END) AS bigint) AS write_bytes,
        count(*) FILTER (access_pattern = 'random') AS random, cast(max(queue_depth_at_issue) AS bigint) AS max_queue_depth FROM sd GROUP BY 1),
    rk AS (SELECT cur, total_ns, row_number() OVER (PARTITION BY cur ORDER BY total_ns) AS rn, count(*) OVER (PARTITION BY cur) AS n FROM sd),
    p AS (SELECT cur, max(CASE WHEN rn = (50 * n + 99) // 100 THEN total_ns END) AS p50, max(CASE WHEN rn = (99 * n + 99) // 100 THEN total_ns END) AS p99 FROM rk GROUP BY 1),
    lg AS (SELECT cur, unnest(['completed', 'read_bytes', 'write_bytes', 'random', 'max_queue_depth', 'p50', 'p99']) AS metric, unnest([completed, read_bytes, write_bytes, random, max_queue_depth, p50, p99]) AS value FROM pv JOIN p USING (cur))
    SELECT metric, a.value AS baseline, b.value AS current, b.value - a.value AS delta, (b.value - a.value) * 100.0::double / a.value AS percent FROM (SELECT * FROM lg WHERE NOT cur) a JOIN (SELECT * FROM lg WHERE cur) b USING (metric)""",
    IO,
)
def compare_sessions(spark, d):
    out = compare.compare_summaries(*halves(spark, d))
    return out.filter("metric in ('completed', 'read_bytes', 'write_bytes', 'random', 'max_queue_depth', 'p50', 'p99')")


@add(
    "compare_filtered_sessions",
    HALVES
    + """ SELECT 'completed' AS metric, count(*) FILTER (NOT cur AND minor = 1) AS baseline, count(*) FILTER (cur AND minor = 2) AS current,
      count(*) FILTER (cur AND minor = 2) - count(*) FILTER (NOT cur AND minor = 1) AS delta,
      (count(*) FILTER (cur AND minor = 2) - count(*) FILTER (NOT cur AND minor = 1)) * 100.0::double / count(*) FILTER (NOT cur AND minor = 1) AS percent
    FROM sd WHERE operation = 'read' AND bytes >= 65536""",
    IO,
)
def compare_filtered_sessions(spark, d):
    a, b = halves(spark, d)
    shared = filters.CohortFilter(operation="read", min_bytes=65536)
    out = compare.compare_cohorts(a, b, shared, filters.CohortFilter(device="8:1"), filters.CohortFilter(device="8:2"))
    return out.filter("metric = 'completed'")


@add(
    "compare_order_sessions",
    """WITH s AS (SELECT o_orderpriority, o_orderdate >= TIMESTAMP '1998-01-01' AS cur, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS value FROM orders WHERE o_orderstatus <> 'P' OR o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL),
    a AS (SELECT * FROM s WHERE NOT cur), b AS (SELECT * FROM s WHERE cur)
    SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.value AS baseline, b.value AS current, b.value - a.value AS delta,
      CASE WHEN a.value <> 0 THEN (b.value - a.value) * 100.0::double / a.value END AS percent FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority""",
)
def compare_order_sessions(spark, d):
    o = T.table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")

    def side(rows):
        return rows.groupBy("o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("value"))

    before = side(o.filter((F.col("o_orderdate").cast("timestamp") < cut) & (F.col("o_orderstatus") != "P")))
    after = side(o.filter(F.col("o_orderdate").cast("timestamp") >= cut))
    return compare.compare_long(before, after, ["o_orderpriority"])


@add("compare_selected_keys", "SELECT 'left' AS side, request_id FROM io WHERE bytes / 1024.0 = 40.0 UNION ALL SELECT 'right', request_id FROM io WHERE bytes / 1024.0 = 200.0", IO)
def compare_selected_keys(spark, d):
    """Two overlapping chunk ranges: the keys only one of them selects."""
    io = T.requests(spark, d).withColumn("kib", F.col("bytes") / 1024.0)
    return compare.same_keys(
        io.filter(F.col("kib").between(40.0, 196.0)), io.filter(F.col("kib").between(44.0, 200.0)), ["request_id"]
    ).select("side", "request_id")


@add(
    "export_comparison",
    HALVES + " SELECT count(*) FILTER (NOT cur) AS baseline, count(*) FILTER (cur) AS current FROM sd",
    IO,
)
def export_comparison(spark, d):
    a, b = (summary.session_summary(x) for x in halves(spark, d))
    doc = exports.comparison_json(a, b)
    return doc.select(
        F.get_json_object("value", "$.baseline.completed").cast("long").alias("baseline"),
        F.get_json_object("value", "$.current.completed").cast("long").alias("current"),
    )


# -- presets ---------------------------------------------------------------------------

TIME = f"greatest(complete_ts - {ORIGIN}, 0) / 1e6"
SCATTER_SQL = {
    "latency_timeline": (TIME, "total_ns / 1e6", "operation"),
    "queue_pressure": ("queue_depth_at_issue::double", "total_ns / 1e6", "operation"),
    "lba_distribution": (TIME, "sector * 512.0::double / 1e6", "operation"),
    "chunk_timeline": (TIME, "bytes / 1024.0::double", "operation"),
    "queue_timeline": (TIME, "issue_depth::double", "operation"),
    "issue_gap_timeline": (TIME, "issue_gap_ns / 1e6", "operation"),
    "completion_gap_timeline": (TIME, "completion_gap_ns / 1e6", "operation"),
    "normalized_latency_timeline": (TIME, "CASE WHEN operation <> 'discard' THEN device_ns / 1e6 / (bytes / 1024.0::double) END", "operation"),
    "cpu_timeline": (TIME, "cpu::double", "comm || ' (' || pid || ')'"),
    "rolling_c2c_bandwidth": (TIME, "completion_rate_payload::double * 1e9 / completion_rate_duration::double / 1048576.0::double", "operation"),
    "rolling_d2d_bandwidth": (TIME, "issue_rate_payload::double * 1e9 / issue_rate_duration::double / 1048576.0::double", "operation"),
}


def _register_scatter(name: str, x: str, y: str, grp: str) -> None:
    @add(name, f" SELECT request_id, {x} AS x, {y} AS y, {grp} AS grp FROM io", IO)
    def query(spark, d):
        return presets.scatter(name, T.requests(spark, d), origin(spark, d))


for _name, (_x, _y, _g) in SCATTER_SQL.items():
    _register_scatter(_name, _x, _y, _g)


@add("latency_by_file", LABELS + f" SELECT request_id, {TIME} AS x, total_ns / 1e6 AS y, coalesce(file_group, 'Unattributed') AS grp FROM fl", EVIDENCE)
def latency_by_file(spark, d):
    return presets.scatter("latency_by_file", labelled(spark, d), origin(spark, d))


@add(
    "layer_contribution",
    LABELS
    + """, sx AS (SELECT event_id, sum(stop - s) FILTER (layer = 'filesystem')::bigint / 1e6 AS fs, sum(stop - s) FILTER (layer = 'ufs')::bigint / 1e6 AS ufs FROM stk GROUP BY 1)
    SELECT fl.request_id, fs AS x, ufs AS y, coalesce(file_group, 'Unattributed') AS grp FROM fl LEFT JOIN sx ON sx.event_id = fl.event_id""",
    EVIDENCE,
)
def layer_contribution(spark, d):
    from iotrail.plans.attribution import with_graph_axes

    nodes, _ = T.graph_tables(spark, d)
    return presets.scatter("layer_contribution", with_graph_axes(labelled(spark, d), nodes), 0)


QUOTA = """, oc AS (SELECT operation, count(*) AS n, greatest(1, 3000 * count(*) // (SELECT count(*) FROM io)) AS q FROM io GROUP BY 1),
    ox AS (SELECT io.*, row_number() OVER (PARTITION BY io.operation ORDER BY complete_ts, event_id) - 1 AS ix, n, q FROM io JOIN oc ON oc.operation = io.operation),
    sm AS (SELECT * FROM ox WHERE n <= q OR ix IN (SELECT i * (n - 1) // (q - 1) FROM range(3000) t(i) WHERE i < q))"""


@add(
    "overall",
    f" SELECT request_id, {TIME} AS time_ms, sector::double AS sector, issue_depth::double AS depth, bytes / 1024.0::double AS chunk_kib FROM io",
    IO,
)
def overall(spark, d):
    return presets.overall(T.requests(spark, d), origin(spark, d))


@add(
    "connected_footprint",
    f" SELECT request_id, greatest(issue_ts - {ORIGIN}, 0) / 1e6 AS from_ms, {TIME} AS to_ms, sector::double AS sector, operation FROM io",
    IO,
)
def connected_footprint(spark, d):
    return presets.connected_footprint(T.requests(spark, d), origin(spark, d))


@add(
    "command_timeline",
    f", l AS (SELECT request_id, {TIME} AS x, major || ':' || minor || ' / ' || operation AS label FROM io) SELECT *, dense_rank() OVER (ORDER BY label) AS lane FROM l",
    IO,
)
def command_timeline(spark, d):
    return presets.command_timeline(T.requests(spark, d), origin(spark, d))


@add(
    "cpu_events",
    f""", l AS (SELECT request_id, 'issue' AS phase, greatest(issue_ts - {ORIGIN}, 0) / 1e6 AS x, major || ':' || minor || ' / CPU ' || lpad(cpu::varchar, 4, '0') AS label FROM io
      UNION ALL SELECT request_id, 'completion', {TIME}, major || ':' || minor || ' / CPU ' || lpad(complete_cpu::varchar, 4, '0') FROM io) SELECT *, dense_rank() OVER (ORDER BY label) AS lane FROM l""",
    IO,
)
def cpu_events(spark, d):
    return presets.cpu_events(T.requests(spark, d), origin(spark, d))


@add("request_gantt", f' SELECT request_id, row_number() OVER (ORDER BY issue_ts, complete_ts, request_id) AS "row", {TIME} AS x FROM io', IO)
def request_gantt(spark, d):
    return presets.request_gantt(T.requests(spark, d), origin(spark, d))


@add(
    "footprint_lanes_by_process",
    """ SELECT major || ':' || minor || ' / ' || comm || ' · PID ' || pid AS lane, count(*) AS n, cast(sum(bytes) AS bigint) AS bytes, (SELECT count(*) FROM io) AS distinct_requests FROM io GROUP BY 1""",
    IO,
)
def footprint_lanes_by_process(spark, d):
    io = T.requests(spark, d)
    return presets.lane_counts(presets.footprint_lanes(io, "process"), io)


@add(
    "footprint_lanes_by_file",
    """, cn AS (SELECT DISTINCT event_id, coalesce(path, inode_label) AS file FROM orl)
    SELECT coalesce(file, '<path unresolved>') || ' | ' || major || ':' || minor || ' / ' || comm || ' · PID ' || pid AS lane, count(*) AS n, cast(sum(bytes) AS bigint) AS bytes, (SELECT count(*) FROM io) AS distinct_requests
    FROM io LEFT JOIN cn ON cn.event_id = io.event_id GROUP BY 1""",
    EVIDENCE,
)
def footprint_lanes_by_file(spark, d):
    io = T.requests(spark, d)
    return presets.lane_counts(presets.footprint_lanes(io, "file_process", T.file_origins(spark, d)), io)


# -- sampling ------------------------------------------------------------------------------


@add(
    "even_sample_with_ends",
    ", x AS (SELECT request_id, row_number() OVER (ORDER BY complete_ts, event_id) - 1 AS ix, count(*) OVER () AS n FROM io) SELECT request_id FROM x WHERE ix IN (SELECT i * (n - 1) // 1999 FROM range(2000) t(i))",
    IO,
)
def even_sample_with_ends(spark, d):
    rows = sampling.indexed(T.requests(spark, d).select("request_id", "seq"), [], ["seq"], F.shiftright("seq", 20))
    return rows.filter(sampling.even_with_ends(2000)).select("request_id")


@add(
    "even_sample_without_ends",
    ", x AS (SELECT request_id, row_number() OVER (ORDER BY complete_ts, event_id) - 1 AS ix, count(*) OVER () AS n FROM io) SELECT request_id FROM x WHERE ix IN (SELECT i * n // 512 FROM range(512) t(i))",
    IO,
)
def even_sample_without_ends(spark, d):
    rows = sampling.indexed(T.requests(spark, d).select("request_id", "seq"), [], ["seq"], F.shiftright("seq", 20))
    return rows.filter(sampling.even_without_ends(512)).select("request_id")


@add("operation_quota_sample", QUOTA + " SELECT request_id, operation FROM sm", IO)
def operation_quota_sample(spark, d):
    io = T.requests(spark, d).select("request_id", "operation", "seq")
    return sampling.operation_quota(io, ["seq"], F.shiftright("seq", 20), 3000).select("request_id", "operation")


SHAPE = f""", pt AS (SELECT request_id, operation, {TIME} AS x, total_ns / 1e6 AS y, row_number() OVER (PARTITION BY operation ORDER BY complete_ts, event_id) - 1 AS ix, count(*) OVER (PARTITION BY operation) AS n,
        greatest(1, 600 * count(*) OVER (PARTITION BY operation) // (SELECT count(*) FROM io)) AS q FROM io),
    lp AS (SELECT *, least(greatest(q // 6, 1), n) AS bk FROM pt WHERE n > q),
    sl AS (SELECT *, ((ix + 1) * bk - 1) // n AS slice FROM lp),
    ex AS (SELECT operation, slice, min(ix) AS a, max(ix) AS b, arg_min(ix, (x, ix)) AS c, arg_max(ix, (x, ix)) AS d, arg_min(ix, (y, ix)) AS e, arg_max(ix, (y, ix)) AS f FROM sl GROUP BY ALL),
    lo AS (SELECT operation, ix, q, 'x' AS ax, x AS v FROM lp UNION ALL SELECT operation, ix, q, 'y', y FROM lp),
    sp AS (SELECT *, v - lag(v) OVER w AS step, lag(ix) OVER w AS pix, max(v) OVER (PARTITION BY operation, ax) - min(v) OVER (PARTITION BY operation, ax) AS span FROM lo WINDOW w AS (PARTITION BY operation, ax ORDER BY v, ix)),
    mr AS (SELECT operation, ax, step, row_number() OVER (PARTITION BY operation, ax ORDER BY step) AS rn, count(*) OVER (PARTITION BY operation, ax) AS c FROM sp WHERE step > 0),
    md AS (SELECT operation, ax, step AS med FROM mr WHERE rn = c // 2 + 1),
    wd AS (SELECT sp.* FROM sp JOIN md ON md.operation = sp.operation AND md.ax = sp.ax WHERE step > med * 8 AND step > span * 2 / q),
    kp AS (SELECT DISTINCT operation, ix FROM (SELECT operation, unnest([a, b, c, d, e, f]) AS ix FROM ex UNION ALL SELECT operation, unnest([ix, pix]) FROM wd)),
    kc AS (SELECT operation, count(*) AS k FROM kp GROUP BY 1),
    rs AS (SELECT lp.operation, lp.ix, lp.request_id, row_number() OVER (PARTITION BY lp.operation ORDER BY lp.ix) - 1 AS j, count(*) OVER (PARTITION BY lp.operation) AS m, q - k AS room FROM lp JOIN kc ON kc.operation = lp.operation
        WHERE NOT EXISTS (SELECT 1 FROM kp WHERE kp.operation = lp.operation AND kp.ix = lp.ix)),
    fl AS (SELECT request_id FROM rs WHERE room > 0 AND (m <= room OR (room = 1 AND j = 0) OR (room > 1 AND j IN (SELECT i * (m - 1) // (room - 1) FROM range(600) t(i) WHERE i < room))))"""


@add(
    "shape_preserving_sample",
    SHAPE + " SELECT request_id FROM lp WHERE EXISTS (SELECT 1 FROM kp WHERE kp.operation = lp.operation AND kp.ix = lp.ix) UNION ALL SELECT request_id FROM fl UNION ALL SELECT request_id FROM pt WHERE n <= q",
    IO,
)
def shape_preserving_sample(spark, d):
    start = origin(spark, d)
    points = axes.explore(T.requests(spark, d), "time_ms", "total_latency_ms", "none", start, keep=("operation", "seq"))
    kept = sampling.shape_sample(points, ["operation"], ["seq"], F.shiftright("seq", 20), "x", "y", 600)
    return kept.select("request_id")


@add(
    "group_cap",
    """, g AS (SELECT comm || ' (' || pid || ')' AS grp, count(*) AS n FROM io GROUP BY 1), t AS (SELECT grp FROM g ORDER BY n DESC, grp LIMIT 31)
    SELECT CASE WHEN grp IN (SELECT grp FROM t) THEN grp ELSE 'Other groups' END AS grp, cast(sum(n) AS bigint) AS n FROM g GROUP BY 1""",
    IO,
)
def group_cap(spark, d):
    points = T.requests(spark, d).select("request_id", axes.GROUPS["process"]().alias("grp"))
    return sampling.cap_groups(points, "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@add(
    "level_of_detail",
    """, p0 AS (SELECT row_number() OVER (ORDER BY complete_ts, event_id) - 1 AS ix, total_ns AS y FROM io),
    lod AS (SELECT 0 AS level, ix, y FROM p0
      UNION ALL
      SELECT level + 1, row_number() OVER (ORDER BY ix) - 1, y FROM (
        SELECT level, ix, y, count(*) OVER () AS n, ix = min(ix) OVER c OR ix = max(ix) OVER c OR ix = arg_min(ix, (y, ix)) OVER c OR ix = arg_max(ix, (y, ix)) OVER c AS keep
        FROM lod WINDOW c AS (PARTITION BY ix // 16)) WHERE keep AND n > 256)
    SELECT level, ix AS idx, y FROM lod""",
    "RECURSIVE " + IO.lstrip(),
)
def level_of_detail(spark, d):
    """All levels of the pyramid."""
    rows = sampling.indexed(T.requests(spark, d).select("seq", "complete_ts", "total_ns"), [], ["seq"], F.shiftright("seq", 20))
    levels = sampling.level_of_detail(rows, "complete_ts", "total_ns")
    return levels.select("level", "idx", "y")


@add(
    "visible_slice",
    """, p0 AS (SELECT row_number() OVER (ORDER BY complete_ts, event_id) - 1 AS ix, complete_ts AS x, total_ns AS y FROM io), b AS (SELECT min(x) + 100000000000 AS lo, min(x) + 150000000000 AS hi FROM p0),
    s AS (SELECT greatest(count(*) FILTER (x < lo) - 1, 0) AS a, least(count(*) FILTER (x <= hi) + 1, count(*)) AS z FROM p0, b GROUP BY lo, hi)
    SELECT 0 AS level, ix AS idx, y FROM p0, s WHERE ix >= a AND ix < z""",
    IO,
)
def visible_slice(spark, d):
    """A narrow view fits the finest level: its points plus one neighbour on each side."""
    rows = sampling.indexed(T.requests(spark, d).select("seq", "complete_ts", "total_ns"), [], ["seq"], F.shiftright("seq", 20))
    first = T.requests(spark, d).agg(F.min("complete_ts")).first()[0]
    levels = sampling.level_of_detail(rows, "complete_ts", "total_ns")
    return sampling.visible(levels, first + 100_000_000_000, first + 150_000_000_000, 100_000).select("level", "idx", "y")


@add("page_of_requests", " SELECT request_id, total_ns FROM io ORDER BY total_ns DESC, request_id LIMIT 40 OFFSET 80", IO)
def page_of_requests(spark, d):
    return sampling.page(T.requests(spark, d), [("total_ns", True), ("request_id", False)], 40, 2).select("request_id", "total_ns")


@add("deep_page_of_requests", " SELECT request_id, total_ns FROM io ORDER BY total_ns, request_id LIMIT 40 OFFSET (SELECT count(*) - 100 FROM io)", IO)
def deep_page_of_requests(spark, d):
    """A page near the end, found through the directory of counts."""
    io = T.requests(spark, d)
    last = io.count() - 100
    rows = sampling.page(io, [("total_ns", False), ("request_id", False)], 20, last // 20, few=1000)
    after = sampling.page(io, [("total_ns", False), ("request_id", False)], 20, last // 20 + 1, few=1000)
    return rows.unionByName(after).select("request_id", "total_ns")


@add(
    "observed_requests",
    """ SELECT event_id AS request_id, CASE WHEN clocked THEN complete_ts END AS complete_ts, CASE WHEN clocked AND matched THEN issue_ts END AS issue_ts,
      CASE WHEN clocked THEN insert_ts END AS insert_ts, CASE WHEN matched THEN pid END AS pid, CASE WHEN seen THEN CASE WHEN matched THEN 'trace-' || pid END ELSE comm END AS comm,
      CASE WHEN NOT seen OR event_id % 4 = 0 THEN status END AS status, CASE WHEN matched THEN complete_ts - issue_ts END AS device_ns, operation, bytes, sector,
      CASE WHEN seen THEN CASE WHEN matched THEN 'probable' ELSE 'unresolved' END ELSE 'exact' END AS timing_confidence
    FROM (SELECT *, event_id % 6 = 0 AS seen, NOT (event_id % 12 = 0) AS clocked, NOT (event_id % 18 = 0) AS matched FROM req WHERE event_id % 3 = 0)""",
    EV,
)
def observed_requests(spark, d):
    """Stored whole requests, written as lines and read back: unconfirmed values are null."""
    return recording.observed_requests(observed_lines(spark, d)).select(
        "request_id", "complete_ts", "issue_ts", "insert_ts", "pid", "comm", "status", "device_ns", "operation", "bytes", "sector", "timing_confidence"
    )


@add(
    "recording_requests",
    """ SELECT event_id AS request_id, NULL::BIGINT AS record_id, complete_ts, 'exact' AS timing_confidence FROM req
    UNION ALL SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_id * 7 END, CASE WHEN event_id % 12 <> 0 THEN complete_ts END,
      CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 18 <> 0 THEN 'probable' ELSE 'unresolved' END ELSE 'exact' END FROM req WHERE event_id % 3 = 0""",
    EV,
)
def recording_requests(spark, d):
    """A recording with block events and stored whole requests yields both."""
    both = lines(spark, d).unionByName(observed_lines(spark, d)).withColumn("session_id", F.lit("text"))
    return recording.requests(both).select("request_id", F.col("evidence.record_id").alias("record_id"), "complete_ts", "timing_confidence")


def observed_lines(spark, d):
    def build():
        rows = T.request_rows(spark, d).filter("event_id % 3 = 0")
        e = F.col("event_id")
        seen, matched = e % 6 == 0, e % 18 != 0
        block = ["device_major", "device_minor", "sector", "sectors", "bytes", "operation"]
        rows = rows.withColumns({"request_id": e, "device_major": F.col("major"), "device_minor": F.col("minor")})
        gap = F.when(matched, F.col("complete_ts") - F.col("issue_ts"))
        evidence = F.struct(
            F.lit("trace").alias("source"),
            (e * 7).alias("record_id"),
            F.array(e * 7 - 1).alias("issue_record_candidates"),
            F.when(matched, F.col("issue_ts")).alias("issue_timestamp_ns"),
            F.when(matched, F.col("pid")).alias("issuer_pid"),
            F.when(matched, F.col("tid")).alias("issuer_tid"),
            F.when(e % 4 == 0, F.col("status")).alias("completion_status"),
            F.when(matched, F.concat(F.lit("trace-"), F.col("pid").cast("string"))).alias("process_name"),
            F.when(matched, "probable").otherwise("unresolved").alias("timing_confidence"),
            F.lit("as found").alias("reason"),
            F.when(e % 12 == 0, 3).otherwise(0).alias("clock"),
        )
        stored = rows.select(
            (e + (1 << 40)).alias("seq"),
            F.struct(F.col("insert_ts").alias("ts_ns"), "request_id", *block).alias("insert"),
            F.struct(F.col("issue_ts").alias("ts_ns"), "request_id", *block, "pid", "tid", "cpu", "comm").alias("issue"),
            F.struct(F.col("complete_ts").alias("ts_ns"), "request_id", "device_major", "device_minor", "status").alias("completion"),
            gap.alias("latency_ns"),
            gap.alias("device_latency_ns"),
            F.lit("unknown").alias("access_pattern"),
            F.when(F.col("bytes") >= 32768, "large").otherwise("small").alias("size_class"),
            F.when(seen, evidence).alias("evidence"),
        )
        path = os.path.join(workspace(spark), f"observed-{uuid.uuid4().hex}")
        recording.write_lines(recording.event_lines(stored, "observed_block_completion", stored.columns[1:], "seq"), path, compress=True)
        return recording.classify_lines(recording.read_lines(spark, path))

    return staged_once(spark, f"observed|{d}", build)


@add("newest_requests", " SELECT request_id FROM io ORDER BY complete_ts DESC, request_id DESC LIMIT 5000", IO)
def newest_requests(spark, d):
    """Opt-in bounded retention."""
    return sampling.retain_newest(T.requests(spark, d), [F.desc("complete_ts"), F.desc("request_id")], 5000).select("request_id")


@add(
    "rank_points",
    ", r AS (SELECT row_number() OVER (ORDER BY total_ns, request_id) AS rn, count(*) OVER () AS n, total_ns FROM io) SELECT rn AS \"rank\", total_ns AS value FROM r WHERE rn - 1 IN (SELECT i * (n - 1) // 999 FROM range(1000) t(i))",
    IO,
)
def rank_points(spark, d):
    from iotrail.operators.stats import magnitude

    rows = T.requests(spark, d).select("request_id", "total_ns")
    idx = sampling.indexed(rows, [], ["total_ns", "request_id"], magnitude(F.col("total_ns")))
    return idx.filter(sampling.even_with_ends(1000)).select((F.col("idx") + 1).alias("rank"), F.col("total_ns").alias("value"))


@add(
    "set_operations",
    """ SELECT (SELECT count(*) FROM (SELECT request_id FROM io WHERE bytes > 100000 INTERSECT SELECT request_id FROM io WHERE operation = 'read')) AS both_sides,
      (SELECT count(*) FROM (SELECT request_id FROM io WHERE bytes > 100000 EXCEPT SELECT request_id FROM io WHERE operation = 'read')) AS only_large,
      (SELECT count(*) FROM (SELECT request_id FROM io WHERE bytes > 100000 UNION SELECT request_id FROM io WHERE operation = 'read')) AS either""",
    IO,
)
def set_operations(spark, d):
    io = T.requests(spark, d)
    large, reads = io.filter("bytes > 100000").select("request_id"), io.filter("operation = 'read'").select("request_id")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    out = count(large.intersect(reads), "both_sides").join(count(large.join(reads, "request_id", "left_anti"), "only_large"), F.lit(True))
    return out.join(count(large.unionByName(reads).dropDuplicates(), "either"), F.lit(True))


