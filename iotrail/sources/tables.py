"""Trace records derived from an application event table.

Every event becomes one storage request (insert, issue, completion) on a clock
that counts its microseconds as nanoseconds, so a month of events reads like a
busy half hour of block I/O: latencies of milliseconds, overlapping requests,
thousands of issuers and a handful of devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.operators.correlate import TTL_NS, annotate_lifetimes, completed_io
from iotrail.operators.intervals import merge_intervals
from iotrail.operators.ordered import with_sequence
from iotrail.session import built_once, spread_for, staged_once

SESSION = "events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spread_for(spark.read.parquet(path), path)


def utc_micros(column: str) -> Column:
    """Microseconds of a zone-less timestamp read as UTC, whatever the session's time zone is."""
    return F.expr(f"unix_micros(cast(convert_timezone('UTC', current_timezone(), cast({column} as timestamp_ntz)) as timestamp))")


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the fields of its three block records."""
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id")
    kinds = {"view": "read", "click": "read", "purchase": "write", "signup": "write"}
    operation: Column = F.lit("discard")
    for name, op in kinds.items():
        operation = F.when(F.col("event_type") == name, op).otherwise(operation)
    end = utc_micros("ts")
    issue = end - F.round(F.col("value") * 100).cast("long") * 100_000
    return table(spark, sf_dir, "events").select(
        "event_id",
        k.alias("k"),
        (issue - k * 1_000_000).alias("insert_ts"),
        issue.alias("issue_ts"),
        end.alias("complete_ts"),
        F.lit(8).cast("long").alias("major"),
        (user % 4).alias("minor"),
        operation.alias("operation"),
        (k * 8).alias("sector"),
        (8 * (1 + user % 3)).alias("sectors"),
        ((k + 1) * 4096).alias("bytes"),
        user.alias("pid"),
        (user * 10 + k % 3).alias("tid"),
        (user % 8).alias("cpu"),
        F.concat(F.lit("user-"), (user % 10).cast("string")).alias("comm"),
        F.when(F.col("event_type") == "error", -5).otherwise(0).alias("status"),
    )


def block_events(spark: SparkSession, sf_dir: str, id_modulus: int | None = None) -> DataFrame:
    """Insert, issue and completion rows in stream order (time, phase, event)."""
    rows = request_rows(spark, sf_dir)
    request = F.col("event_id") % id_modulus if id_modulus else F.col("event_id")
    phases = F.array(
        F.struct(F.lit(0).alias("phase"), F.lit("insert").alias("kind"), F.col("insert_ts").alias("ts_ns")),
        F.struct(F.lit(1).alias("phase"), F.lit("issue").alias("kind"), F.col("issue_ts").alias("ts_ns")),
        F.struct(F.lit(2).alias("phase"), F.lit("complete").alias("kind"), F.col("complete_ts").alias("ts_ns")),
    )
    exploded = rows.withColumn("p", F.explode(phases)).select(
        F.lit(SESSION).alias("session_id"),
        "event_id",
        F.col("p.phase").alias("phase"),
        F.col("p.kind").alias("kind"),
        F.col("p.ts_ns").alias("ts_ns"),
        request.alias("request_id"),
        "major",
        "minor",
        "operation",
        "sector",
        "sectors",
        "bytes",
        "pid",
        "tid",
        "cpu",
        "comm",
        F.when(F.col("p.phase") == 2, F.col("status")).alias("status"),
    )
    name = f"block_events|{sf_dir}|{id_modulus}"
    return staged_once(spark, name, lambda: with_sequence(exploded, ["ts_ns", "phase", "event_id"]))


def block_lifetimes(spark: SparkSession, sf_dir: str, id_modulus: int | None = None, ttl_ns: int = TTL_NS) -> DataFrame:
    """Annotated block events, a view of tables staged once per application."""
    return built_once(
        spark,
        f"lifetimes|{sf_dir}|{id_modulus}|{ttl_ns}",
        lambda: annotate_lifetimes(block_events(spark, sf_dir, id_modulus), ttl_ns, time_sorted=True),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central fact table: correlated requests with whole-stream columns."""
    return staged_once(
        spark, f"completed|{sf_dir}", lambda: completed_io(block_lifetimes(spark, sf_dir), TTL_NS)
    )


def device_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy intervals per device, from every request."""
    from iotrail.plans.activity import device_activity as build

    return staged_once(spark, f"activity|{sf_dir}", lambda: build(requests(spark, sf_dir)))


def busy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy intervals over all devices together (a union of the per-device unions)."""
    return staged_once(spark, f"busy|{sf_dir}", lambda: merge_intervals(device_activity(spark, sf_dir), []))


# ---------------------------------------------------------------------------
# Evidence derived from the same events.


def file_path(k: Column, event: Column) -> Column:
    """File name by k; one file in twenty has two names."""
    base = F.concat(F.lit("/data/f"), (k % 20).cast("string"))
    return F.when((k % 20 == 3) & (event % 2 == 1), F.concat(base, F.lit(".alt"))).otherwise(base)


def _file_identity(k: Column) -> dict[str, Column]:
    return {
        "fs_major": F.lit(8).cast("long"),
        "fs_minor": F.lit(32).cast("long"),
        "inode": 1000 + k % 20,
        "generation": F.lit(None).cast("long"),
        "mount": F.lit(None).cast("long"),
    }


def file_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read or write call around most requests; some have none and some have two."""
    rows = request_rows(spark, sf_dir).filter("operation in ('read', 'write') and event_id % 13 <> 0")
    k, e = F.col("k"), F.col("event_id")
    copies = F.when(e % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    late = k % 11 == 0
    return rows.withColumn("copy", F.explode(copies)).select(
        F.lit(SESSION).alias("session_id"),
        (e * 2 + F.col("copy")).alias("seq"),
        (F.col("insert_ts") - 2_000_000 - F.col("copy") * 1000).alias("start_ns"),
        F.when(late, F.col("insert_ts") - 1_000_000).otherwise(F.col("complete_ts") + 1_000_000).alias("end_ns"),
        "operation",
        (e % 100).alias("fd"),
        F.col("bytes").alias("requested_bytes"),
        F.when(e % 17 == 0, F.lit(-5).cast("long")).otherwise(F.col("bytes")).alias("completed_bytes"),
        "pid",
        "tid",
        "comm",
        F.when(k % 5 != 0, file_path(k, e)).alias("path"),
        *[c.alias(n) for n, c in _file_identity(k).items()],
        F.when(k % 3 == 0, "direct").otherwise("buffered").alias("io_mode"),
    )


def request_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored origins for every third request; every sixth has two files."""
    rows = request_rows(spark, sf_dir).filter("event_id % 3 = 0")
    e = F.col("event_id")
    copies = F.when(e % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    k = F.col("k") + F.col("copy")
    return rows.withColumn("copy", F.explode(copies)).select(
        F.lit(SESSION).alias("session_id"),
        (e * 2 + F.col("copy")).alias("seq"),
        F.col("insert_ts").alias("ts_ns"),
        e.alias("request_id"),
        (e * 10 + F.col("copy")).alias("origin_id"),
        *[c.alias(n) for n, c in _file_identity(k).items()],
        F.when(e % 4 == 0, file_path(k, e)).alias("path"),
        F.lit("file").alias("origin"),
        "operation",
        "bytes",
        "pid",
        "tid",
        F.when(e % 5 != 0, "exact").alias("file_confidence"),
        F.when(e % 9 == 0, "exact").when(e % 9 == 3, "probable").otherwise("context_only").alias("lifetime_confidence"),
        (e % 27 == 0).alias("incomplete"),
    )


def stage_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filesystem, SCSI, UFS and link-context observations around the requests."""
    rows = request_rows(spark, sf_dir)
    e = F.col("event_id")
    null_long, null_str = F.lit(None).cast("long"), F.lit(None).cast("string")
    ins, iss, end = F.col("insert_ts"), F.col("issue_ts"), F.col("complete_ts")

    def obs(part, when, layer, start, stop, phase, conf, corr, sector, size, pid, tid, op):
        return F.when(
            when,
            F.struct(
                F.lit(part).alias("part"),
                F.lit(layer).alias("layer"),
                start.alias("ts_ns"),
                stop.alias("end_ns"),
                F.lit(phase).alias("phase"),
                F.lit(conf).alias("confidence"),
                corr.alias("correlation_id"),
                sector.alias("sector"),
                size.alias("bytes"),
                pid.alias("pid"),
                tid.alias("tid"),
                op.alias("operation"),
            ),
        )

    zero = F.lit(0).cast("long")
    op = F.col("operation")
    parts = F.array(
        obs(0, e % 2 == 0, "filesystem", ins - 500_000, ins + 200_000, "span", "exact", e, null_long, null_long, F.col("pid"), F.col("tid"), op),
        obs(1, e % 4 <= 1, "filesystem", ins - 300_000, iss + 100_000, "span", "exact", null_long, null_long, null_long, F.col("pid"), F.col("tid"), null_str),
        obs(2, e % 5 == 0, "scsi", iss + 1_000, F.greatest(end - 1_000, iss + 1_000), "span", "exact", null_long, F.col("sector"), F.col("bytes"), zero, zero, op),
        obs(3, e % 3 == 1, "ufs", iss + 2_000, F.greatest(end - 2_000, iss + 2_000), "span", "exact", e, null_long, null_long, zero, zero, null_str),
        obs(4, e % 50 == 0, "uic_context", end, null_long, "instant", "context_only", null_long, null_long, null_long, zero, zero, null_str),
    )
    return (
        rows.withColumn("o", F.explode(F.array_compact(parts)))
        .select(
            F.lit(SESSION).alias("session_id"),
            (e * 8 + F.col("o.part")).alias("seq"),
            "o.*",
            F.concat(F.col("o.layer"), F.lit(" step")).alias("name"),
            null_long.alias("stage_key"),
            null_long.alias("opcode"),
            F.lit(None).cast("int").alias("status"),
        )
        .drop("part")
    )


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every request, each staged once."""
    from iotrail.plans import evidence

    reqs = evidence_requests(spark, sf_dir)
    built: list[tuple[DataFrame, DataFrame]] = []

    def build() -> tuple[DataFrame, DataFrame]:
        if not built:
            origins = evidence.origin_nodes(reqs, request_origins(spark, sf_dir))
            built.append(evidence.build_graphs(reqs, spans(spark, sf_dir), origins, file_syscalls(spark, sf_dir)))
        return built[0]

    # build_graphs writes both tables.
    nodes = built_once(spark, f"nodes|{sf_dir}", lambda: build()[0])
    return nodes, built_once(spark, f"edges|{sf_dir}", lambda: build()[1])


def request_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and ranked causal edges of every request, each staged once."""
    from iotrail.operators.graph import KEY, ranked_edges

    nodes, edges = graph_tables(spark, sf_dir)
    ranked = staged_once(spark, f"ranked|{sf_dir}", lambda: ranked_edges(edges), KEY, placed=True)
    return nodes, edges, ranked


def recorded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes as a producer stores them, for every fourth request: a chain of three above the request.

    Added to each: a node that repeats an id, one that ends before it starts, and one from long before.
    """
    rows = request_rows(spark, sf_dir).filter("event_id % 4 = 1")
    e, ins = F.col("event_id"), F.col("insert_ts")
    none = F.lit(None).cast("long")

    def row(part: int, at: int, kind: str, start: Column, end: Column, inode: Column = none, path: Column | None = None) -> Column:
        named = F.lit(None).cast("string") if path is None else path
        return F.struct(
            F.lit(part).alias("part"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), start.alias("start_ts_ns"), end.alias("end_ts_ns"), inode.alias("inode"), named.alias("path")
        )

    named = F.when(e % 3 != 0, F.concat(F.lit("/stored/f"), (F.col("k") % 7).cast("string")))
    parts = F.array(
        row(0, 0, "vfs", ins - 4_000, ins + 100, 5000 + F.col("k") % 7, named),
        row(1, 1, "page_cache", ins - 3_000, ins - 2_000),
        row(2, 2, "bio", ins - 1_000, none, 6000 + F.col("k") % 5),
        row(3, 1, "writeback", ins - 3_000, ins - 2_000),
        row(4, 3, "vfs", ins, ins - 1),
        row(5, 4, "vfs", ins - 40_000_000_000, ins - 39_000_000_000),
    )
    return rows.withColumn("p", F.explode(parts)).select(
        F.lit(SESSION).alias("session_id"),
        (e * 64 + F.col("p.part")).alias("seq"),
        (e * 16 + F.col("p.at") + (1 << 50)).alias("node_id"),
        e.alias("transaction_id"),
        "p.kind",
        "p.start_ts_ns",
        "p.end_ts_ns",
        F.lit("probe").alias("origin"),
        F.when(F.col("p.inode").isNotNull(), F.struct(F.lit(8).cast("long").alias("fs_device_major"), F.lit(32).cast("long").alias("fs_device_minor"), F.col("p.inode").alias("inode"))).alias("file"),
        F.when(F.col("p.path").isNotNull(), F.struct(F.col("p.path").alias("path"))).alias("path"),
        "operation",
        "bytes",
        "pid",
        "tid",
        F.col("p.kind").alias("name"),
    )


def recorded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges over :func:`recorded_nodes`, in an order that closes a cycle in two ways.

    Where 8 leaves 1, the edge back from the lowest node comes first and the chain closes the cycle; else it comes last.
    Added to each: a repeated id, a loop, and edges to nodes that are not admitted.
    """
    from iotrail.functions.scalars import NODE_REQUEST, synthetic_id

    rows = request_rows(spark, sf_dir).filter("event_id % 4 = 1")
    e = F.col("event_id")
    at = lambda j: e * 16 + j + (1 << 50)
    back_first = e % 8 == 1

    def row(order: Column | int, edge: int, a: Column, b: Column, confidence: str, relation: str = "submits") -> Column:
        place = order if isinstance(order, Column) else F.lit(order)
        return F.struct(place.alias("order"), F.lit(edge).alias("edge"), a.alias("a"), b.alias("b"), F.lit(confidence).alias("confidence"), F.lit(relation).alias("relation"))

    parts = F.array(
        row(F.when(back_first, 8).otherwise(19), 3, at(2), at(0), "exact"),
        row(10, 0, at(0), at(1), "exact"),
        row(11, 1, at(1), at(2), "probable"),
        row(12, 2, at(2), synthetic_id(NODE_REQUEST, "event_id"), "exact", "merged_into"),
        row(13, 4, at(1), at(3), "exact"),
        row(14, 5, at(4), at(1), "exact"),
        row(15, 0, at(0), at(2), "exact"),
        row(16, 7, at(1), at(1), "exact"),
        row(17, 8, at(0), at(2), "context_only", "context_for"),
    )
    partial = F.array(F.struct(F.lit("direct_bio_request_incomplete").alias("match_type")))
    return rows.withColumn("p", F.explode(parts)).select(
        F.lit(SESSION).alias("session_id"),
        (e * 64 + F.col("p.order")).alias("seq"),
        (e * 16 + F.col("p.edge") + (1 << 51)).alias("edge_id"),
        e.alias("transaction_id"),
        F.col("p.a").alias("from_node_id"),
        F.col("p.b").alias("to_node_id"),
        "p.relation",
        "p.confidence",
        F.when((F.col("p.edge") == 2) & (e % 12 == 1), partial).otherwise(F.array().cast("array<struct<match_type:string>>")).alias("evidence"),
    )


def evidence_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iotrail.plans.evidence import KEY, evidence_windows

    return staged_once(spark, f"windows|{sf_dir}", lambda: evidence_windows(requests(spark, sf_dir)), KEY)


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every request, not written: for a query that reads them once."""
    from iotrail.plans import evidence

    reqs = evidence_requests(spark, sf_dir)
    return evidence.request_spans(reqs, evidence.match_observations(reqs, stage_observations(spark, sf_dir)))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iotrail.operators.graph import KEY

    return staged_once(spark, f"spans|{sf_dir}", lambda: span_rows(spark, sf_dir), KEY, order=["start_ns"])


def file_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iotrail.operators.graph import KEY
    from iotrail.plans.attribution import file_origins as build

    return staged_once(spark, f"origins|{sf_dir}", lambda: build(*graph_tables(spark, sf_dir)), KEY, placed=True)


# ---------------------------------------------------------------------------
# Decoded trace records without request ids.


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, issue, requeue and completion rows keyed only by device, direction and sectors."""
    from iotrail.operators.ranges import load_events

    rows = request_rows(spark, sf_dir)
    e = F.col("event_id")

    def row(part: int, kind: str, ts: Column, when: Column | None = None) -> Column:
        s = F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), ts.alias("timestamp_ns"))
        return s if when is None else F.when(when, s)

    parts = F.array(
        row(0, "insert", F.col("insert_ts"), e % 5 != 0),
        row(1, "issue", F.col("issue_ts")),
        row(2, "requeue", F.call_function("div", F.col("issue_ts") + F.col("complete_ts"), F.lit(2)), e % 97 == 0),
        row(3, "complete", F.col("complete_ts")),
    )
    rwbs = F.when(F.col("operation") == "read", "RA").when(F.col("operation") == "write", "WS").otherwise("DN")
    half = (F.col("part") == 3) & (e % 41 == 0)
    raw = (
        rows.withColumn("p", F.explode(F.array_compact(parts)))
        .select("*", "p.*")
        .select(
            (e * 4 + F.col("part")).alias("record_id"),
            "kind",
            "timestamp_ns",
            F.when(e % 11 != 0, F.col("cpu")).alias("cpu"),
            F.when(F.col("part") == 1, F.col("tid")).alias("tid"),
            (F.lit(8 * 256) + F.col("minor")).alias("device_encoded"),
            "sector",
            F.when(half, F.expr("sectors div 2")).otherwise(F.col("sectors")).alias("sectors"),
            F.lit(None).cast("long").alias("bytes"),
            rwbs.alias("rwbs"),
            F.when(F.col("part") == 1, F.col("comm")).alias("comm"),
            F.when(F.col("part") == 3, F.col("status")).alias("error"),
            F.when((F.col("part") == 3) & (e % 53 == 0), 3).otherwise(0).alias("clock"),
        )
    )
    return staged_once(spark, f"trace|{sf_dir}", lambda: load_events(raw))


def trace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iotrail.operators.ranges import fold_ranges

    return staged_once(spark, f"fold|{sf_dir}", lambda: fold_ranges(trace_events(spark, sf_dir)))


def trace_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iotrail.operators.ranges import match_trace

    events = trace_events(spark, sf_dir)
    return staged_once(spark, f"matches|{sf_dir}", lambda: match_trace(events, folded=trace_fold(spark, sf_dir)))


def process_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process snapshots taken at sign-ups; some undated, some contradicting each other."""
    rows = request_rows(spark, sf_dir).filter("operation = 'write'")
    e = F.col("event_id")
    twice = F.when(e % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(twice)).select(
        F.when(e % 23 != 0, F.col("complete_ts")).alias("snapshot_ns"),
        "pid",
        "tid",
        F.when(F.col("copy") == 1, "other").otherwise(F.col("comm")).alias("name"),
        F.when(e % 7 == 0, F.col("complete_ts") + 400_000_000_000).alias("start_ns"),
    )


def file_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent sightings shortly before half of the issues, on a mapped device for some."""
    rows = request_rows(spark, sf_dir).filter("event_id % 2 = 0")
    e = F.col("event_id")
    mapped = e % 3 == 0
    return rows.select(
        F.lit(SESSION).alias("session_id"),
        (e * 4).alias("seq"),
        (F.col("insert_ts") - 1_000_000).alias("ts_ns"),
        F.when(mapped, F.lit(253 * 1048576).cast("long")).otherwise(F.lit(8 * 1048576) + F.col("minor")).alias("device"),
        F.lit(253 * 1048576 + 5).cast("long").alias("fs_device"),
        F.when(mapped, F.col("sector") + 4096).otherwise(F.col("sector")).alias("sector"),
        "sectors",
        (1000 + F.col("k") % 20).alias("inode"),
        (e * 10).alias("origin_id"),
        "pid",
        "tid",
    )


def bio_remaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaps of the mapped extents down to the request's device."""
    rows = request_rows(spark, sf_dir).filter("event_id % 6 = 0")
    return rows.select(
        F.lit(SESSION).alias("session_id"),
        (F.col("event_id") * 4 + 1).alias("seq"),
        (F.col("insert_ts") - 500_000).alias("ts_ns"),
        (F.lit(8 * 1048576) + F.col("minor")).alias("device"),
        F.lit(253 * 1048576).cast("long").alias("fs_device"),
        (F.col("sector") + 4096).alias("old_sector"),
        "sector",
        "sectors",
    )


def device_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with the kernel's device number."""
    return request_rows(spark, sf_dir).select(
        F.lit(SESSION).alias("session_id"),
        (F.col("event_id") * 4 + 2).alias("seq"),
        F.col("event_id").alias("request_id"),
        F.col("issue_ts").alias("ts_ns"),
        (F.lit(8 * 1048576) + F.col("minor")).alias("device"),
        "sector",
        "sectors",
    )
