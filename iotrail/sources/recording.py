"""Newline-delimited JSON recordings: guarded line scan, record views, integrity, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.functions import timing
from iotrail.functions.scalars import signed_id, unsigned_id
from iotrail.operators.correlate import TTL_NS, annotate_lifetimes, completed_io
from iotrail.operators.stats import on_keys
from iotrail.session import stage
from iotrail.sources.schemas import ENVELOPE, EVENTS, RECORDS, REQUIRED, SCHEMA_VERSION, U64

MAX_LINE_BYTES = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with file, position and 1-based line number.

    The scan is split anywhere; a line number needs only the counts of the splits before it,
    which a first scan takes, so no text is moved.  Lines of a split are read one after another
    and both scans are cut alike.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("session_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    splits = raw.groupBy("session_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    earlier = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    offsets = stage(splits.select("session_id", "block", (before + 1 - F.col("first")).alias("shift")), "line-offsets")
    placed = raw.join(offsets, ["session_id", "block"])
    return placed.select("session_id", "value", (F.col("pos") + F.col("shift")).alias("line_no"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Parse envelopes; ``status`` is ok, blank or rejected, and a bad line never touches its neighbours."""
    text = F.col("value")
    oversize = F.octet_length(text) > MAX_LINE_BYTES
    broken = ~F.is_valid_utf8(text)
    env = F.when(~oversize & ~broken, F.from_json(text, ENVELOPE))
    rows = lines.withColumn("env", env).withColumn("kind", F.col("env.event.kind"))
    payload_ok: Column = F.lit(False)
    for kind, schema in EVENTS.items():
        parsed = F.from_json(F.col("env.event.data"), schema)
        complete: Column = parsed.isNotNull()
        for name in REQUIRED[kind]:
            complete &= parsed[name].isNotNull()
        payload_ok = F.when(F.col("kind") == kind, complete).otherwise(payload_ok)
    tag = F.col("env.record")
    ok = F.when(tag == "event", payload_ok & F.col("env.sequence").isNotNull()).otherwise(tag.isin(list(RECORDS)))
    status = F.when(F.trim(text) == "", "blank").when(F.coalesce(ok, F.lit(False)), "ok").otherwise("rejected")
    return rows.select(
        "session_id",
        "line_no",
        "value",
        status.alias("status"),
        tag.alias("record"),
        "kind",
        signed_id(F.col("env.sequence")).alias("seq"),
        F.col("env.event.data").alias("data"),
    )


def records(lines: DataFrame, record: str) -> DataFrame:
    """Rows of one bookkeeping record kind with its own schema."""
    rows = lines.filter((F.col("status") == "ok") & (F.col("record") == record))
    return rows.select("session_id", "line_no", F.from_json("value", RECORDS[record]).alias("r")).select(
        "session_id", "line_no", "r.*"
    )


def events(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of one event kind; ids become signed longs."""
    rows = lines.filter((F.col("status") == "ok") & (F.col("record") == "event") & (F.col("kind") == kind))
    parsed = rows.select("session_id", "line_no", "seq", F.from_json("data", EVENTS[kind]).alias("e")).select(
        "session_id", "line_no", "seq", "e.*"
    )
    return parsed.select(*[signed_id(F.col(n)).alias(n) if t == U64 else F.col(n) for n, t in parsed.dtypes])


def block_stream(lines: DataFrame) -> DataFrame:
    """Insert, issue and completion events in the shape the correlator reads."""

    def one(kind: str, label: str) -> DataFrame:
        return events(lines, kind).withColumn("kind", F.lit(label))

    both = one("block_insert", "insert").unionByName(one("block_issue", "issue"), allowMissingColumns=True)
    both = both.unionByName(one("block_complete", "complete"), allowMissingColumns=True)
    return both.withColumnsRenamed({"device_major": "major", "device_minor": "minor"}).drop("line_no")


def observed_requests(lines: DataFrame) -> DataFrame:
    """Requests that a decoded trace stored whole, in the shape of correlated ones.

    With evidence, only what it confirms counts: times on another clock, an unmatched
    issue, its task, cpu and status stay null, and the issuer's name is the evidence's.
    Durations are the stored ones.
    """
    o = events(lines, "observed_block_completion")
    e = "evidence"
    found = o.select(
        "session_id",
        "seq",
        signed_id(F.col("issue.request_id")).alias("request_id"),
        F.col("issue.device_major").alias("major"),
        F.col("issue.device_minor").alias("minor"),
        F.col("insert.ts_ns").alias("insert_ts"),
        F.col("issue.ts_ns").alias("issue_ts"),
        F.col("completion.ts_ns").alias("complete_ts"),
        *[F.col(f"issue.{c}").alias(c) for c in ("operation", "sector", "sectors", "bytes", "pid", "tid", "cpu", "comm")],
        F.col("completion.status").alias("status"),
        F.col("completion.cpu").alias("complete_cpu"),
        F.col("queue_latency_ns").alias("queue_ns"),
        F.col("device_latency_ns").alias("device_ns"),
        F.col("total_latency_ns").alias("total_ns"),
        "size_class",
        "access_pattern",
        F.col("detail_timing.issue_gap_ns").alias("issue_gap_ns"),
        F.col("detail_timing.completion_gap_ns").alias("completion_gap_ns"),
        F.col("detail_timing.issue_depth").alias("issue_depth"),
        "queue_depth_at_issue",
        "queue_depth_after",
        *[F.col(f"detail_timing.{side}_bandwidth.{a}").alias(f"{side}_rate_{b}") for side in ("issue", "completion") for a, b in (("payload_bytes", "payload"), ("duration_ns", "duration"))],
        F.when(
            F.col(e).isNotNull(),
            F.struct(
                signed_id(F.col(f"{e}.record_id")).alias("record_id"),
                F.col(f"{e}.source").alias("source"),
                F.col(f"{e}.clock").alias("clock"),
                F.col(f"{e}.issue_timestamp_ns").alias("issue_ts"),
                F.col(f"{e}.issuer_pid").alias("pid"),
                F.col(f"{e}.issuer_tid").alias("tid"),
                F.col(f"{e}.issuer_cpu").alias("cpu"),
                F.col(f"{e}.completion_status").alias("status"),
                F.col(f"{e}.process_name").alias("comm"),
                F.col(f"{e}.timing_confidence").alias("timing_confidence"),
                F.col(f"{e}.reason").alias("reason"),
            ),
        ).alias(e),
    )
    on_clock = timing.completion_time().isNotNull()
    return found.withColumns(
        {
            "insert_ts": F.when(on_clock, F.col("insert_ts")),
            "issue_ts": timing.issue_time(),
            "complete_ts": timing.completion_time(),
            "pid": timing.issuer_pid(),
            "tid": timing.issuer_tid(),
            "cpu": timing.issuer_cpu(),
            "comm": F.when(F.col(e).isNull(), F.col("comm")).otherwise(F.col(f"{e}.comm")),
            "status": timing.completion_status(),
            "timing_confidence": timing.timing_confidence(),
        }
    )


def requests(lines: DataFrame, ttl_ns: int = TTL_NS) -> DataFrame:
    """All requests of a recording: correlated from block events, and observed whole.

    A session holds one kind or both; ``timing_confidence`` of a correlated request is exact.
    """
    correlated = completed_io(annotate_lifetimes(block_stream(lines), ttl_ns), ttl_ns).drop("issue_seq")
    correlated = correlated.withColumn("timing_confidence", F.lit("exact"))
    return correlated.unionByName(observed_requests(lines), allowMissingColumns=True)


def file_syscalls(lines: DataFrame) -> DataFrame:
    f = events(lines, "file_io")
    return f.select(
        "session_id",
        "seq",
        F.col("start_ts_ns").alias("start_ns"),
        F.col("end_ts_ns").alias("end_ns"),
        "operation",
        "fd",
        "requested_bytes",
        "completed_bytes",
        "pid",
        "tid",
        "comm",
        F.coalesce("path_snapshot.path", "path").alias("path"),
        F.col("file_identity.fs_device_major").alias("fs_major"),
        F.col("file_identity.fs_device_minor").alias("fs_minor"),
        F.col("file_identity.inode").alias("inode"),
        F.col("file_identity.inode_generation").alias("generation"),
        F.col("file_identity.mount_id").alias("mount"),
        "io_mode",
    )


def request_origins(lines: DataFrame) -> DataFrame:
    o = events(lines, "request_origin")
    return o.select(
        "session_id",
        "seq",
        "ts_ns",
        "request_id",
        "origin_id",
        F.col("file.fs_device_major").alias("fs_major"),
        F.col("file.fs_device_minor").alias("fs_minor"),
        F.col("file.inode").alias("inode"),
        F.col("file.inode_generation").alias("generation"),
        F.col("file.mount_id").alias("mount"),
        F.col("path.path").alias("path"),
        "origin",
        "operation",
        "bytes",
        "pid",
        "tid",
        F.coalesce("file_origin_confidence", F.lit("exact")).alias("file_confidence"),
        F.coalesce("request_lifetime_confidence", F.lit("exact")).alias("lifetime_confidence"),
        F.coalesce("incomplete", F.lit(False)).alias("incomplete"),
    )


# Evidence that marks an edge.
INFERRED_PATH = "inferred_path_snapshot"
INCOMPLETE_ORIGIN = "direct_bio_request_incomplete"


def graph_nodes(lines: DataFrame) -> DataFrame:
    """Stored graph nodes in the shape of derived ones."""
    n = events(lines, "node")
    return n.select(
        "session_id",
        "seq",
        "node_id",
        "transaction_id",
        "kind",
        F.col("start_ts_ns").alias("start_ns"),
        F.col("end_ts_ns").alias("end_ns"),
        F.col("file.fs_device_major").alias("fs_major"),
        F.col("file.fs_device_minor").alias("fs_minor"),
        F.col("file.inode").alias("inode"),
        F.col("file.inode_generation").alias("generation"),
        F.col("file.mount_id").alias("mount"),
        F.col("path.path").alias("path"),
        "operation",
        "bytes",
        F.coalesce("pid", F.lit(0)).alias("pid"),
        F.coalesce("tid", F.lit(0)).alias("tid"),
        "name",
    )


def graph_edges(lines: DataFrame) -> DataFrame:
    """Stored graph edges; what their evidence says about path and completeness becomes two flags."""

    def marked(name: str) -> Column:
        return F.coalesce(F.exists("evidence", lambda x: x["match_type"] == name), F.lit(False))

    e = events(lines, "edge")
    return e.select(
        "session_id",
        "seq",
        "edge_id",
        "transaction_id",
        F.col("from_node_id").alias("from_id"),
        F.col("to_node_id").alias("to_id"),
        "relation",
        "confidence",
        marked(INFERRED_PATH).alias("inferred_path"),
        marked(INCOMPLETE_ORIGIN).alias("incomplete"),
    )


def stage_observations(lines: DataFrame) -> DataFrame:
    return events(lines, "pipeline").withColumnRenamed("end_ts_ns", "end_ns").drop("line_no")


def integrity(lines: DataFrame) -> DataFrame:
    """Per session: line counts and whether the footer agrees with what was read.

    No footer means a partial recording: the verdict stays null.  Footers are looked up beside
    the counts, which then read and sort no text.
    """
    footer = lines.filter((F.col("status") == "ok") & (F.col("record") == "footer"))
    last = footer.select("session_id", "line_no", F.from_json("value", RECORDS["footer"]).alias("f")).filter("f IS NOT NULL")
    last = last.groupBy("session_id").agg(F.max_by("f", "line_no").alias("f"))
    counts = lines.groupBy("session_id").agg(
        F.count_if(F.col("status") != "blank").alias("total_lines"),
        F.count_if(F.col("status") == "rejected").alias("rejected_lines"),
        F.count_if((F.col("status") == "ok") & (F.col("record") == "event")).alias("accepted_events"),
    )
    agg = on_keys(counts, last, ["session_id"], "left")
    adds_up = F.col("f.events_seen") == F.col("f.events_persisted") + F.col("f.events_dropped") + F.col("f.events_rejected")
    agrees = adds_up & (F.col("f.events_persisted") == F.col("accepted_events")) & (F.col("rejected_lines") == 0)
    return agg.select(
        "session_id",
        "total_lines",
        "rejected_lines",
        "accepted_events",
        F.when(F.col("f").isNotNull(), agrees).alias("integrity_ok"),
        F.col("f.graceful").alias("graceful"),
    )


def event_intervals(lines: DataFrame) -> DataFrame:
    """Start and end time of every event; edges have none."""
    d = F.from_json(
        "data", "ts_ns long, start_ts_ns long, end_ts_ns long, delay_ns long, issue struct<ts_ns: long>, insert struct<ts_ns: long>, completion struct<ts_ns: long>"
    )
    rows = lines.filter((F.col("status") == "ok") & (F.col("record") == "event")).withColumn("d", d)
    kind = F.col("kind")
    start = (
        F.when(kind == "observed_block_completion", F.coalesce("d.insert.ts_ns", "d.issue.ts_ns", "d.completion.ts_ns"))
        .when(kind.isin("file_io", "node"), F.col("d.start_ts_ns"))
        .when(kind != "edge", F.col("d.ts_ns"))
    )
    end = (
        F.when(kind == "observed_block_completion", F.col("d.completion.ts_ns"))
        .when(kind == "file_io", F.col("d.end_ts_ns"))
        .when(kind == "node", F.coalesce("d.end_ts_ns", "d.start_ts_ns"))
        .when(kind == "pipeline", F.coalesce("d.end_ts_ns", "d.ts_ns"))
        .when(kind != "edge", F.col("d.ts_ns"))
    )
    return rows.select("session_id", "line_no", "kind", start.alias("start_ns"), end.alias("end_ns"))


def source_span(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("session_id").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))


def reload_window(requests: DataFrame, evidence: DataFrame, lower: int, upper: int, reach_ns: int = 30_000_000_000) -> tuple[DataFrame, DataFrame]:
    """Completions of an inclusive window and the evidence they may need.

    Requests keep the columns derived from the whole stream.  Evidence comes along
    by request id, or by time within the reach of the kept requests of its session.
    """
    kept = requests.filter(F.col("complete_ts").between(lower, upper))
    span = kept.groupBy("session_id").agg(F.min(F.coalesce("insert_ts", "issue_ts")).alias("lo"), F.max("complete_ts").alias("hi"))
    by_id = evidence.join(kept.select("session_id", "request_id").distinct(), ["session_id", "request_id"], "left_semi")
    by_time = evidence.join(span, "session_id").filter(
        (F.col("start_ns") <= F.col("hi") + reach_ns) & (F.col("end_ns") >= F.col("lo") - reach_ns)
    ).drop("lo", "hi")
    return kept, by_id.unionByName(by_time).dropDuplicates(["session_id", "seq"])


def raw_context(lines: DataFrame, lifetime: DataFrame, around: int = 3) -> DataFrame:
    """Stored lines of one request lifetime with their neighbours, all of them.

    ``lifetime`` has one row: session_id, request_id, major, minor, insert_ts, issue_ts, complete_ts.
    """
    d = F.from_json("data", f"ts_ns long, request_id {U64}, device_major long, device_minor long")
    rows = lines.filter(
        (F.col("status") == "ok") & F.col("kind").isin("block_insert", "block_issue", "block_complete")
    ).select("session_id", "line_no", "kind", d.alias("d"))
    keyed = rows.select(
        "session_id",
        "line_no",
        "kind",
        F.col("d.ts_ns").alias("ts_ns"),
        signed_id(F.col("d.request_id")).alias("request_id"),
        F.col("d.device_major").alias("major"),
        F.col("d.device_minor").alias("minor"),
    )
    hits = keyed.join(lifetime, ["session_id", "request_id", "major", "minor"]).filter(
        ((F.col("kind") == "block_insert") & (F.col("ts_ns") == F.col("insert_ts")))
        | ((F.col("kind") == "block_issue") & (F.col("ts_ns") == F.col("issue_ts")))
        | ((F.col("kind") == "block_complete") & (F.col("ts_ns") == F.col("complete_ts")))
    )
    marked = hits.select(
        "session_id", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no"), F.col("line_no").alias("hit")
    ).groupBy("session_id", "line_no").agg(F.bool_or(F.col("line_no") == F.col("hit")).alias("matched"))
    return lines.select("session_id", "line_no", "value").join(marked, ["session_id", "line_no"])


# ---------------------------------------------------------------------------
# Writers.


def event_lines(df: DataFrame, kind: str, data: list[str], order: str) -> DataFrame:
    """Event records as JSON text; ids leave as unsigned numbers."""
    ids = {"request_id", "origin_id", "node_id", "edge_id", "transaction_id", "from_node_id", "to_node_id", "correlation_id", "stage_key"}
    body = F.struct(*[unsigned_id(c).alias(c) if c in ids else F.col(c) for c in data])
    record = F.struct(
        F.lit("event").alias("record"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        unsigned_id(order).alias("sequence"),
        F.struct(F.lit(kind).alias("kind"), body.alias("data")).alias("event"),
    )
    return df.select(F.col(order).alias("__seq"), F.to_json(record).alias("value"))


def footer_line(seen: Column, persisted: Column, dropped: Column, rejected: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("footer").alias("record"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            seen.alias("events_seen"),
            persisted.alias("events_persisted"),
            dropped.alias("events_dropped"),
            rejected.alias("events_rejected"),
            F.lit(True).alias("graceful"),
        )
    )


FILE_LINES = 1 << 19  # lines of one compressed file, which a single task reads


def write_lines(df: DataFrame, path: str, source: str | None = None, compress: bool = False) -> None:
    """Write a text recording; never over a source or an existing export.

    Records repeat their field names, so a compressed recording is a fraction of the text.
    Its files cannot be split when read and hold ``FILE_LINES`` lines at most.
    """
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("an export must not replace its source")
    writer = df.select("value").write.mode("errorifexists")
    if compress:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES)
    writer.text(path)
