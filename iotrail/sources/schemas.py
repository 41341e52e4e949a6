"""Fixed record schemas of a recording (never inferred)."""

from __future__ import annotations

# Identifiers are unsigned 64-bit on the wire: parsed as decimal, kept as signed long.
U64 = "decimal(20,0)"
BLOCK = f"ts_ns long, request_id {U64}, device_major long, device_minor long, sector long, sectors long, bytes long, operation string"
IDENTITY = "fs_device_major long, fs_device_minor long, inode long, inode_generation long, mount_id long"
SNAPSHOT = "path string, source string, captured_ts_ns long, deleted boolean"
MATCH = f"match_type string, opaque_key {U64}, delta_ns long, candidate_count long, sector_match boolean, bytes_match boolean, task_match boolean"
ISSUE = f"{BLOCK}, pid long, tid long, cpu long, comm string"
DONE = f"ts_ns long, request_id {U64}, device_major long, device_minor long, status int, cpu long"
RATE = "struct<payload_bytes: long, duration_ns: long, observations: long>"


def _nested(fields: str) -> str:
    return "struct<" + ", ".join(f.strip().replace(" ", ": ", 1) for f in _split(fields)) + ">"


def _split(fields: str) -> list[str]:
    """Split a field list on top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            out.append(fields[start:i])
            start = i + 1
    return [*out, fields[start:]]


EVENTS: dict[str, str] = {
    "scheduler_io_wait": "ts_ns long, delay_ns long, tid long, pid long, comm string, cpu long, source string",
    "block_insert": BLOCK,
    "block_issue": ISSUE,
    "block_complete": DONE,
    "observed_block_completion": (
        f"insert {_nested(BLOCK)}, issue {_nested(ISSUE)}, completion {_nested(DONE)}, latency_ns long, queue_latency_ns long, "
        "device_latency_ns long, total_latency_ns long, queue_depth_at_issue long, queue_depth_after long, "
        f"detail_timing struct<issue_depth: long, issue_gap_ns: long, completion_gap_ns: long, issue_bandwidth: {RATE}, completion_bandwidth: {RATE}>, "
        "access_pattern string, size_class string, "
        f"evidence struct<source: string, record_id: {U64}, issue_record_candidates: array<{U64}>, issue_timestamp_ns: long, issuer_pid: long, issuer_tid: long, issuer_cpu: long, "
        "completion_status: int, process_name: string, timing_confidence: string, reason: string, clock: long>"
    ),
    "file_io": (
        "start_ts_ns long, end_ts_ns long, operation string, fd int, requested_bytes long, completed_bytes long, pid long, tid long, comm string, "
        f"path string, confidence string, file_identity {_nested(IDENTITY)}, path_snapshot {_nested(SNAPSHOT)}, offset long, io_mode string, node_id {U64}"
    ),
    "pipeline": (
        f"ts_ns long, operation string, end_ts_ns long, phase string, layer string, correlation_id {U64}, stage_key {U64}, sector long, bytes long, "
        "opcode long, status int, pid long, tid long, name string, confidence string"
    ),
    "request_origin": (
        f"ts_ns long, request_id {U64}, origin_id {U64}, file {_nested(IDENTITY)}, path {_nested(SNAPSHOT)}, origin string, operation string, bytes long, "
        "pid long, tid long, file_origin_confidence string, request_lifetime_confidence string, incomplete boolean"
    ),
    "node": (
        f"node_id {U64}, transaction_id {U64}, kind string, start_ts_ns long, end_ts_ns long, origin string, file {_nested(IDENTITY)}, "
        f"path {_nested(SNAPSHOT)}, operation string, bytes long, pid long, tid long, name string"
    ),
    "edge": (
        f"edge_id {U64}, transaction_id {U64}, from_node_id {U64}, to_node_id {U64}, relation string, confidence string, evidence array<{_nested(MATCH)}>"
    ),
}

# Fields without a default: a line that lacks one is rejected.
REQUIRED: dict[str, list[str]] = {
    "scheduler_io_wait": ["ts_ns", "delay_ns", "tid"],
    "block_insert": ["ts_ns", "request_id", "device_major", "device_minor", "sector", "sectors", "bytes", "operation"],
    "block_issue": ["ts_ns", "request_id", "device_major", "device_minor", "sector", "sectors", "bytes", "operation", "pid", "tid", "cpu", "comm"],
    "block_complete": ["ts_ns", "request_id", "device_major", "device_minor", "status"],
    "observed_block_completion": ["issue", "completion"],
    "file_io": ["start_ts_ns", "end_ts_ns", "operation", "fd", "requested_bytes", "completed_bytes", "pid", "tid", "comm"],
    "pipeline": ["ts_ns", "phase", "layer", "name", "confidence"],
    "request_origin": ["ts_ns", "request_id", "origin_id", "file", "origin", "operation"],
    "node": ["node_id", "kind", "start_ts_ns", "origin", "name"],
    "edge": ["edge_id", "from_node_id", "to_node_id", "relation", "confidence"],
}

# Record tags other than events.
RECORDS: dict[str, str] = {
    "source_info": "source string, status string, metadata string",
    "disk_stats": "elapsed_ms long, boot_id string, raw string",
    "hello": "agent_version string, boot_id string, kernel_release string",
    "capabilities": "capabilities string",
    "health": (
        "emitted_events long, kernel_drops long, userspace_drops long, "
        "probe_health map<string, struct<emitted: long, paired: long, unpaired: long, dropped: long>>, "
        "correlation_ambiguous long, correlation_expired long, key_reused long"
    ),
    "control": "acknowledgement string",
    "aggregate": "snapshot string",
    "heavy_hitters": "snapshot string",
    "trigger": "trigger string",
    "segment": "segment string",
    "stack_fingerprint": "fingerprint string",
    "footer": "events_seen long, events_persisted long, events_dropped long, events_rejected long, graceful boolean",
}

ENVELOPE = f"record string, schema_version int, sequence {U64}, event struct<kind: string, data: string>"
SCHEMA_VERSION = 8
