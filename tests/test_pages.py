"""Pages through the directory of counts, and stored whole requests, against literal readings."""

import json
import random

from iotrail.operators import sampling
from iotrail.sources import recording


def test_pages_of_tied_values_at_any_depth(spark):
    rnd = random.Random(4)
    rows = [(i, 5 if i % 3 else rnd.randrange(-40, 40)) for i in range(500)] + [(500 + i, 6) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(3)
    for down in (False, True):
        ordered = sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))
        for number in (0, 7, 14, 34, 35):
            got = [(r.id, r.v) for r in sampling.page(df, [("v", down), ("id", False)], 20, number, few=30, fanout=4).collect()]
            assert got == ordered[20 * number : 20 * number + 20]
    assert sampling.page(df.limit(0), [("v", False), ("id", False)], 20, 0).collect() == []


def test_only_confirmed_values_of_a_stored_request_count(spark):
    block = {"ts_ns": 10, "request_id": 7, "device_major": 8, "device_minor": 0, "sector": 64, "sectors": 8, "bytes": 4096, "operation": "read"}
    whole = {"issue": block | {"pid": 5, "tid": 6, "cpu": 1, "comm": "app"}, "completion": {"ts_ns": 30, "request_id": 7, "device_major": 8, "device_minor": 0, "status": -5}}
    found = {"source": "trace", "record_id": 9, "issue_record_candidates": [], "issue_timestamp_ns": None, "issuer_pid": None, "issuer_tid": None, "process_name": None, "timing_confidence": "unresolved", "reason": "none", "clock": 0}
    cases = [whole | {"latency_ns": 20}, whole | {"evidence": found}, whole | {"evidence": found | {"clock": 2, "issue_timestamp_ns": 11, "issuer_pid": 4}}, {"issue": whole["issue"]}]
    lines = [json.dumps({"record": "event", "schema_version": 8, "sequence": i, "event": {"kind": "observed_block_completion", "data": x}}) for i, x in enumerate(cases)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, line_no long, value string")
    got = {r.seq: (r.complete_ts, r.issue_ts, r.pid, r.comm, r.status, r.bytes, r.timing_confidence) for r in recording.observed_requests(recording.classify_lines(df)).collect()}
    assert got == {
        0: (30, 10, 5, "app", -5, 4096, "exact"),
        1: (30, None, None, None, None, 4096, "unresolved"),
        2: (None, None, 4, None, None, 4096, "unresolved"),
    }
