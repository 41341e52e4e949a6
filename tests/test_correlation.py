import random

import pytest
from fold import correlate
from pyspark.sql import functions as F

from iotrail.operators import correlate as C
from iotrail.operators.ordered import split_keys

SCHEMA = (
    "session_id string, seq long, kind string, ts_ns long, request_id long, major long, minor long, operation string, "
    "sector long, sectors long, bytes long, pid long, tid long, cpu long, comm string, status int"
)


def frame(spark, events):
    rows = [
        ("s", i, kind, ts, key, 8, dev, "read", 8 * i, 8, 4096, 1, 1, 0, "c", 0)
        for i, (kind, ts, key, dev) in enumerate(events)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def random_events(seed, n, keys, ttl):
    rng = random.Random(seed)
    ts, out = 0, []
    for _ in range(n):
        ts += rng.choice([0, 1, 1, 2, 5, ttl // 3, ttl + 1] if rng.random() < 0.3 else [0, 1, 2])
        out.append((rng.choice(["insert", "insert", "issue", "issue", "complete"]), ts, rng.randrange(keys), rng.randrange(2)))
    return out


@pytest.mark.parametrize("seed,keys,ttl", [(1, 1, 6), (2, 2, 10), (4, 5, 30)])
def test_correlator_equals_literal_fold(spark, seed, keys, ttl):
    events = random_events(seed, 1000, keys, ttl)
    want = correlate(events, ttl)
    # Blocks of 32 rows: every carried look-up crosses many borders.
    life = C.annotate_lifetimes(frame(spark, events), ttl, time_sorted=True, shift=5).cache()
    got = {
        (r.seq, r.issue, r.ins)
        for r in life.filter("matched").select("seq", F.col("source.seq").alias("issue"), F.col("source.insert_ts").alias("ins")).collect()
    }
    assert got == set(want["matched"])
    c = C.correlation_counters(life, ttl).first()
    assert (c.completed, c.uncorrelated, c.replaced) == (len(want["matched"]), want["uncorrelated"], want["replaced"])
    assert c.expired == want["expired"]
    depth = {r.seq: (r.total_depth, r.device_depth) for r in C.queue_depths(life, ttl, shift=5).collect()}
    assert {i: depth[i][0] for i in want["depth_at_issue"]} == want["depth_at_issue"]
    assert {i: depth[i][1] for i in want["device_depth"]} == want["device_depth"]
    assert {i: depth[i][0] for i in want["depth_after"]} == want["depth_after"]


def test_unsorted_stream_uses_the_running_clock(spark):
    events = [("issue", 0, 1, 0), ("issue", 500, 2, 0), ("complete", 90, 1, 0), ("complete", 510, 2, 0)]
    life = C.annotate_lifetimes(frame(spark, events), 100, time_sorted=False)
    assert [r.seq for r in life.filter("matched").collect()] == [3]


def test_depths_and_gaps_of_two_devices(spark):
    events = [("issue", 10, 1, 0), ("issue", 20, 2, 0), ("issue", 25, 3, 1), ("complete", 30, 2, 0), ("complete", 40, 1, 0), ("complete", 50, 3, 1)]
    life = C.annotate_lifetimes(frame(spark, events), 1000, time_sorted=True)
    io = C.completed_io(life, 1000).orderBy("seq").collect()
    assert [r.issue_depth for r in io] == [2, 1, 1]
    assert io[0].issue_gap_ns == 10 and io[1].completion_gap_ns == 10 and io[2].completion_gap_ns is None


def test_ambiguous_id_leaves_no_depth(spark):
    events = [("issue", 0, 1, 0), ("issue", 1, 1, 0), ("issue", 2, 2, 0), ("complete", 3, 2, 0)]
    io = C.completed_io(C.annotate_lifetimes(frame(spark, events), 100, time_sorted=True), 100).collect()
    assert [r.issue_depth for r in io] == [1]


def test_rolling_rate_needs_64_full_gaps(spark):
    events, rows = [], []
    for i in range(66):
        for dev in (0, 1):
            rows.append(("issue", (i + 1) * 1_000_000, i, dev))
    events = rows + [("complete", 67_000_000 + i, i, dev) for i in range(66) for dev in (0, 1)]
    df = frame(spark, events).withColumn("bytes", F.when(F.col("minor") == 0, 1024).otherwise(2048).cast("long"))
    life = C.annotate_lifetimes(df, 10**12, time_sorted=True, shift=6)
    out = C.issue_columns(life, shift=6).withColumn("mib", C.mib_per_second("issue_rate_payload", "issue_rate_duration"))
    for dev, rate in ((0, 0.9765625), (1, 1.953125)):
        values = [r.mib for r in out.filter(F.col("minor") == dev).orderBy("seq").collect()]
        assert values[:64] == [None] * 64 and values[64:] == [rate, rate]


def test_a_trace_without_collisions_moves_no_row_for_chains(spark):
    events = [(t, r, k) for r in range(40) for t, k in ((3 * r, "insert"), (3 * r + 1, "issue"), (3 * r + 2, "complete"))]
    df = frame(spark, [(k, t, r, 0) for t, r, k in events])
    life = C.annotate_lifetimes(df, 1000, time_sorted=True, shift=5)
    assert life.filter("matched").count() == 40
    assert "__issue_seq" not in life._jdf.queryExecution().toString()
    crossing = {r.request_id for r in split_keys(df, C.KEY, F.shiftright("seq", 5)).collect()}
    assert crossing == {r for r in range(40) if (3 * r) // 32 != (3 * r + 2) // 32}
