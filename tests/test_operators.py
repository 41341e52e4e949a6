import os
import random

import pytest
from pyspark.sql import functions as F

from iotrail.functions import confidence, scalars
from iotrail.functions.filters import CohortFilter, latency_bucket_range
from iotrail.operators import graph, intervals, ordered, sampling, stats
from iotrail.operators import ranges
from iotrail.operators.ranges import fold_ranges, load_events, match_trace
from iotrail.plans import activity
from iotrail.plans.attribution import file_origins
from iotrail.sources import counters, exports, recording
from iotrail.streaming import live


def doubles(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_histogram_and_percentiles_of_a_tiny_sample(spark):
    df = doubles(spark, [0.0, 1.0, 2.0, 3.0, 4.0, None, float("nan")])
    bins = stats.equal_width_histogram(df, [], "v", 2).orderBy("bin").collect()
    assert [b.n for b in bins] == [2, 3] and bins[0].missing == 2
    p = stats.nearest_rank(df, [], "v", [50, 95]).first()
    assert (p.p50, p.p95) == (2.0, 4.0)
    assert len(stats.equal_width_histogram(doubles(spark, [3.0, 3.0]), [], "v", 8).collect()) == 1


def test_ecdf(spark):
    got = [(r.value, r.percent) for r in stats.ecdf(doubles(spark, [1.0, 1.0, 3.0, 7.0]), [], "v").orderBy("value").collect()]
    assert got == [(1.0, 50.0), (3.0, 75.0), (7.0, 100.0)]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_nearest_rank_equals_sorting(spark, kind):
    rng = random.Random(7)
    rows = []
    for g in range(4):
        for _ in range(rng.randrange(1, 400)):
            v = rng.choice([0, -5, rng.randrange(-1000, 1000), rng.randrange(1 << 40)])
            rows.append((g if g else None, v if kind == "long" else v / 7.0))
    df = spark.createDataFrame(rows, f"g long, v {kind}")
    ps = [0, 1, 50, 90, 99, 100]
    for r in stats.nearest_rank(df, ["g"], "v", ps).collect():
        values = sorted(v for g, v in rows if g == r.g)
        for p in ps:
            assert r[f"p{p}"] == values[max(1, -(-p * len(values) // 100)) - 1]


def test_merge_intervals_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), s, s + rng.choice([0, 1, 3, 40])) for s in (rng.randrange(400) for _ in range(120))]
    df = spark.createDataFrame(rows, "k long, start_ns long, end_ns long")
    for gap in (0, 2):
        got = sorted((r.k, r.start_ns, r.end_ns) for r in intervals.merge_intervals(df, ["k"], gap_ns=gap, shift=2).collect())
        want = []
        for k in (0, 1):
            out = []
            for _, s, e in sorted(x for x in rows if x[0] == k and x[2] > x[1]):
                if out and s - out[-1][1] <= gap:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            want += [(k, s, e) for s, e in out]
        assert got == sorted(want)


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(i, i % 2, s, s + rng.choice([0, 5, 90, 5000])) for i, s in enumerate(rng.randrange(20000) for _ in range(150))]
    right = [(i, i % 2, s, s + rng.choice([0, 7, 300, 9000])) for i, s in enumerate(rng.randrange(20000) for _ in range(150))]
    a = spark.createDataFrame(left, "a long, k long, ls long, le long")
    b = spark.createDataFrame(right, "b long, k long, rs long, re long")
    got = sorted((r.a, r.b) for r in intervals.interval_join(a, b, ["k"], ("ls", "le"), ("rs", "re"), 10, long_buckets=4).collect())
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    assert got == want


def test_locate_uses_open_start_and_closed_end(spark):
    points = spark.createDataFrame([(5,), (6,), (10,), (11,)], "ts long")
    spans = spark.createDataFrame([(5, 10)], "start_ns long, end_ns long")
    got = {r.ts: r.interval_start_ns for r in intervals.locate(points, spans, [], "ts").collect()}
    assert got == {5: None, 6: 5, 10: 5, 11: None}


def test_bursts_join_across_half_a_millisecond(spark):
    rows = [("read", 0, 1_000_000, 1 << 20, 1), ("write", 1_500_000, 2_000_000, 2 << 20, 2), ("read", 2_500_001, 3_000_000, 4 << 20, 3), ("discard", 3_100_000, 3_200_000, 1 << 30, 2)]
    io = spark.createDataFrame(rows, "operation string, issue_ts long, complete_ts long, bytes long, pid long").withColumn("major", F.lit(8)).withColumn("minor", F.lit(0))
    merged = activity.device_activity(io, by_device=False)
    found = activity.bursts(merged, 0, 4_000_000)
    got = sorted((r.start_ns, r.end_ns, r.total_bytes >> 20, r.read_bytes >> 20, r.write_bytes >> 20) for r in activity.interval_payload(io, found).collect())
    assert got == [(0, 2_000_000, 3, 1, 2), (2_500_001, 3_200_000, 4, 4, 0)]
    mine = activity.interval_payload(io.filter("pid = 2"), found).orderBy("start_ns").collect()
    assert [r.total_bytes >> 20 for r in mine] == [2, 0]


def test_host_bandwidth_with_and_without_idle(spark):
    rows = [("read", 0, 500_000_000, 1 << 20), ("write", 0, 400_000_000, 2 << 20), ("other", 0, 100, 1 << 30)]
    io = spark.createDataFrame(rows, "operation string, issue_ts long, complete_ts long, bytes long").withColumn("major", F.lit(8)).withColumn("minor", F.lit(0))
    merged = activity.device_activity(io, by_device=False)
    got = {r.direction: (r.with_idle_mib_s, r.without_idle_mib_s) for r in activity.host_bandwidth(io, merged, 0, 10**9).collect()}
    assert got == {"total": (3.0, 6.0), "read": (1.0, 2.0), "write": (2.0, 4.0)}
    unknown = activity.host_bandwidth(io, merged, 0, 10**9, known=False).first()
    assert unknown.busy_ns is None and unknown.idle_ns is None and unknown.without_idle_mib_s is None


def test_even_sampling_keeps_both_ends(spark):
    for n, limit in ((12388, 12000), (20000, 2), (5, 9)):
        df = sampling.indexed(spark.range(n), [], ["id"], F.shiftright("id", 10))
        ids = [r.id for r in df.filter(sampling.even_with_ends(limit)).orderBy("id").collect()]
        assert len(ids) == min(n, limit) and ids[0] == 0 and ids[-1] == n - 1


def test_latency_buckets():
    assert latency_bucket_range(1, 3) == (2, 16)
    assert latency_bucket_range(0, 0) == (0, 2)


def test_latency_drilldown(spark):
    values = [0, 1, 2, 3, 4, 7, 8, 15, 16, 31]
    io = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "request_id long, total_ns long")
    low, high = latency_bucket_range(1, 3)
    got = [r.total_ns for r in CohortFilter(latency_min_ns=low, latency_max_ns=high).apply(io).orderBy("request_id").collect()]
    assert got == [2, 3, 4, 7, 8, 15]


def test_coverage_labels(spark):
    rows = [(99998, 100001), (3, 100001), (0, 184), (184, 184), (141, 184), (0, 0)]
    df = spark.createDataFrame(rows, "n long, t long").withColumn("i", F.monotonically_increasing_id())
    got = [r.label for r in df.select("i", scalars.coverage_label("n", "t").alias("label")).orderBy("i").collect()]
    assert got == [">99.9%", "<0.1%", "0%", "100%", "76.6%", "N/A"]


def test_ids_beyond_signed_range(spark):
    df = spark.sql("select cast('15069763766852447852' as decimal(20,0)) as v")
    r = df.select(scalars.signed_id("v").alias("s")).select("s", scalars.unsigned_id("s").alias("u")).first()
    assert r.s == 15069763766852447852 - 2**64 and int(r.u) == 15069763766852447852


def test_confidence_lattice(spark):
    df = spark.createDataFrame([("exact", "probable_async")], "a string, b string")
    r = df.select(confidence.weakest(F.col("a"), F.col("b")).alias("w"), confidence.strongest(F.col("a"), F.col("b")).alias("s")).first()
    assert (r.w, r.s) == ("probable_async", "exact")


def small_graph(spark, nodes, edges):
    n = spark.createDataFrame([("s", 1, i, k, s, e, f"n{i}", i) for i, k, s, e in nodes], "session_id string, seq long, node_id long, kind string, start_ns long, end_ns long, name string, ord int")
    e = spark.createDataFrame([("s", 1, i, a, b, c, i) for i, (a, b, c) in enumerate(edges)], "session_id string, seq long, edge_id long, from_id long, to_id long, confidence string, ord int")
    return n, e


def test_overlapping_grandchild_is_not_subtracted_twice(spark):
    nodes, edges = small_graph(
        spark,
        [(1, "syscall", 0, 100), (2, "block_queue", 10, 30), (3, "block_request", 20, 60), (4, "uic_context", 0, 90), (5, "scsi_command", 70, 90)],
        [(1, 2, "exact"), (2, 3, "probable"), (1, 4, "exact"), (1, 5, "context_only")],
    )
    ranked = graph.ranked_edges(edges)
    ex = {r.node_id: r.exclusive_ns for r in graph.exclusive_time(nodes, ranked).collect()}
    assert ex == {1: 50, 2: 10, 3: 40, 4: 0, 5: 20}
    path = graph.critical_path(ranked, graph.exclusive_time(nodes, ranked)).first()
    assert path.critical_path_ns == 100 and path.critical_path == [1, 2, 3]
    m = graph.request_metrics(nodes).first()
    assert (m.total_ns, m.accounted_ns, m.unaccounted_ns) == (100, 100, 0)


def test_cycle_is_refused_in_admission_order(spark):
    nodes, edges = small_graph(spark, [(i, "bio", 0, 10) for i in range(1, 5)], [(1, 2, "exact"), (2, 3, "exact"), (3, 1, "exact"), (3, 4, "exact")])
    kept = {(r.from_id, r.to_id) for r in graph.without_cycles(graph.valid_edges(edges, nodes)).collect()}
    assert kept == {(1, 2), (2, 3), (3, 4)}


def test_edges_need_both_ends_and_forward_time(spark):
    nodes, edges = small_graph(spark, [(1, "bio", 50, 60), (2, "bio", 0, 10), (3, "bio", 5, 1)], [(1, 2, "exact"), (2, 1, "exact"), (2, 9, "exact"), (2, 2, "exact")])
    good = graph.valid_nodes(nodes)
    assert sorted(r.node_id for r in good.collect()) == [1, 2]
    assert [(r.from_id, r.to_id) for r in graph.valid_edges(edges, good).collect()] == [(2, 1)]


def test_file_origin_takes_the_strongest_path(spark):
    nodes, edges = small_graph(
        spark,
        [(0, "block_request", 10, 20), (2, "bio", 5, 5), (3, "file_operation", 0, 9)],
        [(3, 2, "probable"), (2, 0, "exact"), (3, 0, "probable_async")],
    )
    for c in ("fs_major", "fs_minor", "inode", "generation", "mount"):
        nodes = nodes.withColumn(c, F.when(F.col("node_id") == 3, F.lit(7)).cast("long"))
    nodes = nodes.withColumn("path", F.when(F.col("node_id") == 3, "/a"))
    edges = edges.withColumn("inferred_path", F.lit(False)).withColumn("incomplete", F.lit(False))
    o = file_origins(nodes, edges).collect()
    assert [(r.confidence, r.path, r.inode_label) for r in o] == [("probable", "/a", "<inode 7:7:7>")]


def trace_rows(spark, rows):
    schema = "record_id long, kind string, timestamp_ns long, device_encoded long, sector long, sectors long, bytes long, rwbs string, tid long, comm string, cpu long, error int, clock int"
    return load_events(spark.createDataFrame([(i, k, ts, 2048, s, n, None, w, 1, "c", 0, 0, c) for i, (k, ts, s, n, w, c) in enumerate(rows)], schema))


def reasons(df):
    return [(r.reason, r.device_ns) for r in df.orderBy("record_id").collect()]


def test_trace_matching_outcomes(spark):
    rows = [
        ("issue", 1, 0, 8, "R", 0), ("complete", 5, 0, 8, "R", 0),
        ("issue", 6, 0, 8, "R", 0), ("issue", 7, 4, 8, "R", 0), ("complete", 9, 0, 4, "R", 0), ("complete", 10, 0, 8, "R", 0),
        ("issue", 11, 100, 8, "W", 0), ("complete", 11, 100, 8, "W", 0),
        ("issue", 12, 200, 8, "W", 0), ("requeue", 13, 200, 8, "W", 0), ("complete", 14, 200, 8, "W", 0),
        ("issue", 15, 300, 8, "W", 0), ("complete", 16, 300, 8, "W", 7),
        ("complete", 17, 400, 8, "W", 0),
    ]
    df = trace_rows(spark, rows)
    want = [
        ("unique match", 4),
        ("overlapping, repeated, partial or requeued", None),
        ("multiple issue candidates", None),
        ("equal or reversed time", None),
        ("overlapping, repeated, partial or requeued", None),
        ("unsupported clock", None),
        ("no issue candidate", None),
    ]
    assert reasons(match_trace(df)) == want
    # The same trace cut into pieces of three events must settle to the same answer.
    assert reasons(match_trace(df, piece_rows=3)) == want
    assert reasons(match_trace(df, lossy=True))[0] == ("trace loss", None)


def test_pieces_settle_in_rounds_of_spans(spark, monkeypatch):
    """Requests that stay open reach every later piece; that must not cost a round per piece."""
    rows = []
    for t in range(0, 80, 4):
        rows += [("issue", t, 0, 8 + t % 8, "R", 0), ("issue", t + 1, 64 - t % 16, 8, "R", 0), ("complete", t + 2, 64 - t % 16, 8, "R", 0), ("insert", t + 3, 4, 64, "R", 0)]
    df = trace_rows(spark, rows)

    def settled(**kw):
        found = fold_ranges(df, **kw).filter("role not like 'left%'")
        return sorted(map(str, found.select("record_id", "role", "candidates", "only_issue", "usable", "closes", "insert_record").collect()))

    want = settled()
    written, plain = [], ranges.stage
    monkeypatch.setattr(ranges, "stage", lambda d, name: written.append(name) or plain(d, name))
    assert settled(piece_rows=4) == want
    assert written.count("range-fold") <= 3
    assert settled(piece_rows=4, span_rows=40) == want


def test_touching_ranges_stay_independent(spark):
    df = trace_rows(spark, [("issue", 1, 0, 8, "R", 0), ("issue", 2, 8, 8, "R", 0), ("complete", 3, 0, 8, "R", 0), ("complete", 4, 8, 8, "R", 0)])
    assert reasons(match_trace(df)) == [("unique match", 2), ("unique match", 2)]
    assert fold_ranges(df).select("component").distinct().count() == 2


def test_diagnostics_are_bounded_and_redacted(spark):
    good = '{"ts_unix_ms":1,"level":"info","component":"c","event":"e","session_id":"s","outcome":"ok","code":"X","detail":"open /data/a.db then C:\\\\x\\\\y ok"}'
    df = spark.createDataFrame([(good,), ("not json /etc/passwd",)], "value string")
    rows = counters.parse_diagnostics(df).orderBy("level").collect()
    assert rows[0].detail == "open <redacted-path> then <redacted-path> ok"
    assert rows[1].code == "AGENT_DIAGNOSTIC_INVALID" and rows[1].detail.endswith("<redacted-path>")


def test_recording_lines_are_isolated(spark, tmp_path):
    ok = '{"record":"event","schema_version":8,"sequence":1,"event":{"kind":"block_complete","data":{"ts_ns":5,"request_id":15069763766852447852,"device_major":8,"device_minor":0,"status":0,"later_field":1}}}'
    big = '{"record":"hello","x":"' + "a" * (1 << 20) + '"}'
    foot = '{"record":"footer","schema_version":8,"events_seen":1,"events_persisted":1,"events_dropped":0,"events_rejected":0}'
    path = tmp_path / "s.ndjson"
    path.write_bytes("\n".join([ok, "", "   ", big, '{"record":"mystery"}', "{broken", foot]).encode() + b"\n\xff\xfe\n")
    lines = recording.classify_lines(recording.read_lines(spark, str(path)))
    counts = {r.status: r["count"] for r in lines.groupBy("status").count().collect()}
    assert counts == {"ok": 2, "blank": 2, "rejected": 4}
    done = recording.events(lines, "block_complete").first()
    assert done.request_id == 15069763766852447852 - 2**64 and done.cpu is None
    assert recording.integrity(lines).first().integrity_ok is False
    path.write_text("\n".join([ok, foot]))
    clean = recording.integrity(recording.classify_lines(recording.read_lines(spark, str(path)))).first()
    assert clean.integrity_ok is True and clean.total_lines == 2


def test_lines_of_split_files_are_numbered_without_moving_text(spark, tmp_path):
    want = {}
    for name, n in (("a.ndjson", 500), ("b.ndjson", 90)):
        (tmp_path / name).write_text("".join(f'{{"record":"mystery","at":{i}}}\n' for i in range(1, n + 1)))
        want[name] = n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = recording.read_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().toString()
        rows = [(r.session_id.rsplit("/", 1)[1], r.line_no, r.value) for r in lines.collect()]
        assert lines.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "hashpartitioning" not in plan
    assert sorted(r[:2] for r in rows) == [(f, i) for f, n in sorted(want.items()) for i in range(1, n + 1)]
    assert all(f'"at":{i}}}' in value for _, i, value in rows)
    checked = recording.integrity(recording.classify_lines(recording.read_lines(spark, str(tmp_path))))
    steps = checked._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("HashAggregate" in x and "count" in x for x in steps) and not any("SortAggregate" in x and "count" in x for x in steps)
    assert {r.total_lines for r in checked.collect()} == set(want.values())


def test_exports_never_replace_their_source(spark, tmp_path):
    df = spark.range(1).select(F.lit("x").alias("value"))
    with pytest.raises(ValueError):
        exports.write_csv(df, str(tmp_path / "a"), source=str(tmp_path / "a"))
    exports.write_csv(df, str(tmp_path / "b"))
    with pytest.raises(Exception, match="exists"):
        exports.write_csv(df, str(tmp_path / "b"))


def test_trigger_machine(spark):
    policy = live.TriggerPolicy("r", 10, 2, 20, 30, 50)
    windows = [(0, 5), (10, 11), (20, 12), (30, 1), (40, 1), (50, 1), (80, 1)]
    df = spark.createDataFrame([("s", t, v) for t, v in windows], "session_id string, ts_ns long, observed long")
    got = [(r.ts_ns, r.to_state, r.reason) for r in live.trigger_transitions(df, policy).orderBy("ts_ns").collect()]
    assert got == [
        (10, "armed", "threshold_observed"),
        (20, "deep", "consecutive_threshold_exceeded"),
        (40, "cooldown", "deep_budget_elapsed"),
        (80, "basic", "cooldown_elapsed"),
    ]
    with pytest.raises(ValueError):
        live.TriggerPolicy(" ", 1, 1, 1, 1, 1)


def test_carry_crosses_empty_blocks(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 500, None), (1, 900, 30), (2, 5, None)], "k long, seq long, v long")
    out = ordered.carry_last(df, ["k"], ["seq"], {"p": F.col("v")}, bucket=F.shiftright("seq", 4)).orderBy("k", "seq").collect()
    assert [r.p for r in out] == [None, 10, 10, None]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("count", [20, 27, 28, 300])
def test_many_spans_keep_their_chain(spark, count):
    from iotrail.plans import evidence
    from iotrail.sources import tables as T

    spans = T.spans(spark, SF)
    one = {**spans.first().asDict(), "layer": "vfs"}
    many = spark.createDataFrame([{**one, "ord": i} for i in range(count)], spans.schema)
    request = T.evidence_requests(spark, SF).filter((F.col("session_id") == one["session_id"]) & (F.col("seq") == one["seq"]))
    origins = evidence.origin_nodes(request, T.request_origins(spark, SF).limit(0))
    nodes, edges = evidence.build_graphs(request, many, origins, T.file_syscalls(spark, SF).limit(0))
    chain = {r.from_id: (r.to_id, r.relation) for r in edges.collect() if r.relation in ("calls", "context_for", "submits")}
    at = {r.node_id for r in nodes.filter("kind = 'vfs'").collect()}
    assert len(at) == count
    (first,) = at - {to for to, _ in chain.values()}
    seen = []
    while first in chain:
        seen.append(first)
        first, relation = chain[first]
    assert len(seen) == count and relation == "submits"


def test_histogram_has_the_bins_asked_for(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert stats.equal_width_histogram(df, [], "v", 500).count() == 500


def test_reload_window_keeps_sessions_apart(spark):
    requests = spark.createDataFrame(
        [("a", 1, 10, 90, 95, 100), ("b", 1, 20, 10_000, 10_005, 10_010)],
        "session_id string, seq long, request_id long, insert_ts long, issue_ts long, complete_ts long",
    )
    evidence = spark.createDataFrame(
        [("a", 1, 7, 95, 95), ("a", 2, 7, 10_001, 10_001), ("b", 3, 7, 95, 95), ("b", 4, 7, 10_001, 10_001)],
        "session_id string, seq long, request_id long, start_ns long, end_ns long",
    )
    _, kept = recording.reload_window(requests, evidence, 0, 20_000, reach_ns=50)
    assert sorted((r.session_id, r.seq) for r in kept.collect()) == [("a", 1), ("b", 4)]


def test_segment_ends_with_its_deep_phase(spark):
    events = spark.createDataFrame([("s", i, t) for i, t in enumerate([1, 6, 15, 40, 70, 95])], "session_id string, request_id long, ts_ns long")
    moves = spark.createDataFrame([("s", 10, "deep"), ("s", 40, "cooldown"), ("s", 60, "armed"), ("s", 65, "deep")], "session_id string, ts_ns long, to_state string")
    got = live.segment_events(events, moves, before_ns=5)
    assert sorted((r.trigger_ns, r.request_id) for r in got.collect()) == [(10, 1), (10, 2), (10, 3), (65, 4), (65, 5)]


def test_a_session_without_windows_times_out(spark, tmp_path):
    """Windows of session a stop while armed, of b while deep; session c moves the clock on."""
    second = 1_000_000_000
    first = [("a", 10, 9), ("b", 10, 9), ("b", 20, 12), ("c", 10, 0)]
    later = [("c", 400, 0)], [("c", 401, 0)], [("c", 900, 0)], [("c", 901, 0)]
    schema = "session_id string, ts_ns long, observed long"
    for i, rows in enumerate([first, *later]):
        frame = spark.createDataFrame([(s, t * second, v) for s, t, v in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    policy = live.TriggerPolicy("r", 6, 2, 20 * second, 30 * second, 50 * second)
    out = live.run_to_table(live.live_trigger(stream, policy), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.session_id, r.ts_ns // second, r.from_state, r.to_state, r.observed, r.reason) for r in out.collect())
    assert got == [
        ("a", 10, "basic", "armed", 9, "threshold_observed"),
        ("a", 60, "armed", "basic", 9, "arming_timeout"),
        ("b", 10, "basic", "armed", 9, "threshold_observed"),
        ("b", 20, "armed", "deep", 12, "consecutive_threshold_exceeded"),
        ("b", 40, "deep", "cooldown", 12, "deep_budget_elapsed"),
        ("b", 70, "cooldown", "basic", 12, "cooldown_elapsed"),
    ]
