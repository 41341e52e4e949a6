"""Blocks of equal depth: crowded clocks are cut by rows, and results do not depend on the cut."""

import random

import pytest
from pyspark.sql import functions as F

from iotrail.operators import addresses, intervals
from iotrail.operators.ordered import BUCKET, in_blocks
from iotrail.plans import activity, presets


def test_rows_of_one_minute_and_of_one_value_are_spread(spark):
    for ts in (F.col("id") % 60_000, F.lit(7)):
        rows = spark.range(10_000).select(F.lit(0).alias("k"), ts.cast("long").alias("ts"))
        sizes = [r["count"] for r in in_blocks(rows, ["k"], ["ts"], shift=8).groupBy(BUCKET).count().collect()]
        assert max(sizes) <= 256 and sum(sizes) == 10_000 and len(sizes) >= 40


def crowd(seed, n=600):
    rnd = random.Random(seed)
    return [(rnd.randrange(2), s, s + rnd.choice([0, 1, 5, 5, 400])) for s in (rnd.randrange(3000) for _ in range(n))] + [(0, 77, 80)] * 300


@pytest.mark.parametrize("shift", [3, 20])
def test_union_gaps_and_look_ups_of_a_crowded_clock(spark, shift):
    rows = crowd(1)
    df = spark.createDataFrame(rows, "k long, start_ns long, end_ns long").repartition(3)
    merged = intervals.merge_intervals(df, ["k"], shift=shift)
    want = []
    for k in (0, 1):
        out = []
        for _, s, e in sorted(x for x in rows if x[0] == k and x[2] > x[1]):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want += [(k, s, e) for s, e in out]
    assert sorted(map(tuple, merged.select("k", "start_ns", "end_ns").collect())) == sorted(want)
    found = sorted((r.k, r.start_ns, r.end_ns) for r in intervals.gaps(merged, ["k"], 0, 4000, shift).collect())
    holes = []
    for k in (0, 1):
        at = 0
        for _, s, e in [x for x in sorted(want) if x[0] == k] + [(k, 4000, 4000)]:
            if s > at:
                holes.append((k, at, s))
            at = max(at, e)
    assert found == sorted(holes)
    points = spark.range(0, 4000, 7).select(F.col("id").alias("ts"), (F.col("id") % 2).alias("k"))
    got = {r.ts: r.interval_start_ns for r in intervals.locate(points, merged, ["k"], "ts", shift).collect()}
    assert got == {t: next((s for k, s, e in want if k == t % 2 and s < t <= e), None) for t in range(0, 4000, 7)}


def test_reuse_rows_and_bursts_of_a_crowded_clock(spark):
    rnd = random.Random(2)
    rows = [(i, 8, 0, rnd.randrange(3), "read", t, t + rnd.randrange(1, 9), 512, i) for i, t in enumerate(sorted(rnd.randrange(500) for _ in range(400)))]
    df = spark.createDataFrame(rows, "request_id long, major long, minor long, sector long, operation string, issue_ts long, complete_ts long, bytes long, seq long")
    got = {r.request_id: r.gap_ms for r in addresses.reuse_gaps(df, shift=3).collect()}
    last, want = {}, {}
    for i, _, _, sector, _, t, *_ in rows:
        want[i] = None if sector not in last else (t - last[sector]) / 1e6
        last[sector] = t
    assert got == want
    ranks = {r.request_id: r.row for r in presets.request_gantt(df, 0).collect()}
    assert ranks == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[5], r[6], r[0])), 1)}
    merged = intervals.merge_intervals(df, [], "issue_ts", "complete_ts")
    total = {r.request_id: r.cumulative_bytes for r in activity.burst_payload(df, merged).collect()}
    assert len(total) == 400 and max(total.values()) <= 400 * 512
