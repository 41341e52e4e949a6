"""Bounded top lists, session ends and refreshed results."""

import random

import pytest
from pyspark.sql import functions as F

from iotrail.streaming import sessions, toplist
from verification import streams


def test_counters_stay_within_their_bounds():
    rng = random.Random(5)
    for capacity in (1, 3, 10):
        exact, counts, error, total = {}, {}, 0, 0
        for _ in range(300):
            for _ in range(rng.randint(0, 8)):
                key, weight = f"k{int(rng.paretovariate(0.7)) % 60}", rng.randint(1, 50)
                exact[key] = exact.get(key, 0) + weight
                counts[key] = counts.get(key, 0) + weight
                total += weight
            counts, taken = toplist.cut_counters(counts, capacity)
            error += taken
            assert len(counts) <= capacity and error * (capacity + 1) <= total
            assert all(counts.get(k, 0) <= n <= counts.get(k, 0) + error for k, n in exact.items())
    assert toplist.cut_counters({"a": 4, "b": 4, "c": 4}, 2) == ({}, 4) and toplist.cut_counters({}, 2) == ({}, 0)


def test_lists_hold_every_heavy_key(spark):
    """Three batches, few counters: the bounds hold for each key, heavy keys are listed, too coarse lists are refused."""
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"rare{i}", i % 7) for i in range(3000)]
    weights = spark.createDataFrame(rows, "at long, key string, weight long")
    stream = toplist.top_counters(streams.chunked(spark, weights, "at", "weights"), capacity=8, shards=2)
    table = streams.drain(spark, stream, "lists", "update")
    lists = toplist.latest_lists(table)
    exact = {r.key: r.weight for r in weights.filter("key IS NOT NULL AND weight > 0").groupBy("key").agg(F.sum("weight").alias("weight")).collect()}
    listed = {r.key: r for r in lists.collect() if r.key}
    assert len(listed) <= 16 and "hot" in listed and table.select("batch").distinct().count() == 3
    assert all(r.at_least <= exact[k] <= r.at_most for k, r in listed.items())
    assert [(r.key, r.weight) for r in toplist.above_share(lists, weights, 0.3).collect()] == [("hot", exact["hot"])]
    with pytest.raises(ValueError):
        toplist.above_share(lists, weights, 1e-6)
    assert toplist.above_share(lists.limit(0), weights.limit(0), 0.1).count() == 0


def test_silent_sessions_end_as_idle(spark):
    second = 1_000_000_000
    rows = [("footer", t * second, t == 6) for t in range(1, 7)] + [("silent", t * second, False) for t in range(1, 9)] + [("long", t * second, False) for t in range(1, 100, 5)]
    records = spark.createDataFrame(rows, "session_id string, ts_ns long, footer boolean")
    out = streams.drain(spark, sessions.session_ends(streams.chunked(spark, records, "ts_ns", "records"), 20 * second), "ends").drop("batch")
    assert sorted(tuple(r) for r in out.collect()) == [("footer", "footer", 6, second, 6 * second), ("silent", "idle", 8, second, 8 * second)]


def test_refresh_touches_dirty_sessions_only(spark):
    seen = []

    def compute(rows):
        def build(only):
            frame = only(spark.createDataFrame(rows, "session_id string, n long"))
            seen.append(sorted(r.session_id for r in frame.collect()))
            return frame.groupBy("session_id").agg(F.sum("n").alias("n"))

        return build

    path = streams.folder(spark, "results")
    evidence = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "session_id string, batch long")
    sessions.refresh_results(spark, path, 0, None, compute([("a", 1), ("b", 2), ("c", 3)]))
    dirty = sessions.dirty_sessions(evidence, 0)
    for _ in range(2):  # a repeated refresh changes nothing
        got = sessions.refresh_results(spark, path, 1, dirty, compute([("a", 9), ("b", 5)]))
        assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 0), ("b", 5, 1)]  # c has no result any more
    assert seen == [["a", "b", "c"], ["b"], ["b"]]
    assert sorted(tuple(r) for r in sessions.results_as_of(spark, path, 0, "session_id string, n long").collect()) == [("a", 1, 0), ("b", 2, 0), ("c", 3, 0)]
