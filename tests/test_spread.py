"""Shuffles follow the size of the input, and short keys are shuffled once."""

from __future__ import annotations

import contextlib
import io

import pytest

from iotrail import session
from iotrail.operators import correlate, ordered, ranges, stats
from iotrail.sources import tables


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.fixture
def plain_width(spark):
    """The session's own number of partitions, before and after."""
    kept = {k: spark.conf.get(k, d) for k, d in ((session.PARTITIONS, None), (session.ADVISORY, None)) if spark.conf.get(k, d) is not None}
    spark.conf.unset(session.PARTITIONS)
    spark.conf.unset(session.ADVISORY)
    yield int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key in (session.PARTITIONS, session.ADVISORY):
        spark.conf.unset(key)
        if key in kept:
            spark.conf.set(key, kept[key])


def test_partitions_follow_the_rows_of_a_table(spark, plain_width, tmp_path, monkeypatch):
    assert session.shuffle_width(spark) == plain_width
    session.spread(spark, 1)
    assert session.shuffle_width(spark) == plain_width
    spark.range(5 * plain_width).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    tables.table(spark, str(tmp_path), "events")
    assert session.shuffle_width(spark) == 5 * plain_width
    numbered = ordered.with_sequence(spark.range(100), ["id"])
    assert f", {5 * plain_width})" in plan(numbered)


def test_short_keys_are_shuffled_once(spark, monkeypatch):
    rows = [(k * 10 + p, kind, k * 100 + p, "s", k, 8, 0) for k in range(200) for p, kind in enumerate(("insert", "issue", "complete"))]
    events = spark.createDataFrame(rows, "seq long, kind string, ts_ns long, session_id string, request_id long, major long, minor long").selectExpr(
        "*", "'read' AS operation", "0L AS sector", "8L AS sectors", "1L AS bytes", "1L AS pid", "1L AS tid", "0L AS cpu", "'c' AS comm", "0 AS status"
    )
    written = {}

    def seen(df, name):
        written[name] = plan(df)
        return session.stage(df, name)

    monkeypatch.setattr(correlate, "stage", seen)
    life = correlate.annotate_lifetimes(events, 10**9, time_sorted=True, shift=4)  # each block holds about one key
    assert life.filter("matched").count() == 200
    assert written["block-lifetimes"].count("Exchange hashpartitioning") == 1


def test_histogram_joins_written_edges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(stats, "stage", lambda df, name: written.append(name) or session.stage(df, name))
    df = spark.range(1000).selectExpr("'read' AS operation", "cast(id AS double) AS value")
    found = stats.equal_width_histogram(df, ["operation"], "value", 4)
    assert {r.bin: r.n for r in found.collect()} == {0: 250, 1: 250, 2: 250, 3: 250}
    assert written == ["histogram-edges"] and "BroadcastHashJoin" in plan(found)


def test_rows_without_a_record_are_spread(spark):
    rows = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, None), (10, None), (None, None)], "record_id long, issue_record long")
    records = spark.createDataFrame([(10, 100), (10, 101), (2, 102), (None, 103)], "issue_record long, i_ts long")
    joined = ranges._with_record(rows, records, "issue_record")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    found = sorted((tuple(r) for r in joined.select("record_id", "issue_record", "i_ts").collect()), key=key)
    assert found == sorted([(1, 10, 100), (1, 10, 101), (2, None, None), (3, 11, None), (4, None, None), (10, None, None), (None, None, None)], key=key)
    spread = rows.repartition(64, "issue_record").filter("issue_record IS NULL")
    assert spread.rdd.glom().filter(len).count() == 1  # what a join on the number alone did
    assert "hashpartitioning(issue_record" not in plan(joined.hint("merge"))
