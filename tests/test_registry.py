import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# One or two queries of every topic; the whole registry is compared by the driver.
CHOSEN = [
    "latency_summary",
    "completed_requests",
    "correlate_two_ids",
    "exact_percentiles_large",
    "share_table",
    "window_busy_percent",
    "burst_payload",
    "address_counts",
    "inferred_paths",
    "critical_path",
    "why_slow",
    "path_coverage",
    "ftrace_matching",
    "extent_paths",
    "recording_correlation",
    "disk_counter_totals",
    "path_redaction",
    "compare_sessions",
    "shape_preserving_sample",
    "stream_correlation",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if v is None or isinstance(v, (bool, int)):
        return v
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    assert got == want
