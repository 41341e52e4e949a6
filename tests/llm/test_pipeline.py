import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline


def test_names():
    names = list(entry.queries())
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names


@pytest.mark.parametrize("wide", [False, True])
def test_stages_keep_columns_and_decide(spark, docs, clash, wide):
    rows = clash if wide else docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, rows, "").cache()
        assert after.columns == rows.columns
        rows = after
    kept = sorted((r.doc_id for r in rows.collect()), key=lambda x: (x is None, x))
    # 4, 5, 6 and 8 have no letters; 2 is longer than 1 and equal to it; 3 shares 10 of 12 shingles with 2; 11 is a near copy of 10; 12 is there twice
    assert kept == [2, 7, 9, 10, 12, 13, None]
    assert [r.text for r in rows.collect() if r.doc_id == 9] == ["[assign] and [access], [hex]"]
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, rows, "").collect()} == set(kept)


def test_empty_table(spark, nothing):
    rows = nothing
    for _, step in corpus_pipeline.STAGES:
        rows = step(spark, rows, "")
    assert rows.count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", ["op3_embedding_dups", "op7_exact_dedup", "op10_near_dups"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    rows = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(map(tuple, cursor.fetchall()))
