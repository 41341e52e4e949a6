from pyspark.sql import functions as F

import corpus_pipeline
from iotrail.llm import near_dups


def words(name: str, n: int = 40) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Null and repeated ids with unrelated texts all stay; near copies of two texts of one id are not joined."""
    rows = [(None, words("a")), (None, words("b", 50)), (None, words("c", 60)), (7, words("d")), (7, words("e", 50)), (8, words("d") + " end"), (9, words("e", 50) + " end"), (3, words("b", 50) + " end"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    after = corpus_pipeline.near_stage(spark, docs, "")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    # 8 and 9 are near copies of the two texts of 7, 3 of a text without an id, which is the smaller id
    assert sorted(map(tuple, after.collect()), key=key) == sorted((r for r in rows if r[0] not in (3, 8, 9)), key=key)


def test_smallest_id_then_first_row_stays(spark):
    rows = [(9, words("a") + " x"), (5, words("a")), (5, words("a") + " y"), (6, words("a"))]
    after = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "")
    assert list(map(tuple, after.collect())) == [(5, words("a"))]


def test_rows_of_many_blocks(spark):
    """More rows than a block of bits holds, in a few partitions, with rows that go at all places of a byte."""
    rows = spark.range(0, 40_000, 1, 1).select("id", F.when(F.col("id") % 37 == 0, F.lit(words("a"))).otherwise(F.concat(F.lit("w"), "id")).alias("text"))
    after = corpus_pipeline.near_stage(spark, rows.select(F.col("id").alias("doc_id"), "text"), "")
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == [i for i in range(40_000) if i == 0 or i % 37]


def test_texts_move_once_for_all_rounds(spark, monkeypatch):
    """Every round compares the texts that the first one brought together; the table of all texts is joined once."""
    calls, whole = [], near_dups._asked_texts
    monkeypatch.setattr(near_dups, "_asked_texts", lambda *a: calls.append(1) or whole(*a))
    texts = [words("a", 60) + f" {i} {j}" for i in range(6) for j in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dups.near_duplicates(docs, offers=(1, 1, None)).collect()
    assert {r.component_id for r in rows} == {0}
    assert len(calls) == 1


def test_the_table_of_texts_meets_no_list_of_rows(spark, monkeypatch):
    """What stays is written as bits, fewer bytes than rows."""
    staged, whole = {}, corpus_pipeline.stage
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, name: staged.setdefault(name, whole(df, name)))
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    assert corpus_pipeline.near_stage(spark, docs, "").count() == 3000
    assert staged["kept"].select(F.sum(F.length("__bits"))).first()[0] <= 3000 / 8 + 2
