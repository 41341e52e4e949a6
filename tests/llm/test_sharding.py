from pyspark.sql import functions as F

from iotrail.llm import sharding


def exchanged_columns(df):
    """Names of the columns that each exchange of the executed plan moves."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_texts_move_with_their_rows(spark):
    rows = [(i, None if i == 3 else f"text {i} " * (i % 5)) for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4, segments=8)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == rows
    digests = got.select("doc_id", "size", "text_crc32", "shard", "slot")
    assert sum("text" in c for c in exchanged_columns(digests)) == 1  # to its shard
    wrong = got.filter((F.col("size") != F.octet_length(F.coalesce("text", F.lit(""))) + 8) | (F.col("text_crc32") != F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    assert wrong.isEmpty()
