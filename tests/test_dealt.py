"""Tables dealt by request: no shuffle of pairs, nodes or edges once they are written, and both ways of a walk agree."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.operators import graph
from iotrail.operators.graph import KEY
from iotrail.plans import evidence
from iotrail.session import stage_dealt, union_dealt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_tables_are_read_without_a_shuffle(spark):
    rows = spark.range(400).select(F.lit("s").alias("session_id"), (F.col("id") % 50).alias("seq"), F.col("id").alias("node_id"))
    a, b = stage_dealt(rows, "a", KEY), stage_dealt(rows, "b", KEY)
    both = union_dealt([a.withColumn("n", F.lit(1)), b.withColumn("n", F.lit(2))], KEY)
    first = both.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY, "node_id").orderBy("n")))
    assert "Exchange" not in plan(first) and first.filter("rn = 2").count() == 400
    assert "Exchange" not in plan(a.groupBy(*KEY).count())


def test_pairs_are_not_grouped_again(spark):
    reqs = spark.createDataFrame(
        [("e", i, i, "read", 8, 4096, 7, 7, 100, 110, 200, 0) for i in range(1, 4)],
        "session_id string, seq long, request_id long, operation string, sector long, bytes long, pid long, tid long, insert_ts long, issue_ts long, complete_ts long, evidence_from long",
    )
    obs = spark.createDataFrame(
        [
            ("e", 10, "scsi", 120, 150, "span", "exact", 2, None, None, 0, 0),
            ("e", 11, "scsi", 120, 150, "span", "exact", None, 8, 4096, 0, 0),
            ("e", 12, "uic_context", 120, None, "instant", "context_only", None, None, None, 0, 0),
            ("e", 13, None, 120, 150, "span", "exact", 3, None, None, 0, 0),
            ("e", 14, None, 120, 150, "span", "exact", None, None, None, 7, 0),
        ],
        "session_id string, seq long, layer string, ts_ns long, end_ns long, phase string, confidence string, correlation_id long, sector long, bytes long, pid long, tid long",
    ).withColumns({"operation": F.lit(None).cast("string"), "name": F.lit("x"), "opcode": F.lit(None).cast("long"), "status": F.lit(None).cast("int")})
    pairs = evidence.match_observations(reqs, obs)
    got = sorted((r.seq, r.obs_seq, r.is_exact, r.r_id) for r in pairs.collect())
    want = [(1, 11, False, 1), (1, 12, False, 1), (1, 14, False, 1), (2, 10, True, 2), (2, 12, False, 2), (2, 14, False, 2)]
    assert got == want + [(3, 11, False, 3), (3, 12, False, 3), (3, 13, True, 3)]
    assert "Window" not in plan(pairs)


def test_refused_edges_and_counted_pairs_agree_both_ways(spark, monkeypatch):
    rnd = random.Random(3)
    edges, nodes = [], []
    for k in range(3):
        nodes += [("s", k, i, rnd.choice("xyz")) for i in range(6)]
        edges += [("s", k, j, rnd.randrange(6), rnd.randrange(6), rnd.choice(["exact", "probable", "context_only"]), j) for j in range(10)]
    e = spark.createDataFrame(edges, "session_id string, seq long, edge_id long, from_id long, to_id long, confidence string, ord int")
    n = spark.createDataFrame(nodes, "session_id string, seq long, node_id long, kind string")

    def both():
        admitted = graph.without_cycles(e)
        counted = graph.closure(admitted, kinds=n)
        return sorted(map(tuple, admitted.collect())), sorted(map(tuple, counted.select(*KEY, "from_kind", "to_kind", "strength", "n").collect()))

    small = both()
    monkeypatch.setattr(graph, "IN_TASK", 1)
    assert small == both()
    pairs = graph.closure(graph.without_cycles(e)).count()
    assert 0 < len(small[0]) < len(edges) and sum(r[-1] for r in small[1]) == pairs


def test_pipelines_read_equal_spans_once(spark):
    reqs = spark.createDataFrame([("e", 1, 0, 5, 100)], "session_id string, seq long, insert_ts long, issue_ts long, complete_ts long")
    spans = [("e", 1, "exact", 0, 10)] * 3 + [("e", 1, "probable", 50, 70), ("e", 1, "probable", 90, 120), ("e", 1, "context_only", 20, 20), ("e", 1, None, 30, 40)]
    rows = spark.createDataFrame(spans, "session_id string, seq long, confidence string, start_ns long, stop_ns long")
    (r,) = evidence.request_pipelines(reqs, rows).collect()
    assert (r.start_ns, r.end_ns, r.spans, r.accounted_ns, r.unaccounted_ns) == (0, 100, 7, 40, 60)
