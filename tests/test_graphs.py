"""Request graphs against literal walks: admission, ranks, times, longest paths, strengths, and reused ids."""

import random

from pyspark.sql import functions as F

from iotrail.operators import graph
from iotrail.plans.evidence import lifetime_at

RANK = {"exact": 3, "probable": 2, "probable_async": 1, "context_only": 0}


def tables(spark, graphs):
    nodes = [("s", k, i, kind, a, b, f"n{i}", i) for k, (ns, _) in enumerate(graphs) for i, kind, a, b in ns]
    edges = [("s", k, j, a, b, c, j) for k, (_, es) in enumerate(graphs) for j, (a, b, c) in enumerate(es)]
    n = spark.createDataFrame(nodes, "session_id string, seq long, node_id long, kind string, start_ns long, end_ns long, name string, ord int")
    e = spark.createDataFrame(edges, "session_id string, seq long, edge_id long, from_id long, to_id long, confidence string, ord int")
    return n.repartition(4), e.repartition(4)


def random_graph(rnd, n, m, forward):
    kinds = ["vfs", "bio", "block_queue", "scsi_command", "uic_context"]
    nodes = []
    for i in range(n):
        a = rnd.randrange(100)
        nodes.append((i, rnd.choice(kinds), a, a + rnd.randrange(40)))
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    pairs = [(min(p), max(p)) if forward else p for p in pairs if p[0] != p[1]]
    return nodes, [(a, b, rnd.choice(list(RANK))) for a, b in pairs]


def reaches(edges, a, b):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for u, v in edges:
            if u == x and v not in seen:
                seen.add(v)
                todo.append(v)
    return b in seen


def test_admission_of_random_graphs(spark):
    rnd = random.Random(5)
    graphs = [random_graph(rnd, 5, 9, False) for _ in range(10)] + [random_graph(rnd, 20, 40, True)]
    _, edges = tables(spark, graphs)
    got = {(r.seq, r.edge_id) for r in graph.without_cycles(edges).collect()}
    want = set()
    for k, (_, es) in enumerate(graphs):
        admitted = []
        for j, (a, b, _) in enumerate(es):
            if not reaches(admitted, b, a):
                admitted.append((a, b))
                want.add((k, j))
    assert got == want


def below(es, v):
    return {u for u in range(64) if u != v and reaches([(a, b) for a, b, c in es if c != "context_only"], v, u)}


def test_times_paths_and_strengths_of_random_graphs(spark):
    rnd = random.Random(6)
    graphs = [random_graph(rnd, n, 2 * n, True) for n in (1, 2, 5, 9, 9, 12, 12)]
    nodes, edges = tables(spark, graphs)
    ranked = graph.ranked_edges(edges)
    exclusive = graph.exclusive_time(nodes, ranked)
    got = {(r.seq, r.node_id): r.exclusive_ns for r in exclusive.collect()}
    paths = {r.seq: (r.critical_path_ns, r.critical_path) for r in graph.critical_path(ranked, exclusive).collect()}
    roots = nodes.filter("node_id = 0").select("session_id", "seq", "node_id")
    up = {(r.seq, r.node_id): r.strength for r in graph.strongest_up(edges.select("session_id", "seq", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "confidence"), roots).collect()}
    for k, (ns, es) in enumerate(graphs):
        by = {i: (kind, a, b) for i, kind, a, b in ns}
        w = {}
        for i, (kind, a, b) in by.items():
            covered = {t for j in below(es, i) if by[j][0] != "uic_context" for t in range(max(a, by[j][1]), min(b, by[j][2]))}
            w[i] = 0 if kind == "uic_context" else b - a - len(covered)
            assert got[k, i] == w[i]
        steps = {(a, b) for a, b, c in es if c != "context_only"}
        walks = [[i] for i in by]
        best = min((-sum(w[x] for x in p), -len(p), p) for p in extend(walks, steps))
        path = best[2]
        lead = next((j for j, x in enumerate(path) if w[x]), len(path))
        assert paths[k] == (-best[0], path[max(lead - 1, 0) :])
        strength = {0: 3}
        for _ in ns:
            for a, b, c in es:
                if a in strength:
                    strength[b] = max(strength.get(b, -1), min(strength[a], RANK[c]))
        assert {i: s for (q, i), s in up.items() if q == k} == strength


def extend(walks, steps):
    out = list(walks)
    while walks:
        walks = [[*p, b] for p in walks for a, b in steps if a == p[-1]]
        out += walks
    return out


def test_a_wide_request_is_no_harder_than_many_small_ones(spark):
    """Twenty thousand stored nodes under one request: no list of pairs, the same number of rounds."""
    n = 20_000
    ids = spark.range(1, n + 1)
    nodes = ids.select(F.lit("s").alias("session_id"), F.lit(1).cast("long").alias("seq"), F.col("id").alias("node_id"), F.lit("bio").alias("kind"), (F.col("id") * 10).alias("start_ns"), (F.col("id") * 10 + 5).alias("end_ns"))
    root = spark.createDataFrame([("s", 1, 0, "vfs", 0, 10 * n + 10)], nodes.schema)
    edges = ids.select(F.lit("s").alias("session_id"), F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("from_id"), F.col("id").alias("to_id"), F.lit("exact").alias("confidence"))
    ranked = graph.ranked_edges(edges)
    exclusive = graph.exclusive_time(nodes.unionByName(root), ranked)
    assert exclusive.filter("node_id = 0").first().exclusive_ns == 10 * n + 10 - 5 * n
    assert graph.critical_path(ranked, exclusive).first().critical_path_ns == 5 * n + 10 + 5


def test_rows_of_reused_ids_go_to_the_lifetime_of_their_time(spark):
    rnd = random.Random(7)
    lives, at = [], {}
    for seq in range(400):
        i = rnd.choice([1, 1, 1, 2, 3])
        end = at.get(i, 0) + rnd.randrange(0, 30)
        since = max(end - rnd.randrange(0, 60), at.get(i, -1) + 1)
        at[i] = end
        lives.append(("s", seq, i, "read", 0, 0, 0, 0, since, since, end, since))
    cols = "session_id string, seq long, request_id long, operation string, sector long, bytes long, pid long, tid long, insert_ts long, issue_ts long, complete_ts long, evidence_from long"
    requests = spark.createDataFrame(lives, cols)
    rows = [("s", k, rnd.choice([1, 2, 3, 9, None]), rnd.randrange(-5, 3000)) for k in range(1500)]
    df = spark.createDataFrame(rows, "session_id string, k long, id long, ts long")
    want = sorted((k, x[1]) for _, k, i, ts in rows for x in lives if x[2] == i and x[11] <= ts <= x[10])
    for shift in (20, 2):
        got = sorted((r.k, r.seq) for r in lifetime_at(df, requests, "id", "ts", shift).collect())
        assert got == want and want


def test_written_tables_do_not_grow_with_the_depth_and_both_ways_agree(spark, monkeypatch):
    rnd = random.Random(11)
    deep = ([(i, "vfs", 10 * i, 10 * i + 15) for i in range(30)], [(i, i + 1, "exact") for i in range(29)])
    plain, written = graph.stage, []
    monkeypatch.setattr(graph, "stage", lambda df, name: written.append(name) or plain(df, name))

    def walked(graphs):
        nodes, edges = tables(spark, graphs)
        ranked = graph.ranked_edges(edges)
        exclusive = graph.exclusive_time(nodes, ranked)
        found = [ranked, exclusive, graph.critical_path(ranked, exclusive), graph.closure(edges)]
        return [sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str) for df in found]

    ranks, own, path, pairs = walked([deep])
    assert len(written) <= 10
    assert len(pairs) == 29 * 30 // 2 and path == [([*range(30)], 305, 0, "s")]
    some = [random_graph(rnd, 5, 7, True) for _ in range(8)]
    small = walked(some)
    monkeypatch.setattr(graph, "IN_TASK", 4)
    assert small == walked(some)
