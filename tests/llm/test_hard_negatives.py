"""Mined negatives against a look at all pairs."""

import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm import hard_negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def expected(rows) -> list[tuple]:
    held = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        held.append((k, i, label, [min(max(math.floor(x * 256), LEAST), MOST) for x in v]))
    rank = lambda x: (-x[0], x[1] is not None, x[1] or 0)
    out = []
    for k, i, label, v in held:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for n, j, m, w in held if n != k]
        for p, j, _ in sorted((x for x in scored if x[2] == label), key=rank)[:5]:
            windows = sorted((x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=rank)[:10]
            cut = lambda x: min(max(x, LEAST), MOST)
            out += [(i, j, r, n, cut(p), cut(s)) for r, (s, n, _) in enumerate(windows, 1)]
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label).collect()), key=str)


def vectors(n: int, dims: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    hubs = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    single = lambda x: struct_float(x)
    return [(i, [single(h + rnd.gauss(0, 0.3)) for h in rnd.choice(hubs)], rnd.randrange(4)) for i in range(n)]


def struct_float(x: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 8 * 150)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    rows = vectors(1000, 8, 1)
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_odd_rows_ties_repeats_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    base = vectors(120, 4, 2)
    rows = base + base[:20] + [(100, base[0][1], 1)] * 2 + [(200, None, 1), (300, [], 2), (400, [1.0, None, 0.0, 0.0], 1), (500, [nan, 0.0, 0.0, 0.0], 1)]
    rows += [(600, [inf, 0.0, 0.0, 0.0], 1), (700, base[3][1], None), (None, base[4][1], 1), (800, [0.0] * 4, 3), (900, [1.0, 2.0], 0), (None, base[5][1], 2), (101, [3e30, 1.0, 1.0, 1.0], 2), (1000, [2e9, -1.0, 0.5, 1.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert found(df) == want and want
    assert found(df.withColumns({n: F.lit("x") for n in ("row", "v", "cell", "shard", "block", "score", "rank", "anchor_id", "positive_id")})) == want
    assert found(df.limit(0)) == []


def test_bounds_leave_cells_out(spark):
    """On clustered vectors the search ends before it has seen all rows, with the same result."""
    import numpy as np
    import pyarrow as pa

    rows = vectors(4000, 16, 3)
    v = np.floor(np.array([r[1] for r in rows]) * 256)
    books = (hard_negatives.centres_of(v[:, :8], 16), hard_negatives.centres_of(v[:, 8:], 16))
    cell = hard_negatives.nearest(v[:, :8], books[0]) * len(books[1]) + hard_negatives.nearest(v[:, 8:], books[1])
    part = pa.table({"v": pa.array(v.astype(np.int64).tolist(), pa.list_(pa.int64())), "vec_id": [r[0] for r in rows], "row": [r[0] for r in rows], "label": [r[2] for r in rows], "cell": cell})
    cells = hard_negatives.Cells(part, books, 16)
    seen = [0]
    plain = cells.scored

    def counted(query):
        score = plain(query)

        def run(a, b):
            seen[0] += b - a
            return score(a, b)

        return run

    cells.scored = counted
    (got,) = hard_negatives.search(cells, v[0].astype(np.int64), lambda at: np.ones(at.stop - at.start, bool), [(-np.inf, np.inf)], 10)
    scores = v @ v[0]
    assert [x[1] for x in got] == sorted(range(4000), key=lambda i: (-scores[i], i))[:10]
    assert seen[0] < 2000


def test_registered_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in hard_negatives.op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == expected(rows)
