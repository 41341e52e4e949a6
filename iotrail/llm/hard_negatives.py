"""Hard negatives by an inverted multi-index.

Vectors become integers; two codebooks, one for each half of the components, are fitted on a bounded sample and every row
is put into the cell of its two nearest half centres. Rows are dealt into shards by a hash (a hot label is in all of them),
a shard keeps its rows cell by cell. An anchor sorts the upper bounds of its half scores (centre plus radius) and a heap
visits cells by the sum of both. It stops when no row outside the visited cells can enter its result: all cells left
are bounded below the lists it must fill. Results are exact; the index only decides what is looked at.

Blocks of anchors meet shards in groups of their own, of bounded size on both sides; a group returns its best rows and
the best of all shards are taken with a window per anchor. Positives come first, since their scores make the windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.llm.common import stage, table

#: Fixed values of the contract.
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100
SCALE = 256

#: Rows the codebooks are fitted on, centres of a half, components of a shard, anchors of a block, cells between two stops.
SAMPLE, CENTRES, SHARD, BLOCK, STEP = 4096, 16, 1 << 22, 512, 8
NULL_ID = -(1 << 63)
LONG = (-(1 << 63), (1 << 63) - 1)


def prepared(df: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(row, vec_id, label, v)`` of the rows that take part, written once; ``row`` tells repeated ids apart."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(good, whole).alias("v"))
    return stage(rows.filter("label IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of integers; a shorter vector counts as filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def centres_of(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Means of ``k`` groups at most, from random points on."""
    distinct = np.unique(points, axis=0)
    centres = np.random.default_rng(seed).permutation(distinct)[:k]
    for _ in range(rounds):
        near = nearest(points, centres)
        centres = np.stack([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


class Cells:
    """The rows of a shard, cell by cell, with the radius of every half centre."""

    def __init__(self, part: pa.Table, books: tuple[np.ndarray, np.ndarray], dims: int) -> None:
        vectors = matrix(part.column("v"), dims)
        ids = part.column("vec_id").fill_null(NULL_ID).to_numpy()
        order = np.argsort(part.column("cell").to_numpy(), kind="stable")
        cells = part.column("cell").to_numpy()[order]
        self.ids, self.rows, self.labels = ids[order], part.column("row").to_numpy()[order], part.column("label").to_numpy()[order]
        self.books, self.dims = books, dims
        vectors = vectors[order]
        self.most = int(np.abs(vectors.astype(np.float64)).max(initial=1))
        self.vectors = vectors.astype(np.float64)
        self.exact = vectors.astype(object) if dims * self.most * self.most >= 1 << 53 else None
        k = len(books[1])
        starts = np.searchsorted(cells, np.arange(len(books[0]) * k + 1))
        self.span = [(int(a), int(b)) for a, b in zip(starts, starts[1:], strict=False)]
        self.radii = []
        cut = (dims + 1) // 2
        for half, code, book in zip((self.vectors[:, :cut], self.vectors[:, cut:]), (cells // k, cells % k), books, strict=True):
            gap = np.sqrt(((half - book[code]) ** 2).sum(1))
            radius = np.full(len(book), -np.inf)
            np.maximum.at(radius, code, gap)
            self.radii.append(radius)

    def scored(self, query: np.ndarray) -> Callable[[int, int], np.ndarray]:
        """Integer inner products of a stretch of rows: in doubles where they are exact, else in Python's integers."""
        top = int(np.abs(query.astype(np.float64)).max(initial=1))
        if self.dims * self.most * top < 1 << 53:
            held, q = self.vectors, query.astype(np.float64)
        else:
            held, q = self.exact if self.exact is not None else self.vectors.astype(np.int64).astype(object), query.astype(object)
        return lambda a, b: held[a:b] @ q

    def visit(self, query: np.ndarray) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """Steps of cells in falling order of their bound, each with the bound of all cells before them left out.

        Yields ``(bound, cells)``: no row that is not in these or later cells scores above what came before, and no row in
        them scores above ``bound``. The last step has no cells and a bound below every score.
        """
        cut, q = (self.dims + 1) // 2, query.astype(np.float64)
        sides = []
        for half, book, radius in zip((q[:cut], q[cut:]), self.books, self.radii, strict=True):
            bound = book @ half + np.sqrt(half @ half) * radius
            order = np.argsort(-bound, kind="stable")
            sides.append((order, bound[order]))
        (first, a), (second, b) = sides
        slack = 1 + 1e-9 * self.dims * self.most * (1 + np.abs(q).max(initial=0))
        heap, step, k = [(-(a[0] + b[0]), 0, 0)], [], len(second)
        while heap and heap[0][0] < np.inf:
            if len(step) == STEP:
                yield top, step
                step = []
            bound, i, j = heapq.heappop(heap)
            if j + 1 < k:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            start, end = self.span[first[i] * k + second[j]]
            if start < end:
                if not step:
                    top = -bound + slack
                step.append((start, end))
        if step:
            yield top, step
        yield -np.inf, []


def search(cells: Cells, query: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray], windows: list[tuple[float, float]], most: int) -> list[list[tuple[int, int, int]]]:
    """Per window ``(low, high)`` of scores the first ``most`` of the wanted rows as ``(score, id, row)``; fewer if there are fewer."""
    scores, seen = np.empty(0), np.empty(0, np.int64)
    score = cells.scored(query)
    least = min((lo for lo, _ in windows), default=np.inf)
    for bound, step in cells.visit(query):
        if all(bound < lo or np.count_nonzero((scores > bound) & (scores >= lo) & (scores <= hi)) >= most for lo, hi in windows):
            break
        found, at = [scores], [seen]
        for start, end in step:
            got = score(start, end)
            keep = np.flatnonzero(wanted(slice(start, end)) & (got >= least))
            found.append(got[keep])
            at.append(keep + start)
        scores, seen = np.concatenate(found), np.concatenate(at)
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
        if len(inside) > most:
            edge = np.partition(scores[inside], len(inside) - most)[len(inside) - most]
            inside = inside[scores[inside] >= edge]
        listed = ((int(scores[i]), int(cells.ids[seen[i]]), int(cells.rows[seen[i]])) for i in inside)
        out.append(sorted(listed, key=lambda x: (-x[0], x[1], x[2]))[:most])
    return out


def _met(anchors: DataFrame, index: DataFrame, shards: int, blocks: int, run: Callable, schema: str) -> DataFrame:
    """Every shard with every block of anchors, each pair a group."""
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, schema)


def _ipc(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_table(part)
    return sink.getvalue().to_pybytes()


def _best(rows: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
    """The first rows of each group by score, then id (null first), then row."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_first(other), F.asc("other_row"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows where ``anchor`` holds.

    ``anchor`` is an expression over ``vec_id``, ``label`` one over ``df``; other columns are not read. Rows without a
    label or vector, or with a null or non-finite component, take no part. Components become floor(256 * x) in double
    precision, within the range of a long; scores are exact and cut to that range. Vectors of unequal length count as filled
    up with zeros. A null id is never an anchor and comes first among ties; rows that repeat an id are rows of their own.
    An anchor alone in its label, a positive without a negative in its window, and an empty table give no rows.
    """
    spark = df.sparkSession
    rows = prepared(df, id_col, vector_col, label)
    n, dims, given = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(anchor, 1))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not given:
        return spark.createDataFrame([], out)
    dims = max(dims, 1)
    shards, blocks = max(1, -(-n * dims // SHARD)), max(1, -(-given // BLOCK))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    points = matrix(sample.column("v"), dims).astype(np.float64)
    cut = (dims + 1) // 2
    books = (centres_of(points[:, :cut], CENTRES), centres_of(points[:, cut:], CENTRES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims).astype(np.float64)
            cell = nearest(v[:, :cut], books[0]) * len(books[1]) + nearest(v[:, cut:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    kinds = "vec_id long, label long, v array<long>, row long, cell int"
    placed = rows.select("vec_id", "label", "v", "row").mapInArrow(place, kinds).withColumn("shard", F.expr(f"CAST(pmod(xxhash64(row), {shards}) AS INT)"))

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([_ipc(part.drop(["shard"]))], pa.binary())})

    index = stage(placed.groupBy("shard").applyInArrow(pack, "shard int, held binary"), "index")
    anchors = rows.filter(anchor).select("vec_id", "label", "v", "row", F.expr(f"CAST(pmod(xxhash64(row, 1), {blocks}) AS INT)").alias("block"))

    def opened(part: pa.Table) -> Cells:
        return Cells(pa.ipc.open_stream(part.column("held")[0].as_buffer()).read_all(), books, dims)

    def positives(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            cells = opened(left)
            for i, q in enumerate(matrix(right.column("v"), dims)):
                own, same = right.column("row")[i].as_py(), right.column("label")[i].as_py()
                wanted = lambda at, own=own, same=same: (cells.labels[at] == same) & (cells.rows[at] != own)
                (found,) = search(cells, q, wanted, [(-np.inf, np.inf)], POSITIVES)
                out += [(own, other, score, row) for score, other, row in found]
        return _table(out, ["anchor_row", "positive_id", "positive_score", "other_row"])

    found = _met(anchors, index, shards, blocks, positives, "anchor_row long, positive_id long, positive_score long, other_row long")
    first = stage(_best(found, ["anchor_row"], "positive_score", "positive_id", POSITIVES).drop("other_row"), "positives")
    scores = first.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("positive_score").alias("score")))).getField("score").alias("scores"))
    armed = anchors.join(scores, anchors["row"] == scores["anchor_row"]).drop("anchor_row", "vec_id")

    def negatives(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            cells = opened(left)
            for i, q in enumerate(matrix(right.column("v"), dims)):
                own, same = right.column("row")[i].as_py(), right.column("label")[i].as_py()
                wanted = lambda at, same=same: cells.labels[at] != same
                windows = [(-(-LOW * p // WHOLE), HIGH * p // WHOLE) for p in right.column("scores")[i].as_py()]
                for k, listed in enumerate(search(cells, q, wanted, windows, NEGATIVES), 1):
                    out += [(own, k, other, score, row) for score, other, row in listed]
        return _table(out, ["anchor_row", "positive_rank", "negative_id", "negative_score", "other_row"])

    found = _met(armed, index, shards, blocks, negatives, "anchor_row long, positive_rank long, negative_id long, negative_score long, other_row long")
    last = _best(found, ["anchor_row", "positive_rank"], "negative_score", "negative_id", NEGATIVES)
    named = first.withColumnRenamed("rank", "positive_rank").join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return last.join(named, ["anchor_row", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    cut = {"positive_score", "negative_score"}
    given = [[min(max(x, LONG[0]), LONG[1]) for x in c] if k in cut else [None if x == NULL_ID else x for x in c] for k, c in zip(names, columns, strict=True)]
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, given, strict=True)})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all rows of ``embeddings`` whose id is divisible by 100, after every seventh id changed its label.

    Nulls, odd vectors, ties, repeated rows and empty tables: see ``mine``. A label must be a whole number.
    """
    df = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS FIRST, b) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id NULLS FIRST, n.b)
QUALIFY row_number() OVER w <= 10
"""
