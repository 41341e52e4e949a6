"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on whole sets.

1. One pass makes each document's set of word shingles, its digest and its 252 registers. Documents of equal
   sets become one class, named by its smallest id; only classes go on.
2. Registers are banded (42 bands of 6: a pair at similarity 0.8 shares no band once in 300,000 cases).
   Bands of a single class drop out while sorted keys stream by.
3. In each shared band, classes of different components are compared by the joint likelihood of their
   registers. A pair is looked at only in the first band that it shares. Bands over ``BLOCK`` classes are cut into
   blocks, and pairs of blocks are separate groups, so no group outgrows a task.
4. Candidates are verified on the whole sets and joined to components. First each class offers its best
   ``OFFERS[0]`` candidates, then more; at last the classes of the bands still open bring their sets, and all likely
   pairs between two components are verified in place. Every likely pair is either verified or already inside one
   component, and a large group of copies passes on a few pairs a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm import sketch as S
from iotrail.llm.common import drop_staged, slices, stage, table, text_bytes
from iotrail.llm.components import components

#: Likelihood estimates err by 0.025 (one sigma) at 0.8; a pair is dropped unverified only below threshold - SLACK.
SLACK = 0.13
BLOCK = 2000
OFFERS = (1, 4, None)
NO_ID = -(1 << 63)


def sketches(rows: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, digest, registers)`` of each row of ``(doc_id, text)``; registers are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = S.shingle_sets(text_bytes(batch.column(1)), k)
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            held = [S.registers(x).tobytes() if len(x) else None for x in sets]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "registers"])

    return rows.mapInArrow(run, "doc_id long, n long, digest binary, registers binary")


def _shared_bands(classes: DataFrame) -> DataFrame:
    """``(key, band, rep)`` of the bands that two classes or more share."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([S.bands(np.frombuffer(x, np.uint8)) for x in batch.column(1).to_pylist()])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.tile(np.arange(S.BANDS, dtype=np.int32), n)), pa.array(np.repeat(batch.column(0).to_numpy(), S.BANDS))], ["key", "band", "rep"]
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far waits for its successor
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([last, part]) if last is not None else part
            if part.num_rows == 0:
                continue
            key = part.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[emitted if last is not None else False], same]) | np.concatenate([same, [False]])
            if last is not None:
                keep[0] &= not emitted
            yield from part.slice(0, part.num_rows - 1).filter(pa.array(keep[:-1])).to_batches()
            emitted = False
            last = part.slice(part.num_rows - 1).combine_chunks()
            if keep[-1]:
                yield from last.to_batches()
                emitted = True
        # a single row left over shares its key with nothing unless it has been given out already

    keyed = classes.select("rep", "registers").mapInArrow(spread, "key long, band int, rep long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(shared, keyed.schema)


def compare_group(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, held: np.ndarray, block: np.ndarray, across: bool, band: int, least: float, offers: int | None, linked=None) -> tuple[list[tuple[int, int]], bool]:
    """Likely pairs of one band between components, at most ``offers`` of the best by each class, and whether some were held back.

    ``across``: only pairs of different blocks. Without a limit ``linked(i, j)`` verifies in place and only links come
    back, none inside what earlier ones have joined.
    """
    keys = np.stack([S.bands(x) for x in held])
    found: list[tuple[float, int, int]] = []
    for i in range(len(rep) - 1):
        rest = np.arange(i + 1, len(rep))
        ok = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= 100 * (least + SLACK) * np.maximum(n[rest], n[i]) - 1e-6)
        if across:
            ok &= block[rest] != block[i]
        rest = rest[ok]
        rest = rest[(keys[rest] == keys[i]).argmax(1) == band] if len(rest) else rest
        rest = rest[(held[rest] == held[i]).mean(1) >= least - 0.1] if len(rest) else rest
        if len(rest):
            likely = S.jaccard_likelihood(np.repeat(held[i : i + 1], len(rest), 0), held[rest], np.full(len(rest), float(n[i])), n[rest].astype(float))
            found += [(e, i, j) for e, j in zip(likely.tolist(), rest.tolist(), strict=True) if e >= least]
    if offers is None:
        parent = {int(c): int(c) for c in comp}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for _, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y and linked(i, j):
                parent[max(x, y)] = min(x, y)
                links.append((int(rep[i]), int(rep[j])))
        return links, False
    _, which, size = np.unique(comp, return_inverse=True, return_counts=True)
    size = size[which]  # the class of the smaller component offers: members of a large one wait to be found
    given, out, more = np.zeros(len(rep), int), [], False
    for _, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        own = i if size[i] <= size[j] else j
        if given[own] < offers:
            given[own] += 1
            out.append((int(rep[i]), int(rep[j])))
        else:
            more = True
    return out, more


def _candidates(members: DataFrame, least: float, offers: int | None, percent: int, k: int) -> DataFrame:
    """``(a, b, key, more)``: likely pairs of each band group; a row without a pair says that the band has more.

    Without a limit ``members`` carry their packed texts and the pairs are verified links.
    """
    schema = "a long, b long, key long, more boolean"
    names = ["key", "first", "second", "own", "band", "rep", "comp", "n", "registers", *(["packed"] if offers is None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_over = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([held_over, part]) if held_over is not None else part
            if part.num_rows == 0:
                continue
            edges = group_starts(part)
            if len(edges) > 1:
                yield groups(part.slice(0, edges[-1]), edges[:-1])
            held_over = part.slice(edges[-1]).combine_chunks()
        if held_over is not None and held_over.num_rows:
            yield groups(held_over, [0])

    def group_starts(part: pa.Table) -> list[int]:
        group = np.stack([part.column(c).to_numpy() for c in ("key", "first", "second")], 1)
        return [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist()]

    def groups(part: pa.Table, starts: list[int]) -> pa.RecordBatch:
        key, first, second, own, band, rep, comp, n = (part.column(c).to_numpy() for c in names[:8])
        packed = part.column("packed").to_pylist() if offers is None else None
        held = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint8).reshape(part.num_rows, -1)
        rows: list[tuple] = []
        for a, b in zip(starts, [*starts[1:], part.num_rows]):
            if b - a > 1:
                made: dict[int, np.ndarray] = {}

                def linked(i: int, j: int, a=a, made=made) -> bool:
                    for x in (i, j):
                        if x not in made:
                            made[x] = unpacked([packed[a + x]], k)[0]
                    return similar(made[i], made[j], percent)

                pairs, more = compare_group(rep[a:b], comp[a:b], n[a:b], held[a:b], own[a:b], first[a] != second[a], int(band[a]), least, offers, linked)
                rows += [(x, y, int(key[a]), False) for x, y in pairs]
                if more:
                    rows.append((None, None, int(key[a]), True))
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "key", "more"])

    dealt = members.select(*names).repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "rep")
    return dealt.mapInArrow(run, schema)


def similar(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(first, second, assume_unique=True))
    return 100 * common >= percent * (len(first) + len(second) - common)


def unpacked(packed: list[bytes], k: int) -> list[np.ndarray]:
    """The whole sets of packed texts."""
    plain = zstandard.ZstdDecompressor().decompress
    return S.shingle_sets([plain(x) for x in packed], k)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """``(u, v)`` of the pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = (unpacked(batch.column(i).to_pylist(), k) for i in (2, 3))
            mask = pa.array([similar(a, b, percent) for a, b in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    both = pairs.join(texts.alias("x"), F.col("a") == F.col("x.rep")).join(texts.alias("y"), F.col("b") == F.col("y.rep"))
    return both.select("a", "b", F.col("x.packed").alias("x"), F.col("y.packed").alias("y")).mapInArrow(run, "u long, v long")


def _asked_texts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``(rep, packed)``: compressed texts of the asked documents, once for each text of an id. All are compressed before
    the join, where those of large tables move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x) for x in text_bytes(batch.column(1))], pa.binary())], ["rep", "packed"])

    own = rows.select("doc_id", "text").mapInArrow(run, "rep long, packed binary").join(asked, "rep")
    return own.groupBy("rep", F.xxhash64("packed")).agg(F.first("packed").alias("packed")).select("rep", "packed")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, offers: tuple = OFFERS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``df``.

    Documents are linked when their sets of ``k``-word shingles have ``100 * intersection >= percent * union``; equal
    sets are linked, documents without words with nothing. ``component_id`` is the smallest id reachable,
    ``kept`` marks the rows of that id. Texts of a repeated id are one document with several texts. Null ids
    are one document, the smallest: its component is null. An empty table gives no rows.
    """
    least = percent / 100 - SLACK
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    listed = stage(sketches(rows, k), "sketches")
    classes = stage(listed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("registers").alias("registers")), "classes")
    buckets = stage(_shared_bands(classes), "bands").withColumn("comp", F.col("rep"))
    texts = stage(_asked_texts(rows, buckets.select("rep").distinct()), "texts")  # no other class is ever compared
    found = None
    for limit in offers:
        size = buckets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        members = (
            buckets.join(size.filter("low != high").select("key", "blocks"), "key")
            .join(classes.select("rep", "n", "registers"), "rep")
            .withColumn("own", F.pmod(F.xxhash64("rep", "key"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("first", F.least("own", "other"))
            .withColumn("second", F.greatest("own", "other"))
        )
        if limit is None:
            members = members.join(texts, "rep")
        offered = stage(_candidates(members, least, limit, percent, k), "candidates")
        pairs = offered.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if limit is None:
            links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        else:
            links = stage(_verified(pairs, texts, percent, k), "links")
        # What earlier rounds joined goes on as one edge per node.
        found = components(links if found is None else links.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        more = offered.filter("more").select("key").distinct()
        if limit is None or more.isEmpty():
            break
        joined = buckets.drop("comp").join(more, "key", "left_semi").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        buckets = stage(joined.withColumn("comp", F.coalesce("root", "rep")).drop("root"), "bands")
    drop_staged(texts)
    return _labelled(listed, classes, found)


def _labelled(listed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    roots = stage(classes.join(found, classes["rep"] == found["node"], "left").select("digest", F.coalesce("root", "rep").alias("root")), "roots")
    rows = listed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    component = F.coalesce("root", "doc_id")
    out = rows.join(roots, "digest", "left")
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != NO_ID, component).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w) x
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
