"""The manifest against a literal tree, and tampering against its roots."""

import hashlib
import zlib

from pyspark.sql import functions as F

from iotrail.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def climb(level: list[str], at: int, folded: str, proof: list[str]) -> tuple[str, str]:
    """``(top, folded top)`` of the tree over ``level``; the siblings of the place ``at`` go to ``proof``."""
    while len(level) > 1:
        start = at // 16 * 16
        run = level[start : start + 16]
        proof += run[: at - start] + run[at - start + 1 :]
        folded = h(*run[: at - start], folded, *run[at - start + 1 :])
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
        at //= 16
    return level[0], folded


def expected(rows) -> list[tuple]:
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [[x[2] for x in sorted(by_source[s], key=lambda x: x[:3])] for s in names]
    tops = [climb(t, 0, t[0], [])[0] for t in trees]
    out = []
    for at, s in enumerate(names):
        for i, (known, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            hit = known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            proof: list[str] = []
            top, folded = climb(trees[at], i, leaf(r, r.text and r.text.translate(lower)) if hit else own, proof)
            root, folded = climb(tops, at, folded, proof)
            out.append((r.doc_id, own, top, root, h(*proof), folded, folded == root))
    return sorted(out, key=str)


def found(docs) -> list[tuple]:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted((tuple(r) for r in merkle.manifest(docs, hit, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}).collect()), key=str)


def test_odd_rows_and_other_columns(docs, clash, nothing):
    want = expected(docs.collect())
    assert found(docs) == want
    assert found(clash.withColumns({n: F.lit("x") for n in ("tree", "leaf", "hash", "uid", "i", "kids", "level")})) == want
    assert found(nothing) == []


def test_deep_trees_many_sources_and_one(spark, docs):
    rows = spark.range(700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text of "), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("source"), F.lit(7).cast("long").alias("n_chars")
    )
    assert found(rows) == expected(rows.collect())
    one = rows.filter("source = 'hot' AND doc_id < 40")
    assert found(one) == expected(one.collect())
    lone = rows.limit(1)
    assert found(lone) == expected(lone.collect())


def test_registered_query_holds_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted((tuple(r) for r in merkle.op11_merkle(spark, "/root/testdata/sf0.001").collect()), key=str) == expected(rows.collect())
