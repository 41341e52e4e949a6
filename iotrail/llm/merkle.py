"""Merkle manifest of a dataset: hash trees of sixteen children, one a source and one over the sources, and audit proofs.

Leaves get their exact rank in their source from one range exchange (by source, id and leaf, so a hot source or id is cut
anywhere) and the counts per partition. Levels are built by grouping sixteen consecutive nodes and kept as node rows: the
hashes of the children, and a link to the parent row and the place there. A recursive query then climbs from every leaf to
the root, appends the siblings and folds the changed hash. The leaves of one run share every sibling above their run, so
they climb as one row of at most sixteen hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.llm.common import drop_staged, stage, table

#: Fixed values of the contract.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The name of the tree over all sources; names of source trees are never empty.
TOP = ""
LINK = ("up_level", "up_tree", "up_run", "pos")


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields, each as ``-`` if null, else UTF-8 byte count, colon, value."""
    held = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x), F.lit(":"), x), F.lit("-")) for x in held]), 256)


def leaves(docs: DataFrame, tampered: Column, changed: dict[str, Column]) -> DataFrame:
    """``(tree, doc_id, leaf, fold)``: fold is the leaf recomputed with the changed fields where the row is tampered with."""
    own = {name: docs[name] for name in FIELDS}
    leaf = leaf_hash(*own.values())
    other = leaf_hash(*(own | changed).values())
    tree = F.coalesce(F.concat(F.lit("1"), own["source"].cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), own["doc_id"].alias("doc_id"), leaf.alias("leaf"), F.when(tampered, other).alias("fold"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``i``, the rank of the row in its ``tree`` by ``order`` from 0, and ``n``, the rows of the tree."""
    by = ["tree", *order]
    placed = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    spans = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n"))
    return placed.join(spans, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def runs(nodes: DataFrame, level: int, *carried: str) -> DataFrame:
    """Node rows over sixteen consecutive ``nodes`` each: ``text`` of the children's hashes, own ``hash``, ``n`` nodes of the level.

    A tree of one node has nothing to hash: its row stands for that node.
    """
    kids = F.array_sort(F.collect_list(F.struct("i", F.col("hash"), *carried)))
    row = nodes.groupBy("tree", F.expr(f"i div {FAN}").alias("run")).agg(kids.alias("kids"), F.first("n").alias("below"))
    text = F.array_join(F.col("kids.hash"), "")
    row = row.withColumn("text", text).withColumn("hash", F.when(F.col("below") == 1, F.col("text")).otherwise(F.sha2("text", 256)))
    n = F.expr(f"(below + {FAN - 1}) div {FAN}")
    return row.withColumn("n", n).withColumn("level", F.lit(level)).select("level", "tree", "run", "text", "hash", "n", "below", *(["kids"] if carried else []))


def grow(first: DataFrame, most: int) -> list[DataFrame]:
    """All levels over the runs of the first one; ``most`` is the greatest number of runs of a tree."""
    levels = [first]
    while most > 1:
        nodes = levels[-1].filter("n > 1").select("tree", F.col("run").alias("i"), "hash", "n")
        levels.append(stage(runs(nodes, len(levels) + 1), "level"))
        most = -(-most // FAN)
    return levels


def _inside(rows: DataFrame) -> DataFrame:
    """Links of nodes that have a parent in their own tree."""
    return rows.filter("n > 1").withColumns({"up_level": F.col("level") + 1, "up_tree": F.col("tree"), "up_run": F.expr(f"run div {FAN}"), "pos": F.expr(f"CAST(run % {FAN} AS INT)")})


_SIDES = f"substr(n.text, 1, 64 * c.pos), {{}}substr(n.text, 64 * c.pos + 65)"
CLIMB = f"""
WITH RECURSIVE climb (tree, run, above, folds, subroot, up_level, up_tree, up_run, pos) AS (
  SELECT tree, run, '', folds, CASE WHEN up_tree IS DISTINCT FROM tree THEN hash END, up_level, up_tree, up_run, pos FROM {{starts}}
  UNION ALL
  SELECT c.tree, c.run, concat(c.above, {_SIDES.format("")}),
    transform(c.folds, f -> sha2(concat({_SIDES.format("f, ")}), 256)),
    coalesce(c.subroot, CASE WHEN n.up_tree IS DISTINCT FROM n.tree THEN n.hash END), n.up_level, n.up_tree, n.up_run, n.pos
  FROM climb c JOIN {{nodes}} n ON n.level = c.up_level AND n.tree = c.up_tree AND n.run = c.up_run
)
SELECT tree, run, above, folds, subroot FROM climb WHERE up_run IS NULL
"""


def climbed(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per start row the hashes at the root, the siblings above the run, and the subroot; written once."""
    spark = starts.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return stage(spark.sql(CLIMB, starts=starts, nodes=nodes), "climbed")
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column]) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row a row of ``docs``.

    ``docs`` needs the columns of ``FIELDS``; others are not read. ``tampered`` marks rows whose hash is recomputed with the
    ``changed`` fields before the climb (null: not tampered with). A null or repeated id is a leaf like any other: nulls come
    first, equal ids are ordered by their leaf. An empty text is a value of no bytes, unlike null. An empty table gives no rows.
    """
    listed = stage(leaves(docs, tampered, changed).withColumn("uid", F.monotonically_increasing_id()), "leaves")
    placed = ranked(listed, "doc_id", "leaf", "uid").withColumnRenamed("leaf", "hash").drop("uid")
    first = stage(runs(placed, 1, "doc_id", "fold"), "level")
    drop_staged(listed)
    most = first.agg(F.max("n")).first()[0] or 1
    own = grow(first, most)
    tops = stage(_union([x.filter("n = 1").select("tree", "hash") for x in own]), "tops")
    over = ranked(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash"), "name")
    over = stage(over.select("tree", "name", "i", "hash", "n"), "ranked-tops")
    first_over = stage(runs(over, 1), "level")
    above = grow(first_over, first_over.agg(F.max("n")).first()[0] or 1)
    root = above[-1].filter("n = 1").select("hash").first()

    to_top = over.select(F.col("name").alias("tree"), "i", F.col("n").alias("sources"))
    none = F.lit(None)

    def crossing(rows: DataFrame) -> DataFrame:
        """Links of the tops of source trees: into the tree over the sources, if there is more than one."""
        met = rows.filter("n = 1").join(to_top, "tree")
        links = {"up_level": F.lit(1), "up_tree": F.lit(TOP), "up_run": F.expr(f"i div {FAN}"), "pos": F.expr(f"CAST(i % {FAN} AS INT)")}
        return met.withColumns({k: F.when(F.col("sources") > 1, v) for k, v in links.items()}).drop("i", "sources")

    columns = ("level", "tree", "run", "text", "hash", *LINK)
    ends = [x.filter("n = 1").withColumns({"up_level": none.cast("int"), "up_tree": none.cast("string"), "up_run": none.cast("long"), "pos": none.cast("int")}) for x in above]
    parts = [f(x) for x in own[1:] for f in (_inside, crossing)] + [_inside(x) for x in above] + ends
    nodes = stage(_union([p.select(*columns) for p in parts]), "nodes")

    start = _inside(first).unionByName(crossing(first))
    without = lambda k: F.concat(F.substring("text", F.lit(1), 64 * k), F.substring("text", 64 * k + 65, F.length("text")))
    put = lambda x, k: F.concat(F.substring("text", F.lit(1), 64 * k), F.coalesce(x["fold"], x["hash"]), F.substring("text", 64 * k + 65, F.length("text")))
    folds = F.transform("kids", lambda x, k: F.when(F.col("below") == 1, F.coalesce(x["fold"], x["hash"])).otherwise(F.sha2(put(x, k), 256)))
    ended = climbed(start.select("tree", "run", "hash", folds.alias("folds"), *LINK), nodes)

    each = first.select("tree", "run", "text", "kids").join(ended, ["tree", "run"]).select("*", F.posexplode("kids").alias("k", "kid"))
    folded = F.element_at("folds", F.col("k") + 1)
    root = F.lit(root[0] if root else None).cast("string")
    proof = F.sha2(F.concat(without(F.col("k")), F.col("above")), 256)
    return each.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.hash").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``; where 5 divides crc32 of the id, the text is tampered with by lower-casing A-Z.

    Nulls, empty texts, repeated ids and rows, and empty tables: see ``manifest``. A row without an id is not tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, hit, {"text": F.translate("text", UPPER, LOWER)})


SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, source, lang, n_chars, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS fold
  FROM given
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM hashed
), own AS (
  SELECT 0 AS level, s, i, leaf AS hash, count(*) OVER (PARTITION BY s) AS n FROM leaves
  UNION ALL
  SELECT level + 1, s, i // 16, sha256(string_agg(hash, '' ORDER BY i)), (n + 15) // 16 FROM own WHERE n > 1 GROUP BY level, s, i // 16, n
), tops AS (SELECT s, hash AS subroot FROM own WHERE n = 1
), over AS (
  SELECT 0 AS level, s AS i, subroot AS hash, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(hash, '' ORDER BY i)), (n + 15) // 16 FROM over WHERE n > 1 GROUP BY level, i // 16, n
), nodes AS (SELECT 0 AS tree, level, s, i, hash, n FROM own UNION ALL SELECT 1, level, 0, i, hash, n FROM over
), sides AS (
  SELECT a.tree, a.level, a.s, a.i, a.n, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.s = b.s AND a.i // 16 = b.i // 16 GROUP BY ALL
), climb AS (
  SELECT s, i AS start, 0 AS tree, 0 AS level, s AS at_s, i AS at_i, coalesce(fold, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.s, c.start, CASE WHEN x.n = 1 THEN 1 ELSE x.tree END, CASE WHEN x.n = 1 THEN 0 ELSE x.level + 1 END,
    CASE WHEN x.n = 1 THEN 0 ELSE x.s END, CASE WHEN x.n = 1 THEN x.s ELSE x.i // 16 END,
    CASE WHEN x.n = 1 THEN c.folded ELSE sha256(x.l || c.folded || x.r) END, CASE WHEN x.n = 1 THEN c.proof ELSE c.proof || x.l || x.r END
  FROM climb c JOIN sides x ON x.tree = c.tree AND x.level = c.level AND x.s = c.at_s AND x.i = c.at_i
  WHERE NOT (x.tree = 1 AND x.n = 1)
), ended AS (
  SELECT c.* FROM climb c JOIN over o ON c.tree = 1 AND o.level = c.level AND o.i = c.at_i WHERE o.n = 1
)
SELECT l.doc_id, l.leaf, t.subroot, o.hash AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = o.hash AS verified
FROM leaves l JOIN tops t ON t.s = l.s JOIN ended e ON e.s = l.s AND e.start = l.i JOIN over o ON o.n = 1
"""
