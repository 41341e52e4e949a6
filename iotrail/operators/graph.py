"""Per-request directed graphs as two tables: nodes and edges.

Nodes: ``key.., node_id, kind, start_ns, end_ns, ...``; edges: ``key.., edge_id,
from_id, to_id, confidence, ...``.  ``key`` names one request.  Paths are followed
level by level with one row per node: upward from the request for origins, and from
the sinks up along topological ranks for times and longest paths.  Every table is
keyed by (key, node), so a request of any size is spread over the tasks; a level is
staged and the loop ends with the deepest path.  Only :func:`closure` lists pairs.

A written table per level costs the same for ten requests as for a million, so ranks,
times, longest paths, pairs and refused edges of the usual small requests (:data:`IN_TASK`) are
found inside the tasks that hold them; only wider ones go level by level.  Tables dealt by
key (``stage_dealt``) are read so without a shuffle, and what is written here is dealt so.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from iotrail.functions.confidence import rank
from iotrail.operators.intervals import merge_small
from iotrail.session import release, stage, stage_dealt, union_dealt

KEY = ["session_id", "seq"]

# Node kinds in their order; context kinds add no time.
NODE_KINDS = [
    "file_operation",
    "syscall",
    "vfs",
    "filesystem",
    "page_cache",
    "writeback",
    "bio",
    "block_queue",
    "block_request",
    "scsi_command",
    "ufs_command",
    "scheduler_context",
    "uic_context",
]


# A request with at most this many nodes and edges is walked inside one task.
IN_TASK = 512

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def end_or_start() -> Column:
    return F.coalesce("end_ns", "start_ns")


def additive() -> Column:
    return F.col("kind") != "uic_context"


def valid_nodes(nodes: DataFrame, key: Sequence[str] = KEY, order: str = "ord") -> DataFrame:
    """First node per id, none that ends before it starts."""
    w = Window.partitionBy(*key, "node_id").orderBy(order)
    kept = nodes.filter(end_or_start() >= F.col("start_ns"))
    return kept.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def valid_edges(edges: DataFrame, nodes: DataFrame, key: Sequence[str] = KEY, order: str = "ord") -> DataFrame:
    """First edge per id with both ends present, not backward in time, not a loop."""
    key = list(key)
    ends = nodes.select(*key, "node_id", "start_ns", end_or_start().alias("stop_ns"))
    source = ends.select(*key, F.col("node_id").alias("from_id"), F.col("start_ns").alias("__from_start"))
    target = ends.select(*key, F.col("node_id").alias("to_id"), F.col("stop_ns").alias("__to_end"))
    linked = (
        edges.filter(F.col("from_id") != F.col("to_id"))
        .join(source, [*key, "from_id"])
        .join(target, [*key, "to_id"])
        .filter(F.col("__from_start") <= F.col("__to_end"))
        .drop("__from_start", "__to_end")
    )
    w = Window.partitionBy(*key, "edge_id").orderBy(order)
    return linked.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def _cyclic_cores(edges: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """What is left when nodes without an edge in or out are dropped over and over; None when nothing is.

    An edge that goes this way lies on no cycle.  Each round reads the edges left.
    """
    key, current = list(key), edges
    before = -1
    while True:
        into = current.select(*key, F.col("to_id").alias("from_id")).distinct()
        out = current.select(*key, F.col("from_id").alias("to_id")).distinct()
        left = stage(current.join(into, [*key, "from_id"], "left_semi").join(out, [*key, "to_id"], "left_semi"), "edges-core")
        if current is not edges:
            release(current)
        current, n = left, left.count()
        if n == 0:
            release(current)
            return None
        if n == before:
            return current
        before = n


def without_cycles(edges: DataFrame, key: Sequence[str] = KEY, order: str = "ord") -> DataFrame:
    """Drop, in admission order, each edge that would close a cycle with the edges admitted before it.

    ``order`` must be unique among edges that can close a cycle.  Small graphs are
    walked in their tasks, wide ones trimmed and bisected (:func:`_refused_by_core`).
    """
    key = list(key)
    rows = edges.select(*key, F.col(order).cast("long").alias("__at"), "edge_id", "from_id", "to_id")
    refused = _by_size([rows], key, _walk_refused, "edge_id long, __at long", lambda rows: _refused_by_core(rows, key))
    refused = stage(refused, "edges-refused")
    return edges.join(refused.withColumnRenamed("__at", order), [*key, "edge_id", order], "left_anti")


def _refused_by_core(edges: DataFrame, key: list[str], order: str = "__at") -> DataFrame:
    """Keys, ids and order of the edges that :func:`without_cycles` drops.

    Trimming leaves the cyclic cores; everything outside them is admitted.  In a core
    the first edge that closes a cycle is the last one of the shortest prefix of the
    order that does not trim away, so every core bisects its own order (by the median
    of the edges still in question), drops that edge, and is trimmed again.  Cores
    advance side by side; rounds grow with the refused edges of one core and the
    logarithm of its size.
    """
    core = _cyclic_cores(edges, key)
    refused = None
    while core is not None:
        held = core.groupBy(*key).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
        bounds = stage(held, "core-bounds")
        while True:
            open_ = core.join(bounds, key).filter(F.col(order).between(F.col("lo"), F.col("hi") - 1))
            middle = stage(open_.groupBy(*key).agg(F.percentile_approx(order, 0.5, 1000).cast("long").alias("mid")), "core-middle")
            if middle.isEmpty():
                break
            prefix = core.join(middle, key).filter(F.col(order) <= F.col("mid")).drop("mid")
            cyclic = _cyclic_cores(prefix, key)
            found = middle.select(*key).limit(0) if cyclic is None else cyclic.select(*key).distinct()
            told = bounds.join(middle, key, "left").join(found.withColumn("cyclic", F.lit(True)), key, "left")
            lo = F.when(F.col("mid").isNotNull() & F.col("cyclic").isNull(), F.col("mid") + 1).otherwise(F.col("lo"))
            hi = F.when(F.col("cyclic"), F.col("mid")).otherwise(F.col("hi"))
            after = stage(told.select(*key, lo.alias("lo"), hi.alias("hi")), "core-bounds")
            release(bounds)
            bounds = after
        closing = core.join(bounds.select(*key, F.col("hi").alias(order)), [*key, order], "left_semi").select(*key, "edge_id", order)
        closing = stage(closing, "edges-refused")
        refused = closing if refused is None else refused.unionByName(closing)
        core = _cyclic_cores(core.join(closing, [*key, "edge_id", order], "left_anti"), key)
    return edges.limit(0).select(*key, "edge_id", order) if refused is None else refused.select(*key, "edge_id", order)


def causal(edges: DataFrame) -> DataFrame:
    """Edges that carry time; context only names what happened beside."""
    return edges.filter(F.col("confidence") != "context_only")


def _wide(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame | None:
    """Keys with more than :data:`IN_TASK` rows in one of the tables; None when there are none."""
    found = None
    for t in tables:
        some = t.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > IN_TASK).select(*key)
        found = some if found is None else found.unionByName(some)
    wide = stage(found.distinct(), "wide-graphs")
    if not wide.isEmpty():
        return wide
    release(wide)
    return None


def _per_graph(parts: Sequence[DataFrame], key: Sequence[str], walk: Callable[..., list[tuple]], result: str) -> DataFrame:
    """``walk`` called once per key with one list of row tuples per part; ``result`` names what it adds to the key.

    Rows stream through the partitions of a window by key; a task holds one small graph at a time.
    """
    key = list(key)
    n = len(key)
    places, rows, at = [], [], n + 1
    for i, part in enumerate(parts):
        names = [c for c in part.columns if c not in key]
        rows.append(part.select(*key, F.lit(i).alias("__part"), *[F.col(c).alias(f"__{i}_{c}") for c in names]))
        places.append((at, at + len(names)))
        at += len(names)
    added = StructType.fromDDL(result)
    schema = StructType([parts[0].schema[k] for k in key] + added.fields)
    types = [_ARROW[f.dataType.simpleString()] for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out, known = None, [], [], []

        def table() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), [*known, *types])]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            known = [batch.schema.field(i).type for i in range(n)]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:n] != current:
                    if current is not None:
                        out += [(*current, *r) for r in walk(*held)]
                        if len(out) >= 20_000:
                            yield table()
                            out = []
                    current, held = row[:n], [[] for _ in places]
                lo, hi = places[row[n]]
                held[row[n]].append(row[lo:hi])
        if current is not None:
            out += [(*current, *r) for r in walk(*held)]
        if out:
            yield table()

    # The window brings the rows of a key together, one after another, and shuffles only tables that are not dealt so.
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__part"))
    return union_dealt(rows, key).withColumn("__number", number).mapInArrow(run, schema)


def _by_size(
    parts: Sequence[DataFrame], key: Sequence[str], walk: Callable[..., list[tuple]], result: str, by_level: Callable[..., DataFrame]
) -> DataFrame:
    """Small graphs through ``walk`` in their tasks, wide ones through ``by_level(*parts)``."""
    wide = _wide(parts, key)
    if wide is None:
        return _per_graph(parts, key, walk, result)
    small = [t.join(wide, list(key), "left_anti") for t in parts]
    return _per_graph(small, key, walk, result).unionByName(by_level(*[t.join(wide, list(key), "left_semi") for t in parts]))


def _walk_ranks(edges: list[tuple]) -> list[tuple]:
    above, left = defaultdict(list), defaultdict(int)
    for a, b in edges:
        above[b].append(a)
        left[a] += 1
    ready = [b for b in above if b not in left]
    rank = dict.fromkeys(ready, 0)
    for b in ready:
        for a in above[b]:
            rank[a] = max(rank.get(a, 0), rank[b] + 1)
            left[a] -= 1
            if left[a] == 0:
                ready.append(a)
    if any(left.values()):
        raise ValueError("a request graph has a cycle")
    return [(a, b, rank[a], rank[b]) for a, b in edges]


def _walk_exclusive(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    spans, covers = defaultdict(list), {}
    for node, kind, start, stop in nodes:
        if kind is not None and kind != "uic_context" and start is not None and stop is not None and stop >= start:
            spans[node].append((start, stop))
    for a, out in groupby(sorted(edges, key=lambda e: (e[2], e[0])), key=lambda e: e[0]):
        merged: list[list] = []
        for start, stop in sorted(x for e in out for x in (*spans.get(e[1], ()), *covers.get(e[1], ()))):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        covers[a] = [tuple(x) for x in merged]
    rows = []
    for node, kind, start, stop in nodes:
        own = 0
        if kind is not None and kind != "uic_context" and start is not None and stop is not None:
            own = max(stop - start - sum(max(min(stop, e) - max(start, s), 0) for s, e in covers.get(node, ())), 0)
        rows.append((node, kind, own))
    return rows


def _walk_critical(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    weight, best = dict(nodes), {}
    for a, out in groupby(sorted(edges, key=lambda e: (e[2], e[0])), key=lambda e: e[0]):
        ways = []
        for _, b, _, to_rank in out:
            end = best.get(b) if to_rank else (-weight[b], -1, ((b, weight[b]),)) if b in weight else None
            if end is not None and a in weight:
                ways.append((end[0] - weight[a], end[1] - 1, ((a, weight[a]), *end[2])))
        if ways:
            best[a] = min(ways)
    every = [(-w, -1, ((n, w),)) for n, w in nodes] + [*best.values()]
    if not every:
        return []
    cost, _, path = min(every)
    lead = next((i for i, (_, w) in enumerate(path) if w > 0), len(path))
    return [(-cost, [n for n, _ in path[max(lead - 1, 0) :]])]


def _walk_refused(edges: list[tuple]) -> list[tuple]:
    edges = sorted((e for e in edges if None not in e), key=lambda e: e[0])
    after, into = defaultdict(list), defaultdict(int)
    for _, _, a, b in edges:
        after[a].append(b)
        into[b] += 1
    free = [a for a in after if not into.get(a)]
    for a in free:  # without a cycle this reaches every node
        for b in after.get(a, ()):
            into[b] -= 1
            if into[b] == 0:
                free.append(b)
    if not any(into.values()):
        return []
    after, refused = defaultdict(list), []
    for at, edge, a, b in edges:
        seen, todo = {b}, [b]
        while todo and a not in seen:
            more = [x for x in after.get(todo.pop(), ()) if x not in seen]
            seen.update(more)
            todo += more
        if a in seen:
            refused.append((edge, at))
        else:
            after[a].append(b)
    return refused


def _walk_closure(edges: list[tuple]) -> list[tuple]:
    after = defaultdict(list)
    for a, b, s in edges:
        after[a].append((b, s))
    strengths = sorted({s for *_, s in edges}, reverse=True)
    rows = []
    for a in after:
        found: dict = {}
        for least in strengths:
            todo, seen = [a, *found], set()
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                for b, s in after.get(x, ()):
                    if s >= least:
                        found.setdefault(b, least)
                        todo.append(b)
        rows += [(a, b, s) for b, s in found.items()]
    return rows


def _walk_closure_kinds(edges: list[tuple], kinds: list[tuple]) -> list[tuple]:
    of = defaultdict(list)
    for node, kind in kinds:
        of[node].append(kind)
    found = Counter((x, y, s) for a, b, s in _walk_closure(edges) for x in of.get(a, ()) for y in of.get(b, ()))
    return [(*k, n) for k, n in found.items()]


def ranked_edges(edges: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Causal edges once per node pair, with the length of the longest path below each end (``rank``, ``to_rank``)."""
    key = list(key)
    steps = stage_dealt(causal(edges).select(*key, "from_id", "to_id").distinct(), "steps", key, placed=True)
    return _by_size([steps], key, _walk_ranks, "from_id long, to_id long, rank int, to_rank int", lambda steps: _ranked_by_level(steps, key))


def _ranked_by_level(steps: DataFrame, key: list[str]) -> DataFrame:
    steps = stage(steps, "steps")
    level, levels = 0, []
    frontier = steps.select(*key, F.col("to_id").alias("node_id")).distinct()
    while True:
        level += 1
        on = steps.join(frontier.select(*key, F.col("node_id").alias("to_id")), [*key, "to_id"], "left_semi")
        frontier = stage(on.select(*key, F.col("from_id").alias("node_id")).distinct(), "frontier")
        if frontier.isEmpty():
            release(frontier)
            break
        levels.append(frontier.withColumn("rank", F.lit(level)))
    if not levels:
        return steps.withColumns({"rank": F.lit(1), "to_rank": F.lit(0)})
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionByName(x)
    ranks = ranks.groupBy(*key, "node_id").agg(F.max("rank").alias("rank"))
    out = steps.join(ranks.withColumnRenamed("node_id", "from_id"), [*key, "from_id"])
    to = ranks.withColumnsRenamed({"node_id": "to_id", "rank": "to_rank"})
    out = stage(out.join(to, [*key, "to_id"], "left").fillna(0, ["to_rank"]), "ranked-edges")
    for x in levels:
        release(x)
    return out


def strongest_up(edges: DataFrame, roots: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(key, node_id, strength)`` of every node above ``roots`` (``key, node_id``), roots with full strength.

    A path is as strong as its weakest edge; a node keeps its strongest path.  Each round carries on only the nodes
    whose strength grew.
    """
    key = list(key)
    steps = edges.groupBy(*key, "from_id", "to_id").agg(F.max(rank("confidence")).alias("edge"))
    steps = stage_dealt(steps, "steps", key, placed=True)
    frontier = roots.select(*key, "node_id", F.lit(3).alias("strength"))
    parts = [frontier]
    while True:
        above = steps.join(frontier.withColumnRenamed("node_id", "to_id"), [*key, "to_id"])
        above = above.groupBy(*key, F.col("from_id").alias("node_id")).agg(F.max(F.least("edge", "strength")).alias("strength"))
        best = union_dealt(parts, key).groupBy(*key, "node_id").agg(F.max("strength").alias("was"))
        grown = above.join(best, [*key, "node_id"], "left").filter("was IS NULL OR strength > was").drop("was")
        frontier = stage_dealt(grown, "frontier", key, placed=True)
        if frontier.isEmpty():
            return best.withColumnRenamed("was", "strength")
        parts.append(frontier)


def closure(edges: DataFrame, key: Sequence[str] = KEY, kinds: DataFrame | None = None) -> DataFrame:
    """All (from, to) pairs with the best over paths of the weakest edge on the path.

    With ``kinds`` (``key, node_id, kind``) the pairs of a request are counted by the kinds of their ends and their
    strength where they are found (``from_kind, to_kind, strength, n``): pairs grow with the square of a request's nodes.
    """
    key = list(key)
    pairs = edges.groupBy(*key, "from_id", "to_id").agg(F.max(rank("confidence")).alias("strength"))
    pairs = stage_dealt(pairs, "closure", key, placed=True)
    if kinds is None:
        if not pairs.filter("strength IS NULL").isEmpty():
            return _closure_by_doubling(pairs, key)
        return _by_size([pairs], key, _walk_closure, "from_id long, to_id long, strength int", lambda pairs: _closure_by_doubling(stage(pairs, "closure"), key))

    def counted(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
        found = _closure_by_doubling(stage(pairs, "closure"), key)
        for end, kind in (("from_id", "from_kind"), ("to_id", "to_kind")):
            found = found.join(kinds.withColumnsRenamed({"node_id": end, "kind": kind}), [*key, end])
        return found.groupBy(*key, "from_kind", "to_kind", "strength").agg(F.count(F.lit(1)).alias("n"))

    kinds = kinds.select(*key, "node_id", "kind")
    if not pairs.filter("strength IS NULL").isEmpty():
        return counted(pairs, kinds)
    return _by_size([pairs, kinds], key, _walk_closure_kinds, "from_kind string, to_kind string, strength int, n long", counted)


def _closure_by_doubling(pairs: DataFrame, key: list[str]) -> DataFrame:
    seen = pairs.agg(F.count(F.lit(1)), F.sum("strength")).first()
    while True:
        left = pairs.select(*key, "from_id", F.col("to_id").alias("__mid"), F.col("strength").alias("__a"))
        right = pairs.select(*key, F.col("from_id").alias("__mid"), "to_id", F.col("strength").alias("__b"))
        longer = left.join(right, [*key, "__mid"]).select(
            *key, "from_id", "to_id", F.least("__a", "__b").alias("strength")
        )
        before = pairs
        pairs = stage(
            pairs.unionByName(longer).groupBy(*key, "from_id", "to_id").agg(F.max("strength").alias("strength")), "closure"
        )
        release(before)
        now = pairs.agg(F.count(F.lit(1)), F.sum("strength")).first()
        if now == seen:
            return pairs
        seen = now


def exclusive_time(nodes: DataFrame, ranked: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Node duration minus the union of all causal descendants clipped to the node.

    Context-only paths neither add nor discount time.  A node's cover is the union of
    its children and their covers, made once per node in the order of ``ranked``
    (:func:`ranked_edges`).
    """
    key = list(key)
    timed = nodes.select(*key, "node_id", "kind", "start_ns", end_or_start().alias("stop_ns"))
    steps = ranked.select(*key, "from_id", "to_id", "rank", "to_rank")
    return _by_size(
        [timed, steps], key, _walk_exclusive, "node_id long, kind string, exclusive_ns long", lambda timed, steps: _exclusive_by_level(timed, steps, key)
    )


def _exclusive_by_level(timed: DataFrame, ranked: DataFrame, key: list[str]) -> DataFrame:
    child = timed.filter(additive()).select(*key, F.col("node_id").alias("to_id"), "start_ns", F.col("stop_ns").alias("end_ns"))
    spans = stage(ranked.join(child, [*key, "to_id"], "left"), "child-spans")
    deepest = spans.agg(F.max("rank")).first()[0] or 0
    covers: DataFrame | None = None
    for level in range(1, deepest + 1):
        here = spans.filter(F.col("rank") == level)
        pieces = here.filter("start_ns IS NOT NULL").select(*key, F.col("from_id").alias("node_id"), "start_ns", "end_ns")
        if covers is not None:
            inner = here.filter("to_rank > 0").select(*key, "from_id", "to_id")
            below = inner.join(covers.withColumnRenamed("node_id", "to_id"), [*key, "to_id"])
            pieces = pieces.unionByName(below.select(*key, F.col("from_id").alias("node_id"), "start_ns", "end_ns"))
        merged = stage(merge_small(pieces, [*key, "node_id"]).select(*key, "node_id", "start_ns", "end_ns"), "covers")
        covers = merged if covers is None else covers.unionByName(merged)
    own = F.col("stop_ns") - F.col("start_ns")
    if covers is not None:
        part = F.least("stop_ns", "c_end") - F.greatest("start_ns", "c_start")
        inside = timed.join(covers.withColumnsRenamed({"start_ns": "c_start", "end_ns": "c_end"}), [*key, "node_id"])
        covered = inside.groupBy(*key, "node_id").agg(F.sum(F.greatest(part, F.lit(0))).alias("covered_ns"))
        timed = timed.join(covered, [*key, "node_id"], "left")
        own = own - F.coalesce("covered_ns", F.lit(0))
    own = F.when(additive(), F.greatest(own, F.lit(0)))
    return timed.select(*key, "node_id", "kind", F.coalesce(own, F.lit(0)).cast("long").alias("exclusive_ns"))


def critical_path(ranked: DataFrame, exclusive: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Heaviest causal path by exclusive time; ties take the longer, then the smaller path.

    The best path from a node on is its own weight and the best of its children, one
    row per node in the order of ``ranked`` (:func:`ranked_edges`).  Leading nodes of
    no weight are dropped, except the one right before the first weight.
    """
    key = list(key)
    weight = stage_dealt(exclusive.select(*key, "node_id", F.col("exclusive_ns").alias("w")), "weights", key, placed=True)
    steps = ranked.select(*key, "from_id", "to_id", "rank", "to_rank")
    return _by_size(
        [weight, steps], key, _walk_critical, "critical_path_ns long, critical_path array<long>", lambda weight, steps: _critical_by_level(weight, steps, key)
    )


def _critical_by_level(weight: DataFrame, ranked: DataFrame, key: list[str]) -> DataFrame:
    weight = stage(weight, "weights")
    wf = weight.select(*key, F.col("node_id").alias("from_id"), F.col("w").alias("wf"))
    wt = weight.select(*key, F.col("node_id").alias("to_id"), F.col("w").alias("wt"))
    steps = stage(ranked.join(wf, [*key, "from_id"]).join(wt, [*key, "to_id"]), "weighted-steps")
    deepest = steps.agg(F.max("rank")).first()[0] or 0

    def at(node: str, w: str) -> Column:
        return F.struct(F.col(node).alias("node"), F.col(w).alias("w"))

    single = weight.select(*key, "node_id", F.struct((-F.col("w")).alias("cost"), F.lit(-1).alias("hops"), F.array(at("node_id", "w")).alias("path")).alias("b"))
    paths: DataFrame | None = None
    for level in range(1, deepest + 1):
        here = steps.filter(F.col("rank") == level)
        end = F.struct((-F.col("wt")).alias("cost"), F.lit(-1).alias("hops"), F.array(at("to_id", "wt")).alias("path"))
        onward = here.filter("to_rank = 0").withColumn("b", end)
        if paths is not None:
            onward = onward.unionByName(here.filter("to_rank > 0").join(paths.withColumnRenamed("node_id", "to_id"), [*key, "to_id"]))
        longer = F.struct(
            (F.col("b.cost") - F.col("wf")).alias("cost"), (F.col("b.hops") - 1).alias("hops"), F.concat(F.array(at("from_id", "wf")), F.col("b.path")).alias("path")
        )
        best = stage(onward.groupBy(*key, F.col("from_id").alias("node_id")).agg(F.min(longer).alias("b")), "paths")
        paths = best if paths is None else paths.unionByName(best)
    every = single if paths is None else single.unionByName(paths)
    top = every.groupBy(*key).agg(F.min("b").alias("b"))
    path = F.col("b.path")
    lead = F.aggregate(
        path,
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")),
        lambda acc, x: F.struct(
            (acc["n"] + F.when(acc["done"] | (x["w"] > 0), 0).otherwise(1)).alias("n"),
            (acc["done"] | (x["w"] > 0)).alias("done"),
        ),
    )["n"]
    skip = F.greatest(lead - 1, F.lit(0))
    return top.select(
        *key,
        (-F.col("b.cost")).alias("critical_path_ns"),
        F.transform(F.slice(path, skip + 1, F.size(path)), lambda x: x["node"]).alias("critical_path"),
    )


def request_metrics(nodes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Total, accounted (union of additive nodes) and unaccounted time per request."""
    key = list(key)
    span = nodes.groupBy(*key).agg(F.min("start_ns").alias("first_ns"), F.max(end_or_start()).alias("last_ns"))
    parts = nodes.filter(additive()).select(*key, "start_ns", end_or_start().alias("end_ns"))
    covered = merge_small(parts, key).groupBy(*key).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("covered"))
    total = F.col("last_ns") - F.col("first_ns")
    accounted = F.least(F.coalesce("covered", F.lit(0)), total)
    return span.join(covered, key, "left").select(
        *key,
        F.col("first_ns").alias("start_ns"),
        F.col("last_ns").alias("end_ns"),
        total.alias("total_ns"),
        accounted.alias("accounted_ns"),
        (total - accounted).alias("unaccounted_ns"),
    )


def uncovered(nodes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Intervals of a request that no additive node covers."""
    key = list(key)
    span = nodes.groupBy(*key).agg(F.min("start_ns").alias("lo"), F.max(end_or_start()).alias("hi"))
    parts = nodes.filter(additive()).select(*key, "start_ns", end_or_start().alias("end_ns"))
    merged = merge_small(parts, key, keep_empty=False)
    marks = union_dealt([merged.select(*key, "start_ns", "end_ns"), span.select(*key, F.col("hi").alias("start_ns"), F.col("hi").alias("end_ns"))], key)
    w = Window.partitionBy(*key).orderBy("start_ns", "end_ns")
    cursor = F.lag("end_ns").over(w)
    return (
        marks.withColumn("from_ns", cursor)
        .join(span.select(*key, "lo"), key)
        .select(*key, F.coalesce("from_ns", "lo").alias("start_ns"), F.col("start_ns").alias("end_ns"), F.lit("unknown").alias("reason"))
        .filter("end_ns > start_ns")
    )


def kind_durations(nodes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Union duration per request and node kind."""
    key = list(key)
    parts = nodes.filter(additive()).select(*key, "kind", "start_ns", end_or_start().alias("end_ns"))
    return merge_small(parts, [*key, "kind"]).groupBy(*key, "kind").agg(
        F.sum(F.col("end_ns") - F.col("start_ns")).alias("duration_ns")
    )
