"""Joining stack observations, file syscalls and stored origins to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.functions.confidence import from_rank, rank
from iotrail.functions.scalars import (
    EDGE_FILE,
    EDGE_LOWER,
    EDGE_QUEUE,
    EDGE_SPAN_BASE,
    EDGE_UPPER,
    NODE_FILE,
    NODE_QUEUE,
    NODE_REQUEST,
    NODE_SPAN_BASE,
    at_least_zero,
    origin_edge_id,
    origin_node_id,
    path_deleted,
    span_tag,
    synthetic_id,
)
from iotrail.operators.graph import KEY, valid_edges, valid_nodes, without_cycles
from iotrail.operators.intervals import interval_join, merge_intervals
from iotrail.operators.ordered import BUCKET, SHIFT, carry_last, seq_bucket, with_sequence
from iotrail.session import stage, stage_dealt, union_dealt

_IDENTITY = ["fs_major", "fs_minor", "inode", "generation", "mount"]
REACH_NS = 30_000_000_000
NEAR_NS = 10_000_000
CELL_NS = 1_000_000_000

# Storage-stack layers from top to bottom, and the node kind of each.
LAYERS = {
    "syscall": "syscall",
    "vfs": "vfs",
    "filesystem": "filesystem",
    "page_cache": "page_cache",
    "writeback": "writeback",
    "bio": "bio",
    "block_queue": "block_queue",
    "block_device": "block_request",
    "scsi": "scsi_command",
    "ufs": "ufs_command",
    "scheduler_context": "scheduler_context",
    "uic_context": "uic_context",
}


def layer_rank(layer: Column) -> Column:
    out: Column = F.lit(None).cast("int")
    for i, name in enumerate(LAYERS):
        out = F.when(layer == name, i).otherwise(out)
    return out


def node_kind(layer: Column) -> Column:
    out: Column = F.lit(None).cast("string")
    for name, kind in LAYERS.items():
        out = F.when(layer == name, kind).otherwise(out)
    return out


def evidence_windows(requests: DataFrame, order: str = "seq", shift: int = SHIFT) -> DataFrame:
    """Add ``evidence_from``: evidence of a reused id counts only after the id's previous completion.

    The window runs from max(start - 30 s, previous completion + 1) to the completion.
    """
    previous = carry_last(
        requests,
        ["session_id", "request_id"],
        [order],
        {"previous_completion_ts": F.col("complete_ts")},
        bucket=seq_bucket(order, shift),
    ).drop(BUCKET)
    earliest = F.coalesce("insert_ts", "issue_ts") - REACH_NS
    return previous.withColumn(
        "evidence_from", F.greatest(earliest, F.coalesce(F.col("previous_completion_ts") + 1, earliest))
    )


def _lifetimes(requests: DataFrame) -> DataFrame:
    """The request columns the evidence joins need, under names that cannot clash."""
    return requests.select(
        "session_id",
        "seq",
        F.col("request_id").alias("r_id"),
        F.col("operation").alias("r_operation"),
        F.col("sector").alias("r_sector"),
        F.col("bytes").alias("r_bytes"),
        F.col("pid").alias("r_pid"),
        F.col("tid").alias("r_tid"),
        F.coalesce("insert_ts", "issue_ts").alias("r_start"),
        F.col("complete_ts").alias("r_end"),
        "evidence_from",
    )


def lifetime_at(rows: DataFrame, requests: DataFrame, id_col: str, ts: str, shift: int = SHIFT) -> DataFrame:
    """Rows with the lifetime columns of the request whose evidence window holds their time; others are left out.

    The windows of one id do not overlap, so a row belongs to the first of the id's
    requests that completes at or after it, if at all.  Both sides are sorted together,
    backward in time and cut into blocks of ``2**shift`` rows, and the latest lifetime
    is carried on: a reused id meets each row once, not once per lifetime.
    ``rows`` must not have columns named like lifetimes (``seq``, ``r_*``, ``evidence_from``).
    """
    req = _lifetimes(requests)
    life = [c for c in req.columns if c != "session_id"]
    keys = ["session_id", "__id"]
    ends = req.select("session_id", F.col("r_id").alias("__id"), (-F.col("r_end")).alias("__back"), F.lit(0).alias("__kind"), (-F.col("seq")).alias("__tie"), F.struct(*life).alias("__life"))
    seen = rows.filter(F.col(id_col).isNotNull()).select(
        "session_id", F.col(id_col).alias("__id"), (-F.col(ts)).alias("__back"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__tie"), F.struct(*rows.columns).alias("__row")
    )
    both = ends.unionByName(seen, allowMissingColumns=True)
    both = stage(with_sequence(both, [*keys, "__back", "__kind", "__tie"], name="__at"), "lifetimes-at")
    found = carry_last(both, keys, ["__at"], {"__held": F.col("__life")}, bucket=seq_bucket("__at", shift))
    inside = (-F.col("__back")).between(F.col("__held.evidence_from"), F.col("__held.r_end"))
    return found.filter((F.col("__kind") == 1) & inside).select("__row.*", "__held.*")


def match_observations(requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Observation-request pairs: by request id, by task, by storage address, or by time for context.

    ``requests`` carries ``evidence_from``.  An id is looked up as of the observation's
    time; two of the other ways are equi-joins, and the time conditions are cut into
    cells, so no key gathers a whole trace.
    A layer with an exact match keeps no probable one: requests know the layers of their exact
    matches before they meet the other observations, so pairs, which in a dense trace are far more
    than requests, are not moved once found.  Correlation limits bound
    the length of a request, so only observations can be long.
    """
    req = _lifetimes(requests)
    obs = observations.withColumn("o_end", F.coalesce("end_ns", "ts_ns")).filter(F.col("o_end") >= F.col("ts_ns"))
    obs = obs.withColumnRenamed("seq", "obs_seq")
    same_op = F.col("operation").isNull() | (F.col("operation") == F.col("r_operation"))
    named, free = obs.filter(F.col("correlation_id").isNotNull()), obs.filter(F.col("correlation_id").isNull())
    columns = [
        "session_id", "seq", "obs_seq", "ts_ns", "o_end", "end_ns", "phase", "layer", "operation", "sector", "bytes",
        "opcode", "status", "pid", "tid", "name", "confidence", "is_exact", "r_id",
    ]
    exact = lifetime_at(named, requests, "correlation_id", "ts_ns").filter(same_op).withColumn("is_exact", F.lit(True))
    exact = stage(exact.select(*columns), "exact-pairs")
    layers = exact.groupBy(*KEY).agg(F.collect_set(F.struct("layer")).alias("r_layers"))
    req = req.join(layers, KEY, "left")
    open_layer = ~F.exists(F.coalesce("r_layers", F.array().cast("array<struct<layer:string>>")), lambda x: x["layer"].eqNullSafe(F.col("layer")))
    causal = free.filter(F.col("confidence") != "context_only")
    context = free.filter(F.col("confidence") == "context_only")
    by_task = interval_join(
        causal.withColumn("__pid", F.col("pid")),
        req.withColumn("__pid", F.col("r_pid")),
        ["session_id", "__pid"],
        ("ts_ns", "o_end"),
        ("r_start", "r_end"),
        CELL_NS,
        right_bounded=True,
    ).filter((F.col("tid") == 0) | (F.col("tid") == F.col("r_tid")))
    by_address = interval_join(
        causal.filter(F.col("sector").isNotNull() & F.col("bytes").isNotNull())
        .withColumn("__sector", F.col("sector"))
        .withColumn("__bytes", F.col("bytes")),
        req.withColumn("__sector", F.col("r_sector")).withColumn("__bytes", F.col("r_bytes")),
        ["session_id", "__sector", "__bytes"],
        ("ts_ns", "o_end"),
        ("r_start", "r_end"),
        CELL_NS,
        right_bounded=True,
    ).filter(~((F.col("pid") == F.col("r_pid")) & ((F.col("tid") == 0) | (F.col("tid") == F.col("r_tid")))))
    around = interval_join(
        context,
        req.withColumn("near_start", F.col("r_start") - NEAR_NS).withColumn("near_end", F.col("r_end") + NEAR_NS),
        ["session_id"],
        ("ts_ns", "o_end"),
        ("near_start", "near_end"),
        CELL_NS,
        right_bounded=True,
    )
    pairs = exact
    for p in (by_task, by_address, around):
        pairs = pairs.unionByName(p.filter(same_op & open_layer).withColumn("is_exact", F.lit(False)).select(*columns))
    return pairs


def request_spans(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Spans of each request, with its id: matched observations plus its own queue and device time.

    A lower-layer pair may be exact in itself while its link to the request is only probable.
    """
    confidence = (
        F.when(F.col("is_exact") & (F.col("confidence") != "context_only"), "exact")
        .when(F.col("confidence") == "exact", "probable")
        .otherwise(F.col("confidence"))
    )
    source = F.when(F.col("phase") == "span", "measured span").when(F.col("phase") == "instant", "context marker").otherwise(
        "paired boundary"
    )
    matched = pairs.select(
        *KEY,
        F.col("obs_seq").alias("ord"),
        "layer",
        "operation",
        "bytes",
        "pid",
        "tid",
        F.col("ts_ns").alias("start_ns"),
        F.col("o_end").alias("stop_ns"),
        (F.col("end_ns").isNotNull() & (F.col("phase") != "instant")).alias("duration_observed"),
        "name",
        confidence.alias("confidence"),
        source.alias("source"),
        F.col("r_id").alias("request_id"),
    )

    def own(layer: str, start: str, stop: str, name: str, source: str) -> DataFrame:
        return requests.filter(F.col(start).isNotNull()).select(
            *KEY,
            F.lit(-1).cast("long").alias("ord"),
            F.lit(layer).alias("layer"),
            "operation",
            "bytes",
            "pid",
            "tid",
            F.col(start).alias("start_ns"),
            F.col(stop).alias("stop_ns"),
            F.lit(True).alias("duration_observed"),
            F.lit(name).alias("name"),
            F.lit("exact").alias("confidence"),
            F.lit(source).alias("source"),
            "request_id",
        )

    return matched.unionByName(own("block_queue", "insert_ts", "issue_ts", "block queue", "insert to issue")).unionByName(
        own("block_device", "issue_ts", "complete_ts", "block device", "issue to complete")
    )


def request_pipelines(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """Bounds, accounted and unaccounted time of each request's span set.

    Spans are read once, and equal times of a request move as one row with their number.
    """
    from iotrail.operators.intervals import merge_small

    start = requests.select(*KEY, F.coalesce("insert_ts", "issue_ts").alias("r_start"), F.col("complete_ts").alias("r_end"))
    timed = F.col("confidence") != "context_only"  # others are only counted
    times = spans.select(
        *KEY, timed.alias("timed"), (F.col("confidence") == "exact").alias("exact"), F.when(timed, F.col("start_ns")).alias("s"), F.when(timed, F.col("stop_ns")).alias("e")
    )
    times = times.groupBy(*KEY, "timed", "exact", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    times = stage_dealt(times, "span-times", KEY)
    bounds = times.groupBy(*KEY).agg(
        F.min(F.when(F.col("exact"), F.col("s"))).alias("lo"), F.max(F.when(F.col("exact"), F.col("e"))).alias("hi"), F.sum("n").alias("spans")
    )
    framed = start.join(bounds, KEY, "left").select(
        *KEY, F.least("lo", "r_start").alias("start_ns"), F.greatest("hi", "r_end").alias("end_ns"), "spans"
    )
    inside = (
        times.filter("timed")
        .join(framed, KEY)
        .select(*KEY, F.greatest("s", "start_ns").alias("start_ns"), F.least("e", "end_ns").alias("end_ns"))
    )
    covered = merge_small(inside, KEY).groupBy(*KEY).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("covered"))
    total = F.col("end_ns") - F.col("start_ns")
    accounted = F.least(F.coalesce("covered", F.lit(0)), total)
    return framed.join(covered, KEY, "left").select(
        *KEY, "start_ns", "end_ns", "spans", accounted.alias("accounted_ns"), (total - accounted).alias("unaccounted_ns")
    )


def recorded_path() -> Column:
    """Path a syscall row proves: its snapshot, else the path itself; empty counts as none."""
    p = F.col("path")
    return F.when(p != "", p)


def identities_compatible(left: str, right: str) -> Column:
    """Same device and inode; generation and mount equal when both are known."""

    def agree(field: str) -> Column:
        a, b = F.col(f"{left}{field}"), F.col(f"{right}{field}")
        return a.isNull() | b.isNull() | (a == b)

    same = [F.col(f"{left}{c}") == F.col(f"{right}{c}") for c in ("fs_major", "fs_minor", "inode")]
    return same[0] & same[1] & same[2] & agree("generation") & agree("mount")


def file_candidates(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Syscalls that could have caused each request: same direction, near in time, large enough, same task."""
    req = _lifetimes(requests).withColumn("near_start", F.col("r_start") - NEAR_NS).withColumn("near_end", F.col("r_end") + NEAR_NS)
    f = files.withColumnRenamed("seq", "file_seq")
    same_pid = interval_join(
        f.withColumn("__task", F.col("pid")),
        req.withColumn("__task", F.col("r_pid")),
        ["session_id", "__task"],
        ("start_ns", "end_ns"),
        ("near_start", "near_end"),
        CELL_NS,
        right_bounded=True,
    )
    same_tid = interval_join(
        f.filter(F.col("tid") != 0).withColumn("__task", F.col("tid")),
        req.withColumn("__task", F.col("r_tid")),
        ["session_id", "__task"],
        ("start_ns", "end_ns"),
        ("near_start", "near_end"),
        CELL_NS,
        right_bounded=True,
    ).filter(F.col("pid") != F.col("r_pid"))
    both = same_pid.unionByName(same_tid)
    enough = (F.col("requested_bytes") >= F.col("r_bytes")) | (F.abs("completed_bytes") >= F.col("r_bytes"))
    return both.filter((F.col("operation") == F.col("r_operation")) & enough)


def unique_file_candidate(candidates: DataFrame, exact_origins: DataFrame) -> DataFrame:
    """The only candidate of a request, when it has exactly one and no exact stored origin."""
    counted = candidates.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    only = counted.filter("__n = 1").join(exact_origins.select(*KEY).distinct(), KEY, "left_anti")
    later = (F.col("io_mode") == "buffered") & (F.col("r_start") > F.col("end_ns"))
    return (
        only.withColumn("confidence", F.when(later, "probable_async").otherwise("probable"))
        .withColumn("relation", F.when(later, "causes_async").otherwise("submits"))
        .withColumn("delta_ns", at_least_zero(F.col("r_start") - F.col("start_ns")))
        .withColumn("bytes_match", F.col("requested_bytes") == F.col("r_bytes"))
        .drop("__n")
    )


def origin_nodes(requests: DataFrame, origins: DataFrame) -> DataFrame:
    """Stored origins inside each request's evidence window, with the confidence of their link."""
    return (
        lifetime_at(origins.withColumnRenamed("seq", "origin_seq"), requests, "request_id", "ts_ns")
        .withColumn("node_id", origin_node_id("request_id", "origin_id"))
        .withColumn("edge_id", origin_edge_id("request_id", "origin_id"))
        .withColumn(
            "confidence",
            from_rank(
                F.least(
                    rank(F.coalesce("file_confidence", F.lit("exact"))), rank(F.coalesce("lifetime_confidence", F.lit("exact")))
                )
            ),
        )
        .withColumn(
            "match_type",
            F.when(F.coalesce("lifetime_confidence", F.lit("exact")) != "exact", "extent_block_overlap")
            .when(F.col("incomplete"), "direct_request_incomplete")
            .otherwise("direct_request"),
        )
    )


def inferred_paths(origins: DataFrame, files: DataFrame) -> DataFrame:
    """Path of pathless origin nodes from syscalls on the same file within 30 s.

    Syscalls that span the origin are preferred; differing paths leave it
    unresolved.  Only "was this path seen then" matters, so the syscalls of one
    (file, path) are first merged into time unions: a file touched millions of
    times meets each origin once per path, not once per syscall.
    """
    base = ["fs_major", "fs_minor", "inode"]
    bare = origins.filter(F.col("path").isNull() & F.col("inode").isNotNull()).select(
        *KEY,
        "node_id",
        F.col("ts_ns").alias("n_ts"),
        F.col("pid").alias("n_pid"),
        F.col("tid").alias("n_tid"),
        F.col("operation").alias("n_operation"),
        *[F.col(c).alias(f"n_{c}") for c in _IDENTITY],
        F.col("r_start").alias("lo"),
        F.col("r_end").alias("hi"),
        *[F.col(c).alias(f"__{c}") for c in base],
    )
    known = (
        files.withColumn("f_path", recorded_path())
        .filter(F.col("f_path").isNotNull() & F.col("inode").isNotNull())
        .fillna(-1, ["generation", "mount"])
    )

    def unions(task: list[str], reach: int) -> DataFrame:
        rows = known.select(
            "session_id",
            "f_path",
            *_IDENTITY,
            *task,
            (F.col("start_ns") - reach).alias("start_ns"),
            (F.col("end_ns") + reach).alias("end_ns"),
        )
        merged = merge_intervals(rows, ["session_id", "f_path", *_IDENTITY, *task], keep_empty=True)
        for c in ("generation", "mount"):
            merged = merged.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
        return merged.select(
            "session_id",
            "f_path",
            "start_ns",
            "end_ns",
            *[F.col(c).alias(f"f_{c}") for c in [*_IDENTITY, *task]],
            *[F.col(c).alias(f"__{c}") for c in base],
        )

    keys = ["session_id", *[f"__{c}" for c in base]]
    near = interval_join(
        unions([], REACH_NS), bare, keys, ("start_ns", "end_ns"), ("lo", "hi"), REACH_NS, right_bounded=True
    ).filter(identities_compatible("f_", "n_"))
    during = interval_join(
        unions(["pid", "tid", "operation"], 0),
        bare.withColumn("n_at", F.col("n_ts")),
        keys,
        ("start_ns", "end_ns"),
        ("n_ts", "n_at"),
        CELL_NS,
        right_bounded=True,
    ).filter(
        identities_compatible("f_", "n_")
        & F.col("n_at").between(F.col("lo") - REACH_NS, F.col("hi") + REACH_NS)
        & ((F.col("n_pid") == 0) | (F.col("n_pid") == F.col("f_pid")))
        & ((F.col("n_tid") == 0) | (F.col("n_tid") == F.col("f_tid")))
        & (F.col("n_operation").isNull() | (F.col("n_operation") == F.col("f_operation")))
    )
    seen = near.select(*KEY, "node_id", "f_path", F.lit(False).alias("now")).unionByName(
        during.select(*KEY, "node_id", "f_path", F.lit(True).alias("now"))
    )
    in_time = F.when(F.col("now"), F.col("f_path"))
    picked = seen.groupBy(*KEY, "node_id").agg(
        F.min(in_time).alias("d_lo"), F.max(in_time).alias("d_hi"), F.min("f_path").alias("a_lo"), F.max("f_path").alias("a_hi")
    )
    path = F.when(F.col("d_lo").isNotNull(), F.when(F.col("d_lo") == F.col("d_hi"), F.col("d_lo"))).when(
        F.col("a_lo") == F.col("a_hi"), F.col("a_lo")
    )
    return picked.select(*KEY, "node_id", path.alias("inferred_path")).filter(F.col("inferred_path").isNotNull())


def _no_file(df: DataFrame) -> DataFrame:
    for c in _IDENTITY:
        df = df.withColumn(c, F.lit(None).cast("long"))
    return df.withColumn("path", F.lit(None).cast("string"))


# Recorded rows come after all derived ones in the order of admission.
RECORDED = 10_000


def build_graphs(
    requests: DataFrame, spans: DataFrame, origins: DataFrame, files: DataFrame, recorded: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every request in one pass.

    ``requests`` carries ``evidence_from``; ``spans`` comes from :func:`request_spans`
    and ``origins`` from :func:`origin_nodes`.  What is written is dealt by request, and the
    plans keep it so: with requests and spans dealt alike, no span, node or edge is shuffled again.
    ``recorded`` are stored nodes and edges
    (``recording.graph_nodes`` and ``graph_edges``): nodes join the request of their
    transaction whose evidence window holds their start, edges the graphs that have
    both of their ends, and an edge that would close a cycle is refused.
    """
    base = requests.select(*KEY, "request_id", "operation", "bytes", "pid", "tid", "insert_ts", "issue_ts", "complete_ts")
    request_node = synthetic_id(NODE_REQUEST, "request_id")
    queue_node = synthetic_id(NODE_QUEUE, "request_id")
    columns = [*KEY, "node_id", "kind", "start_ns", "end_ns", "operation", "bytes", "pid", "tid", "name", "ord", "path", *_IDENTITY]

    def node(df: DataFrame, node_id: Column, kind, start: str, end: Column | str, name: Column, order: int) -> DataFrame:
        kind_col = kind if isinstance(kind, Column) else F.lit(kind)
        end_col = end if isinstance(end, Column) else F.col(end)
        out = df.select(
            *KEY,
            node_id.alias("node_id"),
            kind_col.alias("kind"),
            F.col(start).alias("start_ns"),
            end_col.alias("end_ns"),
            "operation",
            "bytes",
            "pid",
            "tid",
            name.alias("name"),
            F.lit(order).alias("ord"),
            *([c for c in ("path", *_IDENTITY, "arrival") if c in df.columns]),
        )
        return out if "path" in df.columns else _no_file(out)

    req_nodes = node(base, request_node, "block_request", "issue_ts", "complete_ts", F.lit("block request"), 0)
    queued = base.filter(F.col("insert_ts").isNotNull())
    queue_nodes = node(queued, queue_node, "block_queue", "insert_ts", "issue_ts", F.lit("block queue"), 1)

    exact_origins = origins.filter((F.col("confidence") == "exact") & F.col("inode").isNotNull())
    # The evidence joins feed nodes, edges and edge checks, so each is written once.
    file_hits = stage_dealt(
        unique_file_candidate(file_candidates(requests, files), exact_origins).select(
            *KEY, "r_id", "start_ns", "end_ns", "operation", F.col("requested_bytes").alias("bytes"), "pid", "tid", "fd", "path", *_IDENTITY, "relation", "confidence"
        ),
        "file-hits", KEY)
    file_nodes = node(
        file_hits,
        synthetic_id(NODE_FILE, "r_id"),
        "file_operation",
        "start_ns",
        "end_ns",
        F.coalesce("path", F.concat(F.lit("fd "), F.col("fd").cast("string"))),
        2,
    )

    own = base.select(*KEY, "request_id", F.col("insert_ts").isNotNull().alias("has_queue"))
    w = Window.partitionBy(*KEY).orderBy("layer_rank", "start_ns", "stop_ns", "ord")
    stack = (
        spans.drop("request_id")
        .filter(~F.col("layer").isin("block_queue", "block_device"))
        .withColumn("layer_rank", layer_rank(F.col("layer")))
        .withColumn("index", F.row_number().over(w) - 1)
        .join(own, KEY)
    )
    stack = stack.withColumn("node_id", synthetic_id(span_tag(NODE_SPAN_BASE, F.col("index"), 254), "request_id"))
    span_nodes = node(
        stack, F.col("node_id"), node_kind(F.col("layer")), "start_ns", F.when(F.col("duration_observed"), F.col("stop_ns")), F.col("name"), 3
    )

    enriched = origins.join(inferred_paths(origins, files), [*KEY, "node_id"], "left").withColumn(
        "is_inferred", F.col("inferred_path").isNotNull()
    )
    enriched = stage_dealt(enriched.withColumn("path", F.coalesce("path", "inferred_path")), "origins", KEY)
    origin_rows = node(enriched, F.col("node_id"), "bio", "ts_ns", "ts_ns", F.col("match_type"), 4)

    stored_parts = []
    if recorded is not None:
        stored = stage_dealt(_recorded_nodes(requests, recorded[0], files), "recorded-nodes", KEY)
        rows = node(stored, F.col("node_id"), F.col("kind"), "start_ns", "end_ns", F.col("name"), RECORDED)
        stored_parts = [rows.withColumn("ord", F.col("arrival") + RECORDED).drop("arrival")]

    parts = [p.select(*columns) for p in (req_nodes, queue_nodes, file_nodes, span_nodes, origin_rows, *stored_parts)]
    nodes = stage_dealt(valid_nodes(union_dealt(parts, KEY)), "nodes", KEY, placed=True)

    def edge(df, edge_id, from_id, to_id, relation, confidence, order, inferred=None, incomplete=None) -> DataFrame:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return df.select(
            *KEY,
            edge_id.alias("edge_id"),
            as_col(from_id).alias("from_id"),
            as_col(to_id).alias("to_id"),
            as_col(relation).alias("relation"),
            as_col(confidence).alias("confidence"),
            as_col(order).cast("int").alias("ord"),
            as_col(inferred if inferred is not None else False).alias("inferred_path"),
            as_col(incomplete if incomplete is not None else False).alias("incomplete"),
        )

    queue_edges = edge(queued, synthetic_id(EDGE_QUEUE, "request_id"), queue_node, request_node, "dispatches", "exact", 0)
    file_edges = edge(
        file_hits,
        synthetic_id(EDGE_FILE, "r_id"),
        synthetic_id(NODE_FILE, "r_id"),
        synthetic_id(NODE_REQUEST, "r_id"),
        F.col("relation"),
        F.col("confidence"),
        1,
    )
    # Only spans whose node was admitted take part in the chain.
    present = stack.join(nodes.select(*KEY, "node_id"), [*KEY, "node_id"], "left_semi")
    bio_rank = list(LAYERS).index("bio")
    halves = present.withColumn("upper", F.col("layer_rank") <= bio_rank)
    chain = Window.partitionBy(*KEY, "upper").orderBy("index")
    halves = halves.withColumn("prior", F.lag("node_id").over(chain)).withColumn("next", F.lead("node_id").over(chain))
    weak = F.col("confidence") == "context_only"

    def step(when: Column, edge_id: Column, from_id: Column, to_id: Column, relation: Column, order: Column) -> Column:
        row = (edge_id.alias("step_id"), from_id.alias("from_id"), to_id.alias("to_id"), relation.alias("relation"), order.alias("order"))
        return F.when(when, F.struct(*row))

    into_block, out_of_block = F.col("upper") & F.col("next").isNull(), ~F.col("upper") & F.col("prior").isNull()
    into = F.when(F.col("has_queue"), queue_node).otherwise(request_node)
    named = [F.when(weak, "context_for").otherwise(x) for x in ("calls", "dispatches")]
    chain_id = synthetic_id(span_tag(EDGE_SPAN_BASE, F.col("index"), EDGE_UPPER - 1), "request_id")
    steps = F.array(
        step(F.col("prior").isNotNull(), chain_id, F.col("prior"), F.col("node_id"), named[0], F.lit(2) + F.col("index")),
        step(into_block, synthetic_id(EDGE_UPPER, "request_id"), F.col("node_id"), into, F.lit("submits"), F.lit(1000)),
        step(out_of_block, synthetic_id(EDGE_LOWER, "request_id"), request_node, F.col("node_id"), named[1], F.lit(1001)),
    )
    linked = halves.select(*KEY, "confidence", F.explode(F.array_compact(steps)).alias("step")).select(*KEY, "confidence", "step.*")
    span_edges = edge(linked, F.col("step_id"), F.col("from_id"), F.col("to_id"), F.col("relation"), F.col("confidence"), F.col("order"))
    origin_edges = edge(
        enriched,
        F.col("edge_id"),
        F.col("node_id"),
        synthetic_id(NODE_REQUEST, "r_id"),
        "merged_into",
        F.col("confidence"),
        1002,
        F.col("is_inferred"),
        F.col("match_type") == "direct_request_incomplete",
    )
    links = [queue_edges, file_edges, span_edges, origin_edges]
    if recorded is None:
        return nodes, stage_dealt(valid_edges(union_dealt(links, KEY), nodes), "edges", KEY, placed=True)
    kept = _recorded_edges(base, nodes, stored, recorded[1])
    links.append(kept.select(*links[0].columns))
    edges = stage_dealt(valid_edges(union_dealt(links, KEY), nodes), "edges-valid", KEY, placed=True)
    touched = kept.select(*KEY).distinct()
    rest = [edges.join(touched, KEY, "left_anti"), without_cycles(edges.join(touched, KEY, "left_semi"))]
    return nodes, stage_dealt(union_dealt(rest, KEY), "edges", KEY, placed=True)


def _recorded_nodes(requests: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Stored nodes under the request they belong to, pathless ones with the path looked up from syscalls."""
    owned = lifetime_at(nodes.withColumnRenamed("seq", "arrival"), requests, "transaction_id", "start_ns")
    owned = stage(owned.withColumn("ts_ns", F.col("start_ns")), "recorded-owned")
    owned = owned.join(inferred_paths(owned, files), [*KEY, "node_id"], "left").withColumn("is_inferred", F.col("inferred_path").isNotNull())
    return owned.withColumn("path", F.coalesce("path", "inferred_path"))


def _recorded_edges(base: DataFrame, nodes: DataFrame, stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored edges under every request of their transaction that can have both ends.

    An end that is a stored node names the request; only an edge between two derived
    nodes belongs to all requests of the id.
    """
    ids = base.select(*KEY, F.col("request_id").alias("transaction_id"))
    held = nodes.select(*KEY, "node_id", "ord").join(ids, KEY)
    given = edges.filter(F.col("transaction_id").isNotNull()).withColumnRenamed("seq", "arrival")
    on = ["session_id", "transaction_id"]
    found = None
    for end in ("from_id", "to_id"):
        rows = held.filter(F.col("ord") >= RECORDED).select(*on, "seq", F.col("node_id").alias(end))
        part = given.join(rows, [*on, end])
        found = part if found is None else found.unionByName(part)
    derived = held.filter(F.col("ord") < RECORDED).select(*on, "node_id").distinct()
    between = given
    for end in ("from_id", "to_id"):
        between = between.join(derived.withColumnRenamed("node_id", end), [*on, end], "left_semi")
    found = found.unionByName(between.join(ids, on)).distinct()
    guessed = stored.filter("is_inferred").select(*KEY, F.col("node_id").alias("from_id"), F.lit(True).alias("guessed")).distinct()
    return stage_dealt(
        found.join(guessed, [*KEY, "from_id"], "left")
        .withColumn("ord", F.col("arrival") + RECORDED)
        .withColumn("inferred_path", F.col("inferred_path") | F.coalesce("guessed", F.lit(False))),
        "recorded-edges",
        KEY,
    )


def related_files(requests: DataFrame, nodes: DataFrame, file_origins: DataFrame, files: DataFrame) -> DataFrame:
    """Syscalls related to a cohort: its own file operations, or the same file within 30 s of a request."""
    f = files.withColumnRenamed("seq", "file_seq")
    direct = nodes.filter(F.col("kind") == "file_operation").select("session_id", "start_ns", "end_ns", "pid", "tid").distinct()
    linked = f.join(direct, ["session_id", "start_ns", "end_ns", "pid", "tid"], "left_semi").select("session_id", "file_seq")
    span = requests.select(
        *KEY,
        (F.coalesce("insert_ts", "issue_ts") - REACH_NS).alias("start_ns"),
        (F.col("complete_ts") + REACH_NS).alias("end_ns"),
    )
    keys = ["session_id", *_IDENTITY]
    # Unknown generation and mount are kept apart from known ones by a marker value.
    filled = file_origins.join(span, KEY).fillna(-1, ["generation", "mount"])
    merged = merge_intervals(filled, keys).select(
        "session_id", *[F.col(c).alias(f"n_{c}") for c in _IDENTITY], F.col("start_ns").alias("lo"), F.col("end_ns").alias("hi")
    )
    for c in ("generation", "mount"):
        merged = merged.withColumn(f"n_{c}", F.when(F.col(f"n_{c}") >= 0, F.col(f"n_{c}")))
    base = ["fs_major", "fs_minor", "inode"]
    left = f.filter(F.col("inode").isNotNull()).select(
        "session_id", "file_seq", "start_ns", "end_ns", *[F.col(c).alias(f"f_{c}") for c in _IDENTITY], *[F.col(c).alias(f"__{c}") for c in base]
    )
    right = merged
    for c in base:
        right = right.withColumn(f"__{c}", F.col(f"n_{c}"))
    near = interval_join(left, right, ["session_id", *[f"__{c}" for c in base]], ("start_ns", "end_ns"), ("lo", "hi"), REACH_NS)
    by_file = near.filter(identities_compatible("f_", "n_")).select("session_id", "file_seq")
    return linked.unionByName(by_file).distinct()


def deleted_path() -> Column:
    return path_deleted("path")
