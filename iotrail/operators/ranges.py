"""Issue/completion matching of decoded traces that carry no request id.

Requests are recognised by device, direction and sector range.  A completion
takes its issue only when exactly one pending range overlaps it and nothing made
that range doubtful; every other completion stays unresolved with a reason.

Only ranges that overlap can influence each other, so the events are split into
connected sector ranges first.  A range with very many events is also cut in
time: every piece is folded from an assumed start state, and pieces whose start
turns out different from their predecessor's end are folded again until all
agree, which gives the result of one ordered fold without running one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalars import operation_of_rwbs
from iotrail.operators.intervals import locate, merge_intervals
from iotrail.operators.ordered import BUCKET, carry_last, in_blocks, row_numbers, running
from iotrail.session import stage

STREAM = ["device_encoded", "op"]
GROUP = [*STREAM, "component"]


def load_events(raw: DataFrame) -> DataFrame:
    """Decoded block events with bytes filled from sectors and the direction letter."""
    return raw.withColumn("bytes", F.coalesce("bytes", F.col("sectors") * 512)).withColumn("op", F.substring("rwbs", 1, 1))


def _components(events: DataFrame) -> DataFrame:
    """Attach the start of the connected sector range each event falls in."""
    spans = events.select(*STREAM, F.col("sector").alias("start_ns"), (F.col("sector") + F.greatest("sectors", F.lit(1))).alias("end_ns"))
    # Half-open ranges that merely touch do not overlap, hence the gap of -1.
    unions = stage(merge_intervals(spans, STREAM, gap_ns=-1), "range-unions")
    shifted = unions.select(*STREAM, (F.col("start_ns") - 1).alias("start_ns"), (F.col("end_ns") - 1).alias("end_ns"))
    placed = locate(events, shifted, STREAM, "sector")
    return placed.withColumn("component", F.col("interval_start_ns") + 1).drop("interval_start_ns", "interval_end_ns")


_OUT = (
    "device_encoded long, op string, component long, piece long, record_id long, role string, candidates long, only_issue long, "
    "usable boolean, closes boolean, insert_record long, sector long, sectors long, doubtful boolean, ord long"
)
_NAMES = [c.split(" ")[0] for c in _OUT.split(", ")]


class _Pending:
    """Pending ranges of one kind, one entry [count, record, doubtful, insert] per distinct range.

    Two pending ranges that overlap can never be told apart again, so repeats of a
    range need a count only and the state stays as small as the set of ranges.
    """

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.by_start: dict[int, dict[int, list]] = {}
        self.longest = 0

    def hits(self, sector: int, sectors: int) -> list:
        found = []
        i = bisect_left(self.starts, sector - self.longest)
        stop = sector + max(sectors, 1)
        while i < len(self.starts) and self.starts[i] < stop:
            start = self.starts[i]
            for n, entry in self.by_start[start].items():
                if start == sector if (n == 0 or sectors == 0) else start + n > sector:
                    found.append((start, n, entry))
            i += 1
        return found

    def add(self, sector: int, sectors: int, entry: list) -> None:
        same = self.by_start.get(sector)
        if same is None:
            same = self.by_start[sector] = {}
            insort(self.starts, sector)
        self.longest = max(self.longest, sectors)
        if sectors in same:
            same[sectors][0] += entry[0]
            same[sectors][2] = True
        else:
            same[sectors] = entry

    def drop(self, sector: int, sectors: int) -> None:
        del self.by_start[sector][sectors]
        if not self.by_start[sector]:
            del self.by_start[sector]
            self.starts.pop(bisect_left(self.starts, sector))

    def rows(self):
        for start in self.starts:
            for n, entry in self.by_start[start].items():
                yield start, n, entry


def _only(hits: list, e) -> tuple[int, bool]:
    """Number of overlapping pending requests, and whether it is one with the very range of the event."""
    count = sum(h[2][0] for h in hits)
    return count, count == 1 and hits[0][0] == e.sector and hits[0][1] == e.sectors


def _step(issues: _Pending, inserts: _Pending, e):
    """Apply one event; returns the result row of completions, stray requeues and queued issues."""
    if e.kind == "insert":
        inserts.add(e.sector, e.sectors, [1, e.record_id, False, None])
        return None
    hits = issues.hits(e.sector, e.sectors)
    if e.kind == "complete":
        count, same = _only(hits, e)
        entry = hits[0][2] if count == 1 else None
        usable = same and not entry[2]
        if same:
            issues.drop(e.sector, e.sectors)
        else:
            for h in hits:
                h[2][2] = True
        return (e.record_id, "completion", count, entry[1] if entry else None, usable, same, entry[3] if usable else None)
    for h in hits:
        h[2][2] = True
    if e.kind == "requeue":
        return None if hits else (e.record_id, "unpaired_requeue", 0, None, False, False, None)
    queued = inserts.hits(e.sector, e.sectors)
    insert = None
    if _only(queued, e)[1]:
        insert = queued[0][2][1]
        inserts.drop(e.sector, e.sectors)
    issues.add(e.sector, e.sectors, [1, e.record_id, bool(hits), insert])
    return (e.record_id, "queued", 0, None, False, False, insert) if insert is not None else None


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered fold over (group, span); leading rows of a span are its start state, its pieces follow one after another."""
    current, key, issues, inserts = None, None, _Pending(), _Pending()

    def closing():
        for kind, pending in (("issue", issues), ("insert", inserts)):
            for start, n, (count, record, doubtful, insert) in pending.rows():
                yield (*key, record, f"left_{kind}", count, None, False, False, insert, start, n, doubtful)

    for batch in batches:
        rows: list[tuple] = []
        for e in batch.itertuples(index=False):
            group = (e.device_encoded, e.op, e.component)
            if (*group, e.span) != current:
                if current is not None:
                    rows += closing()
                current, issues, inserts = (*group, e.span), _Pending(), _Pending()
            key = (*group, e.piece)
            if e.kind.startswith("left_"):
                insert = None if pd.isna(e.insert_record) else int(e.insert_record)
                target = issues if e.kind == "left_issue" else inserts
                target.add(e.sector, e.sectors, [int(e.n), e.record_id, bool(e.doubtful), insert])
            else:
                result = _step(issues, inserts, e)
                if result:
                    rows.append((*key, *result, 0, 0, False))
        yield _frame(rows)
    if current is not None:
        yield _frame(list(closing()))


def _frame(rows: list) -> pd.DataFrame:
    df = pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=_NAMES)
    return df.astype({"insert_record": "Int64", "only_issue": "Int64"})


def fold_ranges(events: DataFrame, piece_rows: int = 1 << 20, span_rows: int = 1 << 20) -> DataFrame:
    """Outcome of every completion plus what is left pending, per connected range.

    ``role`` is completion, queued (an issue that consumed an insert),
    unpaired_requeue, left_issue or left_insert.  All pieces are folded side by side
    first.  What is pending at a border reaches every later piece, so neighbours are
    folded again in spans of about ``span_rows`` rows, one piece after the other in one
    task: rounds grow with the spans of a range, not with its pieces.
    """
    placed = stage(_components(events.select(*STREAM, "record_id", "timestamp_ns", "kind", "sector", "sectors")), "range-placed")
    numbered = row_numbers(
        placed, GROUP, ["timestamp_ns", "record_id"], "rn", bucket=F.expr("timestamp_ns div 60000000000")
    ).drop(BUCKET)
    per_span = max(span_rows // piece_rows, 1)
    span = F.expr(f"piece div {per_span}")
    pieces = stage(numbered.withColumn("piece", F.expr(f"(rn - 1) div {piece_rows}")), "range-events")
    keys, spans = [*GROUP, "piece"], [*GROUP, "span"]
    blank = [F.lit(None).cast("long").alias("insert_record"), F.lit(False).alias("doubtful"), F.lit(1).cast("long").alias("n")]
    body = pieces.select(*keys, "rn", "record_id", "kind", "sector", "sectors", *blank)

    def run(rows: DataFrame) -> DataFrame:
        return rows.repartition(*spans).sortWithinPartitions(*spans, "piece", "rn").drop("rn").mapInPandas(_fold, _OUT)

    def starts_of(result: DataFrame) -> DataFrame:
        """What each piece hands to the next one; after the first round only spans hand over."""
        ends = result.filter(F.col("role").startswith("left_"))
        starts = ends.join(
            pieces.select(*keys).distinct().withColumn("piece", F.col("piece") - 1), keys, "left_semi"
        ).withColumn("piece", F.col("piece") + 1)
        return starts.select(
            *keys, F.lit(-1).cast("long").alias("rn"), "record_id", F.col("role").alias("kind"), "sector", "sectors", "insert_record", "doubtful", F.col("candidates").alias("n")
        )

    result = stage(run(body.withColumn("span", F.col("piece"))), "range-fold")
    first = starts_of(result)
    changed = stage(first.select(*GROUP, span.alias("span")).distinct(), "range-changed")
    whole = body.withColumn("span", span)
    assumed = None
    while not changed.isEmpty():
        starts = stage(starts_of(result).filter(F.col("piece") % per_span == 0).withColumn("span", span), "range-starts")
        if assumed is not None:
            changed = stage(
                starts.exceptAll(assumed).unionByName(assumed.exceptAll(starts)).select(*spans).distinct(), "range-changed"
            )
            if changed.isEmpty():
                break
        redo = whole.unionByName(starts).join(changed, spans, "left_semi")
        kept = result.withColumn("span", span).join(changed, spans, "left_anti").drop("span")
        result = stage(kept.unionByName(run(redo)), "range-fold")
        assumed = starts
    return result


def _with_record(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Left join on a record number; rows without one are spread by their own number, as they may be most of the trace."""
    own = F.struct(F.col(key).isNull().alias("free"), F.coalesce(key, "record_id").alias("id"))
    wanted = F.struct(F.lit(False).alias("free"), F.col(key).alias("id"))
    return rows.withColumn("__key", own).join(records.withColumn("__key", wanted).drop(key), "__key", "left").drop("__key")


def match_trace(
    events: DataFrame, lossy: bool = False, piece_rows: int = 1 << 20, folded: DataFrame | None = None
) -> DataFrame:
    """One row per completion with its latency when the match is beyond doubt, else the reason.

    ``lossy`` marks a trace whose counters report loss: nothing is timed then.
    """
    folded = (folded if folded is not None else fold_ranges(events, piece_rows)).filter("role = 'completion'")
    done = events.filter("kind = 'complete'").select(
        "record_id", "timestamp_ns", "device_encoded", "op", "sector", "sectors", "bytes", "rwbs", "error", "clock"
    )
    matched = done.join(
        folded.select("record_id", "candidates", "usable", "insert_record", F.col("only_issue").alias("issue_record")), "record_id"
    )
    issue = events.filter("kind = 'issue'").select(
        F.col("record_id").alias("issue_record"),
        F.col("timestamp_ns").alias("i_ts"),
        F.col("clock").alias("i_clock"),
        F.col("tid").alias("i_tid"),
        F.col("comm").alias("i_comm"),
        F.col("cpu").alias("i_cpu"),
    )
    insert = events.filter("kind = 'insert'").select(
        F.col("record_id").alias("insert_record"), F.col("timestamp_ns").alias("q_ts"), F.col("clock").alias("q_clock")
    )
    full = _with_record(_with_record(matched, issue, "issue_record"), insert, "insert_record")
    # Reason of each outcome, first one that applies.
    reason = (
        F.when(F.col("candidates") == 0, "no issue candidate")
        .when(F.col("candidates") > 1, "multiple issue candidates")
        .when(~F.col("usable"), "overlapping, repeated, partial or requeued")
        .when(F.lit(lossy), "trace loss")
        .when((F.col("clock") != 0) | (F.col("i_clock") != 0), "unsupported clock")
        .when(F.col("timestamp_ns") <= F.col("i_ts"), "equal or reversed time")
        .otherwise("unique match")
    )
    ok = F.col("reason") == "unique match"
    queue = F.when((F.col("q_clock") == 0) & (F.col("q_ts") < F.col("i_ts")), F.col("i_ts") - F.col("q_ts"))
    return full.withColumn("reason", reason).select(
        "record_id",
        "timestamp_ns",
        "device_encoded",
        "op",
        "sector",
        "sectors",
        "bytes",
        "rwbs",
        "error",
        "clock",
        "candidates",
        "reason",
        F.when(ok, F.col("issue_record")).alias("issue_record"),
        F.when(ok, F.col("i_ts")).alias("issue_ts"),
        F.when(ok, F.col("i_tid")).alias("issuer_tid"),
        F.when(ok, F.col("i_comm")).alias("issuer_comm"),
        F.when(ok, F.col("i_cpu")).alias("issuer_cpu"),
        F.when(ok, F.col("timestamp_ns") - F.col("i_ts")).alias("device_ns"),
        F.when(ok, queue).alias("queue_ns"),
        F.when(ok, "probable").otherwise("unresolved").alias("timing_confidence"),
    )


def leftovers(events: DataFrame, folded: DataFrame) -> DataFrame:
    """Issues never completed, inserts never issued and stray requeues, with their records."""
    done = folded.filter("role = 'completion' and closes").select(F.col("only_issue").alias("record_id"))
    used = folded.filter("role = 'queued'").select(F.col("insert_record").alias("record_id"))
    stray = folded.filter("role = 'unpaired_requeue'").select("record_id")
    rows = events.select("record_id", "device_encoded", "kind")
    return (
        rows.filter("kind = 'issue'")
        .join(done, "record_id", "left_anti")
        .unionByName(rows.filter("kind = 'insert'").join(used, "record_id", "left_anti"))
        .unionByName(rows.filter("kind = 'requeue'").join(stray, "record_id", "left_semi"))
    )


def trace_coverage(matches: DataFrame, left: DataFrame) -> DataFrame:
    """Per device: completions, unresolved ones, issues never completed and stray requeues."""
    done = matches.groupBy("device_encoded").agg(
        F.count(F.lit(1)).alias("completions"), F.count_if(F.col("timing_confidence") == "unresolved").alias("unresolved")
    )
    rest = left.groupBy("device_encoded").agg(
        F.count_if(F.col("kind") == "issue").alias("unmatched_issues"),
        F.count_if(F.col("kind") == "insert").alias("orphan_inserts"),
        F.count_if(F.col("kind") == "requeue").alias("unpaired_requeues"),
    )
    return done.join(rest, "device_encoded", "full").fillna(0)


def trace_timing(events: DataFrame) -> DataFrame:
    """Access pattern and gaps per device from events on the supported clock, in time order."""
    usable = events.filter("clock = 0")
    order, keys = ["timestamp_ns", "record_id"], ["device_encoded", "kind"]
    blocks = stage(in_blocks(usable.filter("kind in ('issue', 'complete')").select(*keys, *order), keys, order), "gap-blocks")
    gaps = carry_last(blocks, keys, order, {"prev_ts": F.col("timestamp_ns")}).drop(BUCKET)
    return gaps.select("record_id", "kind", "device_encoded", (F.col("timestamp_ns") - F.col("prev_ts")).alias("gap_ns"))


def trace_access(events: DataFrame) -> DataFrame:
    issues = events.filter("kind = 'issue' and clock = 0").withColumn("operation", operation_of_rwbs("rwbs"))
    order, keys = ["timestamp_ns", "record_id"], ["device_encoded", "operation"]
    blocks = stage(in_blocks(issues.select(*keys, *order, "sector", "sectors"), keys, order), "access-blocks")
    seen = carry_last(blocks, keys, order, {"prev_end": F.col("sector") + F.col("sectors")}).drop(BUCKET)
    label: Column = (
        F.when(F.col("prev_end").isNull(), "unknown").when(F.col("prev_end") == F.col("sector"), "sequential").otherwise("random")
    )
    return seen.select("record_id", "operation", label.alias("access_pattern"))


def trace_depth(matches: DataFrame) -> DataFrame:
    """In-flight depth at each uniquely paired issue: started so far minus ended at or before the start."""
    paired = matches.filter("clock = 0 and issue_ts is not null and issue_ts < timestamp_ns")
    spans = paired.groupBy("device_encoded", "issue_record").agg(F.min("issue_ts").alias("start_ts"), F.max("timestamp_ns").alias("end_ts"))
    steps = spans.select(
        "device_encoded",
        F.explode(
            F.array(
                F.struct(F.col("start_ts").alias("t"), F.lit(1).alias("phase"), F.lit(1).alias("d"), F.col("issue_record").alias("rec")),
                F.struct(F.col("end_ts").alias("t"), F.lit(0).alias("phase"), F.lit(-1).alias("d"), F.col("issue_record").alias("rec")),
            )
        ).alias("s"),
    ).select("device_encoded", "s.*")
    order = ["t", "phase", "rec"]
    blocks = stage(in_blocks(steps, ["device_encoded"], order), "depth-blocks")
    swept = running(blocks, ["device_encoded"], order, sums={"depth": F.col("d")})
    return swept.filter("phase = 1").select("device_encoded", F.col("rec").alias("issue_record"), F.col("depth").alias("issue_depth"))


def issuer_process(queries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest process snapshot of the thread at or before the issue.

    Undated snapshots never count, a process that started later is refused, and
    contradicting snapshots of the same instant leave the process unknown.
    ``queries`` has ``record_id, tid, ts``.
    """
    dated = snapshots.filter("snapshot_ns is not null").withColumn("tid", F.coalesce("tid", "pid"))
    content = F.struct("pid", "name", "start_ns")
    moments = dated.groupBy("tid", "snapshot_ns").agg(
        F.min(content).alias("lo"), F.max(content).alias("hi"), F.count_if(F.col("start_ns").isNull()).alias("no_start"), F.count(F.lit(1)).alias("n")
    )
    clear = F.col("lo").eqNullSafe(F.col("hi")) & ((F.col("no_start") == 0) | (F.col("no_start") == F.col("n")))
    marks = moments.select(
        "tid", F.col("snapshot_ns").alias("at"), F.lit(0).alias("phase"), F.lit(None).cast("long").alias("record_id"),
        F.struct(clear.alias("clear"), F.col("lo.pid").alias("pid"), F.col("lo.name").alias("name"), F.col("lo.start_ns").alias("start_ns")).alias("snap"),
    )
    asked = queries.filter("tid is not null and ts is not null").select("tid", F.col("ts").alias("at"), F.lit(1).alias("phase"), "record_id")
    seen = carry_last(
        marks.unionByName(asked, allowMissingColumns=True),
        ["tid"],
        ["at", "phase", "record_id"],
        {"latest": F.col("snap")},
        bucket=F.expr("at div 60000000000"),
    )
    fits = F.col("latest.clear") & (F.col("latest.start_ns").isNull() | (F.col("latest.start_ns") <= F.col("at")))
    return seen.filter("phase = 1").select(
        "record_id", F.when(fits, F.col("latest.pid")).alias("pid"), F.when(fits, F.col("latest.name")).alias("process")
    )


def project_requests(matches: DataFrame, access: DataFrame, gaps: DataFrame, depth: DataFrame, processes: DataFrame) -> DataFrame:
    """Trace completions in the shape of completed requests, carrying their evidence.

    The record number stands in for a request id and never joins kernel ids.
    """
    from iotrail.functions.scalars import trace_device

    major, minor = trace_device("device_encoded")
    c_gap = gaps.filter("kind = 'complete'").select("record_id", F.col("gap_ns").alias("completion_gap_ns"))
    i_gap = gaps.filter("kind = 'issue'").select(F.col("record_id").alias("issue_record"), F.col("gap_ns").alias("issue_gap_ns"))
    out = (
        matches.join(c_gap, "record_id", "left")
        .join(i_gap, "issue_record", "left")
        .join(access.select(F.col("record_id").alias("issue_record"), "access_pattern"), "issue_record", "left")
        .join(depth.select("issue_record", "issue_depth"), "issue_record", "left")
        .join(processes, "record_id", "left")
    )
    size = F.when(F.col("bytes") >= 32768, "large").otherwise("small")
    return out.select(
        F.col("record_id").alias("request_id"),
        major.alias("major"),
        minor.alias("minor"),
        operation_of_rwbs("rwbs").alias("operation"),
        "sector",
        "sectors",
        "bytes",
        F.when(F.col("clock") == 0, F.col("timestamp_ns")).alias("complete_ts"),
        "issue_ts",
        F.col("device_ns"),
        "queue_ns",
        (F.col("device_ns") + F.coalesce("queue_ns", F.lit(0))).alias("total_ns"),
        F.coalesce("access_pattern", F.lit("unknown")).alias("access_pattern"),
        size.alias("size_class"),
        "issue_gap_ns",
        "completion_gap_ns",
        "issue_depth",
        "pid",
        "process",
        F.col("issuer_tid").alias("tid"),
        "timing_confidence",
        "reason",
    )


def trace_status(quality: DataFrame) -> DataFrame:
    """Loss status of a trace from its counters; any missing or decreasing counter leaves it unknown.

    ``quality`` has ``cpu_lost`` (map of cpu to [first, last] counters) and ``flags`` (array of problem names).
    """
    deltas = F.transform(F.map_values("cpu_lost"), lambda v: F.when(v[1] >= v[0], v[1] - v[0]))
    lost = F.aggregate(deltas, F.lit(0).cast("long"), lambda a, b: a + b)
    known = F.when(F.size("cpu_lost") > 0, lost)
    status = (
        F.when(known.isNull(), "loss unknown")
        .when(known > 0, "events lost")
        .when(F.size("flags") > 0, F.array_join(F.array_sort("flags"), ", "))
        .otherwise("no reported loss")
    )
    return quality.withColumn("lost_events", known).withColumn("status", status)


def partial_completions(parts: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Completions that finish a request in parts.

    ``parts`` has ``issued_bytes, bytes, error, ts_ns`` per row.  A part larger than
    what remains is refused; the first error sticks; the request is done when nothing
    remains.  One small state per request streams through the sorted partition.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "remaining", "error", "refused", "complete_ts"]
        current, remaining, error, refused, done = None, 0, 0, 0, None
        for batch in batches:
            out = []
            for k, issued, size, err, ts in batch.itertuples(index=False, name=None):
                if k != current:
                    if current is not None:
                        out.append((current, remaining, error, refused, done))
                    current, remaining, error, refused, done = k, issued, 0, 0, None
                if size > remaining:
                    refused += 1
                    continue
                remaining -= size
                error = error or err
                if remaining == 0 and done is None:
                    done = ts
            yield pd.DataFrame(out, columns=names).astype({"complete_ts": "Int64"})
        if current is not None:
            yield pd.DataFrame([(current, remaining, error, refused, done)], columns=names).astype({"complete_ts": "Int64"})

    ordered = parts.repartition(key).sortWithinPartitions(key, order).select(key, "issued_bytes", "bytes", "error", "ts_ns")
    return ordered.mapInPandas(fold, f"{key} long, remaining long, error int, refused int, complete_ts long")
